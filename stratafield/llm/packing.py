"""Best-fit-decreasing packing of token sequences (operator 1).

Every document is tokenized, closed with an end id and cut: first into full
windows, then one rest shorter than a window.  Best-fit decreasing looks at
lengths only, and there are at most ``window`` distinct lengths.  So the exact
global packing is planned on the histogram of lengths: a segment tree indexed
by remaining capacity finds the tightest open windows, and whole runs of equal
pieces are placed into whole runs of equal windows.  The plan has a size that
depends on ``window`` alone, not on the number of documents.

The n-th piece of a length (over the whole corpus) looks up its window in the
plan.  That number comes from counts: each task numbers its own pieces of each
length, and a prefix sum over (length, task) counts gives the task's first
number.  No window function or sort runs over the pieces themselves.

Edge cases: null or empty text is the end id alone; a null doc_id stays null;
repeated rows are packed once per row; an empty table gives no rows; other
columns are ignored.  Every token lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .text_batches import slices, texts
from .word_bpe import encoder, with_end

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk long, nth long"


class CapacityTree:
    """Segment tree over capacities 0..n: how many windows are open at each."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += count
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest capacity >= ``least`` that has an open window."""
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan_best_fit(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns runs (length, first number, pieces per window, first window, offset)
    in ascending order of length and number, and the number of windows.
    """
    tree, groups, runs, windows = CapacityTree(window), defaultdict(list), [], 0

    def put(length: int, number: int, per: int, first: int, n: int, capacity: int) -> None:
        runs.append((length, number, per, first, window - capacity))
        if left := capacity - per * length:
            groups[left].append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        number, total = 0, counts[length]
        while number < total:
            rest, capacity = total - number, tree.tightest(length)
            if capacity is None:
                first, n, capacity = windows, -(-rest // (window // length)), window
                windows += n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -n)
            per = min(capacity // length, rest)
            full = min(n, rest // per)
            put(length, number, per, first, full, capacity)
            number += full * per
            if full < n:
                if capacity == window:  # the last new window holds fewer pieces
                    put(length, number, total - number, first + full, 1, capacity)
                    number = total
                else:
                    groups[capacity].append((first + full, n - full))
                    tree.add(capacity, n - full)
    return sorted(runs), windows


def cut_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Tokenized pieces with their number among the task's pieces of that length."""

    def run(batches):
        seen: dict[int, int] = defaultdict(int)
        chunk = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole):
                ids, offsets = with_end(*encoder(tokenizer).encode(texts(batch)), end_id)
                ids = ids.astype("<u4")
                rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "tokens", "nth", "at")}
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for at in range(a, b, window):
                        n = min(window, b - at)
                        for key, value in zip(rows, (row, at - a, n, zlib.crc32(ids[at : at + n]), b - a, seen[n], at), strict=True):
                            rows[key].append(value)
                        seen[n] += 1
                out = [batch.column("doc_id").cast(pa.int64()).take(pa.array(rows["row"], pa.int64()))]
                out += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "tokens")]
                out += [pa.array(np.full(len(rows["row"]), chunk)), pa.array(rows["nth"], pa.int64())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array([*rows["at"], len(ids)], pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.split(", ")])

    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves with ``keep_ids``."""
    pieces = materialize(cut_pieces(docs, tokenizer, window, end_id, keep_ids), "pieces")
    counted = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    runs, _ = plan_best_fit(histogram, window)
    table = np.array(runs, np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, ["chunk", "length"]).withColumn("number", F.col("first") + F.col("nth"))
    return place(numbered, table, keep_ids)


def place(numbered: DataFrame, table: np.ndarray, keep_ids: bool) -> DataFrame:
    keys = (table[:, 0] << 48) + table[:, 1]  # lengths below 2**15, numbers below 2**48
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = table[np.searchsorted(keys, (length << 48) + number, side="right") - 1].reshape(-1, 5)
            step = number - at[:, 1]
            new = {"sequence_id": at[:, 3] + step // at[:, 2], "offset": at[:, 4] + step % at[:, 2] * length}
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch.column(c) for c in out], out)

    kinds = {"ids": "array<int>"}
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", *["ids"] * keep_ids).mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in out))


def packed_sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Token arrays of pieces that were packed with ``keep_ids``: one row per
    sequence (sequence_id, n_tokens, ids).  A sequence is padded to ``window``
    unless its length is a power of two.  A group is one window at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    fill = F.when(F.bit_count(n) == 1, 0).otherwise(window - n)
    return rows.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad_id), fill)).alias("ids"))
