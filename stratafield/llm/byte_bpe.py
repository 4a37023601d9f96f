"""Byte-level BPE over a global shuffle of distinct words (operator 7).

1. *Blocks.*  A run of documents of bounded size becomes one row: its
   pre-tokens (matches of the split pattern) by position, written as numbers
   into the block's own list of distinct words.
2. *Words.*  Every block sends each of its distinct words once, gathered by a
   hash bucket (their number follows the bytes sent); a bucket encodes each
   distinct word of the corpus once and answers every block in the block's order.  A word in all documents is thus
   one entry per block, never one per occurrence.
3. *Reassembly.*  A block meets the answers and puts the ids back by position.
   The blocks are a table bucketed by block, so only the answers move.
4. *Decoding* joins ids with the table of token bytes.

Edge cases: null or empty text has no ids and decodes to nothing; null or
repeated doc_ids are kept row by row; an empty table gives no rows; other
columns are ignored.  No text or word is cut or left out.
"""

from __future__ import annotations

import base64
import functools
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import materialize_bucketed, partitions
from .text_batches import gather, give_back, repeat_ranges, slices, texts

BLOCK_BYTES = 12 << 20
#: Compressed words that a bucket gets, on average and at most.
BUCKET_BYTES = 8 << 20
#: A space between white space, or between white space and the end.
INNER_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}] ([\t-\r\x1c-\x1f\x{85}\p{Z}]|\z)"
#: Ids handled at once while decoding.
DECODE_IDS = 400_000


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def squeeze_words(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([words], ["w"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unsqueeze_words(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def pre_tokens(column: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of all texts by position, their count per text, the words.

    A space that has no white space before it or none after it always begins a
    pre-token, so texts are cut there first and the pattern runs once per
    distinct chunk.  Texts with another kind of space (or a NUL, used as the cut
    mark) go through the pattern whole.
    """
    find, number = regex.compile(pattern).findall, {}

    def numbers(text: str) -> list[int]:
        return [number.setdefault(w, len(number)) for w in find(text)]

    words_of, lengths = array("i"), array("i")

    odd = pc.or_(pc.match_substring_regex(column, INNER_SPACE), pc.match_substring(column, "\0")).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", column), " ", "\0 "), "\0")
    coded = parts.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
    del parts
    for begin in range(0, len(coded.dictionary), 20_000):
        for chunk in coded.dictionary.slice(begin, 20_000).to_pylist():
            found = numbers(chunk)
            words_of.extend(found)
            lengths.append(len(found))
    offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    flat, per_chunk = gather(np.array(words_of, np.int32), offsets, coded.indices.to_numpy())
    del coded
    at = np.concatenate([[0], np.cumsum(per_chunk)])[bounds]
    counts = np.diff(at)
    if odd.any():
        whole = {i: np.array(numbers(column[i].as_py()), np.int32) for i in np.flatnonzero(odd).tolist()}
        flat = np.concatenate([whole.get(i, flat[at[i] : at[i + 1]]) for i in range(len(counts))])
        for i, ids in whole.items():
            counts[i] = len(ids)
    return flat, counts, list(number)


def build_blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """block, doc_ids, counts, positions (word numbers, most frequent first), words."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for some in slices(whole, most=BLOCK_BYTES):
                flat, counts, words = pre_tokens(texts(some), pattern)
                order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.uint32)
                rank[order] = np.arange(len(words), dtype=np.uint32)
                ranked = pa.array(words, pa.string()).take(pa.array(order))
                yield pa.RecordBatch.from_pydict({"block": [block], "doc_ids": pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())), "counts": [squeeze(counts)], "positions": [squeeze(rank[flat])], "words": [squeeze_words(ranked)]})
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, doc_ids array<long>, counts binary, positions binary, words binary")


def send_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, places (numbers of the words in the block), words."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                words = unsqueeze_words(data.as_buffer())
                if not len(words):
                    continue
                bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = {"block": [], "bucket": [], "places": [], "words": []}
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                    mine = order[a:b]
                    for key, value in zip(rows, (block, int(bucket[mine[0]]), squeeze(np.diff(mine, prepend=0)), squeeze_words(words.take(pa.array(mine)))), strict=True):
                        rows[key].append(value)
                yield pa.RecordBatch.from_pydict(rows)

    return blocks.select("block", "words").mapInArrow(run, "block long, bucket long, places binary, words binary")


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def load_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def encode_words(sent: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each distinct word of a bucket is encoded once; every block's words are
    answered in the order in which the block sent them."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        lists = [unsqueeze_words(x.as_buffer()) for x in table.column("words")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        encode = load_encoding(path, pattern).encode_ordinary
        ids = [encode(w) for w in coded.dictionary.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(offsets[-1]))
        at, out = 0, {"lengths": [], "ids": []}
        for words in lists:
            got, lengths = gather(flat, offsets, coded.indices.to_numpy()[at : at + len(words)])
            at += len(words)
            out["lengths"].append(squeeze(lengths))
            out["ids"].append(squeeze(got))
        return pa.table({"block": table.column("block"), "places": table.column("places"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    return sent.groupBy("bucket").applyInArrow(run, "block long, places binary, lengths binary, ids binary")


def reassemble(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(mine: pa.Table, answered: pa.Table) -> pa.Table:
        give_back()
        parts = [(np.cumsum(unsqueeze(p.as_buffer())), unsqueeze(n.as_buffer()).astype(np.int64), unsqueeze(i.as_buffer())) for p, n, i in zip(*(answered.column(c) for c in ("places", "lengths", "ids")), strict=True)]
        lengths = np.zeros(sum(len(p[0]) for p in parts), np.int64)
        for places, n, _ in parts:
            lengths[places] = n
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.zeros(int(offsets[-1]), "<u4")
        for places, n, ids in parts:
            flat[repeat_ranges(offsets[places], n)] = ids
        counts = unsqueeze(mine.column("counts")[0].as_buffer()).astype(np.int64)
        ids, per_word = gather(flat, offsets, unsqueeze(mine.column("positions")[0].as_buffer()).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])]
        data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at * 4), pa.py_buffer(ids)])
        return pa.table({"doc_id": mine.column("doc_ids")[0].values, "n_tokens": np.diff(at), "ids": data.cast(pa.binary())})

    return blocks.select("block", "doc_ids", "counts", "positions").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, ids binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    n = partitions(docs.sparkSession)
    blocks = materialize_bucketed(build_blocks(docs, pattern), "blocks", "block", n)
    if not buckets:
        sent = blocks.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
        buckets = max(4 * n, -(-sent // BUCKET_BYTES))
    return reassemble(blocks, encode_words(send_words(blocks, buckets), path, pattern))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its bytes as column ``decoded``."""

    def run(batches):
        ranks = load_ranks(path)
        tokens = sorted(ranks, key=ranks.get)
        numbers = np.array([ranks[t] for t in tokens])
        sizes = np.zeros(numbers[-1] + 1, np.int64)
        sizes[numbers] = [len(t) for t in tokens]
        starts, table = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(tokens), np.uint8)
        for whole in batches:
            for batch in slices(whole, "ids", 4 * DECODE_IDS):
                each = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("ids")]
                data, sizes_out = gather(table, starts, np.concatenate(each).astype(np.int64))
                at = np.concatenate([[0], np.cumsum(sizes_out)])[np.concatenate([[0], np.cumsum([len(x) for x in each])])]
                out = pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(at), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    back = decode_documents(encode_documents(docs, path, pattern), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
