"""Token ids in Arrow IPC files with fixed-size-list batches (operator 4).

Documents are dealt by ranges of doc_id, so part n holds smaller ids than part
n+1 and each part is sorted.  A part is two Arrow files in the shared folder:

* ``part-n.ids.arrow``: the part's token stream cut into rows of ``row`` ids,
  columns ``input_ids`` (fixed-size list of the smallest unsigned type that
  holds the vocabulary) and ``mask`` (fixed-size list of booleans, false on
  the padding of the last row; ``row`` is a multiple of 8, so every row's bits
  begin at a byte).  All batches but the last have ``batch`` rows, so row r is row
  r % batch of batch r // batch: the file footer gives its place and a memory map
  its values and its mask's packed bits without a copy.
* ``part-n.docs.arrow``: doc_id, start within the part and n_tokens.

A file is written under a name of its own attempt and then moved, so a repeated
or speculative task replaces it by the same bytes.

Edge cases: null or empty text is the end id alone; null doc_ids come first;
repeated doc_ids are all kept, in an order of their text's hash; an empty table
gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import new_path, partitions
from .text_batches import slices, texts
from .word_bpe import encoder, with_end


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class PartWriter:
    """Appends ids to one part's files, batch by batch."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, row: int, batch: int):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.base, self.name, self.row, self.batch = base, name, row, batch
        self.attempt = TaskContext.get().taskAttemptId()
        self.kind = pa.from_numpy_dtype(dtype)
        self.ids_schema = pa.schema([("input_ids", pa.list_(self.kind, row)), ("mask", pa.list_(pa.bool_(), row))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = {k: self.fs.open_output_stream(self._path(k, True)) for k in ("ids", "docs")}
        self.ids = pa.ipc.new_file(self.out["ids"], self.ids_schema)
        self.docs = pa.ipc.new_file(self.out["docs"], self.docs_schema)
        self.pending, self.total, self.n_docs = np.zeros(0, dtype), 0, 0

    def _path(self, kind: str, own: bool) -> str:
        return f"{self.base}/{self.name}.{kind}.arrow" + f".{self.attempt}.tmp" * own

    def _rows(self, values: np.ndarray, valid: int) -> None:
        mask = np.arange(len(values)) < valid
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.row) for x in (values, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.ids_schema))

    def append(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(offsets[:-1] + self.total), pa.array(np.diff(offsets))], schema=self.docs_schema))
        self.pending = np.concatenate([self.pending, ids.astype(self.pending.dtype)])
        self.total, self.n_docs = self.total + len(ids), self.n_docs + len(doc_ids)
        step = self.row * self.batch
        whole = len(self.pending) // step * step
        for at in range(0, whole, step):
            self._rows(self.pending[at : at + step], step)
        self.pending = self.pending[whole:]

    def close(self) -> tuple[int, int]:
        if n := len(self.pending):
            self._rows(np.pad(self.pending, (0, -n % self.row)), n)
        self.ids.close()
        self.docs.close()
        for kind, stream in self.out.items():
            stream.close()
            self.fs.move(self._path(kind, True), self._path(kind, False))
        return self.total, self.n_docs


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = 2, row: int = 2048, batch: int = 128, parts: int | None = None) -> list[dict]:
    """Write all documents; returns name, base (ids in earlier parts), tokens
    and docs of each part: as many rows as there are parts."""
    if row % 8:
        raise ValueError("row must be a multiple of 8")
    dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(parts or partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        part, writer = TaskContext.get().partitionId(), None
        for whole in batches:
            for some in slices(whole):
                ids, offsets = with_end(*encoder(tokenizer).encode(texts(some)), end_id)
                writer = writer or PartWriter(folder, f"part-{part:08d}", dtype, row, batch)
                writer.append(some.column("doc_id"), ids, offsets)
        if writer:
            total, n = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "tokens": [total], "docs": [n]})

    found = sorted(dealt.mapInArrow(run, "part long, tokens long, docs long").collect())
    base, out = 0, []
    for r in found:
        out.append({"name": f"part-{r['part']:08d}", "base": base, "tokens": r["tokens"], "docs": r["docs"]})
        base += r["tokens"]
    return out


def read_row(folder: str, name: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Random access: ids of one row and its mask as packed bits (first id in the
    lowest bit; ``unpacked`` gives booleans), from the file's footer; both are views
    of the mapped file where the file system is local."""
    fs, base = _filesystem(folder)
    path = f"{base}/{name}.ids.arrow"
    file = pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))
    per = file.get_batch(0).num_rows
    batch, at = file.get_batch(number // per), number % per
    ids, mask = batch.column("input_ids")[at].values, batch.column("mask")[at].values
    bits = np.frombuffer(mask.buffers()[1], np.uint8)
    return ids.to_numpy(), bits[mask.offset // 8 : (mask.offset + len(mask) + 7) // 8]


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, bitorder="little").astype(bool)


def read_token_files(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """Every document out of the files: doc_id, start (over the corpus),
    n_tokens and its ids as little-endian unsigned 32-bit binary."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, base = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}.docs.arrow") as stream:
                    docs = pa.ipc.open_file(stream).read_all().combine_chunks()
                with fs.open_input_file(f"{base}/{name}.ids.arrow") as stream:
                    file = pa.ipc.open_file(stream)
                    yield from _documents(file, docs, first)

    listed = spark.createDataFrame([(f["name"], f["base"]) for f in files], "name string, base long").repartition(len(files))
    return listed.mapInArrow(run, schema)


def _documents(file, docs: pa.Table, first: int):
    """Rows of one part, some batches of ids at a time."""
    starts, counts = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
    held, held_from, done = np.zeros(0, "<u4"), 0, 0
    for k in range(file.num_record_batches):
        batch = file.get_batch(k)
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("input_ids", "mask"))
        held = np.concatenate([held, ids[mask].astype("<u4")])
        ready = int(np.searchsorted(starts + counts, held_from + len(held), side="right"))
        if ready > done:
            data = [held[a - held_from : a - held_from + n].tobytes() for a, n in zip(starts[done:ready].tolist(), counts[done:ready].tolist(), strict=True)]
            rows = docs.slice(done, ready - done)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(starts[done:ready] + first), pa.array(counts[done:ready]), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
            cut = int(starts[ready - 1] + counts[ready - 1]) - held_from
            held, held_from, done = held[cut:], held_from + cut, ready


def token_file_digests(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2) -> DataFrame:
    """Write, read back, and reduce each document's ids to their CRC-32."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    back = read_token_files(spark, folder, write_token_files(docs, folder, tokenizer, vocabulary, end_id))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
