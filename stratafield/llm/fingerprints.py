"""Fingerprints of prefix polynomial hashes (operator 6).

``PrefixHash`` holds, for a text of code points c0, c1, ..., the modular prefix
sums of (c + 1) * B**i for two 31-bit primes.  Any two spans are compared in
constant time, and the longest common extension from two places is found by
binary search.

A fingerprint is the length, a stride (a power of two that gives 17 to 32
anchors), the prefix hash at every multiple of the stride from the front and
from the back, the hash of the whole text, and the hash and length of every span
of the text.  Spans end where the hash of the last ``WINDOW`` code points says so
(every ``MEAN`` code points on average, ``LONGEST`` at most), so equal stretches
of two texts fall into equal spans wherever they lie.  The likeness is the share
of the longer text that is covered by equal spans, each counted as often as both
texts have it, or by the common beginning and end if these cover more (binary
search finds the last equal anchors).  All spans of a text are kept, so the
fingerprint grows with the text.

Order of documents: descending doc_id, null last, ties by the text's hash
(ascending); the next document of the last one is the first.  Ranges of doc_id,
and of the hash among rows without an id, are dealt to tasks; a range also gets
the first document of the following one, so nothing is numbered or gathered
globally.  The number of ranges follows the bytes of text.

Edge cases: null text is empty; an empty text has a fingerprint of length 0
that is like itself (1) and unlike all others (0); a single document is its own
next; repeated rows follow one another; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import partitions

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
ANCHORS = 32
WINDOW, MEAN, LONGEST = 6, 16, 128
#: Ranges of doc_id for each partition: several, so that the hash that deals them evens out.
RANGES = 8
#: Text that a partition gets, about.
PART_BYTES = 64 << 20

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(k: int, n: int, sign: int = 1) -> np.ndarray:
    """B**0 .. B**(sign * (n-1)) of the k-th prime, grown by doubling."""
    have = _powers.get((k, sign), np.ones(1, np.uint64))
    p = np.uint64(PRIMES[k])
    while len(have) < n:
        step = np.uint64(pow(BASES[k], sign * len(have), PRIMES[k]))
        have = np.concatenate([have, have * step % p])
    _powers[k, sign] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHash:
    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = (points + np.uint64(1)) * powers(k, self.n) % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))

    def at(self, k: int, where) -> np.ndarray:
        return self.sums[k][where] % np.uint64(PRIMES[k])

    def whole(self) -> int:
        return int(self.at(0, self.n)) << 31 | int(self.at(1, self.n))

    def spans(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of self[start:end], the same wherever the span lies."""
        p = np.uint64(PRIMES[k])
        return (self.sums[k][end] - self.sums[k][start]) % p * powers(k, self.n + 1, -1)[start] % p

    def equal(self, other: PrefixHash, i: int, j: int, length: int) -> bool:
        """self[i:i+length] == other[j:j+length]"""
        if i + length > self.n or j + length > other.n:
            return False
        for k, p in enumerate(PRIMES):
            mine = (int(self.at(k, i + length)) - int(self.at(k, i))) % p
            theirs = (int(other.at(k, j + length)) - int(other.at(k, j))) % p
            if mine * pow(BASES[k], j, p) % p != theirs * pow(BASES[k], i, p) % p:
                return False
        return True

    def common_extension(self, other: PrefixHash, i: int, j: int) -> int:
        """Length of the longest common prefix of self[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(other, i, j, mid) else (low, mid - 1)
        return low


def stride_of(n: int) -> int:
    return 1 << max(0, (max(n, 1) - 1).bit_length() - ANCHORS.bit_length() + 1)


def span_ends(text: PrefixHash) -> np.ndarray:
    """Ends of the spans of a text, the last one its own end."""
    if not text.n:
        return np.zeros(0, np.int64)
    end = np.arange(WINDOW, text.n)
    ends = np.append(end[text.spans(1, end - WINDOW, end) % np.uint64(MEAN) == 0], text.n)
    start = np.append(0, ends[:-1])
    more = (ends - start - 1) // LONGEST  # further cuts of an overlong span
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.append(ends, np.repeat(start, more) + step * LONGEST))


class Fingerprint:
    def __init__(self, text: str):
        points = code_points(text)
        front, back = PrefixHash(points), PrefixHash(points[::-1])
        self.n, self.stride = len(points), stride_of(len(points))
        where = np.arange(self.stride, self.n + 1, self.stride)
        self.front, self.back = front.at(0, where), back.at(0, where)
        self.code = f"{front.whole():016x}"
        ends = span_ends(front)
        starts = np.append(0, ends)[:-1]
        self.spans, self.lengths = front.spans(0, starts, ends), (ends - starts).astype(np.uint64)

    def __str__(self) -> str:
        return f"{self.n}-{self.stride}-{self.code}-" + "-".join(x.astype(">u4").tobytes().hex() for x in (self.front, self.back, self.spans)) + "-" + self.lengths.astype("u1").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        if (self.n, self.code) == (other.n, other.code):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        stride = max(self.stride, other.stride)
        common = 0
        for mine, theirs in ((self.front, other.front), (self.back, other.back)):
            mine, theirs = mine[stride // self.stride - 1 :: stride // self.stride], theirs[stride // other.stride - 1 :: stride // other.stride]
            low, high = 0, min(len(mine), len(theirs))
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if mine[mid - 1] == theirs[mid - 1] else (low, mid - 1)
            common += low * stride
        return min(max(common, self.equal_spans(other)), self.n, other.n) / max(self.n, other.n)

    def equal_spans(self, other: Fingerprint) -> int:
        """Code points in equal spans, each counted as often as both have it."""
        (mine, often), (theirs, others) = (np.unique(x.lengths << np.uint64(32) | x.spans, return_counts=True) for x in (self, other))
        both, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        return int(((both >> np.uint64(32)).astype(np.int64) * np.minimum(often[i], others[j])).sum())


def parse(code: str) -> Fingerprint:
    """A fingerprint from its string."""
    out = Fingerprint.__new__(Fingerprint)
    n, stride, out.code, front, back, spans, lengths = code.split("-")
    out.n, out.stride = int(n), int(stride)
    out.front, out.back, out.spans = (np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint64) for x in (front, back, spans))
    out.lengths = np.frombuffer(bytes.fromhex(lengths), "u1").astype(np.uint64)
    return out


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(key, cuts: list[float]):
    """Number of cuts below the key: two looks at lists of the root's length.
    The lists are one literal each, however many cuts there are."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    numbers = lambda values: F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")
    held = F.from_json(F.lit("[" + ",".join("[" + ",".join(map(repr, r)) + "]" for r in rows) + "]"), "array<array<double>>")
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    row = below(numbers([r[0] for r in rows]))
    return F.when(row == 0, 0).otherwise((row - 1) * width + below(F.element_at(held, row)))


def beside_next(docs: DataFrame, parts: int, ranges: int | None = None) -> DataFrame:
    """Rows (part, doc_id, text, guest) sorted within a part so that each row's
    next document is the row below; guest rows only serve as a last next one."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(parts, -(-size["bytes"] // PART_BYTES)) if parts > 1 else 1
    ranges = ranges or (RANGES * parts if parts > 1 else 1)
    cuts = sorted(set(keyed.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    spread = max(1, -(-ranges * size["nulls"] // max(1, size["rows"])))  # ranges of rows without an id
    low = F.lit(-(2**63))
    part = F.lit(len(cuts)) - _range_of(F.col("doc_id").cast("double"), cuts)  # descending
    tie = F.xxhash64("text")
    step = 2**64 // spread + 1
    of_null = F.lit(len(cuts) + 1) + F.floor((tie.cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)")) / F.lit(str(step)).cast("decimal(38,0)"))
    keyed = keyed.select(F.coalesce(F.when(F.col("doc_id").isNotNull(), part), of_null).cast("long").alias("part"), F.coalesce("doc_id", low).alias("key"), tie.alias("tie"), "doc_id", "text")
    first = F.struct((-F.col("key").cast("decimal(20,0)")).alias("last_first"), "tie")
    heads = sorted((r["part"], r["key"], r["tie"]) for r in keyed.groupBy("part").agg(F.min_by(F.struct("key", "tie"), first).alias("h")).select("part", "h.*").collect())  # one row per range
    if not heads:
        return keyed.select("part", "doc_id", "text", F.lit(0).alias("guest"))
    hosts = docs.sparkSession.createDataFrame([(p, key, t, heads[i - 1][0]) for i, (p, key, t) in enumerate(heads)], "part long, key long, tie long, host long")
    guests = keyed.join(F.broadcast(hosts), ["part", "key", "tie"]).groupBy("host").agg(F.first("text").alias("text"))  # one hash, one text; the broadcast has a row per range
    guests = guests.select(F.col("host").alias("part"), low.alias("key"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("guest"))
    rows = keyed.withColumn("guest", F.lit(0)).unionByName(guests).repartition(parts, "part")
    return rows.sortWithinPartitions("part", "guest", F.desc("key"), "tie").select("part", "doc_id", "text", "guest")


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        held = None
        for batch in batches:
            rows = []
            for part, doc_id, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = Fingerprint(text)
                if held and held[0] == part:
                    _, before, its_text, its_mark = held
                    new = edited(its_text, text)
                    its_edit = Fingerprint(new)
                    rows.append((before, its_mark.n, new, str(its_mark), str(its_edit), its_mark.likeness(its_edit), its_mark.likeness(mark)))
                held = None if guest else (part, doc_id, text, mark)
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    near = beside_next(docs, parts or partitions(docs.sparkSession))
    return near.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    found = fingerprint_documents(docs)
    return found.withColumn("edited_sha256", F.sha2(F.encode("edited_text", "UTF-8"), 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
