"""Self-join of documents on the Jaccard similarity of word n-grams (operator 2).

Words are runs without ASCII white space, A-Z lower-cased; a document's set
holds its distinct runs of five words (all its words as one run if fewer).  Two
documents link when 100 * intersection >= 75 * union.  Runs are compared by
64-bit hashes.

1. *Blocks.*  A run of documents becomes one row with its words by position.
   The table is bucketed by block, so that later steps move only what they add.
2. *Classes.*  Documents with equal sets are one node, named by the block and
   place of one of them, never by a doc_id: copies meet no join, and no value of
   the ids' range has a meaning of its own.
3. *Rare first.*  Blocks send their distinct n-grams (short hashes, delta
   coded, with counts) to ranges; a range answers each with its document
   frequency.  Where short hashes collide a frequency is only overstated, alike
   for all documents, so the order stays one global order.
4. *Prefixes.*  A node keeps the rarest n - ceil(0.75 n) + 1 of its n-grams.
   Those that no other node has are left out: they meet nobody.
5. *Stars.*  Nodes that share a prefix n-gram are first compared with one of
   them only (one that has the n-gram early in its order), under the length and positional filters, one pair per
   node; the suffix filter and the exact intersection decide.  Verified links
   are contracted to components.  Where nodes of an n-gram still lie in several
   components, they are compared with another one of them, in at most ``STARS``
   turns while links are found: this merges large groups of near copies at a
   cost in proportion to the entries.
6. *Rest.*  Every n-gram whose nodes still lie in several components is joined
   again: pairs of nodes from different components that pass the length,
   positional and signature filters, once each, are verified.  The signature is
   the parity of hashed set members in ``BITS`` bits: the bits in which two of
   them differ are a lower bound of the members that only one set has.  A
   frequent n-gram's nodes are dealt to blocks of ``HOT`` nodes, each met by the
   others on its own, so no task holds all pairs of an n-gram.  So no link between
   different components is lost, and a group of near copies never meets pairwise.
7. *Labels.*  A component's id is the smallest doc_id of its documents.

Edge cases: null, empty or blank text has an empty set and links with nothing;
null doc_ids are kept, their component is null unless an equal or similar
document has an id; any long is a valid doc_id; rows that share a doc_id are
judged one by one, each by its own text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from .byte_bpe import squeeze, unsqueeze
from .components import components
from .storage import materialize, materialize_bucketed, partitions
from .text_batches import give_back, slices, texts

WORDS = 5
PERCENT = 75
BLOCK_BYTES = 8 << 20
#: Rows of a block are fewer than 2**PLACE_BITS, blocks fewer than 2**(63 - PLACE_BITS).
PLACE_BITS = 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BITS = 512
#: Nodes of an n-gram that one task joins with the others at a time.
HOT = 4096
#: Further turns in which an n-gram's nodes meet one of them.
STARS = 2
#: n-grams that a range of ``answer_frequencies`` holds, on average and at most.
RANGE_GRAMS = 4_000_000
SIGNATURE = [f"s{i}" for i in range(BITS // 64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers by position, words per text, and the words' 64-bit hashes."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded) else np.zeros(0, np.uint64)
    return coded.indices.to_numpy(), counts, hashes.astype(np.uint64)


def sets_of(positions: np.ndarray, counts: np.ndarray, hashes: np.ndarray, words: int = WORDS):
    """The sorted distinct n-gram hashes of each text, one array per text."""
    w = hashes[positions]
    whole = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for j in range(words):
        whole = whole * FACTOR + w[j : j + len(whole)]
    whole = mix(whole)
    at = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(whole[at : at + n - words + 1])
        elif n:
            h = np.full(1, n, np.uint64)
            for j in range(n):
                h = h * FACTOR + w[at + j]
            yield mix(h ^ FACTOR)
        else:
            yield whole[:0]
        at += n


def row_keys(batch: pa.RecordBatch) -> list[bytes]:
    """16 bytes per row that follow from its doc_id and text; ``row_key`` in Python."""
    ids = batch.column("doc_id").to_pylist()
    return [hashlib.md5(f"{'' if i is None else i}:".encode() + t.as_buffer().to_pybytes(), usedforsecurity=False).digest() for i, t in zip(ids, texts(batch).cast(pa.binary()), strict=True)]


def row_key() -> Column:
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(doc_id, F.lit(":"), F.coalesce(F.col("text"), F.lit("")))))


def build_blocks(docs: DataFrame) -> DataFrame:
    def run(batches):
        block = TaskContext.get().partitionId() << 20  # of 2**20 blocks each
        for whole in batches:
            for some in slices(whole, most=BLOCK_BYTES):
                positions, counts, hashes = split_words(texts(some))
                order = np.argsort(-np.bincount(positions, minlength=len(hashes)), kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                sets = list(sets_of(positions, counts, hashes))
                yield pa.RecordBatch.from_pydict({
                    "block": [block],
                    "doc_ids": pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(s) for s in sets]], pa.list_(pa.int64())),
                    "keys": pa.array([row_keys(some)], pa.list_(pa.binary())),
                    "signs": pa.array([[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]], pa.list_(pa.binary())),
                    "counts": [squeeze(counts)], "positions": [squeeze(rank[positions])], "hashes": [hashes[order].tobytes()],
                })
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, keys array<binary>, signs array<binary>, counts binary, positions binary, hashes binary")


def _sets(table: pa.Table):
    row = lambda name: table.column(name)[0].as_buffer()
    return list(sets_of(unsqueeze(row("positions")), unsqueeze(row("counts")).astype(np.int64), np.frombuffer(row("hashes"), np.uint64)))


def _short(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - bits)).astype(np.int64)


def _edges(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return np.searchsorted(keys, [r * (1 << bits) // ranges for r in range(ranges + 1)])


def send_ngrams(blocks: DataFrame, nodes: DataFrame, bits: int, ranges: int) -> DataFrame:
    """block, range, keys, counts: each block's n-grams over its nodes."""

    def run(mine: pa.Table, named: pa.Table) -> pa.Table:
        give_back()
        rows = {"block": [], "range": [], "keys": [], "counts": []}
        if mine.num_rows and named.num_rows:
            sets = _sets(mine)
            keys, counts = np.unique(_short([sets[i] for i in named.column("places")[0].as_py()], bits), return_counts=True)
            edges = _edges(keys, bits, ranges)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[r], edges[r + 1]
                for name, value in zip(rows, (mine.column("block")[0].as_py(), r, squeeze(np.diff(keys[a:b], prepend=r * (1 << bits) // ranges)), squeeze(counts[a:b])), strict=True):
                    rows[name].append(value)
        return pa.table({"block": pa.array(rows["block"], pa.int64()), "range": pa.array(rows["range"], pa.int64()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    texts_ = blocks.select("block", "counts", "positions", "hashes")
    return texts_.groupBy("block").cogroup(nodes.select("block", "places").groupBy("block")).applyInArrow(run, "block long, range long, keys binary, counts binary")


def frequency_class(n: np.ndarray) -> np.ndarray:
    """Document frequency as one byte: 0 for one, then exact, then by steps."""
    coarse = 126 + np.floor(3 * np.log2(np.maximum(n, 127) / 127)).astype(np.int64)
    return np.where(n < 128, n - 1, np.minimum(coarse, 255)).astype(np.uint8)


def answer_frequencies(sent: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unsqueeze(x.as_buffer()), dtype=np.int64) for x in table.column("keys")]
        counts = np.concatenate([unsqueeze(x.as_buffer()) for x in table.column("counts")])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        classes = frequency_class(np.bincount(where, counts).astype(np.int64))[where]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        pack = zstandard.ZstdCompressor(level=3)
        return pa.table({"block": table.column("block"), "range": table.column("range"), "classes": pa.array([pack.compress(x.tobytes()) for x in np.split(classes, cuts)], pa.binary())})

    return sent.groupBy("range").applyInArrow(run, "block long, range long, classes binary")


def signature(grams: np.ndarray) -> list[int]:
    """Parity of the members that hash to each of ``BITS`` bits."""
    odd = np.bincount((grams & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def prefixes(blocks: DataFrame, nodes: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """node, n, grams and their places in the global order, set (sorted hashes)
    of the nodes that share a prefix n-gram's frequency with another."""
    told = answers.select("block", "range", "classes", F.lit(None).cast("array<long>").alias("places"), F.lit(None).cast("array<long>").alias("names"))
    told = told.union(nodes.select("block", F.lit(-1).cast("long"), F.lit(None).cast("binary"), "places", "names"))

    def run(mine: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        out = {k: [] for k in ("node", "n", "grams", "at", "set", *SIGNATURE)}
        parts, places, names = {}, [], []
        for r, data, p, q in zip(*(right.column(c) for c in ("range", "classes", "places", "names")), strict=True):
            if r.as_py() < 0:
                places, names = p.as_py(), q.as_py()
            else:
                parts[r.as_py()] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)
        if places and mine.num_rows:
            sets = _sets(mine)
            _, key = np.unique(_short([sets[i] for i in places], bits), return_inverse=True)
            every, done = np.concatenate([parts[r] for r in sorted(parts)])[key], 0
            for i, node in zip(places, names, strict=True):
                grams = sets[i]
                n = len(grams)
                rare, done = every[done : done + n], done + n
                order = np.argsort(rare, kind="stable")[: n - (PERCENT * n + 99) // 100 + 1]
                shared = np.flatnonzero(rare[order])
                if len(shared):
                    for name, value in zip(out, (node, n, grams[order[shared]].view(np.int64), shared, grams.tobytes(), *signature(grams)), strict=True):
                        out[name].append(value)
        kinds = {"node": pa.int64(), "n": pa.int64(), "grams": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "set": pa.binary(), **dict.fromkeys(SIGNATURE, pa.int64())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    texts_ = blocks.select("block", "counts", "positions", "hashes")
    return texts_.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "node long, n long, grams array<long>, at array<int>, set binary, " + ", ".join(f"{s} long" for s in SIGNATURE))


def _may_link(x: str, y: str) -> str:
    """Length and positional filters for an n-gram at place {x}.at and {y}.at.
    Nothing before the first common n-gram is shared, so from its places on
    both sets must still hold the overlap that a link needs."""
    need = f"(({PERCENT} * ({x}.n + {y}.n) + {99 + PERCENT}) div {100 + PERCENT})"
    return f"100 * least({x}.n, {y}.n) >= {PERCENT} * greatest({x}.n, {y}.n) AND least({x}.n - {x}.at, {y}.n - {y}.at) >= {need}"


def intersection(a: np.ndarray, b: np.ndarray, need: int, depth: int = 2) -> int:
    """Size of the intersection of two sorted sets, or -1 once the suffix
    filter shows that it stays below ``need``: halves around a pivot can share
    no more than their smaller sizes."""
    if _reach(a, b, depth) < need:
        return -1
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0


def _reach(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    if not depth or not len(a) or not len(b):
        return min(len(a), len(b))
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    return _reach(a[:i], b[:j], depth - 1) + _reach(a[i:], b[j:], depth - 1)


def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    sets = found.select("node", "set")
    both = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "set_a", 16 << 20):
                keep = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    need = (PERCENT * (len(x) + len(y)) + 99 + PERCENT) // (100 + PERCENT)
                    keep.append(intersection(x, y, need) >= need)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _unlike(x: str, y: str) -> str:
    """The signatures leave room for the overlap that a link needs."""
    need = f"(({PERCENT} * ({x}.n + {y}.n) + {99 + PERCENT}) div {100 + PERCENT})"
    return f"2 * {need} <= {x}.n + {y}.n - (" + " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in SIGNATURE) + ")"


def _by_gram(nodes: DataFrame, *columns: str) -> DataFrame:
    rows = nodes.select(*columns, F.explode(F.arrays_zip("grams", "at")).alias("g"))
    return rows.select(*columns, F.col("g.grams").alias("gram"), F.col("g.at").alias("at"))


def meet(rest: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a > b, of nodes of ``rest`` (gram, times, node, root, n, at,
    signature) that may link.  A gram of more than ``hot`` nodes is dealt to
    blocks of about that many by ``a``; every block is joined on its own."""
    dealt = rest.withColumn("blocks", F.expr(f"(times + {hot - 1}) div {hot}"))
    x = dealt.withColumn("salt", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(0).cast("long")))
    y = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    on = "x.gram = y.gram AND x.salt = y.salt AND x.node > y.node AND x.root != y.root AND " + _may_link("x", "y") + " AND " + _unlike("x", "y")
    return x.alias("x").join(y.alias("y"), F.expr(on)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def link_nodes(found: DataFrame) -> DataFrame:
    """(node, root) for all nodes with a link, ``found`` as ``prefixes`` gives it."""
    entries = _by_gram(found, "node", "n")
    hubs = entries.groupBy("gram").agg(F.min_by(F.struct("node", "n", "at"), F.struct(_late(), "node")).alias("h"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("gram", "h")
    near = entries.alias("x").join(hubs, "gram").filter("x.node != h.node AND " + _may_link("x", "h"))
    one = near.groupBy("x.node").agg(F.min("h.node").alias("hub"))
    tried = materialize(one.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), "pairs")
    links = materialize(verify(tried, found), "verified")
    roots = materialize(components(links), "roots")
    for turn in range(STARS):
        rest = open_entries(found, roots)
        pairs = materialize(star_pairs(rest, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(verify(pairs, found), "verified")
        if links.isEmpty():
            break
        tried = tried.unionByName(pairs)
        roots = materialize(_merged(roots, links), "roots")
    rest = materialize(open_entries(found, roots), "rest")
    pairs = materialize(meet(rest).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = materialize(verify(pairs, found), "verified")
    return roots if more.isEmpty() else _merged(roots, more)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links.select("a", "b")))


def open_entries(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the n-grams whose nodes lie in several components, with the
    n-gram's number of nodes."""
    placed = found.drop("set").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = _by_gram(placed, "root").groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("times")).filter("low < high").select("gram", "times")
    return _by_gram(placed, "node", "n", "root", *SIGNATURE).join(open_, "gram")


def _late() -> Column:
    """An n-gram so late in a set's order that sets of like sizes cannot have it
    as their first common one: such a node is a poor one to meet the others."""
    return 7 * F.col("at") > F.col("n")


def star_pairs(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), a > b, of every n-gram's nodes with one node of it, another
    one in each ``turn``: no more pairs than entries."""
    own = ["node", "n", "root", "at", *SIGNATURE]
    hubs = rest.groupBy("gram").agg(F.min_by(F.struct(*own), F.struct(_late(), F.xxhash64("gram", "node", F.lit(turn)))).alias("h"))
    near = rest.alias("x").join(hubs, "gram").filter("x.root != h.root AND " + _may_link("x", "h") + " AND " + _unlike("x", "h"))
    return near.select(F.greatest("x.node", "h.node").alias("a"), F.least("x.node", "h.node").alias("b")).distinct()


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), n_shingles, root (names the component, null
    without words), component_id: one row per row of ``docs``."""
    spark = docs.sparkSession
    n = partitions(spark)
    blocks = materialize_bucketed(build_blocks(docs), "shingles", "block", n)
    rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes", "keys", "signs")).alias("place", "d"))
    rows = rows.select("block", F.col("place").cast("long").alias("place"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n"), F.col("d.keys").alias("key"), F.col("d.signs").alias("sign"))
    classes = rows.filter("n > 0").groupBy("sign").agg(F.min(F.struct("block", "place")).alias("m"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
    classes = materialize(classes.select("sign", "n", "least", F.col("m.block").alias("block"), F.col("m.place").alias("place"), F.expr(f"shiftleft(m.block, {PLACE_BITS}) + m.place").alias("node")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(56, max(16, int(total).bit_length() + 7))
    named = classes.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("p")).select("block", F.col("p.place").alias("places"), F.col("p.node").alias("names"))
    named = materialize(named, "nodes")  # a row is one block's documents
    answers = answer_frequencies(send_ngrams(blocks, named, bits, max(4 * n, -(-total // RANGE_GRAMS))))
    found = materialize(prefixes(blocks, named, answers, bits), "prefixes")
    rooted = classes.select("sign", "node", "least").join(link_nodes(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.select("sign", "root").join(linked, "root")
    own = F.to_binary(F.concat_ws(".", "block", "place"), F.lit("utf-8"))  # empty sets: a key of each row's own
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sign")).otherwise(own).alias("sign")).join(rooted, "sign", "left")
    return out.select("doc_id", "key", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    return judge(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies, decided row by row: of each component one row
    stays, the one with the smallest doc_id (null last; ties by the key of doc_id
    and text, then by a hash of the plain columns).  Rows without words, whatever
    their doc_id, all stay; nothing else goes."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    judged = materialize(judge(docs.select("doc_id", "text")).filter("n_shingles > 0").select("doc_id", "key", "root"), "components")
    best = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    groups = materialize(best.select("root", F.col("best.key").alias("best_key")), "groups")
    keys = judged.join(groups, "root").select("key", (F.col("key") == F.col("best_key")).alias("stays"))
    gone = keys.filter("NOT stays").select("key").distinct()
    row = docs.select(F.struct(*own).alias("row"), "doc_id", "text").select("row", row_key().alias("key"))
    kept = row.join(gone.hint("merge"), "key", "left_anti")  # both sides grow with the input
    again = materialize(keys.filter("stays").groupBy("key").count().filter("count > 1").select("key"), "again")
    back = lambda rows: rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])
    if again.isEmpty():
        return back(kept)
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    one = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return back(kept.join(again, "key", "left_anti")).unionByName(back(one))
