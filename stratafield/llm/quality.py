"""Document quality by a linear-chain conditional random field (operator 9).

Every line of a text is a node with two states, bad and good.  A node's score
is linear in features of the line and of its neighbours; an edge has one weight
per pair of states.  Training maximises the penalised likelihood of chains whose
lines all carry their document's label.  A document's score is the mean of the
lines' marginals for good (forward-backward), weighted by line length.

The model is fitted on a bounded sample of labelled documents (``sample``
documents with the smallest hash of doc_id, one row each, whole texts: a
documented parameter of training alone).  Labels, lang, source and doc_id are
never features.  Scoring reads whole texts; a long text's chain is run in chunks
of ``CHUNK`` lines side by side, joined by the chunks' transfer matrices, so time
is linear in lines without a step per line.

Edge cases: null or empty text is one empty line and gets that line's score;
null doc_ids are scored and never trained on; repeated rows are scored row by
row; without labels (or with one class only) every document scores 1, so that
nothing is rejected unseen; an empty table gives no rows; other columns are
ignored by the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .text_batches import slices, texts

THRESHOLD = 0.3
SAMPLE = 1500
CHUNK = 128
#: Bytes of text whose line features a worker holds at a time.
FEATURED = 3 << 20

CLASSES = {"upper": "A-Z", "lower": "a-z", "digit": "0-9", "space": " \t\r\v\f", "stop": ".?;:,", "bang": "!", "bar": "|", "sign": "%#*$&@~^{}[]<>=+_/\\`", "quote": "'\"()-"}


def _class_table() -> np.ndarray:
    table = np.zeros((len(CLASSES) + 1, 256), np.uint8)
    for k, chars in enumerate(CLASSES.values()):
        many = range(ord(chars[0]), ord(chars[2]) + 1) if len(chars) == 3 and chars[1] == "-" else map(ord, chars)
        table[k, list(many)] = 1
    table[-1, 128:] = 1  # bytes of letters beyond ASCII
    return table


TABLE = _class_table()
OWN = 17
SEEN = (1, 2, 3, 5, 6, 12, 14)  # features that neighbours lend
FEATURES = 1 + OWN + 2 * len(SEEN) + 2


def repetition(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, distinct words, and words equal to the one before, of each line."""
    parts = pc.split_pattern(lines, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = parts.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    line = np.repeat(np.arange(len(counts)), counts)
    keys = np.sort(line << 32 | ids)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (line[1:] == line[:-1])
    return counts, np.bincount((keys >> 32)[new], minlength=len(counts)), np.bincount(line[again], minlength=len(counts))


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines, and the number of lines of each text."""
    parts = pc.split_pattern(column, "\n")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = parts.flatten()
    size = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    flat = lines.cast(pa.binary())
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: int(ends[-1]) if len(ends) else 0] if flat.offset == 0 else np.frombuffer(b"".join(x.as_py() for x in flat), np.uint8)
    sums = np.zeros((len(TABLE), len(size)))
    full = size > 0
    for k, flags in enumerate(TABLE):
        if full.any():
            sums[k, full] = np.add.reduceat(flags[data], (ends - size)[full], dtype=np.int64)
    upper, lower, digit, space, stop, bang, bar, sign, quote, beyond = sums
    n, letters = np.maximum(size, 1), upper + lower + beyond
    doc = np.repeat(np.arange(len(counts)), counts)
    key = doc * (int(len(lines)) + 1) + lines.dictionary_encode().indices.to_numpy() if len(lines) else doc
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    words, distinct, again = repetition(lines)
    spare = 1 - distinct / np.maximum(words, 1)
    ratio = lambda x, scale=1.0: np.minimum(scale * x, 3.0)
    own = np.stack([
        ratio(letters / n), ratio(sign / n, 10), ratio(upper / np.maximum(letters, 1), 3), ratio(bang / n, 15), ratio(digit / n, 5), ratio(bar / n, 20),
        ratio((times[where] - 1) * (size > 0), 1), ratio(stop / n, 10), ratio(n / (space + 1) / 10), ratio((sign > 0.1 * (space + 1)) * 1.0), ratio(space / n, 4), ratio(np.log1p(size) / 4),
        ratio(spare, 2), ratio(spare * (words > 20) * (spare > 0.5), 4), ratio(again / np.maximum(words, 1), 4), ratio(np.log1p(words) / 3), ratio(((words < 4) & (size > 0)) * 1.0),
    ], axis=1)
    first = np.cumsum(counts) - counts
    head, tail = np.ones(len(size), bool), np.ones(len(size), bool)
    head[first], tail[first + counts - 1] = False, False
    lend = own[:, SEEN]
    before, after = np.zeros_like(lend), np.zeros_like(lend)
    before[1:], after[:-1] = lend[:-1], lend[1:]
    before[~head], after[~tail] = 0, 0
    return np.hstack([np.ones((len(size), 1)), own, before, after, head[:, None], tail[:, None]]), size, counts


@dataclass
class Chain:
    weights: np.ndarray  # of the node score of state good; bad has 0
    edges: np.ndarray  # [from, to]


def _layers(counts: np.ndarray):
    """Places of the t-th lines of all texts that have one, t ascending."""
    order = np.argsort(-counts, kind="stable")
    first, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        yield first[: int(np.searchsorted(-sizes, -t, side="left"))] + t


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each chunk, and the number of chunks of each text."""
    each = -(-counts // CHUNK)
    sizes = np.full(int(each.sum()), CHUNK)
    sizes[np.cumsum(each) - 1] = counts - (each - 1) * CHUNK
    return sizes, each


def _sweep(node: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Forward scores of all chains: log of the sum over the paths that end in a
    state at a line, with the line's own score."""
    sizes, each = _chunks(counts)
    starts = np.cumsum(sizes) - sizes
    out = node.copy()
    if len(sizes) > len(counts):
        move = np.zeros((len(sizes), 2, 2))  # [state before the chunk, state at its last line]
        for t, at in enumerate(_layers(sizes)):
            which = np.searchsorted(starts, at, side="right") - 1
            move[which] = (edges + node[at][:, None, :]) if t == 0 else _log_sum(move[which][:, :, :, None] + edges[None, None], 2) + node[at][:, None, :]
        # a text's first chunk has no line before it
        opening, first = np.cumsum(each) - each, np.zeros((len(sizes), 2))
        last = np.zeros((len(sizes), 2))
        alone = _sweep_chunks(node, edges, sizes, starts, None)
        last[opening] = alone[(starts + sizes - 1)[opening]]
        for at in list(_layers(each))[1:]:
            first[at] = last[at - 1]
            last[at] = _log_sum(last[at - 1][:, :, None] + move[at], 1)
        entered = np.ones(len(sizes), bool)
        entered[opening] = False
        return _sweep_chunks(node, edges, sizes, starts, np.where(entered[:, None], first, np.nan))
    return _sweep_chunks(out, edges, sizes, starts, None)


def _sweep_chunks(node: np.ndarray, edges: np.ndarray, sizes: np.ndarray, starts: np.ndarray, entry: np.ndarray | None) -> np.ndarray:
    """Forward scores within chunks; ``entry``: scores of the line before a chunk
    (nan: none)."""
    out = node.copy()
    if entry is not None:
        has = ~np.isnan(entry[:, 0])
        out[starts[has]] += _log_sum(entry[has][:, :, None] + edges, 1)
    for at in list(_layers(sizes))[1:]:
        out[at] += _log_sum(out[at - 1][:, :, None] + edges, 1)
    return out


def marginals(chain: Chain, x: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """Probability of good for every line; with ``pairs`` also the expected
    number of each pair of neighbouring states."""
    node = np.stack([np.zeros(len(x)), x @ chain.weights], axis=1)
    forward = _sweep(node, chain.edges, counts)
    backward = _sweep(node[::-1], chain.edges.T, counts[::-1])[::-1] - node
    whole = _log_sum(forward + backward, 1)
    good = np.exp(forward[:, 1] + backward[:, 1] - whole)
    if not pairs:
        return good
    at = np.setdiff1d(np.arange(len(x)), np.cumsum(counts) - counts, assume_unique=True)
    both = forward[at - 1][:, :, None] + chain.edges + (node[at] + backward[at])[:, None, :]
    return good, np.exp(both - whole[at][:, None, None]).sum(axis=0)


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, penalty: float = 3e-4) -> Chain:
    """Adam on the penalised likelihood; documents weigh the same."""
    truth = np.repeat(labels, counts).astype(float)
    share = np.full(len(labels), 1 / max(1, len(labels)))
    weight = np.repeat(share / counts, counts)
    same = np.zeros((2, 2))
    np.add.at(same, (labels, labels), (counts - 1) * share / counts)
    at, mean, spread = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        chain = Chain(at[:-4], at[-4:].reshape(2, 2))
        good, pairs = marginals(chain, x, counts, pairs=True)
        lines = max(1.0, (counts - 1).sum())
        slope = np.concatenate([x.T @ ((truth - good) * weight), (same - pairs * same.sum() / lines).ravel()]) - penalty * at
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        at = at + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Chain(at[:-4], at[-4:].reshape(2, 2))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """The chain, or None where the sample lacks one of the classes."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for whole in batches:
            for some in slices(whole):
                x, _, counts = line_features(texts(some))
                starts = np.cumsum(counts) - counts
                rows = [x[a : a + n].astype("<f4") for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("quality"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "x"])

    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    taught = taught.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))  # one row where an id repeats
    rows = sorted(taught.mapInArrow(run, "doc_id long, quality int, x binary").collect())
    labels_of = np.array([r["quality"] for r in rows], int)
    if len(set(labels_of.tolist())) < 2:
        return None
    each = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float) for r in rows]
    return train(np.vstack(each), np.array([len(e) for e in each]), labels_of)


def score_batch(batch: pa.RecordBatch, chain: Chain):
    """Runs of the batch's rows, each with the scores of its texts."""
    for some in slices(batch, most=FEATURED):
        x, size, counts = line_features(texts(some))
        weight = np.maximum(size, 1)
        first = np.cumsum(counts) - counts
        total = np.add.reduceat(marginals(chain, x, counts) * weight, first) / np.add.reduceat(weight, first)
        yield some, pa.array(np.clip(total, 0, 1))


def score_documents(docs: DataFrame, chain: Chain | None, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the score as ``name``, which must be new."""
    if chain is None:
        return docs.withColumn(name, F.lit(1.0))
    names = [*docs.columns, name]

    def run(batches):
        for whole in batches:
            for some, score in score_batch(whole, chain):
                yield pa.RecordBatch.from_arrays([*some.columns, score], names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def classify_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    name = "quality_score"
    while name in map(str.lower, docs.columns):
        name += "_"
    scored = score_documents(docs, fit(docs, labels), name)
    return scored.filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
