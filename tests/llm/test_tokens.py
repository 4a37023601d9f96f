"""Packing, token files, byte BPE: against the libraries."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from stratafield.llm import byte_bpe, packing, queries, token_files

TOKENIZER = Tokenizer.from_file(queries.WORD_BPE)


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check_pieces(rows, docs, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        ids = ids_of(text)
        for a in range(0, len(ids), window):
            want[i].append((a, len(ids[a : a + window]), zlib.crc32(ids[a : a + window].tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    return len(by_sequence)


def plain_best_fit(lengths, window):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(window - n)
    return len(free)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(5, 60))
    lengths = rng.integers(1, window + 1, rng.integers(1, 400)).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, windows = packing.plan_best_fit(counts, window)
    assert windows == plain_best_fit(lengths, window)
    placed, seen = defaultdict(list), defaultdict(int)
    for length, number, per, first, offset in runs:
        following = [r[1] for r in runs if r[0] == length and r[1] > number]
        for k in range(number, min(following, default=counts[length])):
            step = k - number
            placed[first + step // per].append((offset + step % per * length, length))
            seen[length] += 1
    assert dict(seen) == counts and len(placed) == windows
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window


def test_packing_of_the_table(spark, sf, plain):
    rows = queries.op1_packing(spark, sf).collect()
    n = check_pieces(rows, plain.items(), 4096)
    assert n == plain_best_fit([r["length"] for r in rows], 4096)


def test_packing_of_odd_rows(odd, empty):
    from .conftest import ODD

    check_pieces(packing.pack_documents(odd, queries.WORD_BPE, 64).collect(), ODD, 64)
    assert packing.pack_documents(empty, queries.WORD_BPE).collect() == []


def test_sequences(odd):
    rows = packing.packed_sequences(packing.pack_documents(odd, queries.WORD_BPE, 64, keep_ids=True), 64).collect()
    for r in rows:
        assert len(r["ids"]) == (r["n_tokens"] if bin(r["n_tokens"]).count("1") == 1 else 64)


def check_files(rows, docs):
    start = 0
    groups = defaultdict(list)
    for i, text in docs:
        groups[i].append(ids_of(text))
    got = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        match = next(k for k, ids in enumerate(groups[r["doc_id"]]) if (len(ids), zlib.crc32(ids.tobytes())) == (r["n_tokens"], r["ids_crc32"]))
        groups[r["doc_id"]].pop(match)


def test_token_files(spark, sf, plain, odd, empty):
    from .conftest import ODD

    check_files(queries.op4_token_files(spark, sf).collect(), list(plain.items()))
    check_files(token_files.token_file_digests(odd, queries.WORD_BPE, queries.WORD_VOCABULARY).collect(), ODD)
    assert token_files.token_file_digests(empty, queries.WORD_BPE, queries.WORD_VOCABULARY).collect() == []


def test_random_access(documents, plain, tmp_path):
    folder = f"file://{tmp_path}"
    parts = token_files.write_token_files(documents, folder, queries.WORD_BPE, queries.WORD_VOCABULARY, row=32, batch=8, parts=3)
    stream = np.concatenate([ids_of(plain[i]) for i in sorted(plain)])
    for p in parts:
        for number in (0, 1, 8, 9, p["tokens"] // 32):
            ids, bits = token_files.read_row(folder, p["name"], number)
            mask = token_files.unpacked(bits)
            want = stream[p["base"] + 32 * number : min(p["base"] + 32 * number + 32, p["base"] + p["tokens"])]
            assert ids[mask].tolist() == want.tolist() and ids.dtype == np.uint16
            assert not ids.flags.owndata and not bits.flags.owndata and len(mask) == 32


def test_byte_bpe(spark, sf, plain, odd, empty):
    from .conftest import ODD

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def want(docs):
        out = []
        for i, text in docs:
            ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
            out.append((i, len(ids), sha(ids.tobytes()), sha((text or "").encode())))
        return sorted(out, key=repr)

    assert sorted(map(tuple, queries.op7_byte_bpe(spark, sf).collect()), key=repr) == want(plain.items())
    rows = byte_bpe.round_trip_digests(odd, queries.BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, rows), key=repr) == want(ODD)
    assert byte_bpe.round_trip_digests(empty, queries.BYTE_BPE, public_tokenizers.PATTERN).collect() == []
