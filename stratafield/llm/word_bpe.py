"""Whole-text encoding with a ``tokenizers`` file, one call per distinct chunk.

The tokenizer's normaliser and pre-tokenizer never look across U+0020: NFC
composes nothing over it, white space only separates, and no pre-token holds
it.  So the ids of a text are the ids of its space-separated chunks in order.
Two rewrites that leave the ids as they are make chunks repeat more often:
A-Z are lower-cased first (the normaliser does so anyway), and a space is put
between a letter a-z and a following ASCII sign other than an apostrophe, where
the pre-tokenizer cuts anyway.

A batch is split and dictionary-encoded by Arrow, each chunk that this process
has not met is encoded by the library, and ids are gathered by position.  Texts
that the rewrites could change go to the library whole: those with a special
token's string (the library looks for it before anything else) and those where
a combining mark follows A-Z (composition comes before lower-casing there).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text_batches import gather

#: Chunks that a process remembers (about 40 bytes each); beyond, it starts
#: anew.  This saves time only.
REMEMBERED = 1_200_000

LETTER_SIGN = r"([a-z])([^a-z'\s0-9\x80-\x{10ffff}])"

#: A capital that the normaliser may compose before it lower-cases.
CAPITAL_MARK = r"[A-Z]\p{M}"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.offsets = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Place of every chunk among the known ones; new ones are encoded."""
        if len(self.known) > REMEMBERED:
            self._forget()
        place = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(pc.is_null(place))
        if len(new):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum()))])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            first = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            out = place.fill_null(-1).to_numpy().copy()
            out[out < 0] = np.arange(first, first + len(new))
            return out
        return place.to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text."""
        odd = pc.match_substring_regex(texts, CAPITAL_MARK)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if not pc.any(odd).as_py():
            return self._by_chunk(texts)
        ids, counts = self._by_chunk(pc.if_else(odd, "", texts))
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(texts.filter(odd).to_pylist(), add_special_tokens=False)]
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, found in zip(where.tolist(), whole, strict=True):
            parts[i], counts[i] = np.array(found, np.int32), len(found)
        return np.concatenate(parts), counts

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_SIGN, r"\1 \2"), " ")
        coded = parts.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        ids, counts = gather(self.flat, self.offsets, place[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
        return ids, np.diff(ends[bounds])


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every text: flat ids, and offsets (one more than texts)."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(offsets[-1]), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
