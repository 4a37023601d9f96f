import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings, strategies as st

from stratafield.llm import byte_bpe

PATTERN = public_tokenizers.PATTERN
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = st.text(st.one_of(st.sampled_from("ab'strelld  .,\n\t\r\v\x1c\x1d\x85 ​　᠎\0é1½"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_pre_tokens_by_position(texts):
    flat, counts, words = byte_bpe.pre_tokens(pa.array(texts), PATTERN)
    want = [regex.findall(PATTERN, t) for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert [words[i] for i in flat] == [w for x in want for w in x]


def test_spaces_exhaustively():
    import itertools

    texts = ["".join(t) for n in range(6) for t in itertools.product(" \na\u00a0", repeat=n)]
    flat, counts, words = byte_bpe.pre_tokens(pa.array(texts), PATTERN)
    want = [regex.findall(PATTERN, t) for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert [words[i] for i in flat] == [w for x in want for w in x]


@settings(max_examples=1500, deadline=None)
@given(ODD)
def test_words_encode_like_the_whole_text(text):
    encoding = byte_bpe.load_encoding(PATH, PATTERN)
    flat, _, words = byte_bpe.pre_tokens(pa.array([text]), PATTERN)
    assert [i for w in flat for i in encoding.encode_ordinary(words[w])] == encoding.encode_ordinary(text)
