import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stratafield.llm.word_bpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
OURS = WordEncoder(PATH)
SIGNS = "aAzZHJTWY'sSt .,;<|>#=\n\t\v\x1c\x85\u0307\u0338\u0301 \u3000\u00a0I\u0130\u00df\u03a3\u03c2\u00e99\u00bd"
MARKS = "".join(map(chr, range(0x300, 0x370)))
ODD = st.lists(
    st.one_of(st.sampled_from(SIGNS), st.characters(exclude_categories=["Cs"]), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|>"]), st.builds(str.__add__, st.sampled_from("ABCDEFGHIJKLMNOPQRSTUVWXYZaz"), st.sampled_from(MARKS))),
    max_size=40,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    ids, counts = OURS.encode(pa.array(texts))
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_special_strings_and_marks_after_capitals():
    texts = ["a <|endoftext|> b", "x<|startoftext|><|endoftext|>", "don't've 'S", "", *(c + m + " tail" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in MARKS)]
    ids, counts = OURS.encode(pa.array(texts))
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in want[0] and counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
