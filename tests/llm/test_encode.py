import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import encode

PATH = os.path.join(encode.vocabulary_dir(), "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t\r'.,é漢🙂  \x1c"), max_size=80), st.integers(1, 12))
def test_pieces_encode_like_the_whole(text, cut):
    assert "".join(encode.pieces(text, cut)) == text
    assert encode.encode(text, PATH, cut) == encode.encode(text, PATH, 10**9)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_round_trip(text):
    assert encode.decode_bytes(encode.encode(text, PATH), PATH) == text.encode()


def test_against_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for t in ["Hello world's  end\n\n  x", "<|endoftext|> is text", "\r\n\t漢字 ١٢٣", "a" * 3000, " " * 500 + "x"]:
        assert encode.encode(t, PATH) == other.encode(t, add_special_tokens=False).ids


def test_operator(spark):
    long = ("word " * 200_000) + "end"
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, long, "x"), (5, "é" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode.encode_texts(df, keep=["doc_id"], path=PATH).collect()
    by = {r.doc_id: r.ids for r in got}
    assert len(got) == 6 and by[1] == by[2] == [] and by[3] == encode.encode("a b", PATH) and len(by[4]) == 200_002 - 1
    back = encode.decode_texts(encode.encode_texts(df.drop("ids"), keep=["doc_id"], path=PATH), keep=["doc_id"], path=PATH).collect()
    assert {r.doc_id: r.text for r in back} == {1: "", 2: "", 3: "a b", 4: long, 5: "é" * 100_000}
    counts = encode.encode_texts(df, keep=["doc_id"], path=PATH, out="n", counts_only=True).collect()
    assert {r.doc_id: r.n for r in counts} == {k: len(v) for k, v in by.items()}
    assert encode.encode_texts(df.limit(0), keep=["doc_id"], path=PATH).count() == 0
    bad = spark.createDataFrame([(1, [99_999_999]), (2, None)], "doc_id long, ids array<int>")
    assert {r.text for r in encode.decode_texts(bad, keep=["doc_id"], path=PATH).collect()} == {None}
