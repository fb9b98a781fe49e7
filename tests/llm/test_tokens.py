"""The tree of joins gives what encoding the whole text gives, and decoding gives the text back."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeloom.llm.tokens import TreeEncoder, count_tokens, decode_corpus, encode_corpus, vocabulary

tree = TreeEncoder(vocabulary())
PARTS = st.lists(st.sampled_from(["'s", "'re", "'", "re", "a", "Word", " ", "  ", "\n", "\t", "!?", "12", "é", "漢", "🙂", "'ll", "v", "<|endoftext|>"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS, st.integers(2, 40))
def test_same_ids(text, leaf):
    tree.leaf = leaf
    assert tree.encode(text) == tree.encoding.encode_ordinary(text)
    assert tree.decode(tree.encode(text)) == text


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 60_000, "'re" * 20_000, "word " * 20_000, "é\n" * 20_000, "=" * 30_000 + " x"])
def test_long_texts(text):
    tree.leaf = 1024
    assert tree.encode(text) == tree.encoding.encode_ordinary(text) and tree.decode(tree.encode(text)) == text


def test_corpus(spark):
    texts = {1: "Two words.", 2: "", 3: None, 4: "   ", 5: "it's " * 3000, 6: "Two words."}
    df = spark.createDataFrame([(k, v, "x", [1]) for k, v in texts.items()], "doc_id long, text string, text__ string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got[2] == [] and got[3] is None and got[1] == got[6] and len(got) == 6
    assert {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df)).collect()} == texts
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()} == {k: None if v is None else len(v) for k, v in got.items()}
    assert encode_corpus(df.where("false")).count() == 0
