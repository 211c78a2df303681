from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import bpe

C = bpe.Codec(leaf=16)


@settings(max_examples=80, deadline=None)
@given(st.text("abcdeiou", min_size=30, max_size=400))
def test_a_tree_of_leaves_encodes_like_the_whole_piece(text):
    assert C.tree(text) == C.piece(text.encode())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=10), st.text("ab", min_size=20, max_size=80), st.text(" \n", min_size=1, max_size=40)), max_size=6))
def test_texts_with_long_pieces_encode_exactly(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    tokens = C.encode(text)
    assert tokens == C.encoding.encode_ordinary(text)
    assert C.encoding.decode_bytes(tokens) == text.encode()


def test_nulls_empty_long_and_repeated_rows(spark):
    long = "qwertyuiop" * 20_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, "a b", None), (4, "a b", None)], "doc_id long, text string, tokens string")
    rows = sorted(bpe.encode(df).collect(), key=lambda r: r.doc_id)
    assert rows[0].tokens is None and rows[0].round_trip is None and rows[0].n_tokens == 0
    assert rows[1].tokens == [] and rows[1].round_trip is True
    assert rows[2].round_trip is True and rows[2].n_tokens == len(rows[2].tokens) == len(C.encoding.encode_ordinary(long))
    assert rows[3] == rows[4]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[1] is None and back[2] == "" and back[3] == long and back[4] == "a b"
    assert bpe.encode(df.limit(0)).count() == 0
