import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import encoding as e

if not os.path.isfile(e.default_vocabulary()):
    pytest.skip("no vocabulary here", allow_module_level=True)


@pytest.fixture(scope="module")
def encoder():
    with open(e.default_vocabulary(), "rb") as f:
        return e.FragmentEncoder(f.read())


@pytest.fixture(scope="module")
def whole():
    """Encodes whole texts without any cut."""
    import tiktoken

    with open(e.default_vocabulary(), "rb") as f:
        ranks = e.read_ranks(f.read())
    return tiktoken.Encoding("whole", pat_str=e.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["'", "'s", "'re", "n't", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "a", "The", "é", "ß", "1", "23", "٣", "½", "!", "!'", "...", "<|endoftext|>", "日本", "。", "👍🏽", "‍", "\x00", "\x1c", "\x85", "'S", "’s", "''", "ll", "́"]
texts = st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(HARD), max_size=20).map("".join)), max_size=30)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_fragments_give_the_ids_of_the_whole(encoder, whole, batch):
    assert encoder.encode(pa.array(batch, pa.string())).to_pylist() == [whole.encode_ordinary(t) for t in batch]
    assert all(whole.decode_bytes(ids) == t.encode() for t, ids in zip(batch, encoder.encode(pa.array(batch, pa.string())).to_pylist()))


def test_cuts_never_divide_a_token(encoder, whole):
    import numpy as np

    for t in ["It's 5 o'clock — don't!\n\nNew  line", "naïve café 日本語", "x" * 50]:
        ends, at = set(), 0
        for i in whole.encode_ordinary(t):
            at += len(whole.decode_single_token_bytes(i))
            ends.add(at)
        assert set(encoder.cuts(np.frombuffer(t.encode(), np.uint8)).tolist()) <= ends


def test_documents(spark, whole):
    long = ("word " * 30_000) + "a" * 100_000 + " " * 5_000 + "=" * 5_000
    rows = [(1, "Hello world", "x"), (2, "", None), (3, None, "x"), (4, long, "x"), (1, "Hello world", "x"), (None, "<|endoftext|>", "x"), (6, " \n ", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in e.encode_texts(df).collect()), key=repr)
    assert got == sorted(((d, whole.encode_ordinary(t or "")) for d, t, _ in rows), key=repr)
    assert e.encode_texts(df.limit(0)).count() == 0
    assert e.encode_texts(df).columns == ["doc_id", "ids"]


def test_sliced_batches(encoder, whole):
    a = pa.array(["skip", "naïve", None, "", "end"]).slice(1, 4)
    assert encoder.encode(a).to_pylist() == [whole.encode_ordinary(t) for t in ("naïve", "", "", "end")]


def test_too_large_a_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(e, "MOST_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        e.encode_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
