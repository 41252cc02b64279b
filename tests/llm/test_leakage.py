import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import leakage as k


def shared(a, b):
    """The longest run of words that two lists share."""
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_words_without_case_accents_and_punctuation():
    assert k.words_of("It's CAFÉ́—naïve_x 12,5 ﬁn Straße 漢字!") == ["it", "s", "cafe", "naive", "x", "12", "5", "fin", "strasse", "漢字"]
    assert k.words_of("Café İ") == k.words_of("CAFÉ i̇") and k.words_of(None) == k.words_of("") == k.words_of(" .!") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), max_size=6), st.integers(1, 6), st.integers(1, 8))
def test_winnowing_equals_its_definition(texts, span, window):
    hashes = [x * 0x9E3779B9 + 1 for t in texts for x in t]
    starts = np.cumsum([0, *map(len, texts)])
    at, prints = k.winnow(np.array(hashes, dtype=np.uint64), starts, span, window)
    value = dict(zip(at.tolist(), prints.view(np.uint64).tolist()))
    expected = set()
    full, all_prints = k.winnow(np.array(hashes, dtype=np.uint64), np.array([0, len(hashes)]), span, 1)
    every = dict(zip(full.tolist(), all_prints.view(np.uint64).tolist()))
    for a, b in zip(starts, starts[1:]):
        for w in range(a, b - span - window + 2):
            places = range(w, w + window)
            least = min(every[p] for p in places)
            expected.add(max(p for p in places if every[p] == least))
    assert set(value) == expected and all(value[p] == every[p] for p in value)


ITEMS = "eval_id long, passage string, doc_id string, hits string"
DOCS = "doc_id long, text string, title string, eval_id string, passage string"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "t", "e", "p") for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "d", "h") for i, t in items], ITEMS)
    return {(r.doc_id, r.eval_id): (r.first_word, r.n_words) for r in k.leaked_spans(d, e).collect()}


def test_every_shared_span_of_ten_words_is_found(spark):
    r = random.Random(4)
    vocabulary = [f"w{x}" for x in range(40)]
    items = [(n, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60)))) for n in range(25)]
    docs = []
    for n in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if r.random() < 0.7:
            source = r.choice(items)[1].split()
            a = r.randrange(len(source))
            words[r.randint(0, len(words)) : 0] = source[a : a + r.choice([8, 9, 10, 11, 30])]
        docs.append((n, r.choice([" ", "\n", ", "]).join(x.upper() if r.random() < 0.2 else x for x in words)))
    got = run(spark, docs, items)
    expected = {}
    for d, t in docs:
        for i, p in items:
            n = shared(k.words_of(t), k.words_of(p))
            if n >= 10:
                expected[d, i] = n
    assert {x: n for x, (_, n) in got.items()} == expected
    texts, passages = dict(docs), dict(items)
    for (d, i), (first, n) in got.items():
        span = k.words_of(texts[d])[first : first + n]
        assert " ".join(span) in " ".join(k.words_of(passages[i]))


def test_nine_words_and_altered_words_are_no_leak(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "one two three four five six seven eight nine"), (2, passage.replace("six", "6")), (3, "ONE, twó;\nthree four-five six seven (eight) nine — tén"), (4, None), (5, ""), (6, passage + " " + passage), (6, passage)]
    assert run(spark, docs, [(7, passage), (8, None), (9, passage), (9, passage)]) == {(3, 7): (0, 10), (3, 9): (0, 10), (6, 7): (0, 11), (6, 9): (0, 11)}


def test_empty_sides_long_texts_and_repeats(spark):
    passage = " ".join(f"p{x}" for x in range(12))
    assert run(spark, [], [(1, passage)]) == {} and run(spark, [(1, passage)], []) == {}
    long = "same " * 60_000 + passage + " same" * 60_000
    assert run(spark, [(1, long), (2, "same " * 50_000)], [(1, passage), (2, "same " * 11)]) == {(1, 1): (60_000, 12), (1, 2): (0, 11), (2, 2): (0, 11)}


def test_shorter_spans_cannot_be_asked_for(spark):
    with pytest.raises(ValueError, match="guaranteed"):
        k.leaked_spans(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS), least=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_automaton_finds_the_longest_shared_run(passage, text):
    first, n = k.Automaton(passage).longest(text)
    assert n == shared(text, passage) and "".join(text[first : first + n]) in "".join(passage)


def test_repeated_words_on_both_sides_take_time_in_proportion(spark):
    import time

    start = time.time()
    got = run(spark, [(1, "ha " * 100_000), (2, "ha " * 9 + "x " + "ha " * 25_000)], [(1, "ha " * 25_000), (2, "ha he " * 20_000)])
    assert got == {(1, 1): (0, 25_000), (2, 1): (10, 25_000)} and time.time() - start < 60


def test_items_too_many_to_broadcast_give_the_same(spark, monkeypatch):
    r = random.Random(9)
    items = [(n, " ".join(f"w{r.randint(0, 30)}" for _ in range(30))) for n in range(20)]
    docs = [(n, "so " * r.randint(0, 4) + " ".join(items[n % 20][1].split()[r.randint(0, 15) :])) for n in range(60)]
    expected = run(spark, docs, items)
    monkeypatch.setattr(k, "BROADCAST_ROWS", 0)
    assert run(spark, docs, items) == expected and len(expected) >= 60


def test_only_texts_that_share_a_whole_span_meet(spark):
    at = np.array([0, 3, 7], dtype=np.int64)
    which, first = k.spans_around(at, np.zeros(3, dtype=np.int64), np.full(3, 12))
    assert sorted(zip(which.tolist(), first.tolist())) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 2)]
