import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import measures as m
from lociframe.llm import quality as q
from lociframe.plans import Workspace

DOCS = "doc_id long, text string, lang string, measure string, value int, language int"
LABELS = "doc_id long, text_form string, text string"
LARGE = "/root/testdata/sf0.1"

WORDS = {
    "en": "the lamp is bright and our son likes it after two months of daily use the kettle was warm but a seam broke in the garage".split(),
    "de": "der stecker ist bequem und alles passt genau wir nutzen es in der küche nach drei tagen riecht es leider verbrannt".split(),
    "ru": "крышка очень удобная и всё подошло мы пользуемся ею на кухне после двух недель сломалась ручка к сожалению".split(),
}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LABELS)


def sentence(r, lang):
    return (" ".join(r.choice(WORDS[lang]) for _ in range(r.randint(6, 11)))).capitalize() + "."


def make(r, form, lang):
    """A text of a form, in the words of a language."""
    w = WORDS[lang]
    if form == "prose":
        return r.choice([" ", "\n"]).join(sentence(r, lang) for _ in range(r.randint(1, 7)))
    if form == "list":
        return "\n".join(f"- {r.choice(w)} {r.choice(w)}" for _ in range(r.randint(5, 12)))
    if form == "table":
        return "\n".join(" | ".join([r.choice(w), *[str(r.randint(1, 999)) for _ in range(3)]]) for _ in range(r.randint(5, 9)))
    low, high = {"en": (97, 122), "de": (97, 122), "ru": (0x430, 0x44F)}[lang]
    kind = r.randrange(3)
    if kind == 0:
        return " ".join("".join(chr(r.randint(low, high)) for _ in range(r.randint(3, 9))) for _ in range(12))
    if kind == 1:
        return " ".join([f"{r.choice(w)} {r.choice(w)} {r.choice(w)} {r.choice(w)}"] * 12)
    return "".join(r.choice("?]{$%&/()=+*#~^<>|@") for _ in range(70))


def corpus(seed=4, n=900):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        form = r.choice(["list", "table", "junk"]) if k % 6 == 0 else "prose"
        lang = r.choice(list(WORDS))
        rows.append((k, make(r, form, lang), lang, form))
    return rows


def usage_of(texts):
    """Usage counted plainly over a few texts, each word known and common in as many as the operator asks for."""
    b = m.Batch(texts)
    where, hashes = b.word_sets
    words = np.zeros(m.WORD_BUCKETS, dtype=np.uint8)
    u, n = np.unique(hashes, return_counts=True)
    for h, c in zip(u, n):
        if c >= 2:
            words[int(h) & (m.WORD_BUCKETS - 1)] = 3 if c >= len(texts) / 20 else 1
    pair, lone, counted = b.pairs
    return m.Usage(words, np.bincount(pair[counted], minlength=m.PAIR_BUCKETS).astype(float), np.bincount(lone[counted], minlength=m.SIGN_BUCKETS).astype(float))


def of(texts):
    usage = usage_of(texts)
    return [dict(zip(m.NAMES, row)) for row in m.measure(texts, usage).tolist()]


def test_measures():
    a, b, empty, null, _ = of(["Lamp works.\nlamp 12 x", "ab cd1!", "", None, "a LAMP"])
    assert (a["n_words"], a["n_lines"], a["ended_share"], a["line_words"], a["data_share"]) == (5, 2, 500, 25, 200)
    assert (b["n_words"], b["word_length"], b["symbol_share"], b["digit_share"], b["n_signs"]) == (2, 25, 166, 166, 6)
    assert a["known_share"] == a["common_share"] == 400  # the word that two texts have, in either case
    assert set(empty.values()) == set(null.values()) == {0}


def test_shapes_of_lines():
    rows = of(["a | 1 | 2\nb | 3 | 4\n---|---|---\nc | 5 | 6", "1. ab\n(b) cd\n- ef\n¿gh?", "x;y;\nz;w;", "a  b\nc   d\ne f", "(He said \"so.\")\nand"])
    assert [r["row_share"] for r in rows[:4]] == [1000, 0, 1000, 666] and [r["line_cells"] for r in rows[:4]] == [2, 0, 1, 1]
    assert rows[1]["marked_share"] == 750 and rows[4]["ended_share"] == 500


def test_repetition_at_any_length_and_scripts_without_spaces():
    phrase, han, plain, fair = of(["now please buy this one thing " * 12, "最高です" * 20, "色は写真より少し暗いですが気に入りました", " ".join(map(str, range(60)))])
    assert phrase["repeat_share"] > 850 and han["repeat_share"] > 850
    assert plain["repeat_share"] == fair["repeat_share"] == 0 and plain["n_words"] == 19


def test_words_are_the_same_wherever_they_stand():
    b = m.Batch(["Größe 12 größe", "x Größe\t最高 最"])
    _, hashes, length, number = b.words
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 5
    assert length.tolist() == [5, 2, 5, 1, 5, 2, 1] and number.tolist() == [False, True, False, False, False, False, False]


def test_a_batch_measures_each_text_as_alone():
    texts = [t for _, t, _, _ in corpus(8, 60)] + ["", None, " \n\t", "\ud800x", "a\r\nb c", "'" * 30]
    usage = usage_of(texts)
    assert np.array_equal(m.measure(texts, usage), np.concatenate([m.measure([t], usage) for t in texts]))
    assert [b for s in m.slices(texts * 200) for b in s][0::2] == [0, *[b for s in m.slices(texts * 200) for b in s][1:-1:2]]


@pytest.mark.parametrize("text", ["a" * 300_000, "1." * 100_000, "<!--" * 50_000, "| " * 100_000, '."' * 100_000, "( 1" * 50_000, "x y " * 50_000, "\n".join(["1,2"] * 50_000), "{{" * 100_000, "最高" * 100_000])
def test_very_long_texts_take_time_in_proportion(text):
    import time

    usage = usage_of(["a"])
    start = time.process_time()
    m.measure([text], usage)
    assert time.process_time() - start < 8


def test_forms_of_texts_not_labelled(spark):
    rows = corpus()
    shown = [(k, form) for k, _, _, form in rows if k % 5 in (0, 1)]
    got = {r.doc_id: r.text_form for r in q.forms(frame(spark, [r[:3] for r in rows]), labelled(spark, shown)).collect()}
    hidden = {k: form for k, _, _, form in rows if k % 5 not in (0, 1)}
    true = {k: f for k, f in hidden.items() if f != "prose"}
    found = {k: f for k, f in got.items() if k in hidden}
    both = sum(true.get(k) == f for k, f in found.items())
    assert both >= 0.9 * len(true) and both >= 0.9 * len(found)


def test_ranks_alone_decide(spark):
    rows = corpus(5, 300)
    docs, shown = frame(spark, [r[:3] for r in rows]), labelled(spark, [(k, f) for k, _, _, f in rows])
    stats, ranks, weights = q._prepared(docs, shown)
    scores = q.outlier_scores(stats, ranks, weights)
    flat = q.outlier_scores(stats, ranks.withColumn("upper", F.lit(0.0)).withColumn("lower", F.lit(0.0)), weights)
    assert scores.where("junk_score > 0 or list_score > 0 or table_score > 0").count() >= 40
    assert flat.select("junk_score", "list_score", "table_score").distinct().count() == 1
    fallback, q.BROADCAST_VALUES = q.BROADCAST_VALUES, 0
    try:
        shuffled = {r.row: r for r in q.outlier_scores(stats, ranks, weights).collect()}
    finally:
        q.BROADCAST_VALUES = fallback
    for r in scores.collect():
        assert shuffled[r.row].junk_score == pytest.approx(r.junk_score)


def test_labels_that_are_missing_few_or_odd(spark):
    rows = [r[:3] for r in corpus(6, 120)]
    forms = dict((k, f) for k, _, _, f in corpus(6, 120))
    docs = frame(spark, rows)
    assert q.forms(docs, labelled(spark, [])).count() == 0
    assert q.forms(docs, labelled(spark, [(k, f) for k, f in forms.items() if f == "list"])).count() == 0
    two = [(k, f) for k, f in forms.items() if f in ("prose", "table")]
    odd = [(None, "junk"), (3, None), (4, "poem"), (10**9, "list"), *two, *two]
    assert {r.text_form for r in q.forms(docs, labelled(spark, odd)).collect()} == {"table"}


def test_fit_tells_what_can_be_told():
    r = np.random.default_rng(3)
    x = r.random((400, 3))
    y = np.where(x[:, 0] > 0.7, "list", np.where(x[:, 1] > 0.8, "junk", "prose"))
    w = q.fit_weights(x, list(y))
    scores = np.column_stack([np.zeros(400), *[w[f][0] + x @ w[f][1:] for f in ("list", "junk")]])
    got = np.array(["prose", "list", "junk"])[scores.argmax(axis=1)]
    assert set(w) == {"list", "junk"} and (got == y).mean() > 0.95
    assert q.fit_weights(x[:3], ["list", "junk", "list"]) == {} == q.fit_weights(x[:2], ["prose", "prose"])


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="the test tables aren't here")
def test_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "doc_labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    got = {r.doc_id: r.text_form for r in q.forms(docs, labels.where(half)).collect()}
    hidden = {r.doc_id: r.text_form for r in labels.where(~half).collect()}
    true = {k: f for k, f in hidden.items() if f != "prose"}
    found = {k: f for k, f in got.items() if k in hidden}
    both = sum(true.get(k) == f for k, f in found.items())
    assert both >= 0.9 * len(true) and both >= 0.9 * len(found)


def test_tail_probabilities_are_exact(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "lamp", "xq1z", "!!", "7"]) for _ in range(r.randint(0, 12))) for _ in range(150)]
    docs = frame(spark, [(k, t, r.choice(["en", "de", "fr", None])) for k, t in enumerate(texts)])
    ws = Workspace(spark, "test")
    stats = ws.store(q.measured(docs, q.usage(ws, docs)), "stats")
    values = stats.collect()
    found = q.tail_probabilities(ws, stats)
    tails = {(m.NAMES[x.measure], x.language, x.value): (x.upper, x.lower) for x in found.collect()}
    assert len(tails) == len({(name, lang, row[name]) for row in values for name in m.NAMES for lang in (row.language, q.ALL)})
    for (name, lang, v), (upper, lower) in tails.items():
        group = [row[name] for row in values if lang in (row.language, q.ALL)]
        assert upper == pytest.approx(sum(x >= v for x in group) / len(group)) and lower == pytest.approx(sum(x <= v for x in group) / len(group))
    for x in q.tail_scores(ws, found).collect():
        sides = [tails[m.NAMES[x.measure], lang, x.value] for lang in (x.language, q.ALL)]
        assert x.upper == pytest.approx(-sum(math.log10(s[0]) for s in sides) / 2) and x.lower == pytest.approx(-sum(math.log10(s[1]) for s in sides) / 2)


def test_usage_counts_documents_by_language(spark):
    docs = frame(spark, [*[(k, "rare rare Rare lamp", "en") for k in range(2)], *[(10 + k, "lamp die", "EN-x") for k in range(60)], (99, "die once", "de")])
    got = q.usage(Workspace(spark, "test"), docs)
    b = m.Batch(["rare lamp die once"])
    assert [int(got.words[int(h) & (m.WORD_BUCKETS - 1)]) for h in b.words[1]] == [1, 3, 3, 0]
    assert got.pairs.sum() == 2 * 19 + 60 * 8 + 8 and len(got.words) == m.WORD_BUCKETS


def test_languages_empty_tables_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "EN", "en-XX", " de_AT", "", None, "12")], "lang string")
    assert [r[0] for r in df.select(q.language()).collect()] == ["en", "en", "en", "de", "und", "und", "und"]
    assert q.forms(frame(spark, []), labelled(spark, [(1, "prose"), (2, "list")])).count() == 0
    rows = [r[:3] for r in corpus(7, 200)]
    forms = [(k, f) for k, _, _, f in corpus(7, 200)]
    some = next(k for k, f in forms if f == "table")
    odd = [rows[some], (None, rows[some][1], "en"), (900, "", "en"), (901, None, None), (902, " \n\n\n\n \t", "en"), (903, "\n".join(["- x"] * 3), "en")]
    got = q.forms(frame(spark, rows + odd), labelled(spark, forms)).collect()
    assert [r.text_form for r in got if r.doc_id == some] == ["table"] and len(got) == len(set(got))
    assert not {900, 901, 902, None} & {r.doc_id for r in got} and ("list", 903) not in {(r.text_form, r.doc_id) for r in got}
    assert q.scored(frame(spark, rows + odd), labelled(spark, forms)).count() == len(rows + odd) - 1
