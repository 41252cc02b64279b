import random

import pytest

from lociframe.operators import multivalue as m

SCHEMA = "variant_idx long, id string, alt_allele string, source_format string, items string, delimiter int"
VALUE = {f: set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + m.EXTRA[f]) for f in m.EXTRA}


def brute(text, field):
    """Values of a text, sign by sign."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in "\"'":
            j, value = i + 1, ""
            while j < len(text):
                if text[j] == c:
                    if text[j + 1 : j + 2] != c:
                        break
                    value, j = value + c, j + 2
                else:
                    value, j = value + text[j], j + 1
            if j < len(text):
                out.append(value)
                i = j + 1
                continue
            i += 1
        elif c in VALUE[field]:
            j = i
            while j < len(text) and text[j] in VALUE[field]:
                j += 1
            out.append(text[i:j])
            i = j
        else:
            i += 1
    return [v for v in out if v]


def run(spark, rows):
    df = spark.createDataFrame([(k, a, b, s, "x", 1) for k, (a, b, s) in enumerate(rows)], SCHEMA)
    got = {}
    for r in sorted(m.packed_values(df).collect(), key=lambda r: (r.variant_idx, r.field_name, r.ord)):
        values = got.setdefault((r.variant_idx, r.field_name), [])
        assert r.ord == len(values) + 1
        values.append(r.item)
    return got


def expected(rows):
    out = {(k, f): brute(t, f) for k, r in enumerate(rows) for f, t in (("id", r[0]), ("alt_allele", r[1])) if t is not None}
    return {k: v for k, v in out.items() if len(v) >= 2}


def test_ways_of_writing(spark):
    rows = [
        ("rs1", "C", "vcf"), ("rs1;rs2", "C,G", "vcf"), ("rs1;;rs2;", ",,", "vcf"), (' rs1 | "rs;2" ', "<DEL>&<INS:ME>", None), ("('a';'b''c')", "[A]", "x"), (None, None, "x"), ("", "   ", "x"),
        ('""', "''A'G'", "x"), ('a"b', "A.G", "x"), ('a "b c""d" e', "A-G", "vcf"), ("é,b", "T C", "vcf"), ("1:5:A:0, 2:6", "*", "vcf"), ("a+b;c", "C;G,T", "vcf"), ("a\nb", "A\tC", "vcf"), ("rs1;rs2", "C,G", "vcf"),
    ]
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_agree_with_reading_sign_by_sign(spark, seed):
    r = random.Random(seed)
    pieces = ["rs1", "A", "<DEL>", ";", ",", "|", " ", "\t", "&", '"', "'", "''", '""', "é", "(", "]", "_", ".", "\\", "$"]
    rows = [tuple("".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(2)) + (r.choice(["vcf", "bgen", None]),) for _ in range(600)]
    assert run(spark, rows) == expected(rows)


def test_very_long_fields_and_empty_tables(spark):
    rows = [(";".join(["rs1"] * 30_000), None, "vcf"), ('"a""b" ' * 20_000, "x" * 100_000, "vcf")]
    assert run(spark, rows) == expected(rows)
    assert m.packed_values(spark.createDataFrame([], SCHEMA)).count() == 0


def test_delimiters_are_ranked_for_each_source(spark):
    rows = [(k, "a;b;c", "C,G", "semi", "", 0) for k in range(20)] + [(100 + k, "a|b", "C/G", "bar", "", 0) for k in range(20)] + [(200, "a b;c", None, "bar", "", 0)]
    fields = ("id", "alt_allele")
    scores = m.delimiter_scores(m._long(spark.createDataFrame(rows, SCHEMA), fields), fields)
    best = {(r.source, r.field_name): r.delimiters[0] for r in m.delimiter_ranks(scores).collect()}
    assert best == {("semi", "id"): ";", ("semi", "alt_allele"): ",", ("bar", "id"): "|", ("bar", "alt_allele"): "/"}


def split(spark, texts, delimiters):
    long = spark.createDataFrame([(k, "s", "id", t) for k, t in enumerate(texts)], "variant_idx long, source string, field_name string, packed string")
    ranks = spark.createDataFrame([("s", "id", delimiters)], "source string, field_name string, delimiters array<string>")
    return {r.variant_idx: r["items"] for r in m.split_values(long, ranks).collect()}


def test_the_inferred_delimiters_do_the_parting(spark):
    texts = ["a;b,c", '"x;y";z,w', "a|b"]
    assert split(spark, texts, [";", ","]) == {0: ["a", "b", "c"], 1: ["x;y", "z", "w"], 2: ["a|b"]}
    assert split(spark, texts, ["|"]) == {0: ["a;b,c"], 1: ["x;y", ";z,w"], 2: ["a", "b"]}
    assert split(spark, texts, []) == {0: ["a;b,c"], 1: ["x;y", ";z,w"], 2: ["a|b"]}


def test_consistent_numbers_of_pieces_score_higher(spark):
    even = [(k, "a;b,c", None, "s", "", 0) for k in range(12)]
    uneven = [(50 + k, ",".join("d" * (2 + k % 4)), None, "s", "", 0) for k in range(12)]
    odd = [(80 + k, "e/ é", None, "s", "", 0) for k in range(12)]
    scores = m.delimiter_scores(m._long(spark.createDataFrame(even + uneven + odd, SCHEMA), ("id",)), ("id",))
    by = {r.delimiter: r.score for r in scores.collect()}
    assert by[";"] == pytest.approx(13 / 26 * 13 / 14) and by[";"] != by[","] and set(by) == {";", ",", "/", " ", "é"}
    assert by["/"] == pytest.approx(13 / 26 * 13 / 14)
