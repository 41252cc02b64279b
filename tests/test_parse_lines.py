import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.operators import parse_lines as p


def plain_fields(text):
    """Fields of a text read sign by sign, or None if it is quoted wrongly."""
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(text):
                    return None
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + text[i], i + 1
            if i < len(text) and text[i] != "\t":
                return None
        else:
            end = text.find("\t", i)
            value = text[i:] if end < 0 else text[i:end]
            if '"' in value:
                return None
            i += len(value)
        fields.append(value)
        if i >= len(text):
            return fields
        i += 1


texts = st.lists(st.text(alphabet='"\tab,é漢\n', max_size=30), max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_tokenizer_equals_reading_sign_by_sign(batch):
    ok, fields = p.tokenize(pa.array(batch, pa.string()))
    for text, good, got in zip(batch, ok.to_pylist(), fields.to_pylist()):
        expected = plain_fields(text)
        assert good is (expected is not None)
        if good:
            assert got == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.integers(1, 50))
def test_chunks_compose_to_the_whole_run(symbols, chunk):
    state, expected = p.START, []
    for s in symbols:
        expected.append(state)
        state = p.NEXT[s, state]
    got = p.states_before(np.array(symbols, dtype=np.uint8), chunk) if symbols else []
    assert list(got) == expected


def test_a_field_longer_than_many_chunks_and_sliced_input():
    long = "x" * 100_000 + '\t"' + 'y\t""' * 20_000 + '"\tz'
    ok, fields = p.tokenize(pa.array(["skipped", long, None, ""]).slice(1))
    assert ok.to_pylist() == [True, True, True]
    assert fields.to_pylist()[0] == ["x" * 100_000, 'y\t"' * 20_000, "z"] and fields.to_pylist()[1:] == [[""], [""]]


FILES = "file_id long, file_name string, header_line string, n_fields int, n_variants long, received_at timestamp, fields string"
LINES = "file_id long, source_index long, line_number long, text string, fields int, chrom string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, "a", "#CHROM\tPos\tID\tref\tALT\tQual", 6, 1, None, "x"), (2, "b", None, 5, 1, None, "x"), (3, "c", None, 6, 1, None, "x"),
        (4, "d", "#CHROM\tPOS\tID\tREF\tALT", 5, 1, None, None), (None, "e", None, 5, 1, None, None),
    ]
    return spark.createDataFrame(rows, FILES)


CASES = [
    (1, "1\t5\t.\tA\tC\t.", None), (1, "1\t5\t.\tA\tC\t1e-3", None), (1, '"1"\t"5"\t"a\t""b"""\tA\tC\t3', None), (1, "1\t5\t.\tA\tC\tx", "qual"), (1, "1\t5\t.\tA\tC\t", "qual"),
    (1, "1\t5\t.\tA\tC\t1e", "qual"), (1, '1\t5\t.\tA\t"C\t.', "quoting"), (1, '1\t5\t.\tA\tC"\t.', "quoting"), (1, '1\t5\t"a"b\tA\tC\t.', "quoting"), (1, "1\t5\t.\tA\tC", "columns"),
    (1, "1\t5\t.\tA\tC\t.\t.", "columns"), (1, "\t5\t.\tA\tC\t.", "chrom"), (1, "chr 1\tx\t.\tA\tC\t.", "chrom"), (1, "é\t5\t.\tA\tC\t.", "chrom"), (1, "1\t-5\t.\t?\tC\t.", "pos"),
    (1, "1\t４\t.\tA\tC\t.", "pos"), (1, "1\t4294967295\t.\tacgtn\t*\t.", None), (1, "1\t4294967296\t.\tA\tC\t.", "pos"), (1, "1\t00000000000000000000000000000000000000000000000007\t.\tA\tC\t.", None),
    (1, "1\t5\n\t.\tA\tC\t.", "pos"), (1, "1\t5\t.\tR\tC\t.", "ref"), (1, "1\t5\t.\t\tC\t.", "ref"), (1, "1\t5\t.\tA\tC,,G\t.", "alt"), (1, "1\t5\t.\tA\tC,\t.", "alt"), (1, "1\t5\t.\tA\t<DUP:ME_2>,*,.,c\t.", None),
    (1, "1\t5\t.\tA\t<>\t.", "alt"), (1, "1\t5\t.\tA\t<a b>\t.", "alt"), (2, "1\tx\t7\tC\tA", None), (2, "1\tx\t7\tC\t?", "ref"), (3, "1\tx\t0.1\t7\tC\tA", None), (4, "1\t5\t.\tA\tC", None),
    (99, "1\t5\t.\tA\tC", "columns"), (None, "1\t5\t.\tA\tC", "columns"),
]


def test_reasons(spark, files):
    lines = [(f, k, k, t, 0, None) for k, (f, t, _) in enumerate(CASES)]
    lines += [(1, None, 900, "", 0, None), (1, None, 901, "##x", 0, None), (1, None, 902, None, 0, None), (1, None, 903, " \t", 0, None)]
    df = spark.createDataFrame(lines, LINES)
    got = {r.line_number: r.fail_reason for r in p.parse_lines(df, files).collect()}
    assert got == {k: reason for k, (_, _, reason) in enumerate(CASES)}
    assert {r.line_number for r in p.failed_lines(df, files).collect()} == {k for k, c in enumerate(CASES) if c[2]}
    valid = {r.line_number: r for r in p.valid_lines(df, files).collect()}
    assert valid[2].id == 'a\t"b"' and valid[1].qual == 0.001 and valid[0].qual is None and valid[18].pos == 7 and valid[27].ref == "A" and valid[27].alt == "C"


def test_repeats_empty_tables_and_many_alleles(spark, files):
    line = (1, 1, 1, "1\t5\t.\tA\t" + ",".join(["C"] * 20_000) + ",?\t.", 0, None)
    df = spark.createDataFrame([line, line], LINES)
    assert [tuple(r) for r in p.failed_lines(df, files).collect()] == [(1, 1, "alt")] * 2
    assert p.failed_lines(df.limit(0), files).count() == 0
    assert {r.fail_reason for r in p.failed_lines(df, files.limit(0)).collect()} == {"columns"}


def test_random_lines_agree_with_reading_sign_by_sign(spark, files):
    r = random.Random(1)
    texts = ["\t".join(r.choice(["1", '"1"', '"', "a", "", '""', "5", "A", "C\tG", '"x\ty"']) for _ in range(r.randint(1, 8))) for _ in range(500)]
    texts = [t for t in texts if re.sub(r"\s", "", t)]
    df = spark.createDataFrame([(4, k, k, t, 0, None) for k, t in enumerate(texts)], LINES)
    got = {x.line_number: x.fail_reason for x in p.parse_lines(df, files).collect()}
    for k, t in enumerate(texts):
        f = plain_fields(t)
        assert (got[k] == "quoting") is (f is None)
        if f is not None:
            assert (got[k] == "columns") is (len(f) != 5)


def test_errors_have_the_failing_field_and_byte(spark):
    files = spark.createDataFrame([(1, "#CHROM\tPOS\tID\tREF\tALT", 5, None)], "file_id long, header_line string, n_fields int, received_at timestamp")
    texts = {
        '1\t5\ta"b\tA\tG': ("quoting", 3, 4, 5), '1\t5\té"\tA\tG': ("quoting", 3, 4, 6), '1\t5\t"x"y\tA\tG': ("quoting", 3, 4, 7), '1\t5\t"x\tA\tG': ("quoting", 3, 4, 10),
        "1\t5\tx\tA": ("columns", None, None, 7), "1\t5\tx\tA\tG\tT\tC": ("columns", 6, 10, 10), "é\t5\tx\tA\tG": ("chrom", 1, 0, 0), '"1"\t5x\tx\tA\tG': ("pos", 2, 4, 4),
        '1\t5\t"a\té"\tX\tG': ("ref", 4, 11, 11), "1\t5\tx\tA\t": ("alt", 5, 8, 8),
    }
    lines = [(1, k, t) for k, t in enumerate(texts)] + [(1, 90, "1\t5\tx\tA\tG"), (2, 91, "1\t5\tx\tA\tG")]
    got = {r.line_number: tuple(r)[2:] for r in p.line_errors(spark.createDataFrame(lines, "file_id long, line_number long, text string"), files).collect()}
    assert got == dict(enumerate(texts.values())) | {91: ("columns", None, None, None)}
