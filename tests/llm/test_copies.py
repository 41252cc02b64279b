import datetime as dt
import random
import unicodedata

import pytest

from lociframe.llm import copies

FEED = "rec_id long, chrom string, pos string, a0 string, a1 string, received_at timestamp_ntz, key string, keep_id int, bare_pos string"


def bare(text):
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN").lower()


def brute(rows):
    groups = {}
    for rec, c, p, a, b, _ in rows:
        if None not in (rec, c, p, a, b):
            groups.setdefault((bare(c), bare(p), *sorted((bare(a), bare(b)))), []).append(rec)
    return sorted((min(g), r) for g in groups.values() for r in sorted(g)[1:])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FEED)


def at(k):
    return None if k is None else dt.datetime(2020 + k, 5, 1)


def test_writings_that_are_copies_and_ones_that_are_not(spark):
    rows = [
        (5, "chr1", "12 345", "a", "G.", at(1)), (3, "CHR:1", "12_345", "g", " A", at(2)), (9, "1", "12345", "A", "G", at(0)), (7, "chr1", "12345", "AG", "", at(0)), (8, "chr1", "12345", "", "A-G", at(3)),
        (1, "chr1", None, "A", "G", at(1)), (2, "chr1", None, "A", "G", at(1)), (4, None, "12345", "A", "G", None), (11, "chrÉ", "é１", "*", ".", None), (10, "CHRé", "É１", ".", "-", at(1)), (12, "chrE", "é1", "*", ".", at(1)),
        (13, "chr1", "1\x002345", "A", "G", at(1)), (14, "chr11", "2345", "A", "G", at(1)), (6, "chr1", "12345", "A", "G", None),
    ]
    got = sorted(map(tuple, copies.copies_in(frame(spark, rows)).collect()))
    assert got == brute(rows) == [(3, 5), (3, 6), (3, 13), (7, 8), (10, 11)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_feeds_with_a_hot_group(spark, seed, monkeypatch):
    monkeypatch.setattr(copies, "HOT_ROWS", 50)
    monkeypatch.setattr(copies, "MOST_HOT_KEYS", 20)
    r = random.Random(seed)
    rows = []
    for k in range(900):
        c, p, a, b = ("chr1", "777", "A", "T") if r.random() < 0.35 else (f"chr{r.randint(1, 3)}", str(r.randint(1, 90)), r.choice("ACGT"), r.choice(["A", "AC", "<DEL>"]))
        if r.random() < 0.5:
            a, b = b, a
        if r.random() < 0.3:
            p = r.choice([f"({p})", f" {p}", "_".join(p), p + "\t"])
        rows.append((k * 7 % 901, r.choice([c, c.upper()]), p, r.choice([a, a.lower()]), None if r.random() < 0.02 else b, at(r.choice([0, 1, 2, None]))))
    feed = frame(spark, rows)
    assert sorted(map(tuple, copies.copies_in(feed).collect())) == brute(rows)
    whole = [x for x in rows if None not in x[:5]]
    once = copies.records_once(feed, copies.ledger_of(copies.keyed(feed, "received_at"))).collect()
    counts = {}
    for keep, _ in brute(rows):
        counts[keep] = counts.get(keep, 1) + 1
    assert {x.rec_id: x.n_copies for x in once} == {x[0]: counts.get(x[0], 1) for x in whole if x[0] not in {c for _, c in brute(rows)}}


def test_ledger_adds_batches_and_is_found_again(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    ledger = copies.CopyLedger(spark, folder, buckets=3)
    assert ledger.entries().count() == 0
    batch = lambda *rows: spark.createDataFrame([(bytearray(k.encode()), r) for k, r in rows], "key binary, rec_id long")
    ledger.apply(batch(("a", 5), ("b", 6), ("a", 7)))
    ledger.apply(batch())
    ledger.apply(batch(("a", 2), ("c", 1)))
    again = copies.CopyLedger(spark, folder, buckets=3)
    assert again.version == 3
    again.apply(batch(("c", 9)))
    got = {bytes(r.key).decode(): (r.n_copies, r.keep_id) for r in again.entries().collect()}
    assert got == {"a": (3, 2), "b": (1, 6), "c": (2, 1)}
    plan = again.entries().join(batch(("a", 1)), "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # the ledger itself isn't shuffled


def test_empty_and_long(spark):
    assert copies.copies_in(frame(spark, [])).count() == 0
    long = "ACGT" * 50_000
    rows = [(1, "chr1", "5", long, "A", at(1)), (2, "chr1", "5", "a", long + "-", at(1)), (3, "chr1", "5", long + "A", "A", at(1))]
    assert sorted(map(tuple, copies.copies_in(frame(spark, rows)).collect())) == [(1, 2)]


def test_every_record_comes_out_once_also_with_nulls(spark):
    rows = [
        (1, "chr1", "5", "A", "G", at(1)), (2, "1", "5", "g", "a", at(0)), (3, "chr1", "5", "a", "G", None), (4, "chr1", None, "A", "G", at(1)), (5, "chr1", None, "A", "G", at(2)),
        (6, "chr1", "5", "A", None, None), (7, None, None, None, None, at(1)), (None, "chr1", "5", "A", "G", at(1)), (8, "chr2", "5", None, "G", at(0)),
    ]
    feed = frame(spark, rows)
    got = [tuple(r) for r in copies.every_record(feed, copies.ledger_of(copies.keyed(feed, "received_at"))).collect()]
    assert sorted(got, key=str) == sorted([(*r[:5], {1: 2, 2: 1}.get(r[0], 1)) for r in rows if r[0] != 3], key=str)


def test_a_ledger_without_a_folder_goes_with_the_intermediate_tables(spark):
    import os

    from lociframe.plans import scoped_tables

    before = spark.catalog.listTables()
    with scoped_tables():
        ledger = copies.CopyLedger(spark)
        ledger.apply(spark.createDataFrame([(b"k", 1), (b"k", 2)], "key binary, rec_id long"))
        assert ledger.entries().count() == 1 and os.path.exists(ledger.folder.removeprefix("file:"))
    assert not os.path.exists(ledger.folder.removeprefix("file:")) and len(spark.catalog.listTables()) == len(before)
