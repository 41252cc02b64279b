import datetime as dt
import random

import pytest

from lociframe.operators import orphans as o

SAMPLES = "sample_idx long, iid string, father string, mother string, loaded_at timestamp_ntz, ref string, range_id int"
DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def frames(spark, samples, removals, phenos):
    s = spark.createDataFrame([(k, i, f, m, day(t), "x", 1) for k, (i, f, m, t) in enumerate(samples)], SAMPLES)
    r = spark.createDataFrame([(i, day(t), None) for i, t in removals], "iid string, removed_at timestamp_ntz, reason string")
    p = spark.createDataFrame([(k, i, day(t)) for k, (i, t) in enumerate(phenos)], "pheno_id long, iid string, loaded_at timestamp_ntz")
    return s, r, p


def found(spark, *tables, **sizes):
    s, r, p = frames(spark, *tables)
    rows = o.orphan_references(o.sample_references(s, p), o.key_table(s, r), **sizes).collect()
    return sorted((x.table_name, x.row_id, x.ref_field, x.orphan_kind, x.load_month) for x in rows)


def brute(samples, removals, phenos):
    first, last, gone = {}, {}, {}
    for i, _, _, t in samples:
        if i is not None:
            first.setdefault(i, None), last.setdefault(i, None)
            if t is not None:
                first[i] = t if first[i] is None else min(first[i], t)
                last[i] = t if last[i] is None else max(last[i], t)
    for i, t in removals:
        if i is not None and t is not None:
            gone[i] = max(t, gone.get(i, t))
    refs = [("samples", k, f, v, t) for k, (_, a, b, t) in enumerate(samples) for f, v in (("father", a), ("mother", b))]
    refs += [("phenotypes", k, "iid", i, t) for k, (i, t) in enumerate(phenos)]
    out = []
    for name, k, f, v, t in refs:
        if v is None or v in ("0", ".", "NA"):
            continue
        kind = "missing" if v not in first else "deleted" if last[v] is not None and gone.get(v, -1) > last[v] else "late" if t is not None and first[v] is not None and first[v] > t else None
        if kind:
            out.append((name, k, f, kind, None if t is None else day(t).strftime("%Y-%m")))
    return sorted(out)


def test_kinds(spark):
    samples = [("a", None, "0", 10), ("b", "a", "zz", 5), ("c", "NA", ".", 40), ("c", "a", "d", 60), ("d", "c", "a", None), (None, "a", "b", 70), ("e", "A", "a ", 400)]
    removals = [("b", 20), ("c", 50), ("c", 45), ("never", 3), ("a", 10), (None, 4), ("d", None)]
    phenos = [("b", 30), ("c", 30), ("a", 3), (None, 3), ("q", None), ("q", None), ("d", 1)]
    tables = samples, removals, phenos
    assert found(spark, *tables) == brute(*tables)
    kinds = [(x[1], x[2], x[3]) for x in brute(*tables) if x[0] == "phenotypes"]
    assert (0, "iid", "deleted") in kinds and (1, "iid", "late") in kinds and (2, "iid", "late") in kinds and (4, "iid", "missing") in kinds


@pytest.mark.parametrize(("range_keys", "block_rows"), [(7, 11), (1, 1000), (1000, 5)])
def test_many_ranges_and_divided_hot_references(spark, range_keys, block_rows):
    r = random.Random(range_keys)
    names = [r.choice(["k", "ké", "Z", "漢", ""]) + str(k) for k in range(150)]
    samples = [(r.choice(names[:100]), r.choice(names), "HOT", r.randint(0, 300)) for _ in range(200)]
    removals = [(r.choice(names), r.randint(0, 300)) for _ in range(60)]
    phenos = [(r.choice([*names, "HOT", "HOT"]), r.randint(0, 300)) for _ in range(200)]
    assert found(spark, samples, removals, phenos, range_keys=range_keys, block_rows=block_rows) == brute(samples, removals, phenos)


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [], [], [("a", 1)]) == [("phenotypes", 0, "iid", "missing", "2024-01")]


def test_counts_by_period(spark):
    s, r, p = frames(spark, [("a", "x", "x", 1), ("b", "x", None, 40)], [], [])
    got = o.orphans_by_period(o.orphan_references(o.sample_references(s, p), o.key_table(s, r))).collect()
    assert {(x.load_month, x.ref_field, x.n_orphans) for x in got} == {("2024-01", "father", 1), ("2024-01", "mother", 1), ("2024-02", "father", 1)}
