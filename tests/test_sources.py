import random
import sqlite3

import numpy as np
import pytest

import lociframe as L
from tests import files as w

NAN = float("nan")
DENSE, STATS = w.DENSE, w.numpy_stats(w.DENSE)
NAMES = np.array([v[2] for v in w.VARIANTS])
CHROM, POS = np.array([v[0] for v in w.VARIANTS]), np.array([v[1] for v in w.VARIANTS])
SNP = np.array([len(v[3]) == len(v[4]) == 1 for v in w.VARIANTS])


def bcf_rows(variants, calls):
    gt = {0: (2, 2), 1: (2, 4), 2: (4, 4), None: (0, 0)}
    return [(v, None, [gt[c] for c in row], None) for v, row in zip(variants, calls)]


def written(form, folder, spark, variants=w.VARIANTS, calls=w.CALLS, samples=w.SAMPLES):
    """A cohort in a format."""
    path = folder / "c"
    if form == "vcf":
        return L.vcf(w.write_vcf(folder / "c.vcf", w.vcf_rows(variants, calls), samples), spark)
    if form == "bgzf":
        return L.vcf(w.write_bgzf_vcf(folder / "c.vcf.gz", w.vcf_rows(variants, calls), samples, block=700), spark)
    if form == "plink1":
        return L.bfile(w.write_plink1(path, calls, variants, samples), spark)
    if form == "pgen":
        return L.pfile(w.write_plink2(path, calls, variants, samples), spark)
    if form == "pgen-records":
        return L.pfile(w.write_pgen_records(path, w.pgen_records(calls), variants, samples), spark)
    return L.vcf(w.write_bcf(folder / "c.bcf", bcf_rows(variants, calls), samples), spark)


@pytest.fixture(scope="module", params=["vcf", "bgzf", "plink1", "pgen", "pgen-records", "bcf"])
def cohort(request, spark, tmp_path_factory):
    return written(request.param, tmp_path_factory.mktemp(request.param), spark)


def ids(result):
    return list(result[-1]["id"])


def test_every_format_gives_the_drawn_cohort(cohort):
    matrix, samples, variants = cohort.read(return_samples=True, return_variants=True)
    np.testing.assert_array_equal(matrix, DENSE)
    assert matrix.dtype == np.float32 and list(samples["iid"]) == w.SAMPLES
    assert list(variants.itertuples(index=False, name=None)) == w.VARIANTS == [tuple(r) for r in cohort.variants().collect()]
    assert [r.iid for r in cohort.samples().collect()] == w.SAMPLES
    assert cohort.samples().columns == ["fid", "iid", "father", "mother", "sex", "phenotype"]


def test_statistics_and_filters_are_of_the_asked_samples(cohort):
    places = random.Random(3).sample(range(len(w.SAMPLES)), 9)
    asked = [w.SAMPLES[k] for k in places]
    part = w.numpy_stats(DENSE[sorted(places)])
    matrix, samples, variants = cohort.read(samples=asked, variants=L.mac(min=3), return_samples=True, return_variants=True)
    kept = part["mac"] >= 3
    assert list(samples["iid"]) == [w.SAMPLES[k] for k in sorted(places)] and list(variants["id"]) == list(NAMES[kept]) and 0 < kept.sum() < len(kept)
    np.testing.assert_array_equal(matrix, DENSE[sorted(places)][:, kept])
    with pytest.raises(L.SampleFilterError):
        cohort.read(samples=[w.SAMPLES[0], "nobody"])


FILTERS = {
    "chromosome or name": (L.chrom("X") | L.id_in(list(NAMES[[0, 25]])), (CHROM == "X") | np.isin(NAMES, NAMES[[0, 25]])),
    "all but names": (~L.id_in(list(NAMES[5:50])), ~np.isin(NAMES, NAMES[5:50])),
    "region": (L.region("7:200000-700000"), (CHROM == "7") & (POS >= 200_000) & (POS <= 700_000)),
    "single letters": (L.snp() & L.chrom("3"), SNP & (CHROM == "3")),
    "rare": (L.maf(max=0.1) & L.polymorphic(), (STATS["maf"] <= np.float32(0.1)) & (STATS["mac"] > 0)),
    "counts": (L.mac(min=4, max=9), (STATS["mac"] >= 4) & (STATS["mac"] <= 9)),
    "mostly called": (L.missing_rate(0.15) & ~L.maf(min=0.25), (STATS["missing"] <= np.float32(0.15)) & ~(STATS["maf"] >= 0.25)),
    "mixed": (L.chrom("7") & (L.maf(min=0.3) | ~L.snp()), (CHROM == "7") & ((STATS["maf"] >= np.float32(0.3)) | ~SNP)),
    "list of names": (list(NAMES[[40, 3, 17]]), np.isin(NAMES, NAMES[[3, 17, 40]])),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_equal_numpy(cohort, name):
    expr, mask = FILTERS[name]
    matrix, variants = cohort.read(variants=expr, return_variants=True)
    assert list(variants["id"]) == list(NAMES[mask]) and 0 < mask.sum() < len(mask)
    np.testing.assert_array_equal(matrix, DENSE[:, mask])


def test_empty_result_keeps_shape_and_has_no_blocks(cohort):
    matrix, variants = cohort.read(variants=L.chrom("22"), return_variants=True)
    assert matrix.shape == (len(w.SAMPLES), 0) and list(variants.columns) == ["chrom", "pos", "id", "a0", "a1"]
    assert list(cohort.iter_blocks(2, variants=L.chrom("22"))) == []
    assert cohort.read(variants=L.chrom("3") & L.chrom("7")).shape == (len(w.SAMPLES), 0)


def test_missing_policies(cohort):
    some = STATS["n_called"] > 0
    mean = np.array([np.float32(np.nansum(c)) / np.float32((~np.isnan(c)).sum()) for c in DENSE[:, some].T], dtype="float32")
    np.testing.assert_array_equal(cohort.read(missing="impute", variants=list(NAMES[some])), np.where(np.isnan(DENSE[:, some]), mean, DENSE[:, some]))
    with pytest.raises(L.MissingDataError):
        cohort.read(missing="raise")
    whole = STATS["missing"] == 0
    np.testing.assert_array_equal(cohort.read(missing="raise", variants=L.missing_rate(0.0), dtype="int8"), DENSE[:, whole].astype("int8"))


def test_sparse_forms_count_the_minor_allele(cohort):
    whole = STATS["missing"] == 0
    turned = DENSE[:, whole].sum(axis=0) > len(w.SAMPLES)
    expected = np.where(turned, 2 - DENSE[:, whole], DENSE[:, whole])
    alleles = [(v[4], v[3]) if t else (v[3], v[4]) for v, t in zip([v for v, k in zip(w.VARIANTS, whole) if k], turned)]
    assert 0 < turned.sum() < len(turned)
    for form in ("csc", "csr"):
        matrix, variants = cohort.read(sparse=form, return_variants=True, variants=L.missing_rate(0.0))
        np.testing.assert_array_equal(matrix.to_dense(), expected)
        assert list(zip(variants["a0"], variants["a1"])) == alleles and matrix.form == form and matrix.shape == expected.shape
    with pytest.raises(L.MissingDataError):
        cohort.read(sparse=True)


@pytest.mark.parametrize("size", [7, 60, 1000])
def test_blocks_join_to_the_whole(cohort, size):
    blocks = list(cohort.iter_blocks(size, return_variants=True))
    assert [b[0].shape[1] for b in blocks] == [min(size, 60 - k) for k in range(0, 60, size)]
    np.testing.assert_array_equal(np.hstack([b[0] for b in blocks]), DENSE)
    assert [i for b in blocks for i in b[1]["id"]] == list(NAMES)


def test_blocks_can_be_left_early(cohort):
    with cohort.iter_blocks(1) as it:
        np.testing.assert_array_equal(next(it), DENSE[:, :1])
    assert it.closed and list(it) == []
    it.close()
    for size in (True, 0, 1.5):
        with pytest.raises(L.InvalidOptionError):
            cohort.iter_blocks(size)


def test_regions(cohort):
    asked = [L.region("X:1-450000"), L.region("3:450000-900000"), L.region("9:1-2")]
    got = list(cohort.iter_regions(asked, return_variants=True))
    masks = [(CHROM == "X") & (POS <= 450_000), (CHROM == "3") & (POS >= 450_000), np.zeros(60, dtype=bool)]
    assert [r for r, _ in got] == asked and [ids(x) for _, x in got] == [list(NAMES[m]) for m in masks]
    with pytest.raises(L.InvalidOptionError):
        cohort.iter_regions(asked, variants=None)


def test_option_checks_come_in_order(cohort):
    with pytest.raises(L.UnsupportedRepresentation):
        cohort.read(kind="other", dosage="other")
    for bad in ({"dosage": "x"}, {"sparse": "coo"}, {"missing": "x"}, {"variants": len}, {"variants": "rs1"}, {"dtype": "nope"}, {"sparse": True, "missing": "nan"}, {"dtype": "int8"}, {"samples": "S1"}, {"samples": ["S1", "S1"]}, {"return_samples": 1}):
        with pytest.raises(L.InvalidOptionError):
            cohort.read(**bad)


def test_unsupported_values_are_named(spark, tmp_path):
    d = L.bfile(w.write_plink1(tmp_path / "c", w.CALLS, w.VARIANTS, w.SAMPLES), spark)
    with pytest.raises(L.UnsupportedRepresentation):
        d.read(dosage="dosage")
    with pytest.raises(L.UnsupportedRepresentation):
        d.read(kind="haplo")


def test_resolution(tmp_path, spark):
    w.write_plink1(tmp_path / "c", w.CALLS, w.VARIANTS, w.SAMPLES)
    assert L.bfile(tmp_path / "c.bim", spark).source.prefix == tmp_path / "c"
    (tmp_path / "c.fam").unlink()
    with pytest.raises(L.MissingCompanionFileError, match="c.fam"):
        L.bfile(tmp_path / "c", spark)
    with pytest.raises(L.UnsupportedFormatError):
        L.vcf(tmp_path / "c.bed", spark)
    with pytest.raises(L.InvalidSourceError):
        L.vcf(tmp_path / "none.vcf", spark)


# ---- VCF ----


def test_vcf_dosages_quality_and_ids(spark, tmp_path):
    v = [("1", 10, "a;b", "A", "C"), ("1", 20, ".", "A", "C")]
    rows = [w.vcf_row(v[0], ["0/1:0.2", "1/1:1.4", "1/1:1.8"], 30, "GT:DS"), w.vcf_row(v[1], ["0/0:0", "./.:.", "0/1:0.7"], "nan", "GT:DS")]
    d = L.vcf(w.write_vcf(tmp_path / "d.vcf", rows, ["A", "B", "C"]), spark)
    np.testing.assert_allclose(d.read(dosage="dosage"), np.array([[0.2, 0], [1.4, NAN], [1.8, 0.7]], dtype="float32"))
    assert [r.id for r in d.variants().collect()] == ["a", "."]
    assert d.read(variants=L.qual(min=20)).shape == (3, 1)
    assert d.read(variants=~L.qual(min=50)).shape == (3, 2)  # without a quality the leaf is false, so its negation holds
    assert d.read(dosage="dosage", variants=L.mac(min=1)).shape == (3, 1)


@pytest.mark.parametrize(("token", "kind"), [("./1", L.InvalidSourceError), ("0/2", L.InvalidSourceError), ("0", L.InvalidSourceError), (".", L.InvalidSourceError)])
def test_vcf_bad_genotypes_fail_only_if_retained(spark, tmp_path, token, kind):
    rows = [w.vcf_row(w.SITES[0], ["0/0", "0/1"]), w.vcf_row(w.SITES[3], ["0/0", token])]
    d = L.vcf(w.write_vcf(tmp_path / "d.vcf", rows, ["A", "B"]), spark)
    with pytest.raises(kind):
        d.read()
    assert d.read(variants=L.chrom("1")).shape == (2, 1)
    assert d.read(samples=["A"]).shape == (1, 2)
    blocks = d.iter_blocks(1)
    assert d.variants().count() == 2
    with pytest.raises(kind):
        list(blocks)
    assert blocks.closed


def test_vcf_several_alternates(spark, tmp_path):
    rows = [w.vcf_row(("1", 10, "x", "A", "C,G"), ["0/0", "0/1"]), w.vcf_row(w.SITES[3], ["0/0", "0/1"])]
    d = L.vcf(w.write_vcf(tmp_path / "d.vcf", rows, ["A", "B"]), spark)
    assert d.variants().count() == 2
    with pytest.raises(L.InvalidSourceError, match="several alternate"):
        d.read()
    assert d.read(variants=L.biallelic()).shape == (2, 1)


def test_vcf_haplotypes(spark, tmp_path):
    rows = [w.vcf_row(w.SITES[0], ["0|1", "1|0"]), w.vcf_row(w.SITES[1], ["1|1", ".|1"]), w.vcf_row(w.SITES[2], ["0/0", "0/0"])]
    d = L.vcf(w.write_vcf(tmp_path / "h.vcf", rows, ["A", "B"]), spark)
    matrix, samples = d.read(kind="haplo", variants=L.chrom("1"), return_samples=True)
    np.testing.assert_array_equal(matrix, np.array([[0, 1], [1, 1], [1, NAN], [0, 1]], dtype="float32"))
    assert list(samples["source_sample_index"]) == [0, 0, 1, 1] and list(samples["haplotype_index"]) == [0, 1, 0, 1]
    with pytest.raises(L.UnsupportedRepresentation):
        d.read(kind="haplo")
    assert d.phased()
    flipped = d.read(kind="haplo", sparse=True, samples=["A"], variants=L.id_in(["m2"]))
    assert flipped.to_dense().tolist() == [[0], [0]]


@pytest.mark.parametrize("index", ["tbi", "csi"])
@pytest.mark.parametrize("suffix", [".vcf.gz", ".vcf.bgz"])
def test_blocked_vcf_with_index(spark, tmp_path, index, suffix):
    rows = [w.vcf_row(("1" if k < 300 else "2", 100 * (k + 1), f"rs{k}", "A", "C"), ["0/0", "0/1" if k % 3 else "1/1"]) for k in range(600)]
    rows[400] = w.vcf_row(("2", 40100, "bad", "A", "C"), ["0/0", "0/3"])
    d = L.vcf(w.write_bgzf_vcf(tmp_path / f"d{suffix}", rows, ["A", "B"], block=777, index=index), spark)
    assert [r.pos for r in d.variants().collect()] == [100 * (k + 1) for k in range(600)]
    got = d.read(variants=L.region("1:20000-25000") & L.maf(min=0.1), return_variants=True)[1]
    assert list(got["pos"]) == [100 * (k + 1) for k in range(199, 250)]
    assert d.read(variants=L.region("9:1-5")).shape == (2, 0)
    with pytest.raises(L.InvalidSourceError):
        d.read(variants=L.chrom("2"))


def test_blocked_vcf_without_index_reads_all_but_no_region(spark, tmp_path):
    d = L.vcf(w.write_bgzf_vcf(tmp_path / "d.vcf.gz", w.vcf_rows(w.VARIANTS, w.CALLS), w.SAMPLES, block=37, index=None), spark)
    np.testing.assert_array_equal(d.read(), DENSE)
    with pytest.raises(L.InvalidSourceError, match="no index"):
        d.read(variants=L.region("3:1-900000"))
    assert d.read(variants=L.region("3:1-900000") | L.id_in([NAMES[-1]])).shape == (len(w.SAMPLES), 21)


def test_every_way_to_part_a_blocked_file_gives_all_lines(tmp_path):
    from lociframe.sources.bgzf import block_starts, lines_between

    text = "".join(f"line {k} " + "x" * (k % 50) + "\n" for k in range(200)) + "last without end"
    for block in (1, 7, 64, 100, 5000):
        path = tmp_path / f"b{block}.gz"
        path.write_bytes(w.bgzf(text.encode(), block)[0])
        for every in (1, 3, 1000):
            starts = block_starts(str(path))[::every]
            got = [x for a, b in zip(starts, [*starts[1:], None]) for x in lines_between(str(path), a, b, split=True)]
            assert [line for _, line in got] == text.split("\n")
            assert [p for p, _ in got] == sorted({p for p, _ in got})


# ---- BCF ----


def test_bcf_half_calls_haplotypes_and_dosages(spark, tmp_path):
    rows = [(w.SITES[0], 12.5, [(2, 5), (4, 3)], [0.5, None]), (w.SITES[1], None, [(0, 4), (4, 4)], [2.0, 0.0])]
    d = L.vcf(w.write_bcf(tmp_path / "c.bcf", rows, ["A", "B"]), spark)
    np.testing.assert_array_equal(d.read(), np.array([[1, NAN], [1, 2]], dtype="float32"))
    np.testing.assert_array_equal(d.read(dosage="dosage"), np.array([[0.5, 2], [NAN, 0]], dtype="float32"))
    assert d.phased() and not L.vcf(w.write_bcf(tmp_path / "u.bcf", [(w.SITES[0], None, [(2, 4)], None)], ["A"]), spark).phased()
    np.testing.assert_array_equal(d.read(kind="haplo", variants=L.qual(min=10)), np.array([[0], [1], [1], [0]], dtype="float32"))
    with pytest.raises(L.UnsupportedRepresentation):
        d.read(kind="haplo")


# ---- PLINK 2 ----


def test_pgen_fixed_dosages_and_differences(spark, tmp_path):
    v, s = w.SITES[:2], ["A", "B", "C"]
    d = L.pfile(w.write_plink2(tmp_path / "d", [[0, 1, 2], [1, None, 0]], v, s, [30, 40], [[0.25, 1, 1.75], [1, None, 0.5]]), spark)
    np.testing.assert_array_equal(d.read(dosage="dosage"), np.array([[0.25, 1], [1, NAN], [1.75, 0.5]], dtype="float32"))
    np.testing.assert_array_equal(d.read(), np.array([[0, 1], [1, NAN], [2, 0]], dtype="float32"))
    assert d.read(variants=L.qual(min=35)).shape == (3, 1)
    p = L.pfile(w.write_plink2(tmp_path / "p", [[1, 1, None]], v[:1], s, None, [[1.0, 1.2, None]], [[0.5, -0.8, None]]), spark)
    np.testing.assert_allclose(p.read(kind="haplo", dosage="dosage")[:, 0], [0.75, 0.25, 0.2, 1.0, NAN, NAN], atol=1e-4)


def test_pgen_variable_records(spark, tmp_path):
    s = [f"S{k}" for k in range(5)]
    v = [("1", 10 * (k + 1), f"v{k}", "A", "C") for k in range(8)]
    one = bytes([1])  # a list of one: count, sample, code
    records = [
        (0x00, w.pack([0, 1, 2, 3, 0])),
        (0x02, one + bytes([4]) + bytes([1])),  # as before, but sample 4 is 1
        (0x03, one + bytes([1]) + bytes([3])),  # as the first, sample 1 missing, turned
        (0x01, bytes([2]) + w.bits([1, 0, 0, 1, 0]) + bytes([0])),  # 0 or 2
        (0x04, bytes([2]) + bytes([0]) + w.pack([2, 1]) + bytes([3])),  # samples 0 and 3
        (0x06, bytes([0])),
        (0x07, one + bytes([2]) + bytes([0])),
        (0x60, w.pack([0, 1, 2, 3, 0]) + w.bits([0, 1, 0, 0, 1]) + (16384 * 5 // 4).to_bytes(2, "little") + (8192).to_bytes(2, "little")),
    ]
    d = L.pfile(w.write_pgen_records(tmp_path / "x", records, v, s), spark)
    expected = [[0, 1, 2, NAN, 0], [0, 1, 2, NAN, 1], [2, NAN, 0, NAN, 2], [2, 0, 0, 2, 0], [2, 0, 0, 1, 0], [2] * 5, [NAN, NAN, 0, NAN, NAN], [0, 1, 2, NAN, 0]]
    np.testing.assert_array_equal(d.read(), np.array(expected, dtype="float32").T)
    np.testing.assert_array_equal(d.read(dosage="dosage")[:, 7], np.array([0, 1.25, 2, NAN, 0.5], dtype="float32"))
    np.testing.assert_array_equal(d.read(variants=["v2"])[:, 0], np.array([2, NAN, 0, NAN, 2], dtype="float32"))


def test_pgen_phases(spark, tmp_path):
    s, v = ["A", "B", "C"], w.SITES[:3]
    records = [
        (0x10, w.pack([1, 1, 2]) + w.bits([0, 1, 0])),  # all phased
        (0x10, w.pack([1, 1, 0]) + w.bits([1, 1, 0]) + w.bits([1])),  # only the first of two
        (0xD0, w.pack([1, 1, 2]) + w.bits([0, 0, 1]) + (16384 * 5 // 4).to_bytes(2, "little") * 2 + (16384).to_bytes(2, "little") + (-4096 & 0xFFFF).to_bytes(2, "little") * 0 + (8192).to_bytes(2, "little") * 3),
    ]
    d = L.pfile(w.write_pgen_records(tmp_path / "x", records[:2], v[:2], s), spark)
    np.testing.assert_array_equal(d.read(kind="haplo", variants=["m1"])[:, 0], [1, 0, 0, 1, 1, 1])
    with pytest.raises(L.UnsupportedRepresentation):
        d.read(kind="haplo")
    np.testing.assert_array_equal(d.read(kind="haplo", samples=["A", "C"]), np.array([[1, 1], [0, 0], [1, 0], [1, 0]], dtype="float32"))
    sparse = d.read(kind="haplo", sparse=True, samples=["C"], variants=["m1"])
    assert sparse.to_dense().tolist() == [[1], [1]]  # not turned to the minor allele
    full = (0xD0, w.pack([1, 1, 2]) + w.bits([0, 0, 1]) + b"".join(int(16384 * x).to_bytes(2, "little") for x in (1.25, 1.0, 2.0)) + b"".join(int(16384 * x).to_bytes(2, "little", signed=True) for x in (0.75, -0.5, 0)))
    e = L.pfile(w.write_pgen_records(tmp_path / "e", [full], v[:1], s), spark)
    np.testing.assert_allclose(e.read(kind="haplo", dosage="dosage")[:, 0], [1, 0.25, 0.25, 0.75, 1, 1])
    implied = (0x70, w.pack([1, 1, 2]) + w.bits([0, 1, 0]) + w.bits([1, 0, 0]) + int(16384 * 1.25).to_bytes(2, "little"))
    i = L.pfile(w.write_pgen_records(tmp_path / "i", [implied], v[:1], s), spark)
    np.testing.assert_allclose(i.read(kind="haplo", dosage="dosage")[:, 0], [1, 0.25, 0, 1, 1, 1])
    with pytest.raises(L.UnsupportedRepresentation):
        i.read(kind="haplo")


def test_compressed_pvar_and_counts(spark, tmp_path):
    import zstandard

    w.write_plink2(tmp_path / "c", w.CALLS, w.VARIANTS, w.SAMPLES)
    plain = (tmp_path / "c.pvar").read_bytes()
    (tmp_path / "c.pvar").unlink()
    (tmp_path / "c.pvar.zst").write_bytes(zstandard.ZstdCompressor().compress(plain))
    d = L.pfile(tmp_path / "c.pvar.zst", spark)
    np.testing.assert_array_equal(d.read(), DENSE)
    row = d.samples().first()
    assert (row.fid, row.father, row.mother, row.phenotype) == (None, None, None, "NA")
    (tmp_path / "c.pvar.zst").write_bytes(zstandard.ZstdCompressor().compress(plain + b"2\t50\tx\tA\tC\n"))
    with pytest.raises(Exception, match="variants"):
        L.pfile(tmp_path / "c", spark).read()


# ---- BGEN ----


@pytest.mark.parametrize("compression", [0, 1, 2])
@pytest.mark.parametrize("index", [False, True])
def test_bgen_dosages(spark, tmp_path, compression, index):
    v = [("1", 10, "rs1", "A", "G"), ("2", 20, "rs2", "C", "T")]
    blocks = [w.bgen_block([(204, 26), None]), w.bgen_block([(0, 255), (102, 102)])]
    d = L.bgen(w.write_bgen(tmp_path / "d.bgen", blocks, v, ["A", "B"], compression, index=index), spark)
    one = (26 + 2 * (255 - 204 - 26)) / 255
    np.testing.assert_allclose(d.read(dosage="dosage"), np.array([[one, 1], [NAN, (102 + 2 * 51) / 255]]), rtol=1e-5)
    assert d.read(dosage="dosage", variants=L.region("2:15-25")).shape == (2, 1)
    with pytest.raises(L.UnsupportedRepresentation):
        d.read()
    with pytest.raises(L.UnsupportedRepresentation):
        d.read(kind="haplo", dosage="dosage")


@pytest.mark.parametrize("n_bits", [8, 11, 16])
@pytest.mark.parametrize("pack_missing", [False, True])
def test_bgen_phased_probabilities(spark, tmp_path, n_bits, pack_missing):
    most = (1 << n_bits) - 1
    block = w.bgen_block([(0, most), None, (most // 4, most // 2)], True, n_bits, pack_missing)
    (tmp_path / "d.sample").write_text("ID_1 ID_2\n0 0\nA A\nB B\nC C\n")
    d = L.bgen(w.write_bgen(tmp_path / "d.bgen", [block], w.SITES[:1], ["A", "B", "C"], with_samples=False), spark)
    a, b = most // 4 / most, most // 2 / most
    np.testing.assert_allclose(d.read(kind="haplo", dosage="dosage")[:, 0], [1, 0, NAN, NAN, 1 - a, 1 - b], rtol=1e-6)
    np.testing.assert_allclose(d.read(dosage="dosage")[:, 0], [1, NAN, 2 - a - b], rtol=1e-6)
    assert [r.iid for r in d.samples().collect()] == ["A", "B", "C"]


def test_statistics_diagnostics_and_views(cohort, spark):
    got = {r.id: (r.n_called, r.mac) for r in cohort.stats(variants=L.chrom("7") & L.maf(min=0)).collect()}
    at = (CHROM == "7") & (STATS["n_called"] > 0)
    assert got == {i: (n, m) for i, n, m in zip(NAMES[at], STATS["n_called"][at], STATS["mac"][at])}
    row = cohort.diagnostics(variants=L.chrom("7"), samples=w.SAMPLES[:2]).first()
    assert tuple(row) == (23, 2, 60, 20, 40)
    cohort.create_views("c")
    assert spark.sql("SELECT count(*) FROM c_calls JOIN c_variants USING (variant_idx), c_samples").first()[0] == 60 * 23


def test_cohorts_are_written_for_skipping(cohort, spark, tmp_path):
    from lociframe.operators.cohort import write_cohort

    write_cohort(cohort.frame(), f"{tmp_path}/cohort")
    back = spark.read.parquet(f"{tmp_path}/cohort").where("chrom = '7' and pos >= 450000")
    assert sorted(r.id for r in back.collect()) == sorted(NAMES[(CHROM == "7") & (POS >= 450_000)])
    assert "PushedFilters: [IsNotNull(chrom), IsNotNull(pos), EqualTo(chrom,7), GreaterThanOrEqual(pos,450000)" in back._jdf.queryExecution().executedPlan().toString()


def test_positions_are_pushed_into_the_source(spark, tmp_path):
    d = L.bgen(w.write_bgen(tmp_path / "d.bgen", [w.bgen_block([(204, 26)])] * 2, [("1", 10, "a", "A", "G"), ("2", 20, "b", "C", "T")], ["A"]), spark)
    plan = d.frame(dosage="dosage", variants=L.region("2:15-25"))._jdf.queryExecution().executedPlan().toString()
    assert "chrom" in plan and "BatchScan" in plan
    assert d.read(dosage="dosage", variants=L.region("2:15-25")).shape == (1, 1)


def test_entry_names_every_query_once():
    import __spark_entry__ as e

    names = [n for m in e.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(e.oracle_sql()) <= set(e.queries())


def test_uncountable_genotypes_fail_once_statistics_are_asked_for(spark, tmp_path):
    rows = [w.vcf_row(w.SITES[0], ["0|0", "0|1"]), w.vcf_row(w.SITES[3], ["0|0", "0|3"])]
    d = L.vcf(w.write_vcf(tmp_path / "d.vcf", rows, ["A", "B"]), spark)
    assert d.read(variants=L.chrom("1") & L.polymorphic()).shape == (2, 1)
    with pytest.raises(L.InvalidSourceError):
        d.read(variants=L.chrom("2") & L.maf(min=0.4))  # dropped if the bad call were missing
    half = L.vcf(w.write_vcf(tmp_path / "h.vcf", [w.vcf_row(w.SITES[0], ["0|1", ".|1"])], ["A", "B"]), spark)
    np.testing.assert_array_equal(half.read(kind="haplo")[:, 0], [0, 1, NAN, 1])
    with pytest.raises(L.InvalidSourceError, match="half"):
        half.read(kind="haplo", variants=L.polymorphic())


def test_statistics_drop_variants_before_phases_are_needed(spark, tmp_path):
    rows = [w.vcf_row(w.SITES[0], ["0/0", "0/0"]), w.vcf_row(w.SITES[1], ["0|1", "1|1"])]
    d = L.vcf(w.write_vcf(tmp_path / "d.vcf", rows, ["A", "B"]), spark)
    assert d.read(kind="haplo", variants=L.polymorphic()).tolist() == [[0], [1], [1], [1]]
    records = [(0x00, w.pack([0, 0])), (0x10, w.pack([1, 2]) + w.bits([0, 1]))]
    p = L.pfile(w.write_pgen_records(tmp_path / "p", records, w.SITES[:2], ["A", "B"]), spark)
    assert p.read(kind="haplo", variants=L.polymorphic()).tolist() == [[1], [0], [1], [1]]
    with pytest.raises(L.UnsupportedRepresentation):
        p.read(kind="haplo")
    b = L.bgen(w.write_bgen(tmp_path / "d.bgen", [w.bgen_block([(255, 0)]), w.bgen_block([(0, 255)], True)], w.SITES[:2], ["A"]), spark)
    assert b.read(kind="haplo", dosage="dosage", variants=L.polymorphic()).tolist() == [[1], [0]]


def test_broken_files_raise_their_own_errors(spark, tmp_path):
    prefix = w.write_plink1(tmp_path / "c", w.CALLS, w.VARIANTS, w.SAMPLES)
    (tmp_path / "c.bed").write_bytes((tmp_path / "c.bed").read_bytes() + b"\0")
    with pytest.raises(L.InvalidSourceError, match="records"):
        L.bfile(prefix, spark).read()
    (tmp_path / "c.bed").write_bytes(b"\x6c\x1b\x00" + bytes(4))
    with pytest.raises(L.InvalidSourceError, match="variant-major"):
        L.bfile(prefix, spark).read()
    path = w.write_bgen(tmp_path / "d.bgen", [w.bgen_block([(200, 100)])], w.SITES[:1], ["A"])
    with pytest.raises(L.InvalidSourceError, match="more than one"):
        L.bgen(path, spark).read(dosage="dosage")


@pytest.mark.parametrize("form", ["vcf", "plink1", "plink2", "bgen", "bgen-index", "bcf"])
def test_variants_at_position_0_are_kept(spark, tmp_path, form):
    v = [("1", 0, "unplaced", "G", "A"), ("1", 20, "rs2", "T", "C"), ("2", 0, "other", "C", "T")]
    dosage = {}
    if form == "vcf":
        d = L.vcf(w.write_vcf(tmp_path / "c.vcf", [w.vcf_row(x, ["0/1", "1/1"]) for x in v], ["A", "B"]), spark)
    elif form == "plink1":
        d = L.bfile(w.write_plink1(tmp_path / "c", [[1, 2]] * 3, v, ["A", "B"]), spark)
    elif form == "plink2":
        d = L.pfile(w.write_plink2(tmp_path / "c", [[1, 2]] * 3, v, ["A", "B"]), spark)
    elif form == "bcf":
        d = L.vcf(w.write_bcf(tmp_path / "c.bcf", [(x, None, [(2, 4), (4, 4)], None) for x in v], ["A", "B"]), spark)
    else:
        dosage = {"dosage": "dosage"}
        d = L.bgen(w.write_bgen(tmp_path / "c.bgen", [w.bgen_block([(0, 255), (0, 0)])] * 3, v, ["A", "B"], index=form == "bgen-index"), spark)
    matrix, variants = d.read(return_variants=True, **dosage)
    assert matrix.tolist() == [[1] * 3, [2] * 3]
    assert [tuple(r) for r in variants.itertuples(index=False)] == v == [tuple(r) for r in d.variants().collect()]
    assert d.frame(**dosage).count() == 3 and sum(b.shape[1] for b in d.iter_blocks(2, **dosage)) == 3
    assert ids(d.read(variants=L.chrom("1"), return_variants=True, **dosage)) == ["unplaced", "rs2"]
    assert ids(d.read(variants=L.region("1:1-30"), return_variants=True, **dosage)) == ["rs2"]


def test_a_bcf_position_below_0_is_no_position(spark, tmp_path):
    rows = [(("1", -1, "x", "G", "A"), None, [(2, 4)], None)]
    with pytest.raises(L.InvalidSourceError, match="position"):
        L.vcf(w.write_bcf(tmp_path / "c.bcf", rows, ["A"]), spark).read()


@pytest.mark.parametrize("change", ["DELETE FROM Variant WHERE rsid = 'm2'", "INSERT INTO Variant SELECT * FROM Variant WHERE rsid = 'm2'"])
def test_a_bgen_index_of_other_variants_loses_none(spark, tmp_path, change):
    path = w.write_bgen(tmp_path / "d.bgen", [w.bgen_block([(204, 26)])] * 4, w.SITES, ["A"], index=True)
    with sqlite3.connect(f"{path}.bgi") as db:
        db.execute(change)
    d = L.bgen(path, spark)
    assert ids(d.read(dosage="dosage", return_variants=True)) == [v[2] for v in w.SITES]
    assert d.variants().count() == 4 and d.frame(dosage="dosage").count() == 4
    assert ids(d.read(dosage="dosage", variants=L.region("1:1500-2500"), return_variants=True)) == ["m2"]
