"""Queries of the file sources: the wide cohort is written in every format and read back through the readers.

The cohort has as many variants as ``embeddings`` has rows; the driver writes it into
the shared folder, where all executors see it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lociframe import filters as f
from lociframe.plans import Workspace
from lociframe.queries import genotype_files as w
from lociframe.queries.cohort import E_SQL, _HAPLO_SQL, _f32, wide
from lociframe.session import reach_workers
from lociframe.sources.dataset import Dataset, bfile, open_bgen, open_vcf, pfile

Write = Callable[[Path, list[Row]], object]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SAMPLES = [f"S{k}" for k in range(64)]


def shared_path(spark: SparkSession) -> Path:
    """A new folder on the path that all executors share."""
    where = urlparse(Workspace(spark, "files").root)
    if where.scheme not in ("", "file"):
        raise ValueError(f"genotype files are opened by path, which {where.scheme}: isn't")
    folder = Path(where.path)
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def cohort(spark: SparkSession, sf_dir: str) -> list[Row]:
    """The wide cohort in the order of chromosomes and positions, as a file has it."""
    reach_workers(spark)
    return wide(spark, sf_dir).orderBy(F.col("chrom").cast("int"), "pos").collect()


def sites(rows: list[Row]) -> list[w.Variant]:
    return [(r.chrom, r.pos, r.id, r.a0, r.a1) for r in rows]


def hard(rows: list[Row]) -> list[list]:
    return [[None if c is None else int(c) for c in r.calls] for r in rows]


def phases(row: Row) -> list[tuple | None]:
    """The two alleles of every sample; of a heterozygote the alternate lies second where ``first`` is true."""
    return [None if c is None else (int(c) // 2, int(c) // 2) if c != 1 else (0, 1) if second else (1, 0) for c, second in zip(row.calls, row.first)]


# ---- how each format is written and opened ----


def _vcf(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    return open_vcf(w.write_vcf(folder / "c.vcf", w.vcf_rows(sites(rows), hard(rows)), SAMPLES), spark)


def _vcf_phased(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    lines = [w.vcf_row(v, [".|." if p is None else f"{p[0]}|{p[1]}" for p in phases(r)]) for v, r in zip(sites(rows), rows)]
    return open_vcf(w.write_vcf(folder / "c.vcf", lines, SAMPLES), spark)


def _vcf_dosages(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    lines = [w.vcf_row(v, [f"./.:{'.' if d is None else format(math.floor(d * 1000) / 1000, '.3f')}" for d in r.dosages], r.qual if r.qual is not None else ".", "GT:DS") for v, r in zip(sites(rows), rows)]
    return open_vcf(w.write_vcf(folder / "c.vcf", lines, SAMPLES), spark)


def _blocked(index: str | None, suffix: str = ".vcf.gz"):
    def write(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
        return open_vcf(w.write_bgzf_vcf(folder / f"c{suffix}", w.vcf_rows(sites(rows), hard(rows)), SAMPLES, block=8_000, index=index), spark)

    return write


def _bcf(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    gts = [[(0, 1) if p is None else (p[0] + 1 << 1, (p[1] + 1 << 1) | 1) for p in phases(r)] for r in rows]
    return open_vcf(w.write_bcf(folder / "c.bcf", [(v, r.qual, g, list(r.dosages)) for v, r, g in zip(sites(rows), rows, gts)], SAMPLES), spark)


def _bed(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    return bfile(w.write_plink1(folder / "c", hard(rows), sites(rows), SAMPLES), spark)


def _pgen(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    quals = ["." if r.qual is None else format(r.qual, ".0f") for r in rows]
    return pfile(w.write_plink2(folder / "c", hard(rows), sites(rows), SAMPLES, quals), spark)


def _pgen_compressed(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    import zstandard

    w.write_plink2(folder / "c", hard(rows), sites(rows), SAMPLES)
    plain = folder / "c.pvar"
    (folder / "c.pvar.zst").write_bytes(zstandard.ZstdCompressor().compress(plain.read_bytes()))
    plain.unlink()
    return pfile(folder / "c", spark)


def _pgen_records(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    return pfile(w.write_pgen_records(folder / "c", w.pgen_records(hard(rows)), sites(rows), SAMPLES), spark)


def _pgen_phased(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    records = []
    for r in rows:
        codes = [3 if c is None else int(c) for c in r.calls]
        first = [int(not second) for c, second in zip(codes, r.first) if c == 1]
        records.append((0x10, w.pack(codes) + w.bits([0, *first])))
    return pfile(w.write_pgen_records(folder / "c", records, sites(rows), SAMPLES), spark)


def _fine(d: float | None) -> float | None:
    return None if d is None else math.floor(d * 16384) / 16384


def _pgen_dosages(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    return pfile(w.write_plink2(folder / "c", hard(rows), sites(rows), SAMPLES, None, [[_fine(d) for d in r.dosages] for r in rows]), spark)


def _pgen_record_dosages(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    """Dosages of some samples only: of those called 1, in a bit array; the others keep their hard call."""
    records = []
    for r in rows:
        codes = [3 if c is None else int(c) for c in r.calls]
        stored = [int(c == 1) for c in codes]
        values = b"".join(struct.pack("<H", int(_fine(d) * 16384)) for d, s in zip(r.dosages, stored) if s)
        records.append((0x60, w.pack(codes) + w.bits(stored) + values) if any(stored) else (0x00, w.pack(codes)))
    return pfile(w.write_pgen_records(folder / "c", records, sites(rows), SAMPLES), spark)


def _pgen_phased_dosages(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    totals = [[_fine(d) for d in r.dosages] for r in rows]
    apart = [[None if t is None else (-1 if second else 1) * math.floor(min(t, 2 - t) * 4096) / 16384 for t, second in zip(row, r.first)] for row, r in zip(totals, rows)]
    return pfile(w.write_plink2(folder / "c", hard(rows), sites(rows), SAMPLES, None, totals, apart), spark)


def _bgen(compression: int, index: bool = False):
    def write(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
        blocks = [w.bgen_block([None if d is None else ((255 - math.floor(d * 127)) // 2, math.floor(d * 127)) for d in r.dosages]) for r in rows]
        return open_bgen(w.write_bgen(folder / "c.bgen", blocks, sites(rows), SAMPLES, compression, index=index), spark)

    return write


def _bgen_phased(folder: Path, rows: list[Row], spark: SparkSession) -> Dataset:
    most = (1 << 16) - 1
    blocks = [w.bgen_block([None if p is None else (most * (1 - p[0]), most * (1 - p[1])) for p in phases(r)], True, 16) for r in rows]
    (folder / "c.sample").write_text("ID_1 ID_2\n0 0\n" + "".join(f"{s} {s}\n" for s in SAMPLES))
    return open_bgen(w.write_bgen(folder / "c.bgen", blocks, sites(rows), SAMPLES, 2, with_samples=False), spark)


# ---- queries ----


def _long(frame: DataFrame, digits: int | None = None) -> DataFrame:
    out = frame.select("id", F.posexplode("calls").alias("at", "value"))
    value = F.col("value").cast("double")
    return out.select("id", F.col("at").cast("long").alias("row_idx"), (F.round(value, digits) if digits else value).alias("value"))


def _register(name: str, sql: str, write, digits: int | None = None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(write(shared_path(spark), cohort(spark, sf_dir), spark).frame(**options), digits)

    run.__doc__ = f"The cohort of {write.__name__.strip('_')} files, read with {options or 'no options'}."
    QUERIES[name], SQL[name] = run, sql


_CALLS = E_SQL + "SELECT 'rs' || variant_idx AS id, sample_idx AS row_idx, value::DOUBLE AS value FROM g"
_KEPT_CALLS = E_SQL + "SELECT e.id, sample_idx AS row_idx, value::DOUBLE AS value FROM g JOIN e USING (variant_idx) JOIN st USING (variant_idx) WHERE "
_HAPLOTYPES = _HAPLO_SQL + "SELECT 'rs' || variant_idx AS id, row_idx, value::DOUBLE AS value FROM h"
_REGION, _IN_REGION = f.region("3:2000-4500"), "e.chrom = '3' AND e.pos BETWEEN 2000 AND 4500"
_FILTER = f.snp() & f.maf(min=0.1) & f.missing_rate(0.06)
_PASSES = f"strlen(e.a0) = 1 AND st.maf >= {_f32(0.1)} AND st.missing_rate <= {_f32(0.06)}"


def _dosage_sql(value: str) -> str:
    return E_SQL + f"SELECT 'rs' || variant_idx AS id, sample_idx AS row_idx, {value} AS value FROM g"


for _name, _write in {"vcf": _vcf, "bgzf": _blocked(None, ".vcf.bgz"), "bcf": _bcf, "bed": _bed, "pgen": _pgen, "pgen_zst": _pgen_compressed, "pgen_records": _pgen_records}.items():
    _register(f"file_{_name}_calls", _CALLS, _write)
for _name, _write in {"vcf": _vcf, "bed": _bed, "pgen_records": _pgen_records, "bcf": _bcf}.items():
    _register(f"file_{_name}_filtered", _KEPT_CALLS + _PASSES, _write, variants=_FILTER)
for _name, _write in {"tbi": _blocked("tbi"), "csi": _blocked("csi", ".vcf.bgz"), "bed": _bed, "pgen": _pgen}.items():
    _register(f"file_{_name}_region", _KEPT_CALLS + _IN_REGION, _write, variants=_REGION)
for _name, _write in {"vcf": _vcf_phased, "bcf": _bcf, "pgen": _pgen_phased}.items():
    _register(f"file_{_name}_haplotypes", _HAPLOTYPES, _write, kind="haplo")
_register("file_bgen_haplotypes", _HAPLOTYPES, _bgen_phased, kind="haplo", dosage="dosage")
_register("file_vcf_dosages", _dosage_sql("round(floor(dosage * 1000) / 1000, 3)"), _vcf_dosages, 3, dosage="dosage")
_register("file_bcf_dosages", _dosage_sql("dosage::FLOAT::DOUBLE"), _bcf, dosage="dosage")
_register("file_pgen_dosages", _dosage_sql("floor(dosage * 16384) / 16384"), _pgen_dosages, dosage="dosage")
_register("file_pgen_record_dosages", _dosage_sql("CASE WHEN value = 1 THEN floor(dosage * 16384) / 16384 ELSE value::DOUBLE END"), _pgen_record_dosages, dosage="dosage")
_SPLIT = """, t AS (SELECT variant_idx, sample_idx, x, floor(dosage * 16384) / 16384 AS t FROM g),
d AS (SELECT *, floor(least(t, 2 - t) * 4096) / 16384 * CASE WHEN x > 0 THEN -1 ELSE 1 END AS apart FROM t)
SELECT 'rs' || variant_idx AS id, 2 * sample_idx + k AS row_idx, (t + CASE WHEN k = 0 THEN apart ELSE -apart END) / 2 AS value FROM d, (SELECT unnest([0, 1]) AS k)"""
_register("file_pgen_phased_dosages", E_SQL + _SPLIT, _pgen_phased_dosages, kind="haplo", dosage="dosage")
_EXPECTED = "(p + 2 * (255 - (255 - p) // 2 - p)) / 255.0::DOUBLE"
_BGEN = E_SQL + f", p AS (SELECT *, floor(dosage * 127)::BIGINT AS p FROM g) SELECT e.id, sample_idx AS row_idx, round({_EXPECTED}, 5) AS value FROM p JOIN e USING (variant_idx)"
for _name, _compression in (("plain", 0), ("zlib", 1), ("zstd", 2)):
    _register(f"file_bgen_{_name}_dosages", _BGEN, _bgen(_compression), 5, dosage="dosage")
_register("file_bgi_region", _BGEN + " WHERE " + _IN_REGION, _bgen(1, index=True), 5, dosage="dosage", variants=_REGION)


def _variants(write):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The variants that a format's files name."""
        return write(shared_path(spark), cohort(spark, sf_dir), spark).variants()

    return run


for _name, _write in {"vcf": _vcf, "bgzf": _blocked("tbi"), "bcf": _bcf, "bim": _bed, "pvar": _pgen, "pvar_zst": _pgen_compressed, "bgen": _bgen(2), "bgi": _bgen(1, index=True)}.items():
    QUERIES[f"file_{_name}_variants"] = _variants(_write)
    SQL[f"file_{_name}_variants"] = E_SQL + "SELECT chrom, pos, id, a0, a1 FROM e"


def _samples(write):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The samples that a format's files name."""
        return write(shared_path(spark), cohort(spark, sf_dir)[:4], spark).samples()

    return run


_NO_SAMPLES = "NULL::VARCHAR AS fid, 'S' || k AS iid, NULL::VARCHAR AS father, NULL::VARCHAR AS mother, NULL::VARCHAR AS sex, NULL::VARCHAR AS phenotype"
_SAMPLE_SQL = {
    "vcf": (_vcf, _NO_SAMPLES), "bcf": (_bcf, _NO_SAMPLES), "bgen": (_bgen(0), _NO_SAMPLES), "sample": (_bgen_phased, _NO_SAMPLES),
    "fam": (_bed, "'F' || k AS fid, 'S' || k AS iid, NULL::VARCHAR AS father, NULL::VARCHAR AS mother, (1 + k % 2)::VARCHAR AS sex, '-9' AS phenotype"),
    "psam": (_pgen, "NULL::VARCHAR AS fid, 'S' || k AS iid, NULL::VARCHAR AS father, NULL::VARCHAR AS mother, (1 + k % 2)::VARCHAR AS sex, 'NA' AS phenotype"),
}
for _name, (_write, _columns) in _SAMPLE_SQL.items():
    QUERIES[f"file_{_name}_samples"] = _samples(_write)
    SQL[f"file_{_name}_samples"] = f"SELECT {_columns} FROM (SELECT unnest(range(0, 64)) AS k)"


def file_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of several regions, each read of its own through an index."""
    ds = _blocked("tbi")(shared_path(spark), cohort(spark, sf_dir), spark)
    asked = ["2:1000-2000", "5:3000-9000", "12:1-5"]
    found = [(k, i) for k, (_, (_, variants)) in enumerate(ds.iter_regions([f.region(a) for a in asked], return_variants=True)) for i in variants["id"]]
    return spark.createDataFrame(found, "region_idx long, id string")


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and called values of the blocks that an iterator over a file gives."""
    ds = _bed(shared_path(spark), cohort(spark, sf_dir), spark)
    with ds.iter_blocks(128, variants=f.maf(min=0.2), return_variants=True) as blocks:
        sums = [(k, int(matrix.shape[1]), str(variants["id"].iloc[0]), float((matrix >= 0).sum())) for k, (matrix, variants) in enumerate(blocks)]
    return spark.createDataFrame(sums, "block_idx long, n_variants long, first_id string, n_called double")


QUERIES |= {"file_regions": file_regions, "file_blocks": file_blocks}
SQL["file_regions"] = E_SQL + "SELECT CASE WHEN chrom = '2' THEN 0 ELSE 1 END::BIGINT AS region_idx, id FROM e WHERE (chrom = '2' AND pos BETWEEN 1000 AND 2000) OR (chrom = '5' AND pos BETWEEN 3000 AND 9000)"
SQL["file_blocks"] = E_SQL + f""", kept AS (SELECT e.id, nc, row_number() OVER (ORDER BY e.chrom::INTEGER, e.pos) - 1 AS k FROM e JOIN st USING (variant_idx) WHERE maf >= {_f32(0.2)})
SELECT (k // 128)::BIGINT AS block_idx, count(*)::BIGINT AS n_variants, arg_min(id, k) AS first_id, sum(nc)::DOUBLE AS n_called FROM kept GROUP BY 1"""
