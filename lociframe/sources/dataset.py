"""Reusable handles on genotype sources: metadata, whole reads, blocks and regions."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.errors import InvalidOptionError, InvalidSourceError, MissingDataError, SampleFilterError, UnsupportedRepresentation, untagged
from lociframe.filters import FilterExpr, as_filter
from lociframe.functions.alleles import with_stats
from lociframe.operators import cohort as ops
from lociframe.plans.predicates import NO, concrete_region, simplify, uses_stats
from lociframe.sources import bcf, bgen, plink, resolve, vcf
from lociframe.sources.datasource import register
from lociframe.streaming.blocks import BlockIterator

SAMPLE_SCHEMA = "sample_idx bigint, " + ", ".join(f"{c} string" for c in ops.SAMPLE_COLUMNS)
#: Cells that a read may bring to the driver.
MOST_CELLS = 2_000_000_000


@contextmanager
def public_errors() -> Iterator[None]:
    """Raise errors of executors as the errors they are."""
    try:
        yield
    except Exception as error:
        known = untagged(error)
        if known is error:
            raise
        raise known from error


@dataclass(frozen=True)
class ReadOptions:
    """Checked options of a read."""

    kind: str = "geno"
    dosage: str = "hardcall"
    sparse: Any = False
    variants: Any = None
    samples: Any = None
    missing: str | None = None
    dtype: Any = "float32"
    return_samples: bool = False
    return_variants: bool = False

    def checked(self) -> ReadOptions:
        """The same options, normalised; the first that isn't allowed raises."""
        if self.kind not in ("geno", "haplo"):
            raise UnsupportedRepresentation(f"unknown kind {self.kind!r}")
        if self.dosage not in ("hardcall", "dosage"):
            raise InvalidOptionError(f"unknown dosage {self.dosage!r}")
        known = {"csc": "csc", "csr": "csr"}
        form = None if self.sparse is False else "csc" if self.sparse is True else known.get(self.sparse) if isinstance(self.sparse, str) else None
        if form is None and self.sparse is not False:
            raise InvalidOptionError(f"unknown sparse form {self.sparse!r}")
        missing = self.missing if self.missing is not None else "raise" if form else "nan"
        if missing not in ("nan", "raise", "impute"):
            raise InvalidOptionError(f"unknown missing-data policy {missing!r}")
        chosen = as_filter(self.variants)
        try:
            dtype = np.dtype(self.dtype)
        except TypeError:
            raise InvalidOptionError(f"{self.dtype!r} is no dtype") from None
        if form and missing != "raise":
            raise InvalidOptionError("sparse values can't be missing; use missing='raise'")
        if missing != "raise" and not np.issubdtype(dtype, np.floating):
            raise InvalidOptionError(f"missing={missing!r} needs a floating dtype")
        if self.samples is not None:
            if not isinstance(self.samples, (list, tuple, set)) or not all(isinstance(s, str) for s in self.samples):
                raise InvalidOptionError("samples takes a list, tuple or set of sample IDs")
            if len(set(self.samples)) < len(self.samples):
                raise InvalidOptionError("a sample is named twice")
        for name in ("return_samples", "return_variants"):
            if not isinstance(getattr(self, name), bool):
                raise InvalidOptionError(f"{name} is true or false")
        return ReadOptions(self.kind, self.dosage, form, chosen, self.samples, missing, dtype, self.return_samples, self.return_variants)


@dataclass(frozen=True)
class SparseMatrix:
    """A sparse matrix as its three arrays, in column (``csc``) or row (``csr``) order."""

    form: str
    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    shape: tuple[int, int]

    def to_dense(self) -> np.ndarray:
        out = np.zeros(self.shape, dtype=self.data.dtype)
        major = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        out[(self.indices, major) if self.form == "csc" else (major, self.indices)] = self.data
        return out

    def to_scipy(self):
        import scipy.sparse

        return getattr(scipy.sparse, f"{self.form}_matrix")((self.data, self.indices, self.indptr), shape=self.shape)


@dataclass
class Dataset:
    """A resolved source.  Metadata are read once; calls are planned anew for each read."""

    source: resolve.Source
    spark: SparkSession
    _samples: DataFrame | None = field(default=None, repr=False)
    _sample_rows: list[dict] | None = field(default=None, repr=False)
    _variants: DataFrame | None = field(default=None, repr=False)

    # ---- metadata ----

    def sample_rows(self) -> list[dict]:
        """The samples in source order."""
        if self._sample_rows is None:
            s = self.source
            blank = dict.fromkeys(ops.SAMPLE_COLUMNS)
            if s.format == "vcf":
                rows = [blank | {"iid": i} for i in vcf.read_samples(s.path)]
            elif s.format == "bcf":
                rows = [blank | {"iid": i} for i in bcf.open_bcf(str(s.path))[1].samples]
            elif s.format == "plink1":
                rows = plink.read_fam(str(s.members["fam"]))
            elif s.format == "plink2":
                rows = plink.read_psam(str(s.members["psam"]))
            else:
                beside = s.members.get("sample")
                rows = [blank | {"iid": i} for i in bgen.read_samples(str(s.path), str(beside) if beside else None, bgen.read_header(str(s.path)))]
            self._sample_rows = rows
        return self._sample_rows

    def sample_table(self) -> DataFrame:
        if self._samples is None:
            rows = [(k, *[r[c] for c in ops.SAMPLE_COLUMNS]) for k, r in enumerate(self.sample_rows())]
            self._samples = self.spark.createDataFrame(rows, SAMPLE_SCHEMA)
        return self._samples

    def samples(self, **options: object) -> DataFrame:
        """The six sample columns, in source order."""
        _no_options(options)
        return self.sample_table().orderBy("sample_idx").select(*ops.SAMPLE_COLUMNS)

    def variant_table(self) -> DataFrame:
        """Variants with their ordinal and the columns that filters use."""
        if self._variants is None:
            if self.source.format == "vcf":
                self._variants = vcf.variants(vcf.lines(self.spark, self.source.path), str(self.source.path)).drop("f", "is_record")
            else:
                self._variants = self._load({"content": "variants"}).drop("calls", "counted", "error")
        return self._variants

    def variants(self, stats: object = None, **options: object) -> DataFrame:
        """The five variant columns, in source order."""
        if stats is not None:
            raise InvalidOptionError("variant statistics aren't part of the variant frame")
        _no_options(options)
        return self.variant_table().orderBy("variant_idx").select(*ops.VARIANT_COLUMNS)

    def phased(self) -> bool:
        """Whether a VCF or BCF file holds any phased genotype; PLINK 2 and BGEN files tell it for each variant."""
        s = self.source
        if s.format == "vcf":
            return not vcf.lines(self.spark, s.path).where(F.col("line").rlike(r"\t[0-9.]+\|[0-9.]+")).isEmpty()
        return s.format == "bcf" and any(bcf.any_phased(fields, n) for _, fields, n in bcf.records(*bcf.open_bcf(str(s.path))))

    # ---- calls ----

    def _load(self, options: dict) -> DataFrame:
        register(self.spark)
        files = {k: str(p.resolve()) for k, p in self.source.members.items()}
        return self.spark.read.format("lociframe").option("source", json.dumps({"format": self.source.format, "files": files} | options)).load()

    def _places(self, samples) -> list[int] | None:
        if samples is None:
            return None
        ids = [r["iid"] for r in self.sample_rows()]
        at = [k for k, i in enumerate(ids) if i in set(samples)]
        if len(at) != len(samples) or len({ids[k] for k in at}) != len(samples):
            missing = len(set(samples) - set(ids))
            raise SampleFilterError(f"of {len(samples)} requested samples {len(at)} were retained and {missing} are missing")
        return at

    def frame(self, **options: Any) -> DataFrame:
        """Retained variants as wide rows: ``variant_idx``, the five columns and ``calls``.

        This is the form to compute with at any size; :meth:`read` brings it to the driver.
        """
        o = ReadOptions(**options).checked()
        resolve.check_support(self.source.format, o.kind, o.dosage, bool(o.sparse))
        return self._frame(o, self._places(o.samples))

    def _frame(self, o: ReadOptions, places: list[int] | None, named: bool = True) -> DataFrame:
        node = simplify(o.variants)
        region = None if node is NO else concrete_region(node)
        if self.source.format == "vcf":
            indexed = region if self.source.path.suffix in (".gz", ".bgz") else None
            typed = vcf.variants(vcf.lines(self.spark, self.source.path, indexed), str(self.source.path))
            wide = vcf.with_calls(typed, list(range(len(self.sample_rows()))) if places is None else places, o.kind, o.dosage, uses_stats(node))
        else:
            wide = self._load({"kind": o.kind, "dosage": o.dosage, "keep": places, "named": named or node.kind != "yes"})
            if region:
                wide = wide.where((F.col("chrom") == region[0]) & (F.col("pos") >= region[1]) & (F.col("pos") <= region[2]))
        wide = ops.read_variants(wide, o.variants, o.missing, failed="error", counted="counted" if o.kind == "haplo" else None)
        if o.sparse and (o.kind == "geno" or self.source.format in resolve.TURNED_HAPLOTYPES):
            wide = ops.orient_minor(wide, most=1 if o.kind == "haplo" else 2)
        return wide.select("variant_idx", *ops.VARIANT_COLUMNS, "calls")

    def stats(self, **options: Any) -> DataFrame:
        """Retained variants with the allele statistics of the selected samples."""
        return with_stats(self.frame(**options)).drop("calls")

    def diagnostics(self, **options: Any) -> DataFrame:
        """One row: samples and variants offered, retained and dropped."""
        o = ReadOptions(**options).checked()
        places = self._places(o.samples)
        n = len(self.sample_rows())
        return ops.diagnostics(self.variant_table(), self._frame(o, places), n, n if places is None else len(places))

    def create_views(self, prefix: str, **options: Any) -> None:
        """Temporary views ``<prefix>_samples``, ``<prefix>_variants`` and ``<prefix>_calls`` for SQL."""
        self.sample_table().createOrReplaceTempView(f"{prefix}_samples")
        self.variant_table().createOrReplaceTempView(f"{prefix}_variants")
        self.frame(**options).createOrReplaceTempView(f"{prefix}_calls")

    def samples_frame(self, o: ReadOptions, places: list[int] | None) -> pd.DataFrame:
        rows = [self.sample_rows()[k] for k in (range(len(self.sample_rows())) if places is None else places)]
        frame = pd.DataFrame(rows, columns=list(ops.SAMPLE_COLUMNS), dtype=object)
        if o.kind == "haplo":
            frame = frame.loc[frame.index.repeat(2)].reset_index(drop=True)
            at = range(len(self.sample_rows())) if places is None else places
            frame["source_sample_index"] = np.repeat(np.array(list(at), dtype=np.int64), 2)
            frame["haplotype_index"] = np.tile(np.array([0, 1], dtype=np.int64), len(rows))
        return frame

    def assemble(self, rows: list, o: ReadOptions, places: list[int] | None):
        """The result of a block from its rows in source order: the matrix, or a tuple with metadata."""
        dense = np.array([r.calls for r in rows], dtype=np.float32).reshape(len(rows), self._width(o, places))
        variants = pd.DataFrame([[r[c] for c in ops.VARIANT_COLUMNS] for r in rows], columns=list(ops.VARIANT_COLUMNS)) if o.return_variants else None
        return self._result(dense, variants, o, places)

    def _width(self, o: ReadOptions, places: list[int] | None) -> int:
        return (len(self.sample_rows()) if places is None else len(places)) * (2 if o.kind == "haplo" else 1)

    def _result(self, dense: np.ndarray, variants: pd.DataFrame | None, o: ReadOptions, places: list[int] | None):
        """The result of variants x samples values: the matrix, or a tuple with metadata."""
        if o.sparse:
            matrix = _sparse(dense, o)
        else:
            matrix = np.ascontiguousarray(dense.T).astype(o.dtype)
        out: list = [matrix]
        if o.return_samples:
            out.append(self.samples_frame(o, places))
        if o.return_variants:
            out.append(variants)
        return tuple(out) if len(out) > 1 else matrix

    def read(self, **options: Any):
        """A samples x variants matrix on the driver, with sample and variant frames if asked for.

        Retained variants and samples keep the source's order.  Results above
        MOST_CELLS are refused; they are for :meth:`frame` and :meth:`iter_blocks`.
        """
        o = ReadOptions(**options).checked()
        resolve.check_support(self.source.format, o.kind, o.dosage, bool(o.sparse))
        places = self._places(o.samples)
        n = len(self.sample_rows()) if places is None else len(places)
        with public_errors():
            frame = self._frame(o, places, o.return_variants).select("variant_idx", *(ops.VARIANT_COLUMNS if o.return_variants else ()), "calls")
            bound = self._most_variants()
            if (bound is None or bound * max(1, n) > MOST_CELLS) and frame.count() * max(1, n) > MOST_CELLS:
                raise InvalidOptionError(f"the result has more than {MOST_CELLS} cells; use frame() or iter_blocks()")
            table = frame.toArrow()
        # rows come in any order; sorting their numbers here spares a sort of the whole rows
        order = np.argsort(table.column("variant_idx").to_numpy(), kind="stable")
        values = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("calls").chunks]
        dense = np.concatenate(values).astype(np.float32, copy=False) if values else np.zeros(0, dtype=np.float32)
        dense = dense.reshape(len(order), self._width(o, places))[order]
        variants = table.select(list(ops.VARIANT_COLUMNS)).to_pandas().iloc[order].reset_index(drop=True) if o.return_variants else None
        return self._result(dense, variants, o, places)

    def _most_variants(self) -> int | None:
        """A bound of the source's variants that headers and sizes give; none for compressed text and BCF."""
        s = self.source
        if s.format == "plink1":
            return plink.bed_count(str(s.members["bed"]), len(self.sample_rows()))
        if s.format == "plink2":
            return plink.pgen_header(str(s.members["pgen"])).n_variants
        if s.format == "bgen":
            return bgen.read_header(str(s.path)).n_variants
        # a line has two bytes a sample at least
        return s.path.stat().st_size // (2 * max(1, len(self.sample_rows()))) if s.format == "vcf" and s.path.suffix == ".vcf" else None

    def iter_blocks(self, size: int, **options: Any) -> BlockIterator:
        """Consecutive blocks of at most ``size`` retained variants, each as :meth:`read` gives it."""
        if isinstance(size, bool) or not isinstance(size, int) or size < 1 or size > sys.maxsize:
            raise InvalidOptionError("a block has a positive whole number of variants")
        o = ReadOptions(**options).checked()
        resolve.check_support(self.source.format, o.kind, o.dosage, bool(o.sparse))
        places = self._places(o.samples)
        return BlockIterator(lambda: self._frame(o, places).orderBy("variant_idx"), size, lambda rows: self.assemble(rows, o, places), self.spark, untagged)

    def iter_regions(self, regions: Iterable[FilterExpr], **options: Any) -> Iterator[tuple]:
        """``(region, result)`` of one read for each region, in order."""
        if "variants" in options:
            raise InvalidOptionError("iter_regions takes its variants from the regions")
        return ((r, self.read(variants=r, **options)) for r in regions)


def _no_options(options: dict) -> None:
    if options:
        raise InvalidOptionError(f"unknown options {', '.join(sorted(options))}")


def _sparse(dense: np.ndarray, o: ReadOptions) -> SparseMatrix:
    """Columns or rows of the nonzero cells of a variants x samples matrix."""
    if np.isnan(dense).any():
        raise MissingDataError("sparse values can't be missing")
    major = dense if o.sparse == "csc" else dense.T
    at, minor = np.nonzero(major)
    if len(at) > np.iinfo(np.int32).max or max(major.shape) > np.iinfo(np.int32).max:
        raise InvalidSourceError("the sparse result doesn't fit 32-bit indices")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=major.shape[0]))]).astype(np.int32)
    return SparseMatrix(o.sparse, indptr, minor.astype(np.int32), major[at, minor].astype(o.dtype), dense.T.shape)


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def open_vcf(path: str | Path, spark: SparkSession | None = None) -> Dataset:
    """A dataset on a ``.vcf``, ``.vcf.gz``, ``.vcf.bgz`` or ``.bcf`` file."""
    return Dataset(resolve.resolve_vcf(path), _session(spark))


def bfile(path: str | Path, spark: SparkSession | None = None) -> Dataset:
    """A dataset on a BED/BIM/FAM set."""
    return Dataset(resolve.resolve_bfile(path), _session(spark))


def pfile(path: str | Path, spark: SparkSession | None = None) -> Dataset:
    """A dataset on a PGEN/PVAR/PSAM set."""
    return Dataset(resolve.resolve_pfile(path), _session(spark))


def open_bgen(path: str | Path, spark: SparkSession | None = None) -> Dataset:
    """A dataset on a BGEN file."""
    return Dataset(resolve.resolve_bgen(path), _session(spark))
