"""Genotype files as Spark data sources.

The driver reads headers and indexes and parts the file by records or blocks; each
part is read and decoded by one task, which seeks to its bytes.  Files must be on
paths that all executors see.  Samples are selected while decoding; equality on
``chrom`` and bounds on ``pos`` are pushed into the source.

Two sources are registered: ``lociframe`` gives wide rows of PLINK, BGEN and BCF
files, and ``lociframe_lines`` gives lines of blocked gzip files.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from lociframe.errors import InvalidSourceError, UnsupportedRepresentation, tag
from lociframe.session import reach_workers
from lociframe.sources import bcf, bgen, bgzf, plink

WIDE_SCHEMA = (
    "variant_idx bigint, chrom string, pos bigint, id string, a0 string, a1 string, ref_allele string, alt_allele string, "
    "qual float, calls array<float>, counted array<float>, error string"
)
_ARROW = pa.schema(
    [("variant_idx", pa.int64()), ("chrom", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("a0", pa.string()), ("a1", pa.string())]
    + [("ref_allele", pa.string()), ("alt_allele", pa.string()), ("qual", pa.float32()), ("calls", pa.list_(pa.float32())), ("counted", pa.list_(pa.float32())), ("error", pa.string())]
)
#: Variants of a task at least and at most, its cells, unless the format forces others, and cells of an Arrow batch.
LEAST_PART, MOST_PART, PART_CELLS, BATCH_CELLS = 256, 8_192, 1 << 22, 1 << 20


def part_variants(n_samples: int) -> int:
    """Variants of a task over files of so many samples."""
    return max(LEAST_PART, min(MOST_PART, PART_CELLS // max(1, n_samples)))


class Span(InputPartition):
    """Variants ``first`` to ``last`` (not included) with what a format needs to find them."""

    def __init__(self, first: int, last: int, **places):
        super().__init__((first, last))
        self.first, self.last, self.places = first, last, places


#: The four calls of every BED byte.
BED_BYTES = plink.BED_CALLS[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3].astype(np.float32)


def _nulls(values: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.float32(), from_pandas=True)


class _Rows:
    """Collects decoded variants into record batches."""

    def __init__(self, with_calls: bool, with_counted: bool):
        self.with_calls, self.with_counted = with_calls, with_counted
        self.clear()

    def clear(self) -> None:
        self.meta: list[tuple] = []
        self.calls: list[np.ndarray] = []
        self.counted: list[np.ndarray] = []
        self.errors: list[str | None] = []
        self.cells = 0

    def add(self, number: int, meta: tuple, decode) -> None:
        none = np.zeros(0, dtype=np.float32)
        calls, counted, error = none, none, None
        if self.with_calls:
            try:
                calls, counted = decode()
            except (InvalidSourceError, UnsupportedRepresentation) as e:
                error, counted = tag(type(e), str(e)), getattr(e, "counted", None)
                counted = none if counted is None else counted
        self.meta.append((number, *meta))
        self.calls.append(calls)
        self.counted.append(counted if self.with_counted else none)
        self.errors.append(error)
        self.cells += len(calls) + len(counted) + 16

    def full(self) -> bool:
        return self.cells >= BATCH_CELLS

    def batch(self) -> pa.RecordBatch:
        def lists(parts: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), _nulls(np.concatenate(parts) if parts else np.zeros(0, np.float32)))

        columns = [pa.array(c, type=_ARROW.field(k).type) for k, c in enumerate(zip(*self.meta))]
        out = pa.RecordBatch.from_arrays([*columns, lists(self.calls), lists(self.counted), pa.array(self.errors, pa.string())], schema=_ARROW)
        self.clear()
        return out


class WideReader(DataSourceReader):
    """Reads one file or file set; subclasses know a format.

    Members: ``files``, ``content`` (``variants`` skips genotypes), ``kind``,
    ``dosage``, ``keep`` (ordinals of selected samples, or none for all) and ``named``
    (whether the metadata of variants are wanted, where they lie in a file of their own).
    """

    def __init__(self, options: dict):
        self.files = options["files"]
        self.with_calls = options.get("content", "calls") == "calls"
        self.kind, self.dosage, self.keep = options.get("kind", "geno"), options.get("dosage", "hardcall"), options.get("keep")
        self.named = options.get("named", True)
        # bounds of pushed filters only: 0 is a position too, that of unplaced variants
        self.chrom: str | None = None
        self.low, self.high = 0, (1 << 32) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chrom = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("pos",):
                self.low = max(self.low, int(f.value))
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("pos",):
                self.high = min(self.high, int(f.value))
            yield f  # Spark checks all of them again

    def region(self) -> tuple[str, int, int] | None:
        return (self.chrom, self.low, self.high) if self.chrom is not None else None

    def outside(self, meta: tuple) -> bool:
        return (self.chrom is not None and meta[0] != self.chrom) or not self.low <= meta[1] <= self.high

    def unbounded(self) -> bool:
        return self.chrom is None and self.low == 0 and self.high == (1 << 32) - 1

    def kept(self, n: int) -> np.ndarray:
        return np.arange(n) if self.keep is None else np.array(self.keep, dtype=np.int64)

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        # calls of genotypes are what statistics count, so they are sent once
        rows = _Rows(self.with_calls, self.kind == "haplo")
        for number, meta, decode in self.variants(span):
            if meta[0] is not None and self.outside(meta):
                continue
            rows.add(number, meta, decode)
            if rows.full():
                yield rows.batch()
        if rows.meta:
            yield rows.batch()

    def variants(self, span: Span) -> Iterator[tuple]:
        raise NotImplementedError


def _line_places(path: str, every: int) -> tuple[list[int], int]:
    """Byte places of every ``every``-th non-blank line, and the number of such lines."""
    places, n, at = [], 0, 0
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                if n % every == 0:
                    places.append(at)
                n += 1
            at += len(line)
    return places, n


class Plink1Reader(WideReader):
    """BED records with their BIM lines, each task reading its own bytes of both."""

    def partitions(self) -> list[Span]:
        n = len(plink.read_fam(self.files["fam"]))
        part = part_variants(n)
        places, n_lines = _line_places(self.files["bim"], part)
        n_records = plink.bed_count(self.files["bed"], n)
        if n_lines != n_records:
            raise InvalidSourceError(f"{self.files['bed']} has {n_records} records, but the BIM file {n_lines} lines")
        return [Span(k * part, min(n_lines, (k + 1) * part), bim=p, samples=n) for k, p in enumerate(places)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        """Many records at once: those of a batch are decoded as one matrix."""
        n = span.places["samples"]
        keep, width = self.kept(n), -(-n // 4)
        step = max(1, BATCH_CELLS // max(1, 4 * width))
        named = self.named or not self.unbounded() or not self.with_calls
        with open(self.files["bim"], encoding="utf-8") as bim, open(self.files["bed"], "rb") as bed:
            bim.seek(span.places["bim"])
            lines = (x for x in bim if x.strip())
            for first in range(span.first, span.last, step):
                numbers = np.arange(first, min(first + step, span.last), dtype=np.int64)
                if named:
                    metas = [plink.parse_bim(line, self.files["bim"]) for line in islice(lines, len(numbers))]
                    inside = np.array([not self.outside(m) for m in metas], dtype=bool)
                    metas = [m for m, kept in zip(metas, inside) if kept]
                    numbers = numbers[inside]
                if not len(numbers):
                    continue
                columns = [pa.array(c, type=_ARROW.field(k + 1).type) for k, c in enumerate(zip(*metas))] if named else [pa.nulls(len(numbers), f.type) for f in list(_ARROW)[1:9]]
                calls = np.zeros((len(numbers), 0), dtype=np.float32)
                if self.with_calls:
                    bed.seek(3 + first * width)
                    packed = np.frombuffer(bed.read((int(numbers[-1]) + 1 - first) * width), dtype=np.uint8).reshape(-1, width)[numbers - first]
                    calls = BED_BYTES[packed].reshape(len(numbers), 4 * width)
                    calls = calls[:, :n] if self.keep is None else calls[:, keep]
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(numbers) + 1, dtype=np.int32)), pa.array([], pa.float32()))
                ends = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * calls.shape[1])
                lists = pa.ListArray.from_arrays(ends, _nulls(np.ascontiguousarray(calls).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *columns, lists, none, pa.nulls(len(numbers), pa.string())], schema=_ARROW)


class Plink2Reader(WideReader):
    """PGEN records with their PVAR lines.

    Tasks begin at records that don't refer back, and at the byte of their first
    PVAR line.  A compressed PVAR file can't be entered in the middle, so each task
    passes over the lines before its own.
    """

    def partitions(self) -> list[Span]:
        h = plink.pgen_header(self.files["pgen"])
        n = len(plink.read_psam(self.files["psam"]))
        if n != h.n_samples:
            raise InvalidSourceError(f"the PGEN file has {h.n_samples} samples, but the PSAM file {n}")
        starts = list(range(0, h.n_variants, part_variants(n)))
        if h.types is not None:
            fresh = np.flatnonzero((h.types & 6) != 2)
            starts = sorted({int(fresh[np.searchsorted(fresh, s, side="right") - 1]) for s in starts})
        header, places, n_lines = plink.pvar_places(self.files["pvar"], starts)
        if n_lines != h.n_variants:
            raise InvalidSourceError(f"the PGEN file has {h.n_variants} variants, but the PVAR file {n_lines}")
        return [Span(a, b, header=header, place=p) for a, b, p in zip(starts, [*starts[1:], h.n_variants], places) if a < b]

    def variants(self, span: Span) -> Iterator[tuple]:
        h = plink.pgen_header(self.files["pgen"])
        reader, keep = plink.PgenReader(h), self.kept(h.n_samples)
        with open(self.files["pgen"], "rb") as f:
            named = self.named or not self.unbounded() or not self.with_calls
            metas = plink.pvar_from(self.files["pvar"], span.places["header"], span.places["place"]) if named else repeat((None,) * 8)
            for number, meta in zip(range(span.first, span.last), metas):
                start, end = (h.first + number * h.width(), h.first + (number + 1) * h.width()) if h.types is None else h.offsets[number : number + 2]
                record = None
                if self.with_calls:  # rejected records too: later ones may refer to them
                    f.seek(int(start))
                    try:
                        record = reader.decode(f.read(int(end - start)), number)
                    except InvalidSourceError as e:
                        record = e

                def decode(record=record) -> tuple[np.ndarray, np.ndarray]:
                    if isinstance(record, Exception):
                        raise record
                    return plink.pgen_values(record, self.kind, self.dosage, keep)

                yield number, meta, decode


class BgenReader(WideReader):
    """BGEN variants; a region is found by the index beside the file if there is one.

    An index with another number of variants than the header isn't used: the file
    is walked instead.
    """

    def partitions(self) -> list[Span]:
        path = self.files["bgen"]
        h = bgen.read_header(path)
        whole = bgen.indexed(path, None)
        if whole is not None and len(whole) != h.n_variants:
            whole = None
        places = [p for p, _ in whole] if whole is not None else list(bgen.walk(path, h))
        sizes = dict(whole) if whole is not None else {}
        numbers = range(len(places))
        region = self.region()
        if region and whole is not None:
            hits = [p for p, _ in bgen.indexed(path, region)]
            numbers = [bisect.bisect_left(places, p) for p in hits]
        numbers, step = list(numbers), part_variants(h.n_samples)
        return [
            Span(part[0], part[-1] + 1, variants=[(k, places[k], sizes.get(places[k])) for k in part], compression=h.compression, samples=h.n_samples)
            for part in (numbers[i : i + step] for i in range(0, len(numbers), step))
        ]

    def variants(self, span: Span) -> Iterator[tuple]:
        n, compression = span.places["samples"], span.places["compression"]
        keep = self.kept(n)
        with open(self.files["bgen"], "rb") as f:
            for number, place, size in span.places["variants"]:
                f.seek(place)
                meta, at, length = bgen.read_variant(f, compression)
                if size is not None and at + length - place != size:
                    raise InvalidSourceError(tag(InvalidSourceError, "the BGEN index gives another record size"))

                def decode(at: int = at, length: int = length) -> tuple[np.ndarray, np.ndarray]:
                    f.seek(at)
                    return bgen.values(bgen.payload(f.read(length), compression), n, self.kind, keep)

                yield number, meta, decode


class BcfReader(WideReader):
    """BCF records; their places aren't known beforehand, so a file is one task."""

    def partitions(self) -> list[Span]:
        return [Span(0, -1)]

    def variants(self, span: Span) -> Iterator[tuple]:
        stream, header = bcf.open_bcf(self.files["bcf"])
        for number, (meta, fields, n) in enumerate(bcf.records(stream, header)):

            def decode(meta=meta, fields=fields, n=n) -> tuple[np.ndarray, np.ndarray]:
                if "," in meta[6]:
                    raise InvalidSourceError(f"record {meta[0]}:{meta[1]} has several alternate alleles")
                return bcf.values(fields, n, self.kind, self.dosage, self.kept(n))

            yield number, meta, decode


READERS = {"plink1": Plink1Reader, "plink2": Plink2Reader, "bgen": BgenReader, "bcf": BcfReader}


class GenotypeSource(DataSource):
    """Wide rows; the option ``source`` holds the reader's options as JSON."""

    @classmethod
    def name(cls) -> str:
        return "lociframe"

    def schema(self) -> str:
        return WIDE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = json.loads(self.options["source"])
        return READERS[options["format"]](options)


class LineReader(DataSourceReader):
    """Lines of a blocked gzip file: ranges of blocks, or the chunks of an index."""

    def __init__(self, options: dict):
        self.path, self.region = options["path"], options.get("region")
        self.blocks = options.get("blocks", 512)

    def partitions(self) -> list[Span]:
        if self.region:
            chunks = bgzf.region_chunks(self.path, *self.region)
            return [Span(a, b, split=False) for a, b in chunks] or [Span(0, 0, split=False, empty=True)]
        starts = bgzf.block_starts(self.path)[:: self.blocks]
        return [Span(a << 16, (b << 16) if b is not None else -1, split=True) for a, b in zip(starts, [*starts[1:], None])]

    def read(self, span: Span) -> Iterator[tuple]:
        if span.places.get("empty"):
            return
        end = None if span.last < 0 else span.last
        lines = bgzf.lines_between(self.path, span.first >> 16, None if end is None else end >> 16, span.first & 0xFFFF, 0 if end is None else end & 0xFFFF, span.places["split"])
        for place, line in lines:
            yield place, line


class LineSource(DataSource):
    """Lines with their virtual places, which are in file order."""

    @classmethod
    def name(cls) -> str:
        return "lociframe_lines"

    def schema(self) -> str:
        return "variant_idx bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(json.loads(self.options["source"]))


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, with filter pushdown."""
    reach_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GenotypeSource)
    spark.dataSource.register(LineSource)


__all__ = ["READERS", "WIDE_SCHEMA", "GenotypeSource", "LineSource", "register"]
