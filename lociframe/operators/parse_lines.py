"""Tab-parted variant lines: typed rows, or the reason why a line doesn't parse.

Lines are read by a quote-aware finite-state machine.  A batch of lines is one
run of symbols, cut into chunks of equal length without regard to lines.  For
each chunk the transition it makes from every state is computed, transitions are
composed over all chunks to find the state each one starts in, and a second pass
gives the state at every byte.  All passes run over whole chunks at once, so very
long lines cost no more a byte than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.plans import sized_join

# states of the machine
START, BARE, QUOTED, CLOSED, BROKEN = range(5)
# symbols
OTHER, TAB, QUOTE, END = range(4)
#: NEXT[symbol, state]; the end of a line always leads to the start of the next.
NEXT = np.array(
    [
        [BARE, BARE, QUOTED, BROKEN, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
CHUNK = 128


def states_before(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each symbol, by composing the transitions of chunks."""
    n = len(symbols)
    m = -(-n // chunk)
    padded = np.full(m * chunk, END, dtype=np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(m, chunk).T)
    flat = NEXT.ravel()
    # transition of each chunk: moves[i, s] is the state after chunk i begun in s
    moves = np.tile(np.arange(5, dtype=np.uint8), (m, 1))
    for column in columns:
        moves = flat[(column * np.uint8(5))[:, None] + moves]
    # inclusive composition over chunks, doubling the reach each time
    reach = 1
    while reach < m:
        moves[reach:] = np.take_along_axis(moves[reach:], moves[:-reach].copy(), axis=1)
        reach *= 2
    state = np.full(m, START, dtype=np.uint8)
    state[1:] = moves[:-1, START]
    out = np.empty((chunk, m), dtype=np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = flat[column * np.uint8(5) + state]
    return out.T.ravel()[:n]


_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("\t")], _CLASS[ord('"')] = TAB, QUOTE


def tokenize(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Whether each text is quoted rightly, and its fields without enclosing quotes."""
    return tokenize_with_places(text, False)[:2]


def tokenize_with_places(text: pa.Array, places: bool = True) -> tuple[pa.Array, ...]:
    """As :func:`tokenize`, and the bytes (from 0) where fields start and where quoting fails.

    Quoting fails at the first byte that mustn't stand there, or at the end of a
    text whose quote isn't closed (null if it doesn't fail); the failing field is
    the last one, as nothing is parted behind it.
    """
    text = text.fill_null("").cast(pa.large_string())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=n + 1 + text.offset)[text.offset :]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = offsets[1:] + np.arange(n)
    inside = np.ones(len(data) + n, dtype=bool)
    inside[ends] = False
    symbols = np.full(len(data) + n, END, dtype=np.uint8)
    symbols[inside] = _CLASS[data]
    raw = np.zeros(len(data) + n, dtype=np.uint8)
    raw[inside] = data
    before = states_before(symbols)
    last = before[ends]
    ok = (last != QUOTED) & (last != BROKEN)
    parts = (symbols == END) | ((symbols == TAB) & (before != QUOTED) & (before != BROKEN))
    enclosing = (symbols == QUOTE) & ((before == START) | (before == QUOTED))
    kept = ~parts & ~enclosing
    sizes = np.cumsum(kept)
    field_ends = np.flatnonzero(parts)
    value_offsets = np.zeros(len(field_ends) + 1, dtype=np.int64)
    value_offsets[1:] = sizes[field_ends]
    values = pa.LargeStringArray.from_buffers(len(field_ends), pa.py_buffer(value_offsets), pa.py_buffer(raw[kept].tobytes()))
    list_offsets = np.zeros(n + 1, dtype=np.int32)
    list_offsets[1:] = np.cumsum(parts)[ends]
    found = pa.array(ok), pa.ListArray.from_arrays(pa.array(list_offsets), values.cast(pa.string()))
    if not places:
        return found
    firsts = offsets[:-1] + np.arange(n)
    starts = np.zeros(len(field_ends), dtype=np.int64)
    starts[1:] = field_ends[:-1] + 1
    starts -= np.repeat(firsts, np.diff(list_offsets))
    breaks = np.flatnonzero((before != BROKEN) & (NEXT[symbols, before] == BROKEN))
    lines = np.searchsorted(ends, breaks)
    at = np.where(last == QUOTED, ends - firsts, -1)
    at[lines] = breaks - firsts[lines]
    return *found, pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(starts)), pa.array(at, mask=at < 0)


def _tokenize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, fields = tokenize(batch.column("text"))
        others = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in others], ok, fields], names=[*others, "quoted_rightly", "fields"])


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in others], *tokenize_with_places(batch.column("text"))], names=[*others, "quoted_rightly", "fields", "starts", "broken_at"])


def with_fields(lines: DataFrame, places: bool = False) -> DataFrame:
    """Rows with ``quoted_rightly`` and ``fields``, and with ``places`` also ``starts`` and ``broken_at``, in place of their ``text``."""
    others = [f for f in lines.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("quoted_rightly", T.BooleanType()), T.StructField("fields", T.ArrayType(T.StringType()))])
    if places:
        return lines.mapInArrow(_place_batches, schema.add("starts", T.ArrayType(T.LongType())).add("broken_at", T.LongType()))
    return lines.mapInArrow(_tokenize_batches, schema)


#: Column order of files without header, by number of fields (fixed values of the format).
PLAIN_ORDER = ("CHROM", "ID", "POS", "ALT", "REF")
CM_ORDER = ("CHROM", "ID", "CM", "POS", "ALT", "REF")
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL")


def layouts(files: DataFrame) -> DataFrame:
    """``file_id, n_fields`` and the place of each column (from 1, 0 if the file has none).

    Header names are compared without case.  Rows with a null ``file_id`` are left
    out; of several rows of a file the last received counts.
    """
    named = F.transform(F.split(F.regexp_replace("header_line", "\\A#+", ""), "\t"), lambda c: F.upper(F.trim(c)))
    plain = F.when(F.col("n_fields") <= 5, F.array(*map(F.lit, PLAIN_ORDER))).otherwise(F.array(*map(F.lit, CM_ORDER)))
    order = F.coalesce(named, plain)
    one = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max_by(F.struct("header_line", "n_fields"), F.struct("received_at", "header_line", "n_fields")).alias("f")).select("file_id", "f.*")
    return one.select("file_id", F.col("n_fields").cast("int").alias("n_fields"), *[F.array_position(order, c).cast("int").alias(f"at_{c.lower()}") for c in COLUMNS])


def _field(name: str) -> Column:
    at = F.col(f"at_{name}")
    return F.when(at > 0, F.get("fields", at - 1))


def fail_reason() -> Column:
    """The first reason that holds, null for a valid line; over the columns of :func:`parse_lines`."""

    def unless(good: Column) -> Column:
        return ~F.coalesce(good, F.lit(False))

    digits = F.regexp_replace(F.col("pos_text"), "\\A0+(?=[0-9])", "")
    pos_good = F.col("pos_text").rlike("\\A[0-9]+\\z") & (F.length(digits) <= 10) & (F.expr("try_cast(pos_text as decimal(38,0))") <= 4294967295)
    allele = "\\A(?:[ACGTNacgtn]+|\\*|\\.|<[A-Za-z0-9:_]+>)\\z"
    number = "\\A(?:\\.|[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\\z"
    return (
        F.when(~F.col("quoted_rightly"), "quoting")
        .when(unless(F.size("fields") == F.col("n_fields")), "columns")
        .when(unless(F.col("chrom").rlike("\\A[A-Za-z0-9]+\\z")), "chrom")
        .when(unless(pos_good), "pos")
        .when(unless(F.col("ref").rlike("\\A[ACGTNacgtn]+\\z")), "ref")
        .when(unless(F.forall(F.split("alt", ",", -1), lambda a: a.rlike(allele))), "alt")
        .when((F.col("at_qual") > 0) & unless(F.col("qual_text").rlike(number)), "qual")
    )


def _fail_places() -> list[Column]:
    """``field_ord``, ``field_start`` and ``fail_byte`` of a line that fails, over the columns of :func:`parse_lines`."""
    reason, size = F.col("fail_reason"), F.size("fields")
    value = F.coalesce(*[F.when((reason == c) & (F.col(f"at_{c}") > 0), F.col(f"at_{c}")) for c in ("chrom", "pos", "ref", "alt", "qual")])
    ord_ = F.when(reason == "quoting", size).when(reason == "columns", F.when(size > F.col("n_fields"), F.col("n_fields") + 1)).otherwise(value)
    start = F.get("starts", ord_ - 1)
    short = (reason == "columns") & (size < F.col("n_fields"))
    byte = F.when(reason == "quoting", F.col("broken_at")).when(short, F.col("n_bytes").cast("long")).otherwise(start)
    return [ord_.cast("int").alias("field_ord"), start.alias("field_start"), byte.alias("fail_byte")]


def parse_lines(lines: DataFrame, files: DataFrame, places: bool = False) -> DataFrame:
    """Every record line with its typed fields and ``fail_reason`` (null if it parses).

    Null, blank and ``##`` texts are no records.  A line of an unknown or null
    file fails with ``columns``.  Repeated lines come out as often as they occur.
    Only ``file_id``, ``line_number`` and ``text`` of ``lines`` are used, so other
    columns, also of clashing names, don't matter.  Valid lines have ``chrom``,
    ``pos``, ``id``, ``ref``, ``alt`` and, where the file has it, ``qual``.  With
    ``places`` a line that fails has the columns of :func:`line_errors` too.
    """
    records = lines.select("file_id", "line_number", "text").where(F.col("text").isNotNull() & (F.trim(F.translate("text", "\t\r\n", "   ")) != "") & ~F.col("text").startswith("##"))
    if places:
        records = records.withColumn("n_bytes", F.octet_length("text"))
    rows = sized_join(with_fields(records, places), layouts(files), "file_id", "left", spread_by="line_number")
    typed = rows.select(
        "file_id", "line_number", "quoted_rightly", "fields", "n_fields", "at_qual",
        _field("chrom").alias("chrom"), _field("pos").alias("pos_text"), _field("id").alias("id"),
        _field("ref").alias("ref"), _field("alt").alias("alt"), _field("qual").alias("qual_text"),
        *(["starts", "broken_at", "n_bytes", *[f"at_{c}" for c in ("chrom", "pos", "ref", "alt")]] if places else []),
    )
    out = ("file_id", "line_number", "chrom", "pos_text", "id", "ref", "alt", "qual_text", "fail_reason")
    judged = typed.withColumn("fail_reason", fail_reason())
    return judged.select(*out, *(_fail_places() if places else []))


def failed_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, line_number, fail_reason)`` of the lines that don't parse."""
    return parse_lines(lines, files).where(F.col("fail_reason").isNotNull()).select("file_id", "line_number", "fail_reason")


def line_errors(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines that don't parse with the place of the first failure.

    ``field_ord`` (from 1) and ``field_start`` name the failing field and the byte
    of the line, from 0, where it starts, quotes included; ``fail_byte`` is where
    quoting fails, the end of a line with too few fields, and else ``field_start``.
    With too many fields the first one too many fails.  A line with too few has no
    failing field; one of an unknown file, or whose file lacks the column, no place.
    """
    return parse_lines(lines, files, places=True).where(F.col("fail_reason").isNotNull()).select("file_id", "line_number", "fail_reason", "field_ord", "field_start", "fail_byte")


def valid_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines that parse as typed variants; a missing quality is null."""
    good = parse_lines(lines, files).where(F.col("fail_reason").isNull())
    return good.select("file_id", "line_number", "chrom", F.expr("try_cast(pos_text as bigint)").alias("pos"), "id", "ref", "alt", F.expr("try_cast(nullif(qual_text, '.') as double)").alias("qual"))
