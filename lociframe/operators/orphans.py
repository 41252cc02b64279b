"""References to records that don't exist.

Referable keys are range-partitioned and stored as sorted arrays of bounded
size, each with the moments that decide about its keys.  The different values that
references have find their range by binary search over the ranges' lowest keys, and
each block of them is probed against its range by one vectorised binary search.  What
is found for a value then goes to its references; a value that a third of all rows
refers to is probed once, and only its one finding is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.plans import Workspace, sized_join, skew_join

#: Keys in one sorted array, unless that gave more than MOST_RANGES of them, and values in one block.
RANGE_KEYS, MOST_RANGES, BLOCK_ROWS = 20_000, 100_000, 50_000
NOBODY = ("0", ".", "NA")
MOMENTS = ("first", "last", "removed")


def key_table(samples: DataFrame, removals: DataFrame) -> DataFrame:
    """One row a loaded ``iid``: first and last load and last removal, in microseconds.

    Null ``iid`` are left out.  Null times don't count; a key whose loads all lack
    a time has null moments and is then never ``late`` or ``deleted``.
    """
    loads = samples.where(F.col("iid").isNotNull()).groupBy("iid").agg(F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"))
    gone = removals.where(F.col("iid").isNotNull()).groupBy("iid").agg(F.max("removed_at").alias("removed"))
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("first", "last", "removed")]
    return loads.join(gone, "iid", "left").select(F.col("iid").alias("key"), *micros)


def sorted_ranges(ws: Workspace, keys: DataFrame, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Rows ``(lowest, key[], first[], last[], removed[])`` of at most ``range_keys`` sorted keys each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            columns = [pa.array([table.column("key")[0].as_py()])]
            for name in table.schema.names:
                values = table.column(name).combine_chunks()
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(columns, names=["lowest", *table.schema.names])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= range_keys:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, range_keys))
                held = table.slice(range_keys).to_batches()
                count -= range_keys
        if count:
            yield flush(pa.Table.from_batches(held))

    schema = "lowest string, key array<string>, first array<bigint>, last array<bigint>, removed array<bigint>"
    ordered = keys.select("key", "first", "last", "removed").repartitionByRange("key").sortWithinPartitions("key")
    return ws.store(ordered.mapInArrow(pack, schema), "ranges")


def _probe(values: pa.Table, ranges: pa.Table) -> pa.Table:
    """The moments of those values of one block that one sorted array holds."""
    value = values.column("ref").to_numpy(zero_copy_only=False)
    if not ranges.num_rows or not len(value):
        return pa.table({"ref": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in MOMENTS}})
    row = ranges.slice(0, 1)
    held = row.column("key")[0].values.to_numpy(zero_copy_only=False)
    at = np.searchsorted(held, value)
    at[at == len(held)] = 0
    known = np.flatnonzero(held[at] == value)
    place = pa.array(at[known])
    return pa.table({"ref": values.column("ref").take(pa.array(known)), **{c: row.column(c)[0].values.take(place) for c in MOMENTS}})


def found_values(ws: Workspace, values: DataFrame, keys: DataFrame, range_keys: int = RANGE_KEYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``ref`` and the moments of those different ``ref`` values that are keys."""
    spark = values.sparkSession
    keys = ws.store(keys, "keys")
    ranges = sorted_ranges(ws, keys, max(range_keys, -(-keys.count() // MOST_RANGES)))
    # one short string a range, and a partition's last range: MOST_RANGES and the partitions at most
    lows = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in ranges.select("lowest").collect()), dtype=object))

    def range_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ref in batches:
            yield pd.Series(np.maximum(np.searchsorted(lows.value, ref.to_numpy(), side="right") - 1, 0), dtype="int64")

    find = F.pandas_udf(range_of, "bigint")
    placed = ws.store(values.select("ref", find("ref").alias("range_id")), "values")
    n_blocks = ws.store(placed.groupBy("range_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks")), "blocks")
    placed = sized_join(placed, n_blocks, "range_id", "inner", spread_by="ref").withColumn("block", F.pmod(F.xxhash64("ref"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    numbered = ranges.withColumn("range_id", find("lowest"))
    repeated = sized_join(numbered, n_blocks.toDF("range_id", "parts"), "range_id", "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = "ref string, " + ", ".join(f"{c} bigint" for c in MOMENTS)
    return placed.groupBy("range_id", "block").cogroup(repeated.groupBy("range_id", "block")).applyInArrow(_probe, schema)


def orphan_references(refs: DataFrame, keys: DataFrame, range_keys: int = RANGE_KEYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """References of ``refs`` that nobody answers to.

    ``refs`` has ``table_name, row_id, ref_field, ref, loaded_at``; ``keys`` comes
    from :func:`key_table`.  Result: ``table_name, row_id, ref_field,
    orphan_kind, load_month``, the kind being the first that holds of ``missing``,
    ``deleted`` (last removal after the last load) and ``late`` (first load after
    the referring row's).  Null, ``0``, ``.`` and ``NA`` refer to nobody; a row
    without load time has a null month and is never ``late``.  Repeated references
    come out each; without keys all references are missing.
    """
    ws = Workspace(refs.sparkSession, "orphans")
    some = refs.where(F.col("ref").isNotNull() & ~F.col("ref").isin(*NOBODY))
    told = found_values(ws, some.select("ref").distinct(), keys, range_keys, block_rows).withColumn("known", F.lit(True))
    placed = some.select(
        "table_name", F.col("row_id").cast("long").alias("row_id"), "ref_field", "ref", F.date_format("loaded_at", "yyyy-MM").alias("load_month"),
        F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded"),
    )
    judged = skew_join(placed, ws.store(told, "found"), "ref", "left", spread_by="row_id")
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("removed") > F.col("last"), "deleted").when(F.col("first") > F.col("loaded"), "late")
    return judged.select("table_name", "row_id", "ref_field", kind.alias("orphan_kind"), "load_month").where(F.col("orphan_kind").isNotNull())


def sample_references(samples: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Parent values of samples and the ``iid`` of phenotypes, one row a reference."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("ref")) for f in ("father", "mother")])).alias("r")
    parents = samples.select(F.lit("samples").alias("table_name"), F.col("sample_idx").alias("row_id"), "loaded_at", fields).select("table_name", "row_id", "r.ref_field", "r.ref", "loaded_at")
    traits = phenotypes.select(F.lit("phenotypes").alias("table_name"), F.col("pheno_id").alias("row_id"), F.lit("iid").alias("ref_field"), F.col("iid").alias("ref"), "loaded_at")
    return parents.unionByName(traits)


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Number of orphan references a table, month, field and kind."""
    return orphans.groupBy("table_name", "load_month", "ref_field", "orphan_kind").agg(F.count("*").alias("n_orphans"))
