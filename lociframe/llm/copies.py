"""Records that are equal but for their writing, counted in an incremental ledger.

The ledger is a table of canonical keys, bucketed and sorted by key, with the
number of copies and the earliest representative of each.  A new batch is
aggregated by key, joined bucket by bucket with the ledger in a full outer join,
and counts are added.  A batch costs one shuffle of its distinct keys; the ledger
itself is never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.plans import Workspace, skew_join
from lociframe.plans.joins import HOT_ROWS, MOST_HOT_KEYS, md5_key

#: The ASCII characters that are neither letters nor digits.
ASCII_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
FIELDS = ("chrom", "pos", "a0", "a1")
#: Rows with a null in these have no key.
NEEDED = (*FIELDS, "rec_id")


def _bare(value: Column) -> Column:
    return F.translate(F.lower(value), ASCII_SIGNS, "")


def _plain(value: Column, bare: Column) -> Column:
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, bare).otherwise(F.lower(F.regexp_replace(value, "[^\\p{L}\\p{N}]+", "")))


def plain(value: Column) -> Column:
    """The letters and digits of a text in lower case."""
    return _plain(value, _bare(value))


def keyed(feed: DataFrame, at: str | None = None) -> DataFrame:
    """``(key, rec_id)`` of rows that have all fields, with the column ``at`` if named.

    The key is of 128 bits, over ``chrom``, ``pos`` and the two alleles in either
    order.  Each step is a projection of its own, so that none is worked out twice.
    """
    cols = ["rec_id", *([at] if at else [])]
    whole = feed.select(*FIELDS, *cols).dropna(subset=[*NEEDED])
    bare = whole.select(*FIELDS, *cols, *[_bare(F.col(c)).alias(f"bare_{c}") for c in FIELDS])
    told = bare.select(*cols, *[_plain(F.col(c), F.col(f"bare_{c}")).alias(c) for c in FIELDS])
    ordered = told.select(*cols, "chrom", "pos", F.least("a0", "a1").alias("a0"), F.greatest("a0", "a1").alias("a1"))
    return ordered.select(md5_key(*map(F.col, FIELDS)).alias("key"), *cols)


class CopyLedger:
    """A bucketed table ``(key, n_copies, keep_id)`` that takes one batch after another.

    Each batch writes a new version and then removes the one before, so a job that
    fails half-way leaves the last whole version in place; a version is whole if
    its folder holds ``_SUCCESS``.  Without a folder of its own the ledger is an
    intermediate table and is removed with these.
    """

    SCHEMA = "key BINARY, n_copies BIGINT, keep_id BIGINT"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        ws = None if folder else Workspace(spark, "copy-ledger")
        self.folder = folder or ws.root
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._name = f"copy_ledger_{uuid.uuid4().hex}"
        self.version = self._newest()
        if ws:
            ws.at_removal(lambda: self._remove(self.version))
        if self.version:
            self._register(self.version)

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:06d}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        jvm, path, fs = self._fs()
        if not fs.exists(path):
            return 0
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        whole = [int(n[1:]) for n in found if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def _table(self, version: int) -> str:
        return f"{self._name}_v{version}"

    def _register(self, version: int) -> None:
        self.spark.sql(
            f"CREATE TABLE {self._table(version)} ({self.SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self._path(version)}'"
        )

    def _remove(self, version: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(version)}")
        jvm, _, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self._path(version)), True)

    def entries(self) -> DataFrame:
        """All keys so far."""
        if not self.version:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.table(self._table(self.version))

    def apply(self, batch: DataFrame) -> None:
        """Add the rows ``(key, rec_id)`` of a batch.

        The batch is shuffled once, by key into as many parts as there are buckets
        where the session's number of shuffle partitions is theirs.
        """
        new = batch.groupBy("key").agg(F.count("*").alias("n_new"), F.min("rec_id").alias("id_new"))
        if self.version:
            both = self.entries().join(new, "key", "full_outer")
            merged = both.select(
                "key",
                (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("n_copies"),
                F.least("keep_id", "id_new").alias("keep_id"),
            )
        else:
            merged = new.select("key", F.col("n_new").alias("n_copies"), F.col("id_new").alias("keep_id"))
        before, self.version = self.version, self.version + 1
        merged.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self._path(self.version)).saveAsTable(self._table(self.version))
        if before:
            self._remove(before)


def batches_by_year(feed: DataFrame, at: str = "received_at") -> list[Column]:
    """Conditions that part a feed by the year of arrival; rows without a time come last."""
    years = sorted(r[0] for r in feed.select(F.year(at)).distinct().collect() if r[0] is not None)
    starts = [F.make_date(F.lit(y), F.lit(1), F.lit(1)).cast(feed.schema[at].dataType) for y in years]
    parts = []
    for k, start in enumerate(starts):
        part = F.col(at) >= start
        parts.append(part & (F.col(at) < starts[k + 1]) if k + 1 < len(starts) else part)
    return [*parts, F.col(at).isNull()]


def ledger_of(rows: DataFrame, at: str = "received_at") -> CopyLedger:
    """The ledger of all keyed rows, taken year by year as they arrived."""
    ledger = CopyLedger(rows.sparkSession)
    for part in batches_by_year(rows.select(at), at):
        ledger.apply(rows.where(part).select("key", "rec_id"))
    return ledger


def ledger_of_feed(feed: DataFrame, at: str = "received_at") -> CopyLedger:
    """The ledger of a feed, whose keys are worked out once and stored."""
    return ledger_of(Workspace(feed.sparkSession, "copies").store(keyed(feed, at), "keys"), at)


def copy_pairs(rows: DataFrame, ledger: CopyLedger) -> DataFrame:
    """``(keep_id, copy_id)``: the earliest record of each group and each other one.

    ``rows`` are keyed rows that the ledger has taken.  Rows of keys that occur once
    only are dropped by the join with the ledger; a key of many rows is divided by
    ``rec_id``.
    """
    several = ledger.entries().where(F.col("n_copies") > 1).select("key", "keep_id", "n_copies")
    total = several.agg(F.sum("n_copies")).first()[0] or 0
    most = max(HOT_ROWS, total // MOST_HOT_KEYS)
    hot = [r[0] for r in several.where(F.col("n_copies") > most).select("key").collect()]
    joined = skew_join(rows.select("key", "rec_id"), several.drop("n_copies"), "key", hot=hot, spread_by="rec_id")
    return joined.where(F.col("rec_id") != F.col("keep_id")).select("keep_id", F.col("rec_id").alias("copy_id"))


def copies_in(feed: DataFrame, at: str = "received_at") -> DataFrame:
    """``(keep_id, copy_id)`` of a whole feed.

    ``feed`` has ``rec_id, chrom, pos, a0, a1`` and the time of arrival; rows with a
    null in these fields are no copies of anything; fields without any letter or
    digit equal each other; a null time makes a batch of its own; an empty feed gives
    no rows; other columns don't matter.  Keys are worked out once and stored.
    """
    rows = Workspace(feed.sparkSession, "copies").store(keyed(feed, at), "keys")
    return copy_pairs(rows, ledger_of(rows, at))


def records_once(feed: DataFrame, ledger: CopyLedger) -> DataFrame:
    """Each keyed record once, as its earliest row writes it, with ``n_copies``.

    Rows with a null in ``NEEDED`` aren't in the ledger and are left out;
    :func:`every_record` gives them too.
    """
    entries = ledger.entries().select(F.col("keep_id").alias("rec_id"), "n_copies")
    return feed.select("rec_id", *FIELDS).join(entries, "rec_id")


def every_record(feed: DataFrame, ledger: CopyLedger) -> DataFrame:
    """Each record of the feed once, with ``n_copies``.

    A row with a null in ``NEEDED`` is a copy of nothing, so it is a record of one
    copy; such rows are added without a shuffle.
    """
    unkeyed = F.lit(False)
    for c in NEEDED:
        unkeyed = unkeyed | F.col(c).isNull()
    alone = feed.where(unkeyed).select("rec_id", *FIELDS, F.lit(1).cast("long").alias("n_copies"))
    return records_once(feed, ledger).unionByName(alone)
