"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many rows, counted before.
BROADCAST_ROWS = 100_000
#: Rows of one key above which it is salted, and the largest number of salted keys.
HOT_ROWS, MOST_HOT_KEYS = 200_000, 1_000
#: Parts into which a hot key is divided.
SALTS = 32


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """The keys with more than ``hot_rows`` rows; of more than MOST_HOT_KEYS the largest ones.

    A table of no more rows than that is told from a count alone.
    """
    if within(df, hot_rows):
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot_rows)
    top = counts.orderBy(F.desc("count")).limit(MOST_HOT_KEYS).collect()
    return [row[0] for row in top]


def skew_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, spread_by: str | None = None, hot: list | None = None, both: str | None = None
) -> DataFrame:
    """Equi-join on ``key`` where ``left`` may be skewed.

    Rows of hot keys are divided by a hash of ``spread_by`` (of the whole row if
    not given), and the matching rows of ``right`` are repeated for each part.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.  Null keys
    never match.  The other keys take the same shuffle, so there is one join.
    ``hot`` names the hot keys where they are known, at most MOST_HOT_KEYS.  In an
    inner join ``both`` names a column of ``right`` by whose hash its hot keys are
    divided too, and rows of ``left`` with such keys are repeated for these parts.
    """
    if hot is None:
        hot = hot_keys(left, key, hot_rows)
    hot_right = hot_keys(right, key, hot_rows) if both else []
    on = [key]
    for keys, divided, repeated, by in ((hot, "left", "right", spread_by), (hot_right, "right", "left", both)):
        if not keys:
            continue
        sides, salt = {"left": left, "right": right}, f"__salt_{divided}"
        is_hot = F.col(key).isin(keys)
        spread = F.xxhash64(by) if by else F.xxhash64(*left.columns)
        part = F.when(is_hot, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        sides[divided], sides[repeated] = sides[divided].withColumn(salt, part), sides[repeated].withColumn(salt, F.explode(parts))
        left, right = sides["left"], sides["right"]
        on.append(salt)
    return left.join(right, on if len(on) > 1 else key, how).drop(*on[1:])


def sized_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int = BROADCAST_ROWS, spread_by: str | None = None) -> DataFrame:
    """Broadcast ``right`` if it is counted to have at most ``rows`` rows, else join by shuffle with salting."""
    if within(right, rows):
        return left.join(F.broadcast(right), key, how)
    return skew_join(left, right, key, how, spread_by=spread_by)


def md5_key(*parts: Column) -> Column:
    """A 128-bit key of several text columns; parts are told apart by their lengths."""
    framed = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*framed)))
