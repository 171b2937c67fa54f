"""Positional joins, look-ups with defaults, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import global_index, hash_key

#: Rows of a look-up table that are sent to every task at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcasting if a count shows it to be small; else leave the choice to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def zip_frames(a: DataFrame, a_order, b: DataFrame, b_order) -> DataFrame:
    """Rows of the same position side by side; the shorter side ends it."""
    return global_index(a, a_order, "_rn").join(global_index(b, b_order, "_rn"), "_rn").drop("_rn")


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default) -> DataFrame:
    """Add ``value`` of the table; ``default`` where the key is missing or null."""
    own = table.select(F.col(table_key).alias("_key"), F.col(value).alias(value))
    out = df.join(small(own), df[key] == F.col("_key"), "left").drop("_key")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_hashed(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, members: int, slots: int) -> DataFrame:
    """A lossy look-up through two hash buckets of the key; of colliding entries the largest value counts, 0 without any."""
    def bucket(c: str, n: int) -> Column:
        return F.conv(F.substring(hash_key(c), 1, 8), 16, 10).cast("long") % n

    own = table.groupBy(bucket(table_key, members).alias("_m"), bucket(table_key, slots).alias("_s")).agg(F.max(value).alias(value))
    # each distinct key is hashed once
    keys = df.select(key).distinct().withColumns({"_m": bucket(key, members), "_s": bucket(key, slots)})
    keys = keys.join(own, ["_m", "_s"]).select(key, value)
    return df.join(keys, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def differences(before: DataFrame, after: DataFrame, key: str, name: str = "side") -> DataFrame:
    """Keys of one side only: ``removed`` or ``added``."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn(name, F.lit("removed")).unionByName(b.join(a, key, "left_anti").withColumn(name, F.lit("added")))
