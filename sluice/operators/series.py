"""Analytic functions over ordered series, per group.

A group may hold any share of the rows. Where a count finds groups of more than BLOCK rows, groups are cut into blocks of so
many consecutive rows, which are windows of their own: a block also gets the last rows of the one before it, as many as a
function looks back, and running sums add what the blocks before hold. Else a group is one window. Rows whose order is equal are taken in an arbitrary order, but in
sums they count together; a null group is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import key_index

#: Consecutive rows of a group that are one window.
BLOCK = 10_000
_MARKS = ("_i", "_b", "_own")


def _blocks(df: DataFrame, order: str, by: list[str], back: int = 0) -> tuple[DataFrame, Window, bool]:
    """The rows with their position ``_i`` in the group and block ``_b``, and once more, not ``_own``, in the next block if it
    looks back at them; the window of a block; and whether there is more than one."""
    if back > BLOCK:
        raise ValueError("a block must hold what the next looks back at")
    if not _large(df, by):
        at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
        return df.withColumns({"_i": at, "_b": F.lit(0).cast("long"), "_own": F.lit(True)}), Window.partitionBy(*by).orderBy("_i"), False
    rows = key_index(df, by, order, "_i")
    own = F.floor(F.col("_i") / BLOCK)
    both = F.when(F.col("_i") % BLOCK >= BLOCK - back, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_b", F.explode(both)).withColumn("_own", F.col("_b") == own)
    return rows, Window.partitionBy(*by, "_b").orderBy("_i"), True


def _large(df: DataFrame, by: list[str]) -> bool:
    """Whether a group has more than BLOCK rows."""
    return (df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) > BLOCK


def _done(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop(*_MARKS)


def _running(df: DataFrame, sums: dict[str, str], order: str, by: list[str]) -> DataFrame:
    """Add, for each name, the running sum of a column, the row and all of equal order included. Only groups of several blocks
    need what is before a block; there are few such blocks."""
    from .joins import small

    rows, w, cut = _blocks(df, order, by)
    if not cut:
        peers = Window.partitionBy(*by).orderBy(order)
        return rows.withColumns({n: F.sum(c).over(peers) for n, c in sums.items()})
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(by)], F.col("_b").alias("_block"), *[F.sum(n).over(upto).alias(f"_{n}") for n in sums]).where("_block > 0")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(by)], F.col("_b") == F.col("_block"))
    rows = rows.join(small(before), same, "left")
    out = rows.withColumns({n: F.sum(c).over(w) + F.coalesce(f"_{n}", F.lit(0)) for n, c in sums.items()})
    last = Window.partitionBy(*by, order).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumns({n: F.last(n).over(last) for n in sums})
    return out.drop("_block", *[f"_{n}" for n in sums], *[f"_key{i}" for i in range(len(by))])


def diff(df: DataFrame, value: str, order: str, by: list[str], name: str = "diff") -> DataFrame:
    rows, w, _ = _blocks(df, order, by, 1)
    return _done(rows.withColumn(name, F.col(value) - F.lag(value).over(w)))


def rates(df: DataFrame, count: str, seconds: str, order: str, by: list[str]) -> DataFrame:
    """Add ``cumulative`` and ``current``: elements per second so far, and of this row."""
    rows = _running(df, {"_n": count, "_s": seconds}, order, by)
    return _done(rows.withColumns({"cumulative": F.col("_n") / F.col("_s"), "current": F.col(count) / F.col(seconds)}).drop("_n", "_s"))


def plateau(df: DataFrame, rate: str, order: str, by: list[str]) -> DataFrame:
    """Whether the last four rates gained little on those four steps before: all below 1.10, or 1.01 at most on average."""
    rows, w, _ = _blocks(df, order, by, 7)
    rows = rows.withColumn("_g", F.col(rate) / F.lag(rate, 4).over(w))
    last = w.rowsBetween(-3, 0)
    return _done(rows.withColumn("plateau", F.coalesce((F.col("_i") >= 4) & ((F.max("_g").over(last) < 1.10) | (F.avg("_g").over(last) <= 1.01)), F.lit(False))).drop("_g"))


def cycle(df: DataFrame, change: str, order: str, by: list[str], times: int = 5) -> DataFrame:
    """Whether the last ``times`` changes are the same."""
    rows, w, _ = _blocks(df, order, by, times)
    rows = rows.withColumn("_same", (F.col(change) == F.lag(change).over(w)).cast("int"))
    return _done(rows.withColumn("cycle", (F.col("_i") >= times - 1) & (F.coalesce(F.sum("_same").over(w.rowsBetween(2 - times, 0)), F.lit(0)) == times - 1)).drop("_same"))


def converged(df: DataFrame, count: str, seconds: str, order: str, by: list[str], every: int = 20, tolerance: float = 0.01, least_s: float = 12) -> DataFrame:
    """The first row of each group at which the cumulative rate, looked at every so many rows, has settled."""
    r = _running(df, {"_n": count, "_s": seconds}, order, by).withColumn("cumulative", F.col("_n") / F.col("_s")).where((F.col("_i") + 1) % every == 0)
    # what is left of a group is looked at in blocks again: each row with the one before it
    looked = r.select(*by, order, "cumulative", F.col("_s").alias("so_far"))
    rows, w, _ = _blocks(looked, order, by, 1)
    rows = _done(rows.withColumn("_p", F.lag("cumulative").over(w)))
    return rows.where((F.abs(F.col("_p") / F.col("cumulative") - 1) < tolerance) & (F.col("so_far") >= least_s)).groupBy(*by).agg(F.min(order).alias(order))


def segments(df: DataFrame, starts: str, real: str, order: str, by: list[str]) -> DataFrame:
    rows = _running(df.withColumn("_start", F.col(starts).cast("long")), {"_upto": "_start"}, order, by)
    return _done(rows.withColumn("segment", F.col("_upto") * F.col(real).cast("long")).drop("_upto", "_start"))


def position(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    rows, _, _ = _blocks(df, order, by)
    return rows.withColumnRenamed("_i", "position").drop("_b", "_own")


def depths(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, depth) of an acyclic graph (src, dst): the longest path from any node without a predecessor."""
    edges.createOrReplaceTempView("_edges")
    return spark.sql("""WITH RECURSIVE d(node, depth) AS (
        SELECT DISTINCT src, 0 FROM _edges WHERE src NOT IN (SELECT dst FROM _edges)
        UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN _edges e ON e.src = d.node)
        SELECT node, max(depth) AS depth FROM d GROUP BY node""")
