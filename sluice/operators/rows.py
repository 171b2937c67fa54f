"""Order, partition, cardinality and batch operators.

DataFrames have no order, so every operator whose meaning depends on one takes the order columns; they should be
unique, and ties are resolved arbitrarily. Empty inputs give empty outputs. Null order keys come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, str | Column) else order)]


def global_index(df: DataFrame, order, name: str = "rn") -> DataFrame:
    """Add the 0-based position of each row in the given order.

    No row ever passes through a single task: rows are range-partitioned and sorted, numbered inside their partition, and
    the partition's offset comes from a table of counts, one row per partition.
    """
    keys = _columns(order)
    local = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    local = materialize(local.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "index")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def shard(df: DataFrame, n: int, k: int, order) -> DataFrame:
    """Every n-th row, from the k-th on."""
    return global_index(df, order, "_rn").where(F.col("_rn") % n == k).drop("_rn")


def shard_shared(df: DataFrame, hosts: int, host: int, sharing: int, order) -> DataFrame:
    """``sharing`` consecutive hosts read the same shard of ``hosts // sharing``."""
    return shard(df, hosts // sharing, host // sharing, order)


def take(df: DataFrame, n: int, order) -> DataFrame:
    return df.orderBy(*_columns(order)).limit(n)


def skip(df: DataFrame, n: int, order) -> DataFrame:
    return global_index(df, order, "_rn").where(F.col("_rn") >= n).drop("_rn")


def repeat(df: DataFrame, epochs: int, name: str = "epoch") -> DataFrame:
    """Each row once per epoch; a narrow operation."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else df.withColumn(name, F.lit(0)).limit(0)


def repeat_take(df: DataFrame, n: int, order) -> DataFrame:
    """The first n rows of the endless repetition, with the epoch."""
    size = df.count()
    if not size:
        return df.withColumn("epoch", F.lit(0))
    return take(repeat(df, -(-n // size)), n, ["epoch", *_columns(order)])


def hash_key(key, seed: int = 0, epoch=None) -> Column:
    """A reproducible pseudo-random sort key: md5 of key, seed and epoch."""
    parts = [F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(seed))]
    if epoch is not None:
        parts.append(F.col(epoch).cast("string"))
    return F.md5(F.concat_ws("-", *parts).cast("binary"))


def hash01(key, seed: int = 0) -> Column:
    """A reproducible pseudo-random number in [0, 1)."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / float(2**32)


def shuffle(df: DataFrame, key: str, seed: int = 0, name: str = "pos") -> DataFrame:
    """A full reproducible shuffle: the position in the order of ``hash_key``."""
    return global_index(df.withColumn("_h", hash_key(key, seed)), ["_h", key], name).drop("_h")


def shuffle_repeat(df: DataFrame, key: str, epochs: int, seed: int = 0, name: str = "pos") -> DataFrame:
    """Shuffle, then repeat: each epoch is complete before the next begins, and has an order of its own."""
    return global_index(repeat(df, epochs).withColumn("_h", hash_key(key, seed, "epoch")), ["epoch", "_h", key], name).drop("_h")


def shuffle_buffer(df: DataFrame, order, buffer: int, seed: int = 0, name: str = "pos") -> DataFrame:
    """Bounded-buffer shuffle with the exact buffer rule, per partition of the range-partitioned input: a buffer of
    ``buffer`` rows is filled, one random row of it is emitted, and the next row takes its place. Rows leave at most
    ``buffer - 1`` positions early. Memory is bounded by the buffer."""
    keys = _columns(order)
    schema = df.withColumn(name, F.lit(0).cast("long")).schema
    columns = schema.names

    def run(it):
        import random

        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        r, held, at = random.Random(f"{seed}-{part}"), [], 0
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                held.append(row)
                if len(held) > buffer:
                    k = r.randrange(buffer)
                    out.append((*held[k], (part << 33) + at))
                    held[k] = held.pop()
                    at += 1
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = []
        while held:
            k = r.randrange(len(held))
            held[k], held[-1] = held[-1], held[k]
            out.append((*held.pop(), (part << 33) + at))
            at += 1
        if out:
            yield pd.DataFrame(out, columns=columns)

    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def interleave(df: DataFrame, source: str, order, cycle: int, block: int, name: str = "pos") -> DataFrame:
    """Round-robin over ``cycle`` sources at a time, ``block`` rows each; the next ``cycle`` sources follow."""
    sources = global_index(df.select(source).distinct(), source, "_s")
    out = key_index(df, source, order, "_r").join(sources, source)
    return global_index(out.withColumns({"_g": F.floor(F.col("_s") / cycle), "_b": F.floor(F.col("_r") / block)}), ["_g", "_b", "_s", "_r"], name).drop("_s", "_r", "_g", "_b")


def echo(df: DataFrame, times: Column | int, name: str = "copy") -> DataFrame:
    """Each row ``times`` times in a row (data echoing)."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def echo_continuous(df: DataFrame, factor: float, key: str, seed: int = 0) -> DataFrame:
    """A fractional echo factor: the whole part, and one more copy with the probability of the rest, per row."""
    whole = int(factor // 1)
    return echo(df, F.lit(whole) + (hash01(key, seed) < factor - whole).cast("int"))


def batch(df: DataFrame, size: int, order, columns: list[str], drop_remainder: bool = False) -> DataFrame:
    """(batch_id, n, one array per column): ``size`` consecutive rows each, in order."""
    rows = global_index(df.select(*{*columns, *[c for c in ([order] if isinstance(order, str) else order) if isinstance(c, str)]}), order, "_rn")
    out = rows.groupBy(F.floor(F.col("_rn") / size).alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("_rn", *columns))).alias("_rows"))
    out = out.select("batch_id", F.size("_rows").alias("n"), *[F.col("_rows")[c].alias(c) for c in columns])
    return out.where(F.col("n") == size) if drop_remainder else out


def pad(array, length, value) -> Column:
    """Right-pad an array; longer arrays raise an error."""
    a, n = (F.col(array) if isinstance(array, str) else array), (F.lit(length) if isinstance(length, int) else length)
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(n - F.size(a), F.lit(0)).cast("int"))
    return F.when(F.size(a) > n, F.raise_error(F.lit("element longer than the padded shape")).cast("array<int>")).otherwise(F.concat(a, fill))


def trim_and_pad(array, length: int, value) -> Column:
    a = F.col(array) if isinstance(array, str) else array
    return pad(F.slice(a, 1, length), length, value)


def _padder(length: str, value):
    return lambda a: pad(a, F.col(length), value)


def padded_batch(df: DataFrame, size: int, order, columns: list[str], values: dict, length: int | None = None, drop_remainder: bool = False) -> DataFrame:
    """``batch`` of array columns, padded to the longest of the batch or to ``length``; a column per array, and the length
    of its padded rows as ``<column>_len``."""
    out = batch(df, size, order, columns, drop_remainder)
    for c in columns:
        longest = F.lit(length) if length is not None else F.array_max(F.transform(c, F.size))
        out = out.withColumn(f"{c}_len", longest).withColumn(c, F.transform(c, _padder(f"{c}_len", values[c])))
    return out


def unbatch(df: DataFrame, columns: list[str], name: str = "pos") -> DataFrame:
    """One row per element of the arrays, with its position."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias(name, "_e")).select(*rest, name, *[F.col(f"_e.{c}").alias(c) for c in columns])


def rebatch(df: DataFrame, size: int, columns: list[str], batch_id: str = "batch_id") -> DataFrame:
    """Batches of another size, in the same order of elements."""
    rows = unbatch(df.select(batch_id, *columns), columns).withColumnRenamed(batch_id, "_b")
    return batch(rows.withColumnRenamed("pos", "_p"), size, ["_b", "_p"], columns)


def prefetch(df: DataFrame, amount: int = 1) -> DataFrame:
    """Rows are unchanged; tasks of a stage overlap without it. Kept so that pipelines can be described."""
    return df


def cache(df: DataFrame) -> DataFrame:
    """Keep the rows for later readers, in memory or on disk."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cache_take(df: DataFrame, n: int, order, epochs: int) -> DataFrame:
    """The first n rows, kept, again and again: a steady state for benchmarks."""
    return repeat(cache(take(df, n, order)), epochs)


def cache_partial(df: DataFrame, every: int, order) -> DataFrame:
    """Keep each ``every``-th row only; the others are read anew. The result is the input."""
    rows = global_index(df, order, "_rn")
    kept = cache(rows.where(F.col("_rn") % every == 0))
    return kept.unionByName(rows.where(F.col("_rn") % every != 0)).drop("_rn")


def concat(*frames: DataFrame, name: str = "origin") -> DataFrame:
    """All rows of the frames, tagged with the number of their frame."""
    return reduce(DataFrame.unionByName, [d.withColumn(name, F.lit(k)) for k, d in enumerate(frames)])


def pad_eval(df: DataFrame, padding: DataFrame, size: int, order) -> DataFrame:
    """Rows, then padding rows, ``size`` in all; ``is_padded`` tells them apart."""
    both = df.withColumn("is_padded", F.lit(False)).unionByName(padding.withColumn("is_padded", F.lit(True)))
    return take(both, size, ["is_padded", *_columns(order)])


def choose_from(frames: list[DataFrame], order, name: str = "pos") -> DataFrame:
    """Strict alternation: the first rows of all frames, then the second rows, and so on."""
    parts = [global_index(d, order, "_rn").withColumn("origin", F.lit(k)) for k, d in enumerate(frames)]
    return global_index(reduce(DataFrame.unionByName, parts), ["_rn", "origin"], name).drop("_rn")


#: A key with more rows is joined by a broadcast, whatever the number of keys; so few keys can be that large.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def _by_key(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the columns of its key in ``table`` (_key0.., _n rows, ..); nulls are a key.

    A table of few keys is broadcast. Else the keys are dealt out by a shuffle, but for those that hold so many rows that
    one task should not take them: at most HOT_KEYS of them can exist, and they are broadcast."""
    from .joins import BROADCAST_ROWS

    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    n, total = table.agg(F.count("*"), F.sum("_n")).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), same)
    hot = F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)
    few, many = F.broadcast(table.where(hot)), table.where(~hot)
    return rows.join(few, same).unionByName(rows.join(few, same, "left_anti").join(many, same))


def _key_columns(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]


def key_index(df: DataFrame, key, order, name: str = "rn") -> DataFrame:
    """Add the 0-based position of each row among the rows of its key.

    A key may hold any share of the rows, so it is not numbered in one task: rows are sorted by key and order over all
    partitions, and a key's positions are those of the sorted table less the position of its first row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = global_index(df, [*keys, *_columns(order)], "_rn")
    first = materialize(rows.groupBy(*_key_columns(keys)).agg(F.min("_rn").alias("_first"), F.count("*").alias("_n")), "keys")
    return _by_key(rows, first, keys).withColumn(name, F.col("_rn") - F.col("_first")).drop("_rn", "_first", "_n", *[f"_key{i}" for i in range(len(keys))])


def group_by_window(df: DataFrame, key, size: int, order, drop_remainder: bool = False) -> DataFrame:
    """Add ``window`` and ``at``: per key, each ``size`` consecutive rows form a window; the last may be short."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = key_index(df, keys, order, "_i").withColumns({"window": F.floor(F.col("_i") / size), "at": F.col("_i") % size}).drop("_i")
    if not drop_remainder:
        return rows
    counts = materialize(rows.groupBy(*_key_columns(keys)).agg(F.count("*").alias("_n")), "counts")
    return _by_key(rows, counts, keys).where((F.col("window") + 1) * size <= F.col("_n")).drop("_n", *[f"_key{i}" for i in range(len(keys))])
