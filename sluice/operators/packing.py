"""Greedy packing of examples with several sequences into rows of a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import global_index


def assign_rows(df: DataFrame, order: str, lengths: list[str], limit: int, batch: int) -> DataFrame:
    """Add ``batch_id`` and ``row``: within each batch of ``batch`` consecutive examples, in order, an example joins the
    open row if all its sequences still fit, else it begins the next. A fold over each batch's array, which the batch
    size bounds, in generated code."""
    rows = global_index(df, order, "_rn").withColumn("batch_id", F.floor(F.col("_rn") / batch))
    item = F.struct("_rn", *df.columns)
    groups = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    room = "cast(0 as bigint)"
    start = f"named_struct('row', {room}, {', '.join(f'{repr(c)}, {room}' for c in lengths)}, 'out', cast(array() as array<bigint>))"
    fits = " and ".join(f"a.{c} + x.{c} <= {limit}" for c in lengths)
    row = f"if({fits}, a.row, a.row + 1)"
    step = f"(a, x) -> named_struct('row', {row}, {', '.join(f'{repr(c)}, if({fits}, a.{c} + x.{c}, x.{c})' for c in lengths)}, 'out', concat(a.out, array({row})))"
    groups = groups.withColumn("_row", F.expr(f"aggregate(_items, {start}, {step}, a -> a.out)"))
    out = groups.select("batch_id", F.explode(F.arrays_zip("_items", "_row")).alias("_e"))
    return out.select("batch_id", F.col("_e._row").alias("row"), *[F.col(f"_e._items.{c}").alias(c) for c in df.columns])


def pack(df: DataFrame, order: str, keys: list[str], limit: int, batch: int) -> DataFrame:
    """(batch_id, row, and per key the packed ids, their ``_position`` and ``_segmentation``), each of ``limit`` ids.

    Sequences are cut at ``limit``. Zeros are padding: a sequence is as long as it has other ids, so an id 0 inside cuts
    off as many real ids at the end. Positions count within an example; segments number the examples of a row from 1,
    and are 0 in the padding.
    """
    own = df.select(order, *[F.slice(k, 1, limit).alias(k) for k in keys])
    own = own.select(order, *[F.slice(k, F.lit(1), F.size(F.filter(k, lambda x: x != 0))).alias(k) for k in keys])
    sized = own.select("*", *[F.size(k).cast("long").alias(f"_{k}") for k in keys])
    rows = assign_rows(sized, order, [f"_{k}" for k in keys], limit, batch)
    groups = rows.groupBy("batch_id", "row").agg(F.array_sort(F.collect_list(F.struct(order, *keys))).alias("_i"))
    fill = lambda a: F.concat(a, F.array_repeat(F.lit(0), F.lit(limit) - F.size(a)))
    out = []
    for k in keys:
        out.append(fill(F.flatten(F.col("_i")[k])).alias(k))
        out.append(fill(F.flatten(F.transform(F.col("_i")[k], lambda a: F.transform(a, lambda x, j: j)))).alias(f"{k}_position"))
        out.append(fill(F.flatten(F.transform(F.col("_i")[k], lambda a, i: F.transform(a, lambda x: i + 1)))).alias(f"{k}_segmentation"))
    return groups.select("batch_id", "row", *out)
