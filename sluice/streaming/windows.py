"""Keyed count windows over streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import new_path


def count_windows(stream: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, window, n, total): a row whenever a key has had ``size`` further elements. Elements of a micro-batch are taken
    in the order of ``value``. The state of a key is its window number, count and sum; what is unfinished waits."""
    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, window long, n long, total long"

    def step(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        window, n, total = state.get if state.exists else (0, 0, 0)
        values = sorted(v for f in frames for v in f[value].tolist())
        rows = []
        for v in values:
            n, total = n + 1, total + v
            if n == size:
                rows.append((k[0], window, n, total))
                window, n, total = window + 1, 0, 0
        state.update((window, n, total))
        yield pd.DataFrame(rows, columns=[key, "window", "n", "total"])

    return stream.groupBy(key).applyInPandasWithState(step, out, "window long, n long, total long", "append", GroupStateTimeout.NoTimeout)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A parquet path as a stream that ends when all present files have been read."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    probe = spark.read.format("binaryFile").load(path).select("path").first()[0]
    if probe.endswith(f"/{name}"):  # a single file: the stream watches its folder
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def run_count_window(spark: SparkSession, path: str, key: str, value: str, size: int) -> DataFrame:
    """Run the count windows over a finite stream and return what they emitted."""
    out = new_path(spark, "stream")
    q = count_windows(_read(spark, path).select(key, value), key, value, size).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a stream's progress reports counted."""
    q = _read(spark, path).writeStream.format("noop").option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.createDataFrame([(sum(p["numInputRows"] for p in q.recentProgress),)], "rows long")


def tumbling(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """An extension: counts per event-time window, with a watermark for late data."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))
