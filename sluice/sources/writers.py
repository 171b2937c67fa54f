"""Sinks."""

from __future__ import annotations

import functools
import struct

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    (df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def _write_raw(df: DataFrame, path: str, frame) -> None:
    """One file per partition with the framed records, through a file system that the executors share. A file gets its
    name only when it is complete."""
    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(path)
        draft, n = f"{root}/.{uuid.uuid4().hex}", 0
        with where.open_output_stream(draft) as out:
            for b in batches:
                for r in b.column("record"):
                    out.write(frame(r.as_py()))
                    n += 1
        where.move(draft, f"{root}/part-{TaskContext.get().partitionId():06d}")
        yield pa.RecordBatch.from_pydict({"n": [n]}, schema=pa.schema([("n", pa.int64())]))

    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root, recursive=True)
    df.select("record").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


@functools.cache
def _crc_table() -> tuple[int, ...]:
    """Of the Castagnoli polynomial, bit-reversed."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return tuple(table)


def masked_crc(data: bytes) -> int:
    """CRC-32C, rotated by 15 bits and shifted by a constant, as record files store it."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _framed(record: bytes) -> bytes:
    """Length, check sum of the length, record, check sum of the record."""
    head = struct.pack("<Q", len(record))
    return head + struct.pack("<I", masked_crc(head)) + record + struct.pack("<I", masked_crc(record))


def write_records(df: DataFrame, path: str) -> None:
    _write_raw(df, path, _framed)


def write_fixed(df: DataFrame, path: str) -> None:
    _write_raw(df, path, bytes)


def write_lines(df: DataFrame, path: str, column: str, order: str) -> None:
    """A file whose line numbers mean something, such as a vocabulary: one file, since no order holds between files."""
    df.coalesce(1).sortWithinPartitions(order).select(column).write.text(path)


def write_traced(df: DataFrame, name: str, path: str) -> None:
    """Run a pipeline to its end and keep what was observed."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("elements")).write.format("noop").mode("overwrite").save()
    df.sparkSession.createDataFrame([(name, seen.get["elements"])], "name string, elements long").write.parquet(path)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([(k, str(v)) for k, v in sorted(params.items())], "key string, value string").write.json(path)
