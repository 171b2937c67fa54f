"""Sources. Paths are read by Spark alone, so any store that Spark reaches will do."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructType

from ..operators.rows import global_index

SPECIAL = ("<unk>", "<s>", "</s>")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of the files that match, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(pattern).select("path", "length")


def file_sizes(spark: SparkSession, pattern: str) -> DataFrame:
    return list_files(spark, pattern)


def from_slices(spark: SparkSession, values: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def lines_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per line of a text column, numbered from 0."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line", "value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_records(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """Length-prefixed records: u64 length, 4 bytes of check sum, the record, 4 bytes of check sum. One file is read by one
    task. With ``verify`` a wrong check sum is an error."""
    def split(it):
        import struct

        import pyarrow as pa

        from .writers import masked_crc

        for b in it:
            for content in b.column("content"):
                raw, at, out = content.as_buffer().to_pybytes(), 0, []
                while at < len(raw):
                    (n,) = struct.unpack_from("<Q", raw, at)
                    out.append(raw[at + 12 : at + 12 + n])
                    if verify and struct.unpack_from("<I", raw, at + 12 + n)[0] != masked_crc(out[-1]):
                        raise ValueError(f"record at byte {at} is damaged")
                    at += n + 16
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(split, "record binary")


def read_fixed(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Records of ``size`` bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    at = F.explode(F.when(F.length("content") >= size, F.sequence(F.lit(1), (F.length("content") - size + 1).cast("int"), F.lit(size)))).alias("at")
    return files.select("content", at).select(F.expr(f"substring(content, at, {size})").alias("record"))


def split_slice(df: DataFrame, start: int, stop: int, order) -> DataFrame:
    """Rows [start, stop) of a table, as a host's share of a split."""
    return global_index(df, order, "_rn").where((F.col("_rn") >= start) & (F.col("_rn") < stop)).drop("_rn")


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with the prefix; the predicate is pushed to the scan."""
    return df.where(F.col(key).startswith(prefix))


def synthetic(spark: SparkSession, schema: StructType, n: int) -> DataFrame:
    """Constant rows of a schema: zeros, empty strings, false, empty arrays."""
    def zero(kind):
        if isinstance(kind, NumericType):
            return F.lit(0).cast(kind)
        if isinstance(kind, StringType):
            return F.lit("")
        if isinstance(kind, BooleanType):
            return F.lit(False)
        if isinstance(kind, ArrayType):
            return F.array().cast(kind)
        return F.lit(None).cast(kind)

    return spark.range(n).select(*[zero(f.dataType).alias(f.name) for f in schema])


def vocabulary(words: DataFrame, token: str, order) -> DataFrame:
    """(token, id): the special tokens, then the words in the given order."""
    special = words.sparkSession.createDataFrame([(w, i) for i, w in enumerate(SPECIAL)], "token string, id long")
    ranked = global_index(words.where(~F.col(token).isin(*SPECIAL)), order, "_rn")
    return special.unionByName(ranked.select(F.col(token).alias("token"), (F.col("_rn") + len(SPECIAL)).alias("id")))


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a file with one token per line; the special tokens are put in front where they are missing."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    rows = global_index(lines, "_at", "id")
    head = [r.value for r in rows.where(F.col("id") < len(SPECIAL)).orderBy("id").collect()]
    if tuple(head) != SPECIAL:
        rows = rows.withColumn("id", F.col("id") + len(SPECIAL)).select("value", "id").unionByName(spark.createDataFrame([(w, i) for i, w in enumerate(SPECIAL)], "value string, id long"))
    return rows.select(F.col("value").alias("token"), "id")


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of a text file. A first line of two numbers is a header; lines of another width than most are dropped."""
    rows = spark.read.text(path).select(F.split("value", " ").alias("p")).where(F.size("p") > 2)
    rows = rows.select(F.element_at("p", 1).alias("token"), F.transform(F.slice("p", 2, 1 << 20), lambda x: x.try_cast("double")).alias("vector"))
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(width), F.size("vector") == F.col("n")).select("token", "vector")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="key string, value string")


def scan_bandwidth(spark: SparkSession, path: str) -> DataFrame:
    """Bytes per second of a full scan, as a stand-in for a disk benchmark."""
    size = list_files(spark, path).agg(F.sum("length")).first()[0] or 0
    began = time.perf_counter()
    spark.read.parquet(path).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(path.rsplit("/", 1)[-1], int(size), size / (time.perf_counter() - began))], "name string, bytes long, bandwidth double")
