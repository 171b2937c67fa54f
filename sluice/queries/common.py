"""Shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: md5 of key and seed as hexadecimal digits, in SQL; the twin of operators.rows.hash_key.
def sql_hash(key: str, seed: int = 0, epoch: str | None = None) -> str:
    more = f" || '-' || CAST({epoch} AS VARCHAR)" if epoch else ""
    return f"md5(CAST({key} AS VARCHAR) || '-{seed}'{more})"


def sql_hash01(key: str, seed: int = 0) -> str:
    return f"(CAST(('0x' || substr({sql_hash(key, seed)}, 1, 8)) AS BIGINT) / 4294967296.0)"
