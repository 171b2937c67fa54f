"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
An empty table passes through every stage; rows with a null id are judged by the language stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.base import materialize
from sluice.llm.decontaminate import contaminated
from sluice.llm.exact_dedup import exact_dedup
from sluice.llm.langid import fit_language_model, identify
from sluice.llm.ngram_join import ngram_join
from sluice.llm.packing import pack

#: Ids to drop that are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``dropped`` (one column, doc_id)."""
    dropped = materialize(dropped.where("doc_id is not null").distinct(), "dropped")
    small = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that can be text of a language: null, without any letter, or implausible by its likelihood
    per letter in the predicted language is rejected. Where no language could be learned, letters are enough."""
    model = fit_language_model(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model, ("_sluice_lang", "_sluice_score", "_sluice_keep")).where("_sluice_keep").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the longest, then the one with the smallest id."""
    found = materialize(exact_dedup(docs), "exact")
    ids = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).where("k < n"), "ids")
    out = without(docs, ids.select("doc_id"))
    partly = ids.where("k > 0").select("doc_id")
    if partly.isEmpty():
        return out
    # ids with several rows, of which some stay: decided by the text
    key = ["doc_id", "text_sha256", "n_chars"]
    stay = found.where("kept").join(partly, "doc_id").select(*[F.col(c).alias(f"_{c}") for c in key])
    text = F.coalesce("text", F.lit(""))
    some = docs.join(partly, "doc_id", "left_semi").withColumns({"_sha": F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", "").cast("binary"), 256), "_len": F.length(text).cast("long")})
    some = some.join(stay, (some.doc_id == stay._doc_id) & (some._sha == stay._text_sha256) & (some._len == stay._n_chars), "left_semi")
    return out.unionByName(some.dropDuplicates(["doc_id", "_sha", "_len"]).select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group linked by a Jaccard similarity of 0.8 or more on
    five-word shingles."""
    return without(docs, ngram_join(docs, k=5, percent=80).where("doc_id <> component_id").select("doc_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a test item."""
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("decontaminate", benchmark), ("packing", packing)]

#: Language identification, decontamination by passages and packing have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
