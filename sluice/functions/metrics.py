"""Text and ranking metrics as queries: partial sums per row, combined by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from . import text as X


def ngram_matches(df: DataFrame, key: list[str], hypothesis: str, reference: str, orders: int = 4, grams=X.ngrams) -> DataFrame:
    """(key, n, matches, possible, ref_possible): clipped overlaps of the n-grams of two token arrays, per row and order.

    Counts are built by grouping exploded n-grams of both sides together, so nothing is joined. The arrays are written
    first: the planner would else compute them again for every n-gram.
    """
    df = materialize(df.select(*key, hypothesis, reference), "grams")

    def side(column: str, tag: int) -> DataFrame:
        tagged = lambda n: F.transform(grams(column, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
        own = [tagged(n) for n in range(1, orders + 1)]
        return df.select(*key, F.explode(F.concat(*own)).alias("e")).select(*key, "e.n", "e.g", F.lit(tag).alias("side"))

    both = side(hypothesis, 0).unionByName(side(reference, 1))
    counts = both.groupBy(*key, "n", "g").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("h"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("r"))
    return counts.groupBy(*key, "n").agg(F.sum(F.least("h", "r")).alias("matches"), F.sum("h").alias("possible"), F.sum("r").alias("ref_possible"))


def corpus_stats(df: DataFrame, hypothesis: str, reference: str, key: list[str], shard: Column | None = None, orders: int = 4) -> DataFrame:
    """Sufficient statistics of corpus BLEU, one row, or one per shard: matches and possible n-grams, lengths."""
    by = [] if shard is None else ["shard"]
    own = df if shard is None else df.withColumn("shard", shard)
    m = ngram_matches(own, [*by, *key], hypothesis, reference, orders).groupBy(*by, "n").agg(F.sum("matches").alias("matches"), F.sum("possible").alias("possible"))
    wide = m.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}") for n in range(1, orders + 1) for c in ("matches", "possible")])
    lengths = own.groupBy(*by).agg(F.sum(F.size(hypothesis)).alias("h_len"), F.sum(F.size(reference)).alias("r_len"))
    return wide.join(lengths, by) if by else wide.join(F.broadcast(lengths))


def combine(stats: DataFrame, orders: int = 4) -> DataFrame:
    """The statistics of all shards together."""
    return stats.agg(*[F.sum(c).alias(c) for n in range(1, orders + 1) for c in (f"matches_{n}", f"possible_{n}")], F.sum("h_len").alias("h_len"), F.sum("r_len").alias("r_len"))


def bleu_simple(stats: DataFrame, smooth: bool = False, orders: int = 4) -> DataFrame:
    """Geometric mean of the precisions, 0 if any is 0; optional add-one smoothing."""
    add = 1 if smooth else 0
    p = [(F.col(f"matches_{n}") + add) / F.nullif(F.col(f"possible_{n}") + add, F.lit(0)) for n in range(1, orders + 1)]
    ratio = F.col("h_len") / F.col("r_len")
    bp = F.when(ratio > 1, F.lit(1.0)).otherwise(F.exp(1 - 1 / ratio))
    ok = F.least(*[F.coalesce(x, F.lit(0.0)) for x in p]) > 0
    return stats.select(F.when(ok, F.exp(sum(F.log(x) for x in p) / orders) * bp).otherwise(F.lit(0.0)).alias("bleu"))


def bleu_exponential(stats: DataFrame, orders: int = 4) -> DataFrame:
    """Orders without a match count as 1 / (2^k possible), k rising with each; in percent."""
    zeros = [F.when((F.col(f"matches_{n}") == 0) & (F.col(f"possible_{n}") > 0), 1).otherwise(0) for n in range(1, orders + 1)]
    logs = []
    for n in range(1, orders + 1):
        k = sum(zeros[:n], F.lit(0))
        p = F.when(F.col(f"matches_{n}") > 0, F.col(f"matches_{n}") / F.col(f"possible_{n}")).otherwise(1 / (F.pow(F.lit(2.0), k) * F.nullif(F.col(f"possible_{n}").cast("double"), F.lit(0.0))))
        logs.append(F.coalesce(F.log(p), F.lit(0.0)))
    bp = F.when(F.col("h_len") >= F.col("r_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r_len") / F.col("h_len")))
    return stats.select((100 * bp * F.exp(sum(logs) / orders)).alias("bleu"))


def bleu_smoothed(stats: DataFrame, method: str = "exp", value: float = 0.1, effective_order: bool = False, orders: int = 4) -> DataFrame:
    """Corpus BLEU in percent with smoothing ``exp``, ``floor``, ``add-k`` (from bigrams on) or ``none``. Orders from the
    first without possible n-grams on are left out; with ``effective_order`` they do not count in the mean either."""
    alive, zeros = F.lit(True), F.lit(0)
    logs, used = [], []
    for n in range(1, orders + 1):
        m, t = F.col(f"matches_{n}").cast("double"), F.col(f"possible_{n}").cast("double")
        if method == "add-k" and n > 1:
            m, t = m + value, t + value
        alive = alive & (F.col(f"possible_{n}") > 0)
        zeros = zeros + F.when(alive & (m == 0), 1).otherwise(0)
        miss = {"exp": 100.0 / (F.pow(F.lit(2.0), zeros) * t), "floor": 100.0 * value / t}.get(method, F.lit(0.0))
        p = F.when(~alive, F.lit(0.0)).when(m > 0, 100.0 * m / t).otherwise(miss)
        logs.append(F.when(alive | F.lit(not effective_order), F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0))).otherwise(F.lit(0.0)))
        used.append(F.when(alive, 1).otherwise(0))
    count = F.greatest(sum(used), F.lit(1)) if effective_order else F.lit(orders)
    bp = F.when(F.col("h_len") < F.col("r_len"), F.when(F.col("h_len") > 0, F.exp(1 - F.col("r_len") / F.col("h_len"))).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    return stats.select((bp * F.exp(sum(logs) / count)).alias("bleu"))


def character_grams(text: str, n: int) -> Column:
    """Hashes of the n-grams of the characters of a text."""
    c = F.col(text)
    size = F.length(c)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def chrf(df: DataFrame, key: list[str], hypothesis: str, reference: str, beta: float = 2.0, orders: int = 6) -> DataFrame:
    """Character n-gram F-score of a corpus, white space left out: precision and recall per order, averaged over the orders that occur."""
    df = df.select(*key, *[F.regexp_replace(c, r"\s+", "").alias(c) for c in (hypothesis, reference)])
    m = ngram_matches(df, key, hypothesis, reference, orders, character_grams).groupBy("n").agg(F.sum("matches").alias("m"), F.sum("possible").alias("h"), F.sum("ref_possible").alias("r"))
    mean = m.where("h > 0 and r > 0").agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    b2 = beta * beta
    return mean.select(F.when(F.col("p") + F.col("q") > 0, (1 + b2) * F.col("p") * F.col("q") / (b2 * F.col("p") + F.col("q"))).otherwise(F.lit(0.0)).alias("chrf"))


def roc_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """Area under the ROC curve: targets below 0 are ignored, equal scores are one step, null with a single class.

    Points are cumulated over distinct scores by ranges, not in one task: each range adds what the ranges before hold.
    """
    from ..operators.rows import global_index

    g = df.where(F.col(target) >= 0).groupBy(score).agg(F.sum(F.when(F.col(target) > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(target) > 0, 0).otherwise(1)).alias("q"))
    g = global_index(g, F.col(score).desc(), "rn").withColumn("part", F.floor(F.col("rn") / 10_000))
    blocks = g.groupBy("part").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("part", F.coalesce(F.sum("bp").over(upto), F.lit(0)).alias("p0"))
    inside = Window.partitionBy("part").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    g = g.join(blocks, "part").withColumn("before", F.col("p0") + F.coalesce(F.sum("p").over(inside), F.lit(0)))
    return g.agg(F.sum(F.col("q") * (F.col("before") + F.col("p") / 2)).alias("a"), F.sum("p").alias("pos"), F.sum("q").alias("neg")).select((F.col("a") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auc"))
