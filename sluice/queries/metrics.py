"""Aggregations and metrics (survey 2.6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import images as I
from ..functions import metrics as M
from ..functions import text as X
from ..operators import rows as R
from .common import sql_hash01, t
from .maps import DW, PIX_SQL, W, pixels

# hypotheses are the turns of conversations, references the turns before them
HR_SQL = f"(SELECT conv_id, turn, h, r FROM (SELECT conv_id, turn, {W.format('text')} AS h, lag({W.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r IS NOT NULL)"


def hyps(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf, "conversations").withColumn("w", X.words("text"))
    return c.select("conv_id", "turn", F.col("w").alias("h"), F.lag("w").over(w).alias("r"), F.col("text").alias("ht"), F.lag("text").over(w).alias("rt")).where("r is not null")


def grams(column, key="conv_id, turn", source=HR_SQL, orders=4):
    return " UNION ALL ".join(f"SELECT {key}, {n} AS n, array_to_string({column}[i : i + {n} - 1], ' ') AS g FROM (SELECT {key}, {column}, unnest(range(1, len({column}) - {n} + 2)) AS i FROM {source})" for n in range(1, orders + 1))


def overlap(key="conv_id, turn", source=HR_SQL, a="h", b="r"):
    h = f"(SELECT {key}, n, g, count(*) AS c FROM ({grams(a, key, source)}) GROUP BY ALL)"
    r = f"(SELECT {key}, n, g, count(*) AS c FROM ({grams(b, key, source)}) GROUP BY ALL)"
    cols = key + ", n, g"
    return f"(SELECT {key}, n, CAST(sum(least(coalesce(h.c, 0), coalesce(r.c, 0))) AS BIGINT) AS matches, CAST(sum(coalesce(h.c, 0)) AS BIGINT) AS possible FROM {h} h FULL JOIN {r} r USING ({cols}) GROUP BY {key}, n)"


STATS_SQL = f"(SELECT {', '.join(f'CAST(coalesce(sum({c}) FILTER (n = {n}), 0) AS DOUBLE) AS {c[0]}{n}' for n in range(1, 5) for c in ('matches', 'possible'))}, (SELECT CAST(sum(len(h)) AS DOUBLE) FROM {HR_SQL}) AS hl, (SELECT CAST(sum(len(r)) AS DOUBLE) FROM {HR_SQL}) AS rl FROM {overlap()})"
_BP = "CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / hl) END"


def key(spark, sf):
    return hyps(spark, sf), ["conv_id", "turn"]


@query("agg_ngram", f"SELECT conv_id, turn, CAST(n AS INTEGER) AS n, matches, possible FROM {overlap()}")
def agg_ngram(spark, sf):
    return M.ngram_matches(*key(spark, sf), "h", "r").select("conv_id", "turn", "n", "matches", "possible")


@query("agg_bleu_simple", f"SELECT round(CASE WHEN least(m1, m2, m3, m4) = 0 THEN 0 ELSE exp((ln(m1 / p1) + ln(m2 / p2) + ln(m3 / p3) + ln(m4 / p4)) / 4) * {_BP} END, 6) AS bleu, round(exp((ln((m1 + 1) / (p1 + 1)) + ln((m2 + 1) / (p2 + 1)) + ln((m3 + 1) / (p3 + 1)) + ln((m4 + 1) / (p4 + 1))) / 4) * {_BP}, 6) AS smooth FROM {STATS_SQL}")
def agg_bleu_simple(spark, sf):
    df, k = key(spark, sf)
    s = M.corpus_stats(df, "h", "r", k)
    return M.bleu_simple(s).select(F.round("bleu", 6).alias("bleu")).join(M.bleu_simple(s, True).select(F.round("bleu", 6).alias("smooth")))


_EXP = " + ".join(f"CASE WHEN m{n} > 0 THEN ln({{s}} * m{n} / p{n}) ELSE ln({{s}} / (power(2, {' + '.join(f'CAST(m{j} = 0 AS INTEGER)' for j in range(1, n + 1))}) * p{n})) END" for n in range(1, 5))


@query("agg_bleu_partial_final", f"SELECT round(100 * {_BP} * exp(({_EXP.format(s=1.0)}) / 4), 6) AS bleu FROM {STATS_SQL}")
def agg_bleu_partial_final(spark, sf):
    """Statistics per shard of the conversations, then their sum."""
    df, k = key(spark, sf)
    return M.bleu_exponential(M.combine(M.corpus_stats(df, "h", "r", k, F.col("conv_id") % 4))).select(F.round("bleu", 6).alias("bleu"))


_FLOOR = " + ".join(f"ln(CASE WHEN m{n} > 0 THEN 100 * m{n} / p{n} ELSE 10.0 / p{n} END)" for n in range(1, 5))
_ADD = "ln(100 * m1 / p1) + " + " + ".join(f"ln(100 * (m{n} + 1) / (p{n} + 1))" for n in range(2, 5))


@query("agg_sacrebleu", f"SELECT round({_BP} * exp(({_EXP.format(s=100.0)}) / 4), 6) AS exp, round({_BP} * exp(({_FLOOR}) / 4), 6) AS floor, round({_BP} * exp(({_ADD}) / 4), 6) AS add_k FROM {STATS_SQL}")
def agg_sacrebleu(spark, sf):
    df, k = key(spark, sf)
    s = M.corpus_stats(df, "h", "r", k)
    one = lambda name, *a: M.bleu_smoothed(s, *a).select(F.round("bleu", 6).alias(name))
    return one("exp", "exp").join(one("floor", "floor", 0.1)).join(one("add_k", "add-k", 1.0))


def _chars(c):
    return " UNION ALL ".join(f"SELECT conv_id, turn, {n} AS n, substr(s, i, {n}) AS g FROM (SELECT conv_id, turn, s, unnest(range(1, length(s) - {n} + 2)) AS i FROM (SELECT conv_id, turn, array_to_string({c}, '') AS s FROM {HR_SQL}))" for n in range(1, 7))


@query("agg_chrf", f"SELECT round(5 * p * q / (4 * p + q), 6) AS chrf FROM (SELECT avg(m / h) AS p, avg(m / r) AS q FROM (SELECT n, CAST(sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) AS DOUBLE) AS m, sum(coalesce(a.c, 0)) AS h, sum(coalesce(b.c, 0)) AS r FROM (SELECT conv_id, turn, n, g, count(*) AS c FROM ({_chars('h')}) GROUP BY ALL) a FULL JOIN (SELECT conv_id, turn, n, g, count(*) AS c FROM ({_chars('r')}) GROUP BY ALL) b USING (conv_id, turn, n, g) GROUP BY n) WHERE h > 0 AND r > 0)")
def agg_chrf(spark, sf):
    df, k = key(spark, sf)
    return M.chrf(df, k, "ht", "rt").select(F.round("chrf", 6).alias("chrf"))


_AUC = f"SELECT d.doc_id, l.quality AS y, round({sql_hash01('d.doc_id')}, 2) AS s FROM labels l JOIN documents d USING (doc_id)"


@query("agg_roc_auc", f"SELECT round(sum(q * (b + p / 2.0)) / nullif(sum(p) * sum(q), 0), 6) AS auc FROM (SELECT p, q, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT s, CAST(count(*) FILTER (y > 0) AS DOUBLE) AS p, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS q FROM ({_AUC}) WHERE y >= 0 GROUP BY s))")
def agg_roc_auc(spark, sf):
    """Quality labels against a hash rounded to two digits, so that scores tie."""
    d = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id"), "doc_id").select(F.col("quality").alias("y"), F.round(R.hash01("doc_id"), 2).alias("s"))
    return M.roc_auc(d, "s", "y").select(F.round("auc", 6).alias("auc"))


@query("agg_eval_text")
def agg_eval_text(spark, sf):
    """Detokenise, lower-case, tokenise by the international convention, then BLEU with floor smoothing."""
    tok = lambda c: F.split(X.tokenize_international(F.lower(X.moses_detokenize(c))), " ")
    df, k = key(spark, sf)
    df = df.select(*k, tok("ht").alias("h"), tok("rt").alias("r"))
    return M.bleu_smoothed(M.corpus_stats(df, "h", "r", k), "floor", 0.1, effective_order=True).select(F.round("bleu", 4).alias("bleu"))


@query("agg_rates", "SELECT round(count(*) / (max(epoch_us(ts)) - min(epoch_us(ts))) * 1e6, 9) AS rate, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events")
def agg_rates(spark, sf):
    e = t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.agg(F.round(F.count("*") / (F.max("us") - F.min("us")) * 1e6, 9).alias("rate"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("variance"))


@query("agg_span_stats", "SELECT event_type, round(m, 6) AS mean, round(s, 6) AS std, CAST(count(*) FILTER (value > m + 2 * s) AS BIGINT) AS outliers FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events) GROUP BY event_type, m, s")
def agg_span_stats(spark, sf):
    """Few kinds may hold all rows: their statistics are grouped first and joined back by broadcast."""
    from ..operators.joins import small

    e = t(spark, sf, "events").select("event_type", "value")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    e = e.join(small(s), "event_type")
    return e.groupBy("event_type", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std")).agg(F.sum((F.col("value") > F.col("m") + 2 * F.col("s")).cast("long")).alias("outliers"))


@query("agg_token_counts", f"SELECT w, count(*) AS n FROM (SELECT unnest({DW}) AS w FROM documents) GROUP BY w")
def agg_token_counts(spark, sf):
    return t(spark, sf, "documents").select(F.explode(X.words("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("agg_token_budget", f"SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM (SELECT len({DW}) AS n, sum(strlen(text)) OVER (ORDER BY doc_id) AS upto FROM documents) WHERE upto <= 500000")
def agg_token_budget(spark, sf):
    """Words of the first texts that fit into a byte budget (the budget is the operator's parameter)."""
    d = R.global_index(t(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("b"), F.size(X.words("text")).alias("w")), "doc_id").withColumn("part", F.floor(F.col("rn") / 10_000))
    blocks = d.groupBy("part").agg(F.sum("b").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    d = d.join(blocks, "part").withColumn("upto", F.col("before") + F.sum("b").over(Window.partitionBy("part").orderBy("rn")))
    return d.where("upto <= 500000").agg(F.count("*").alias("docs"), F.sum("w").alias("words"))


@query("agg_subtoken_counts", f"SELECT g, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substr(w, i, k) AS g, n FROM (SELECT w, n, i, unnest(range(1, length(w) - i + 2)) AS k FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM (SELECT w || '_' AS w, count(*) AS n FROM (SELECT unnest({DW}) AS w FROM documents) GROUP BY 1)))) GROUP BY g")
def agg_subtoken_counts(spark, sf):
    """Weighted counts of all pieces, from every character of every word to each of its ends: as many rows a word as the
    square of its length, which is the feature; learning counts only frequent ones (``text.piece_counts``)."""
    w = t(spark, sf, "documents").select(F.explode(X.words("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("w", F.concat("w", F.lit("_")))
    rest = w.select("n", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i")).select("n", F.expr("substring(w, i)").alias("rest"))
    # equal ends of words are one row before their prefixes are made
    rest = rest.groupBy("rest").agg(F.sum("n").alias("n")).select("n", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("k"))
    return rest.groupBy(F.expr("substring(rest, 1, k)").alias("g")).agg(F.sum("n").alias("n"))


@query("agg_unique_counts", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS uniques, CAST(count(*) - count(DISTINCT c_nationkey) AS BIGINT) AS collisions FROM customer")
def agg_unique_counts(spark, sf):
    g = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("uniques"), (F.sum("n") - F.count("*")).alias("collisions"))


_HIST = f"(SELECT v, count(*) AS n FROM (SELECT unnest(p) AS v FROM {PIX_SQL}) GROUP BY v)"


@query("agg_histogram", f"SELECT v, n, CAST(CASE WHEN s = 0 THEN v ELSE least((c + s // 2) // s, 255) END AS BIGINT) AS lut FROM (SELECT v, n, c, CAST((total - last) AS BIGINT) // 255 AS s FROM (SELECT v, n, CAST(sum(n) OVER () AS BIGINT) AS total, max_by(n, v) OVER () AS last, CAST(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM {_HIST}))".replace("max_by(n, v) OVER ()", "last_value(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
def agg_histogram(spark, sf):
    return I.equalize_table(pixels(spark, sf).select(F.explode("p").alias("v")), "v")


@query("agg_minmax_scale", "SELECT p_partkey, round(CASE WHEN hi > lo THEN (p_retailprice - lo) * 255 / (hi - lo) ELSE p_retailprice END, 6) AS scaled FROM (SELECT p_partkey, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi FROM part)")
def agg_minmax_scale(spark, sf):
    from ..operators.joins import small

    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    p = p.join(small(p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))), "p_brand")
    v = F.col("p_retailprice")
    return p.select("p_partkey", F.round(F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))).otherwise(v), 6).alias("scaled"))


@query("agg_least_squares", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS m, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b FROM lineitem GROUP BY 1")
def agg_least_squares(spark, sf):
    from ..plans.perfmodel import least_squares

    return least_squares(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("m", 4).alias("m"), F.round("b", 2).alias("b"))


@query("agg_piecewise_fit", "SELECT 3 AS i, 8.285714 AS m1, 2.0 AS b1, 0.035714 AS m2, 41.0 AS b2, 4.0 AS x_thresh, 0.031888 AS error")
def agg_piecewise_fit(spark, sf):
    from ..plans.perfmodel import piecewise_fit

    d = spark.createDataFrame([(1.0, 10.0), (2.0, 19.0), (4.0, 35.0), (8.0, 41.0), (16.0, 42.0), (32.0, 42.0)], "x double, y double")
    return piecewise_fit(d, "x", "y").select("i", *[F.round(c, 6).alias(c) for c in ("m1", "b1", "m2", "b2", "x_thresh", "error")])


@query("agg_subsample_sim", f"SELECT CAST(k AS INTEGER) AS trial, round(abs(sum(s) / count(*) * max(total) / max(whole) - 1), 6) AS error FROM (SELECT k, s, total, whole, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(doc_id AS VARCHAR) || '-' || CAST(k AS VARCHAR)), doc_id) AS r FROM (SELECT doc_id, strlen(text) AS s, count(*) OVER () AS total, sum(strlen(text)) OVER () AS whole FROM documents), range(5) t(k)) WHERE r <= 50 GROUP BY k")
def agg_subsample_sim(spark, sf):
    """Five trials: the total size extrapolated from 50 sampled texts, against the truth."""
    d = t(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("s"))
    total = d.agg(F.count("*").alias("total"), F.sum("s").alias("whole"))
    h = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("trial").cast("string")).cast("binary"))
    d = R.repeat(d, 5, "trial").withColumn("r", F.row_number().over(Window.partitionBy("trial").orderBy(h, "doc_id"))).where("r <= 50")
    return d.join(F.broadcast(total)).groupBy("trial").agg(F.round(F.abs(F.sum("s") / F.count("*") * F.max("total") / F.max("whole") - 1), 6).alias("error"))


@query("agg_best", "SELECT max_by(s_name, s_acctbal) AS name, max(s_acctbal) AS rate FROM supplier")
def agg_best(spark, sf):
    return t(spark, sf, "supplier").agg(F.max_by("s_name", "s_acctbal").alias("name"), F.max("s_acctbal").alias("rate"))


@query("agg_common_prefix", "SELECT substr(a, 1, CAST(coalesce(list_min(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))), length(a) + 1) - 1 AS BIGINT)) AS prefix FROM (SELECT min(c_name) AS a, max(c_name) AS b FROM customer)")
def agg_common_prefix(spark, sf):
    """The common prefix of the least and the greatest string is that of all."""
    m = t(spark, sf, "customer").agg(F.min("c_name").alias("a"), F.max("c_name").alias("b"))
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.length("a")), lambda i: F.substring(F.col("a"), i, F.lit(1)) != F.substring(F.col("b"), i, F.lit(1))))
    return m.select(F.expr("a").substr(F.lit(1), F.coalesce(at - 1, F.length("a"))).alias("prefix"))


@query("agg_dataset_size", f"SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(2 * len({DW}) + 4) AS BIGINT) AS tensors FROM documents")
def agg_dataset_size(spark, sf):
    return t(spark, sf, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(2 * F.size(X.words("text")) + 4).alias("tensors"))


@query("agg_all_equal", "SELECT count(DISTINCT len(embedding)) = 1 AS same FROM embeddings")
def agg_all_equal(spark, sf):
    return t(spark, sf, "embeddings").agg((F.countDistinct(F.size("embedding")) == 1).alias("same"))
