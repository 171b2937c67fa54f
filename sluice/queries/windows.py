"""Windows, sort, top-k, packing and streaming (survey 2.6 group_by_window, 2.7, 2.9, 2.12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import packing as P
from ..operators import rows as R
from ..operators import series as S
from ..streaming import windows as ST
from .common import sql_hash, t
from .maps import BOX_SQL, DW, PAIRS_SQL, boxes, pairs
from .sources import SQL_VOCAB, vocabulary

_P6 = f"""WITH p AS (SELECT doc_id, src[1:148] AS src, tgt[1:149] AS tgt FROM {PAIRS_SQL} WHERE len(src) > 0 AND len(tgt) > 0),
v AS ({SQL_VOCAB}),
ids AS (SELECT doc_id, CAST(sum(coalesce(id, 0)) AS BIGINT) AS s FROM (SELECT doc_id, unnest(src) AS w FROM p) LEFT JOIN v ON v.token = w GROUP BY 1),
b AS (SELECT p.doc_id, s + 3 AS ids, len(src) + 2 AS l, least(5, greatest((len(src) + 2) // 30, (len(tgt) + 1) // 30)) AS bucket FROM p JOIN ids USING (doc_id)),
w AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // 64 AS win FROM b)
SELECT bucket, win AS window, count(*) AS n, CAST(sum(ids) AS BIGINT) AS ids, CAST(max(l) AS BIGINT) AS longest FROM w GROUP BY 1, 2"""


@query("group_by_window", _P6)
def group_by_window(spark, sf):
    """The text-pair pipeline: split, drop empty, truncate, look up ids, add end markers, bucket by length, and windows
    of 64 pairs per bucket."""
    from ..operators.joins import lookup

    p = pairs(spark, sf).where("size(src) > 0 and size(tgt) > 0").select("doc_id", F.slice("src", 1, 148).alias("src"), F.slice("tgt", 1, 149).alias("tgt"))
    words = lookup(p.select("doc_id", F.explode("src").alias("w")), "w", vocabulary(spark, sf), "token", "id", 0)
    ids = words.groupBy("doc_id").agg((F.sum("id") + 3).alias("ids"))
    p = p.select("doc_id", (F.size("src") + 2).alias("l"), X.bucket_key(F.size("src") + 2, F.size("tgt") + 1, 5, 150).alias("bucket")).join(ids, "doc_id")
    return R.group_by_window(p, "bucket", 64, "doc_id").groupBy("bucket", "window").agg(F.count("*").alias("n"), F.sum("ids").alias("ids"), F.max("l").cast("long").alias("longest"))


@query("bucket_key", f"SELECT doc_id, least(5, greatest(len(src) // 30, len(tgt) // 30)) AS a, least(5, greatest(len(src) // 10, len(tgt) // 10)) AS b FROM {PAIRS_SQL}")
def bucket_key(spark, sf):
    return pairs(spark, sf).select("doc_id", X.bucket_key(F.size("src"), F.size("tgt"), 5, 150).alias("a"), X.bucket_key(F.size("src"), F.size("tgt"), 5, None).alias("b"))


@query("group_by_window_events", "SELECT event_type, w AS window, count(*) AS n, min(event_id) AS first FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS w, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE (w + 1) * 64 <= c GROUP BY 1, 2")
def group_by_window_events(spark, sf):
    """Full windows of 64 events per kind."""
    e = R.group_by_window(t(spark, sf, "events").select("event_type", "event_id"), "event_type", 64, "event_id", drop_remainder=True)
    return e.groupBy("event_type", "window").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("win_diff", "SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events")
def win_diff(spark, sf):
    return S.diff(t(spark, sf, "events").select("event_id", "user_id"), "event_id", "event_id", ["user_id"], "d").select("event_id", "d")


@query("win_elapsed_rate", "SELECT user_id, event_id, round(count(*) OVER w / sum(1 + event_id % 3) OVER w, 6) AS cumulative, round(1.0 / (1 + event_id % 3), 6) AS current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win_elapsed_rate(spark, sf):
    """Elements per second so far, and of the last loop alone."""
    e = t(spark, sf, "events").select("user_id", "event_id", F.lit(1).alias("n"), (1 + F.col("event_id") % 3).alias("s"))
    return S.rates(e, "n", "s", "event_id", ["user_id"]).select("user_id", "event_id", F.round("cumulative", 6).alias("cumulative"), F.round("current", 6).alias("current"))


_RATE = "(SELECT user_id, event_id, 100 + event_id % 7 AS rate, event_type AS change FROM events)"


@query("win_plateau", f"SELECT user_id, event_id, coalesce(n >= 5 AND (max(g) OVER w < 1.10 OR avg(g) OVER w <= 1.01), false) AS plateau FROM (SELECT *, rate / lag(rate, 4) OVER (PARTITION BY user_id ORDER BY event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {_RATE}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def win_plateau(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", (100 + F.col("event_id") % 7).alias("rate"))
    return S.plateau(e, "rate", "event_id", ["user_id"]).select("user_id", "event_id", "plateau")


@query("win_cycle", "SELECT user_id, event_id, n >= 5 AND same = 4 AS cycle FROM (SELECT user_id, event_id, row_number() OVER w AS n, sum(CASE WHEN event_type = prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS same FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def win_cycle(spark, sf):
    """The same change five times in a row."""
    return S.cycle(t(spark, sf, "events").select("user_id", "event_id", "event_type"), "event_type", "event_id", ["user_id"]).select("user_id", "event_id", "cycle")


@query("win_converged", "SELECT user_id, min(event_id) AS stop FROM (SELECT user_id, event_id, r, n, lag(r) OVER (PARTITION BY user_id ORDER BY event_id) AS p, s FROM (SELECT user_id, event_id, count(*) OVER w / sum(1 + event_id % 3) OVER w AS r, sum(1 + event_id % 3) OVER w AS s, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n % 5 = 0) WHERE abs(p / r - 1) < 0.05 AND s >= 12 GROUP BY 1")
def win_converged(spark, sf):
    """Where the cumulative rate, looked at every five events, has settled."""
    e = t(spark, sf, "events").select("user_id", "event_id", F.lit(1).alias("n"), (1 + F.col("event_id") % 3).alias("s"))
    return S.converged(e, "n", "s", "event_id", ["user_id"], every=5, tolerance=0.05, least_s=12).select("user_id", F.col("event_id").alias("stop"))


@query("win_cumsum_seg", "SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) * CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END AS segment FROM lineitem")
def win_cumsum_seg(spark, sf):
    """Segment numbers: how many segments have begun, 0 at padding."""
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("starts"), (F.col("l_quantity") > 5).alias("real"))
    return S.segments(line, "starts", "real", "l_linenumber", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "segment")


@query("win_position", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position FROM lineitem")
def win_position(spark, sf):
    return S.position(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("position").cast("long"))


@query("topk_flat", "SELECT vec_id, j AS class, round(v, 6) AS score FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j FROM embeddings) ORDER BY v DESC, vec_id, j LIMIT 50")
def topk_flat(spark, sf):
    """The 50 largest of all (row, class) scores."""
    e = t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("class", "v")).withColumn("v", F.col("v").cast("double"))
    return e.orderBy(F.desc("v"), "vec_id", "class").limit(50).select("vec_id", "class", F.round("v", 6).alias("score"))


@query("topk_per_class", f"SELECT img, k, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, img, k) AS r FROM {BOX_SQL} WHERE score > 5000) WHERE r <= 20")
def topk_per_class(spark, sf):
    """The planner keeps 20 rows per class of each task before the shuffle."""
    w = Window.partitionBy("class").orderBy(F.desc("score"), "img", "k")
    return boxes(spark, sf).where("score > 5000").withColumn("r", F.row_number().over(w)).where("r <= 20").select("img", "k", "class")


@query("beam_topk", "SELECT vec_id, CAST(c % 8 AS BIGINT) AS token, CAST(c // 8 AS BIGINT) AS beam FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, c) AS r FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings)) WHERE r <= 4")
def beam_topk(spark, sf):
    """The top four of flattened (beam, token) scores, and their beam and token."""
    scored = F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("c")))
    e = t(spark, sf, "embeddings").select("vec_id", F.explode(F.slice(F.array_sort(scored), 1, 4)).alias("e"))
    return e.select("vec_id", (F.col("e.c") % 8).cast("long").alias("token"), F.floor(F.col("e.c") / 8).alias("beam"))


@query("sort_multi", "SELECT w, n, row_number() OVER (ORDER BY n DESC, w DESC) - 1 AS pos FROM (SELECT w, count(*) AS n FROM (SELECT unnest(" + DW + ") AS w FROM documents) GROUP BY w)")
def sort_multi(spark, sf):
    words = t(spark, sf, "documents").select(F.explode(X.words("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return R.global_index(words, [F.desc("n"), F.desc("w")], "pos")


_DAG = [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "f"), ("e", "f"), ("a", "f")]


@query("topo_sort", "SELECT * FROM (VALUES ('a', 0), ('b', 0), ('c', 1), ('d', 2), ('e', 2), ('f', 3)) v(node, depth)")
def topo_sort(spark, sf):
    """Longest distance of each node from a source, by a recursive query."""
    return S.depths(spark, spark.createDataFrame(_DAG, "src string, dst string"))


_PACK_ROWS = f"(SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b, CAST(least(64, len({DW})) AS BIGINT) AS a, CAST(least(20, len({DW})) AS BIGINT) AS c FROM documents)"


_PACK_SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS i FROM {_PACK_ROWS}),
r AS (SELECT doc_id, b, i, CAST(0 AS BIGINT) AS row, a AS fa, c AS fc FROM d WHERE i = 1
UNION ALL SELECT d.doc_id, d.b, d.i, CASE WHEN r.fa + d.a <= 64 AND r.fc + d.c <= 64 THEN r.row ELSE r.row + 1 END, CASE WHEN r.fa + d.a <= 64 AND r.fc + d.c <= 64 THEN r.fa + d.a ELSE d.a END, CASE WHEN r.fa + d.a <= 64 AND r.fc + d.c <= 64 THEN r.fc + d.c ELSE d.c END FROM r JOIN d ON d.b = r.b AND d.i = r.i + 1)"""


@query("pack", f"{_PACK_SQL} SELECT b AS batch_id, row, CAST(64 AS BIGINT) AS n, CAST(coalesce(max(example) FILTER (a > 0), 0) AS BIGINT) AS examples FROM (SELECT r.b, r.row, d.a, row_number() OVER (PARTITION BY r.b, r.row ORDER BY r.doc_id) AS example FROM r JOIN d ON d.doc_id = r.doc_id) GROUP BY 1, 2")
def pack(spark, sf):
    """Greedy packing of word-length sequences into rows of 64, in batches of 64 examples."""
    d = t(spark, sf, "documents").select("doc_id", F.transform(F.slice(X.words("text"), 1, 64), lambda w: F.length(w)).alias("inputs"), F.transform(F.slice(X.words("text"), 1, 20), lambda w: F.length(w)).alias("targets"))
    return P.pack(d, "doc_id", ["inputs", "targets"], 64, 64).select("batch_id", "row", F.size("inputs").cast("long").alias("n"), F.array_max("inputs_segmentation").cast("long").alias("examples"))


@query("pack_lengths", f"{_PACK_SQL} SELECT doc_id, b AS batch_id, row FROM r")
def pack_lengths(spark, sf):
    """Which packed row each example goes to."""
    w = F.size(X.words("text"))
    d = t(spark, sf, "documents").select("doc_id", F.least(F.lit(64), w).cast("long").alias("a"), F.least(F.lit(20), w).cast("long").alias("c"))
    return P.assign_rows(d, "doc_id", ["a", "c"], 64, 64).select("doc_id", "batch_id", "row")


# ------------------------------------------------------------------ streams


@query("st_count_window", "SELECT event_type, w AS window, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS w, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE (w + 1) * 64 <= c GROUP BY 1, 2")
def st_count_window(spark, sf):
    """Keyed count windows over a stream of the events; a stream never flushes an unfinished window."""
    return ST.run_count_window(spark, f"{sf}/events.parquet", "event_type", "event_id", 64)


@query("st_shuffle_buffer")
def st_shuffle_buffer(spark, sf):
    return R.shuffle_buffer(t(spark, sf, "events").select("event_id"), "event_id", 32)


@query("st_monitor")
def st_monitor(spark, sf):
    import time

    from ..plans.trace import Monitor

    with Monitor(0.02) as m:
        time.sleep(0.1)
    return m.frame(spark)


@query("st_time_limit")
def st_time_limit(spark, sf):
    from ..plans.trace import benchmark

    b = benchmark(t(spark, sf, "nation"), 5.0, batch=5)
    return spark.createDataFrame([(b["elements"], b["global_element_rate"], len(b["data_load_times"]))], "elements long, rate double, batches int")


@query("st_periodic_dump", "SELECT CAST(count(*) AS BIGINT) AS rows FROM events")
def st_periodic_dump(spark, sf):
    """Row counts that a stream's progress reports at every micro-batch, summed."""
    return ST.progress_rows(spark, f"{sf}/events.parquet")


@query("st_iter_trace", "SELECT CAST(count(*) AS BIGINT) AS pulls, true AS ordered FROM nation")
def st_iter_trace(spark, sf):
    from ..plans.trace import iter_trace

    rows = list(iter_trace(t(spark, sf, "nation")))
    return spark.createDataFrame([(len(rows), all(a <= b for _, a, b in rows))], "pulls long, ordered boolean")
