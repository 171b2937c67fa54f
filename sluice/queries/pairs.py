"""Joins, look-ups and boxes (survey 2.5, and the box operators of 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import boxes as B
from ..operators import joins as J
from ..operators import rows as R
from .common import sql_hash, sql_hash01, t
from .maps import BOX_SQL, DW, boxes
from .sources import SQL_VOCAB, vocabulary


@query("zip", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS rn FROM supplier) USING (rn)")
def zip_(spark, sf):
    c, s = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "supplier").select("s_suppkey")
    return J.zip_frames(c, "c_custkey", s, F.col("s_suppkey").desc())


@query("lookup", f"SELECT doc_id, CAST(sum(coalesce(v.id, 0)) AS BIGINT) AS total, count(*) AS n, CAST(count(*) FILTER (v.id IS NULL) AS BIGINT) AS unknown FROM (SELECT doc_id, unnest({DW}) AS w FROM documents) d LEFT JOIN ({SQL_VOCAB}) v ON v.token = d.w GROUP BY doc_id")
def lookup(spark, sf):
    """Ids of all words of a text, 0 for unknown ones."""
    w = t(spark, sf, "documents").select("doc_id", F.explode(X.words("text")).alias("w"))
    ids = J.lookup(w, "w", vocabulary(spark, sf), "token", "id", None)
    return ids.groupBy("doc_id").agg(F.sum(F.coalesce("id", F.lit(0))).alias("total"), F.count("*").alias("n"), F.sum(F.col("id").isNull().cast("long")).alias("unknown"))


def _bucket(c, n):
    return f"(CAST(('0x' || substr({sql_hash(c)}, 1, 8)) AS BIGINT) % {n})"


@query("lookup_hashed", f"SELECT doc_id, CAST(sum(coalesce(b.id, 0)) AS BIGINT) AS total FROM (SELECT doc_id, unnest({DW}) AS w FROM documents) d LEFT JOIN (SELECT {_bucket('token', 4099)} AS m, {_bucket('token', 257)} AS k, max(id) AS id FROM ({SQL_VOCAB}) GROUP BY 1, 2) b ON b.m = {_bucket('d.w', 4099)} AND b.k = {_bucket('d.w', 257)} GROUP BY doc_id")
def lookup_hashed(spark, sf):
    """A lossy table: a word is known if its membership bucket is taken, and has the id of its value bucket."""
    w = t(spark, sf, "documents").select("doc_id", F.explode(X.words("text")).alias("w"))
    return J.lookup_hashed(w, "w", vocabulary(spark, sf), "token", "id", 4099, 257).groupBy("doc_id").agg(F.sum("id").alias("total"))


@query("lookup_reverse", f"SELECT o_orderkey, coalesce(v.token, '<unk>') AS token FROM orders LEFT JOIN ({SQL_VOCAB}) v ON v.id = o_custkey % 700")
def lookup_reverse(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 700).alias("k"))
    return J.lookup(o, "k", vocabulary(spark, sf), "id", "token", "<unk>").select("o_orderkey", "token")


@query("lookup_item", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_item(spark, sf):
    return J.lookup(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", t(spark, sf, "nation"), "n_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("join_index_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_index_left(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_index_inner", "SELECT a.event_id, CAST(b.event_id - a.event_id AS BIGINT) AS d FROM events a JOIN events b ON a.event_id = b.event_id")
def join_index_inner(spark, sf):
    a = t(spark, sf, "events").select("event_id", F.col("event_id").alias("start"))
    b = t(spark, sf, "events").select("event_id", F.col("event_id").alias("stop"))
    return a.join(b, "event_id").select("event_id", (F.col("stop") - F.col("start")).alias("d"))


@query("join_graph_attrs", "SELECT n.n_nationkey, count(c.c_custkey) AS customers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def join_graph_attrs(spark, sf):
    stats = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return t(spark, sf, "nation").join(stats, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("c", F.lit(0)).alias("customers"))


_I = "greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0) * greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0)"
_IOU = f"CASE WHEN {_I} = 0 THEN 0 ELSE {_I} / ((a.ymax - a.ymin) * (a.xmax - a.xmin) + (b.ymax - b.ymin) * (b.xmax - b.xmin) - {_I}) END"
# rows are the boxes with odd numbers, columns those with even numbers
PAIR_SQL = f"(SELECT a.img, a.k AS r, b.k AS c, {_IOU} AS iou FROM {BOX_SQL} a JOIN {BOX_SQL} b ON a.img = b.img AND a.k % 2 = 1 AND b.k % 2 = 0)"


def iou_pairs(spark, sf):
    b = boxes(spark, sf)
    a = b.where("k % 2 = 1").select("img", F.col("k").alias("r"), *[F.col(s).alias(f"a_{s}") for s in B.SIDES])
    c = b.where("k % 2 = 0").select("img", F.col("k").alias("c"), *[F.col(s).alias(f"b_{s}") for s in B.SIDES])
    return a.join(c, "img").select("img", "r", "c", B.iou(B.box("a"), B.box("b")).alias("iou"))


@query("cross_iou", f"SELECT img, r, c, round(iou, 6) AS iou FROM {PAIR_SQL}")
def cross_iou(spark, sf):
    """All pairs of boxes of an image, by an equi-join on the image."""
    return iou_pairs(spark, sf).withColumn("iou", F.round("iou", 6))


_MATCH = f"""(SELECT b.img, b.c, coalesce(f.forced, b.match) AS match FROM
 (SELECT img, c, CAST(CASE WHEN iou >= 0.3 THEN r WHEN iou < 0.1 THEN -1 ELSE -2 END AS BIGINT) AS match FROM (SELECT *, row_number() OVER (PARTITION BY img, c ORDER BY iou DESC, r) AS n FROM {PAIR_SQL}) WHERE n = 1) b
 LEFT JOIN (SELECT img, c, CAST(min(r) AS BIGINT) AS forced FROM (SELECT *, row_number() OVER (PARTITION BY img, r ORDER BY iou DESC, c) AS n FROM {PAIR_SQL}) WHERE n = 1 GROUP BY 1, 2) f ON f.img = b.img AND f.c = b.c)"""


def matches(spark, sf):
    return B.match(iou_pairs(spark, sf), "img", "r", "c", "iou", 0.3, 0.1)


@query("anchor_match", f"SELECT img, c, match FROM {_MATCH}")
def anchor_match(spark, sf):
    return matches(spark, sf)


@query("match_gather", f"SELECT m.img, m.c, CASE m.match WHEN -1 THEN 0 WHEN -2 THEN -1 ELSE b.class END AS class FROM {_MATCH} m LEFT JOIN {BOX_SQL} b ON b.img = m.img AND b.k = m.match")
def match_gather(spark, sf):
    m = matches(spark, sf)
    b = boxes(spark, sf).select("img", F.col("k").cast("long").alias("match"), F.col("class").alias("own"))
    return m.join(b, ["img", "match"], "left").select("img", "c", F.when(F.col("match") == -1, F.lit(0)).when(F.col("match") == -2, F.lit(-1)).otherwise(F.col("own")).alias("class"))


@query("semi_validate", "SELECT CAST(count(*) AS BIGINT) AS outside FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def semi_validate(spark, sf):
    return t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("outside"))


@query("anti_diff", "SELECT DISTINCT p_size AS k, 'removed' AS side FROM part WHERE p_size NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT DISTINCT c_nationkey, 'added' FROM customer WHERE c_nationkey NOT IN (SELECT p_size FROM part)")
def anti_diff(spark, sf):
    a, b = t(spark, sf, "part").select(F.col("p_size").alias("k")), t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return J.differences(a, b, "k")


_POS = "(SELECT img, k, class < 2 AS pos FROM {})".format(BOX_SQL)


@query("win_pos_neg_sampler", f"SELECT img, k, pos FROM (SELECT *, row_number() OVER (PARTITION BY img, pos ORDER BY {sql_hash('k', 3)}, k) AS r, least(count(*) FILTER (pos) OVER (PARTITION BY img), 2) AS p FROM {_POS}) WHERE CASE WHEN pos THEN r <= 2 ELSE r <= 4 - p END")
def win_pos_neg_sampler(spark, sf):
    """Four boxes an image, at most half of them positive; the order is a hash."""
    b = boxes(spark, sf).select("img", "k", (F.col("class") < 2).alias("pos")).withColumn("h", F.concat(R.hash_key("k", 3), F.lpad(F.col("k").cast("string"), 10, "0")))
    return B.sample_balanced(b, "img", "pos", "h", 4, 0.5).select("img", "k", "pos")


_IND = f"(SELECT img, k, pos, pos OR row_number() OVER (PARTITION BY img ORDER BY pos DESC, {sql_hash('k', 4)}, k) <= 3 AS ind FROM {_POS})"


@query("win_static_sampler", f"SELECT img, k, pos FROM (SELECT *, row_number() OVER (PARTITION BY img, ind, pos ORDER BY {sql_hash('k', 5)}, k) AS r, count(*) FILTER (ind AND pos) OVER (PARTITION BY img) AS p FROM {_IND}) WHERE ind AND CASE WHEN pos THEN r <= 1 ELSE r <= 3 - least(p, 1) END")
def win_static_sampler(spark, sf):
    """The indicator is topped up to three rows; then at most one positive, and negatives to fill."""
    from pyspark.sql import Window

    key = lambda seed: F.concat(R.hash_key("k", seed), F.lpad(F.col("k").cast("string"), 10, "0"))
    b = boxes(spark, sf).select("img", "k", (F.col("class") < 2).alias("pos"))
    b = b.withColumn("ind", F.col("pos") | (F.row_number().over(Window.partitionBy("img").orderBy(F.desc("pos"), key(4))) <= 3)).where("ind").withColumn("h", key(5))
    return B.sample_balanced(b, "img", "pos", "h", 3, 1 / 3).select("img", "k", "pos")


@query("win_hard_neg_topk", f"SELECT img, k, NOT pos AND rk <= 3 * p AS hard FROM (SELECT *, rank() OVER (PARTITION BY img ORDER BY CASE WHEN pos THEN 0 ELSE score END DESC) AS rk, count(*) FILTER (pos) OVER (PARTITION BY img) AS p FROM (SELECT img, k, class = 0 AS pos, score FROM {BOX_SQL}))")
def win_hard_neg_topk(spark, sf):
    return B.hard_negatives(boxes(spark, sf).withColumn("pos", F.col("class") == 0), "img", "pos", "score").select("img", "k", "hard")


# boxes of an image's class in the order of falling score; a row adds itself to the list of kept ones unless one of them covers it
_OVER = "list_filter(kept, lambda y: greatest(least(y.ymax, o.ymax) - greatest(y.ymin, o.ymin), 0) * greatest(least(y.xmax, o.xmax) - greatest(y.xmin, o.xmin), 0) > 0.5 * ((y.ymax - y.ymin) * (y.xmax - y.xmin) + (o.ymax - o.ymin) * (o.xmax - o.xmin) - greatest(least(y.ymax, o.ymax) - greatest(y.ymin, o.ymin), 0) * greatest(least(y.xmax, o.xmax) - greatest(y.xmin, o.xmin), 0)))"
_BOX = "{'k': o.k, 'ymin': o.ymin, 'xmin': o.xmin, 'ymax': o.ymax, 'xmax': o.xmax}"
NMS_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY img, class ORDER BY score DESC, k) AS rn FROM {BOX_SQL}),
 r AS (SELECT img, class, rn, [{_BOX}] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.img, o.class, o.rn, CASE WHEN len(kept) < 100 AND len({_OVER}) = 0 THEN list_append(kept, {_BOX}) ELSE kept END FROM r JOIN o ON o.img = r.img AND o.class = r.class AND o.rn = r.rn + 1)
SELECT img, unnest(kept).k AS k FROM (SELECT img, class, max_by(kept, rn) AS kept FROM r GROUP BY 1, 2)"""


@query("nms", NMS_SQL)
def nms(spark, sf):
    b = boxes(spark, sf)
    return B.nms(b.select("img", "k", *B.SIDES, "score", "class"), ["img", "class"], "score", "k", 0.5, 100).select("img", "k")


@query("agg_matched", f"SELECT img, CAST(count(*) FILTER (match >= 0) AS BIGINT) AS matched FROM {_MATCH} GROUP BY img")
def agg_matched(spark, sf):
    return matches(spark, sf).groupBy("img").agg(F.sum((F.col("match") >= 0).cast("long")).alias("matched"))


# candidates of a detection, best first; the detections that have some, in the order of falling score, take the first that is free
_COCO_SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY img, class ORDER BY score DESC, k) AS rank FROM {BOX_SQL} WHERE k % 2 = 0),
 p AS (SELECT b.img, b.class, b.rank, list({{'k': a.k, 'iou': {_IOU}}} ORDER BY {_IOU} DESC, a.k DESC) AS near FROM (SELECT * FROM {BOX_SQL} WHERE k % 2 = 1) a JOIN d b ON a.img = b.img AND a.class = b.class WHERE b.rank <= 100 AND {_IOU} >= 0.5 GROUP BY 1, 2, 3),
 q AS (SELECT p.*, l.i / 100.0 AS level, row_number() OVER (PARTITION BY img, class, l.i ORDER BY rank) AS rn FROM p, (VALUES (50), (55), (60), (65), (70), (75), (80), (85), (90), (95)) l(i)),
 r AS (SELECT img, class, level, rn, rank, list_filter(near, lambda c: c.iou >= level)[1].k AS got, list_filter([list_filter(near, lambda c: c.iou >= level)[1].k], lambda k: k IS NOT NULL) AS taken FROM q WHERE rn = 1
  UNION ALL SELECT q.img, q.class, q.level, q.rn, q.rank, list_filter(q.near, lambda c: c.iou >= q.level AND NOT list_contains(r.taken, c.k))[1].k,
   list_concat(r.taken, list_filter([list_filter(q.near, lambda c: c.iou >= q.level AND NOT list_contains(r.taken, c.k))[1].k], lambda k: k IS NOT NULL))
  FROM r JOIN q ON q.img = r.img AND q.class = r.class AND q.level = r.level AND q.rn = r.rn + 1),
 n AS (SELECT class, CAST(count(*) AS BIGINT) AS total FROM {BOX_SQL} WHERE k % 2 = 1 GROUP BY 1),
 s AS (SELECT d.class, l.i / 100.0 AS threshold, row_number() OVER (PARTITION BY d.class, l.i ORDER BY score DESC, d.img, d.rank) AS seen,
   count(r.got) OVER (PARTITION BY d.class, l.i ORDER BY score DESC, d.img, d.rank ROWS UNBOUNDED PRECEDING) AS hits
  FROM d CROSS JOIN (VALUES (50), (55), (60), (65), (70), (75), (80), (85), (90), (95)) l(i) LEFT JOIN r ON r.img = d.img AND r.class = d.class AND r.rank = d.rank AND r.level = l.i / 100.0 WHERE d.rank <= 100),
 c AS (SELECT s.class, threshold, p.i AS point, max(hits / seen) FILTER (100 * hits >= p.i * total) AS best FROM (SELECT class, threshold, hits, min(seen) AS seen FROM s WHERE hits > 0 GROUP BY 1, 2, 3) s JOIN n ON n.class = s.class, range(101) p(i) GROUP BY 1, 2, 3)
SELECT n.class, CAST(l.i / 100.0 AS DOUBLE) AS threshold, round(coalesce((SELECT sum(best) FROM c WHERE c.class = n.class AND c.threshold = l.i / 100.0), 0) / 101, 6) AS ap,
 round(coalesce((SELECT max(hits) FROM s WHERE s.class = n.class AND s.threshold = l.i / 100.0), 0) / total, 6) AS recall
FROM n, (VALUES (50), (55), (60), (65), (70), (75), (80), (85), (90), (95)) l(i)"""


def detections(spark, sf):
    b = boxes(spark, sf)
    return b.where("k % 2 = 1").select("img", "class", F.col("k").cast("long").alias("k"), *B.SIDES), b.where("k % 2 = 0").select("img", "class", "k", *B.SIDES, "score")


@query("agg_coco", _COCO_SQL)
def agg_coco(spark, sf):
    """Average precision and recall of detections against truth at ten thresholds: greedy matching per image and class."""
    from ..functions.detection import coco

    return coco(*detections(spark, sf))


@query("agg_coco_summary")
def agg_coco_summary(spark, sf):
    """The twelve measures over classes, thresholds and size ranges."""
    from ..functions.detection import coco_summary

    return coco_summary(*detections(spark, sf))
