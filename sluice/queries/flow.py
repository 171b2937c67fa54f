"""Order, partition, cardinality, batch and set operators (survey 2.4, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import rows as R
from .common import sql_hash, sql_hash01, t
from .maps import DW

RN = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)"


def orders(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def customers(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_nationkey")


@query("shard", f"SELECT o_orderkey FROM {RN} WHERE rn % 7 = 3")
def shard(spark, sf):
    return R.shard(orders(spark, sf), 7, 3, "o_orderkey").select("o_orderkey")


@query("shard_shared", f"SELECT o_orderkey FROM {RN} WHERE rn % 4 = 2")
def shard_shared(spark, sf):
    """Host 5 of 8, two of which share each of four shards."""
    return R.shard_shared(orders(spark, sf), 8, 5, 2, "o_orderkey").select("o_orderkey")


@query("take", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def take(spark, sf):
    return R.take(orders(spark, sf), 100, "o_orderkey").select("o_orderkey")


@query("skip", f"SELECT o_orderkey FROM {RN} WHERE rn >= 100")
def skip(spark, sf):
    return R.skip(orders(spark, sf), 100, "o_orderkey").select("o_orderkey")


@query("repeat_n", "SELECT c_custkey, CAST(e AS INTEGER) AS epoch FROM customer, range(3) r(e)")
def repeat_n(spark, sf):
    return R.repeat(customers(spark, sf), 3).select("c_custkey", "epoch")


@query("repeat_inf", "SELECT n_nationkey, CAST(e AS INTEGER) AS epoch FROM nation, range(5) r(e) ORDER BY e, n_nationkey LIMIT 110")
def repeat_inf(spark, sf):
    """The first 110 rows of an endless repetition."""
    return R.repeat_take(t(spark, sf, "nation").select("n_nationkey"), 110, "n_nationkey")


@query("shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash('o_orderkey', 5)}, o_orderkey) - 1 AS pos FROM orders")
def shuffle(spark, sf):
    return R.shuffle(orders(spark, sf), "o_orderkey", 5).select("o_orderkey", "pos")


@query("shuffle_buffer")
def shuffle_buffer(spark, sf):
    return R.shuffle_buffer(orders(spark, sf), "o_orderkey", 64).select("o_orderkey", "pos")


@query("shuffle_repeat_order", f"SELECT c_custkey, CAST(e AS INTEGER) AS epoch, row_number() OVER (ORDER BY e, {sql_hash('c_custkey', 1, 'e')}, c_custkey) - 1 AS pos FROM customer, range(2) r(e)")
def shuffle_repeat_order(spark, sf):
    return R.shuffle_repeat(customers(spark, sf), "c_custkey", 2, 1).select("c_custkey", "epoch", "pos")


_INTER = "SELECT o_orderkey, row_number() OVER (ORDER BY g, b, s, r) - 1 AS pos FROM (SELECT o_orderkey, s, r, s // 2 AS g, r // 3 AS b FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS s FROM orders))"


@query("interleave", _INTER)
def interleave(spark, sf):
    """Two priorities at a time, three rows each in turn."""
    return R.interleave(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 2, 3).select("o_orderkey", "pos")


@query("interleave_nondet", "SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def interleave_nondet(spark, sf):
    return orders(spark, sf).select("o_orderkey").union(t(spark, sf, "lineitem").select("l_orderkey"))


@query("interleave_outer", "SELECT s_suppkey, CAST(p AS INTEGER) AS replica FROM supplier, range(3) r(p)")
def interleave_outer(spark, sf):
    return R.repeat(t(spark, sf, "supplier").select("s_suppkey"), 3, "replica")


@query("flat_map", f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, w FROM (SELECT doc_id, unnest({DW}) AS w, generate_subscripts({DW}, 1) AS i FROM documents)")
def flat_map(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.posexplode(X.words("text")).alias("i", "w")).select("doc_id", F.col("i").cast("long"), "w")


@query("echo", "SELECT o_orderkey, CAST(c AS INTEGER) AS copy FROM orders, range(3) r(c)")
def echo(spark, sf):
    return R.echo(orders(spark, sf), 3).select("o_orderkey", "copy")


@query("echo_continuous", f"SELECT o_orderkey, CAST(c AS INTEGER) AS copy FROM orders, range(3) r(c) WHERE c < 1 + CAST({sql_hash01('o_orderkey')} < 0.5 AS INTEGER)")
def echo_continuous(spark, sf):
    return R.echo_continuous(orders(spark, sf), 1.5, "o_orderkey").select("o_orderkey", "copy")


@query("echo_unbatch", f"SELECT rn // 10 AS batch_id, o_orderkey, CAST((rn % 10) * 2 + c AS INTEGER) AS pos FROM {RN}, range(2) r(c)")
def echo_unbatch(spark, sf):
    """Repeat inside the batch, then take the batch apart."""
    b = R.batch(orders(spark, sf), 10, "o_orderkey", ["o_orderkey"])
    b = b.withColumn("o_orderkey", F.flatten(F.transform("o_orderkey", lambda x: F.array_repeat(x, 2)))).drop("n")
    return R.unbatch(b, ["o_orderkey"])


@query("echo_prefetch", "SELECT s_suppkey, CAST(c AS INTEGER) AS copy FROM supplier, range(2) r(c)")
def echo_prefetch(spark, sf):
    return R.prefetch(R.echo(t(spark, sf, "supplier").select("s_suppkey"), 2), 2)


@query("unbatch", f"SELECT rn // 16 AS batch_id, CAST(rn % 16 AS INTEGER) AS pos, o_orderkey, o_custkey FROM {RN}")
def unbatch(spark, sf):
    return R.unbatch(R.batch(orders(spark, sf), 16, "o_orderkey", ["o_orderkey", "o_custkey"]).drop("n"), ["o_orderkey", "o_custkey"])


_BATCH = f"SELECT rn // 32 AS batch_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS keys FROM {RN} GROUP BY 1"


def joined(b, column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query("batch", _BATCH + " HAVING count(*) = 32")
def batch(spark, sf):
    b = R.batch(orders(spark, sf), 32, "o_orderkey", ["o_orderkey"], drop_remainder=True)
    return b.select("batch_id", "n", joined(b, "o_orderkey").alias("keys"))


@query("batch_parallel", _BATCH)
def batch_parallel(spark, sf):
    b = R.batch(orders(spark, sf).repartition(8), 32, "o_orderkey", ["o_orderkey"])
    return b.select("batch_id", "n", joined(b, "o_orderkey").alias("keys"))


_CUT = "(SELECT c.*, len(w) AS l, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rn FROM (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INTEGER)) AS w FROM conversations) c)"


@query("padded_batch", f"SELECT rn // 8 AS batch_id, CAST(max(l) AS INTEGER) AS len, string_agg(array_to_string(w, ',') || repeat(',-1', CAST(m - l AS INTEGER)), ';' ORDER BY rn) AS rows FROM (SELECT *, max(l) OVER (PARTITION BY rn // 8) AS m FROM {_CUT} WHERE l > 0) GROUP BY 1".replace("FROM conversations) c)", "FROM conversations) c WHERE len(w) > 0)"))
def padded_batch(spark, sf):
    """Eight turns, the lengths of their words padded by -1 to the longest turn."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.transform(X.words("text"), lambda w: F.length(w)).alias("w")).where("size(w) > 0")
    b = R.padded_batch(c, 8, ["conv_id", "turn"], ["w"], {"w": -1})
    return b.select("batch_id", F.col("w_len").alias("len"), F.array_join(F.transform("w", lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")), ";").alias("rows"))


@query("rebatch", _BATCH.replace("// 32", "// 20"))
def rebatch(spark, sf):
    b = R.rebatch(R.batch(orders(spark, sf), 32, "o_orderkey", ["o_orderkey"]), 20, ["o_orderkey"])
    return b.select("batch_id", "n", joined(b, "o_orderkey").alias("keys"))


@query("prefetch", "SELECT c_custkey FROM customer")
def prefetch(spark, sf):
    return R.prefetch(customers(spark, sf), 10).select("c_custkey")


@query("cache", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def cache(spark, sf):
    return R.cache(customers(spark, sf)).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("cache_take", "SELECT c_custkey, CAST(e AS INTEGER) AS epoch FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50), range(4) r(e)")
def cache_take(spark, sf):
    return R.cache_take(customers(spark, sf).select("c_custkey"), 50, "c_custkey", 4)


@query("cache_partial", "SELECT c_custkey FROM customer")
def cache_partial(spark, sf):
    return R.cache_partial(customers(spark, sf), 4, "c_custkey").select("c_custkey")


@query("pad_eval", "SELECT s_suppkey, false AS is_padded FROM supplier UNION ALL SELECT * FROM (SELECT s_suppkey, true FROM supplier ORDER BY s_suppkey LIMIT (SELECT CEIL(count(*) / 64.0) * 64 - count(*) FROM supplier))")
def pad_eval(spark, sf):
    """Up to the next multiple of 64 by padding rows."""
    s = t(spark, sf, "supplier").select("s_suppkey")
    return R.pad_eval(s, s, -(-s.count() // 64) * 64, "s_suppkey")


@query("options_noop")
def options_noop(spark, sf):
    """What the options of the pipelines become: settings of the session."""
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes"]
    return spark.createDataFrame([(k, spark.conf.get(k)) for k in keys], "key string, value string")


@query("dist_service", "SELECT s_suppkey FROM supplier")
def dist_service(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey")


@query("dist_infeed_shard", "SELECT s_suppkey, CAST(e AS INTEGER) AS epoch FROM supplier, range(2) r(e)")
def dist_infeed_shard(spark, sf):
    return R.repeat(R.cache(t(spark, sf, "supplier").select("s_suppkey")), 2)


@query("dist_multidevice", f"SELECT o_orderkey, CAST(rn % 4 AS BIGINT) AS host FROM {RN}")
def dist_multidevice(spark, sf):
    return R.global_index(orders(spark, sf), "o_orderkey").select("o_orderkey", (F.col("rn") % 4).alias("host"))


# ------------------------------------------------------------------ sets and shapes


@query("concat", "SELECT n_nationkey AS k, CAST(0 AS INTEGER) AS origin FROM nation UNION ALL SELECT r_regionkey, 1 FROM region")
def concat(spark, sf):
    return R.concat(t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), t(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@query("choose_from", "SELECT k, CAST(origin AS INTEGER) AS origin, row_number() OVER (ORDER BY rn, origin) - 1 AS pos FROM (SELECT c_custkey AS k, 0 AS origin, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer UNION ALL SELECT s_suppkey, 1, row_number() OVER (ORDER BY s_suppkey) FROM supplier)")
def choose_from(spark, sf):
    return R.choose_from([t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))], "k").select("k", "origin", "pos")


@query("concat_frames", "SELECT n_name AS name, 'a' AS trial, NULL AS r FROM nation UNION ALL SELECT r_name, 'b', r_regionkey FROM region")
def concat_frames(spark, sf):
    a = t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("a").alias("trial"))
    b = t(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("b").alias("trial"), F.col("r_regionkey").alias("r"))
    return a.unionByName(b, allowMissingColumns=True)


@query("unpivot", "SELECT l_orderkey, l_linenumber, 'discount' AS kind, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def unpivot(spark, sf):
    u = t(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "kind", "v")
    return u.withColumn("kind", F.element_at(F.create_map(F.lit("l_discount"), F.lit("discount"), F.lit("l_tax"), F.lit("tax")), F.col("kind")))


@query("multiset_ops", "SELECT coalesce(a.k, b.k) AS k, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS both, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS either FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def multiset_ops(spark, sf):
    a = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, "k", "full").select("k", F.least(x, y).alias("both"), F.greatest(x, y).alias("either"))


@query("set_diff", "SELECT p_size AS k FROM part EXCEPT SELECT c_nationkey FROM customer")
def set_diff(spark, sf):
    return t(spark, sf, "part").select(F.col("p_size").alias("k")).distinct().exceptAll(t(spark, sf, "customer").select("c_nationkey").distinct())


@query("grid_product", "SELECT CAST(a AS INTEGER) AS a, b, CAST(c AS INTEGER) AS c FROM (VALUES (1), (2)) x(a), (VALUES ('x'), ('y')) y(b), (VALUES (0), (1), (2)) z(c)")
def grid_product(spark, sf):
    """All combinations of a few arguments."""
    grid = spark.range(1)
    for name, values in (("a", [1, 2]), ("b", ["x", "y"]), ("c", [0, 1, 2])):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf):
    return t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf, "supplier").select("s_nationkey"))
