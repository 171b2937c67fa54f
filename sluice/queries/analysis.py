"""Performance analysis and rewrites (survey 2.13, 4.1), over the fixture of stage statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..plans import machine as M
from ..plans import perfmodel as P
from ..plans.spec import REMOVE_CACHES, PipelineSpec, Stage, same_result
from .common import sql_hash, t

_NAMES = [c.split()[0] for c in P.SCHEMA.split(", ")]


def _value(v):
    return "NULL" if v is None else ("'" + v + "'") if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)


FIX = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in P.FIXTURE) + f") v({', '.join(_NAMES)}))"
SEQ = "(SELECT min(per_core_rate) FROM " + FIX + " WHERE NOT is_parallel)"
X8 = f"least(8 / (SELECT sum(1 / per_core_rate) FROM {FIX}), {SEQ})"


def fix(spark):
    return P.fixture(spark)


def demo() -> PipelineSpec:
    """A small pipeline over the lines of orders."""
    return PipelineSpec([
        Stage("scan", "source", lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")),
        Stage("decode", "map", lambda df: df.withColumn("v", F.expr("cast(l_extendedprice as bigint) div cast(l_quantity as bigint)"))),
        Stage("keep", "filter", lambda df: df.where("v > 1000")),
        Stage("sums", "batch", lambda df: df.groupBy("l_orderkey").agg(F.sum("v").alias("v"))),
    ])


_V = "CAST(trunc(l_extendedprice) AS BIGINT) // CAST(trunc(l_quantity) AS BIGINT)"
_DEMO = f"SELECT l_orderkey, CAST(sum({_V}) AS BIGINT) AS v FROM lineitem WHERE {_V} > 1000 GROUP BY 1"


@query("agg_lp_maxmin", f"SELECT name, round({X8}, 6) AS x, round({X8} / per_core_rate, 6) AS theta FROM {FIX}")
def agg_lp_maxmin(spark, sf):
    return P.max_min(fix(spark), 8).select("name", F.round("x", 6).alias("x"), F.round("theta", 6).alias("theta"))


@query("agg_lp_usage")
def agg_lp_usage(spark, sf):
    return P.max_min_with_usage(fix(spark), 8, 0.5).select("name", F.round("x", 6).alias("x"), F.round("theta", 6).alias("theta"))


_COST = f"WITH s AS (SELECT *, 10 / per_core_rate AS theta, coalesce(sum(10 / per_core_rate) OVER (ORDER BY topo DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM {FIX}) SELECT name AS cache, round({M.CPU_HOUR} * above + {M.GB_HOUR} * expected_dataset_size / 1e9, 6) AS dollars FROM s WHERE topo < 3 UNION ALL SELECT 'none', round({M.CPU_HOUR} * sum(theta) + {M.SSD_HOUR_100MB!r} * 10 / 20, 6) FROM s"


def costs(spark):
    return P.cost(fix(spark), 10.0, 20.0, M.CPU_HOUR, M.SSD_HOUR_100MB, M.GB_HOUR)


@query("agg_lp_cost", _COST)
def agg_lp_cost(spark, sf):
    return costs(spark).select("cache", F.round("dollars", 6).alias("dollars"))


@query("agg_n_customers", "SELECT round(4 * 0.25, 6) AS n_star, round(300.0 / 100, 6) AS n, round(300.0 / (3.5 * 100), 6) AS response, round(least(21.5, 3 / (300.0 / 350)), 6) AS cpu_bound, 0.0 AS prefetch")
def agg_n_customers(spark, sf):
    r = P.roofline(21.5, 4.0, 0.25, 300.0, 100.0, 3.5)
    return spark.createDataFrame([tuple(round(r[k], 6) for k in ("n_star", "n", "response", "cpu_bound", "prefetch"))], "n_star double, n double, response double, cpu_bound double, prefetch double")


@query("an_plan_graph")
def an_plan_graph(spark, sf):
    return demo().nodes(spark)


@query("an_ranked_nodes", f"SELECT name, row_number() OVER (ORDER BY per_core_rate * parallelism, topo) AS rank FROM {FIX}")
def an_ranked_nodes(spark, sf):
    return P.ranked(fix(spark)).select("name", F.col("rank").cast("long"))


_NODE_TABLE = f"""SELECT name, row_number() OVER (ORDER BY per_core_rate * parallelism, topo) AS rank, topo, op, parallelism, element_ratio, cardinality, expected_dataset_size, is_random,
 per_core_rate AS core_max_rate, per_core_rate * parallelism AS parallel_max_rate, round(cores_used / parallelism, 6) AS p_busy, cores_used AS num_cores_used, cpu_s AS processing_time,
 round(sum(cpu_s) OVER t, 6) AS aggregate_processing_time, CASE WHEN op = 'map' AND cpu_s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_udf,
 elements AS elements_produced, coalesce(lag(elements) OVER t, 0) AS elements_consumed, bytes_per_elem AS bytes_produced, coalesce(lag(bytes_per_elem) OVER t, 0) AS bytes_consumed,
 round(coalesce(bytes_per_elem / lag(bytes_per_elem) OVER t, 0), 6) AS byte_ratio, round(bytes_per_elem * elements / (cpu_s / cores_used), 6) AS bandwidth_used,
 round(cardinality / first_value(cardinality) OVER t, 6) AS dataset_record_ratio, coalesce(parent_name, '') AS parent_name, bytes_per_elem * parallelism AS max_memory_used,
 round(cpu_s / elements / parallelism * element_ratio, 6) AS autotune_latency_s FROM {FIX} WINDOW t AS (ORDER BY topo)"""


@query("an_node_table", _NODE_TABLE)
def an_node_table(spark, sf):
    n = P.node_table(fix(spark))
    return n.withColumns({c: F.round(c, 6) for c in ("p_busy", "aggregate_processing_time", "byte_ratio", "bandwidth_used", "dataset_record_ratio", "autotune_latency_s")})


@query("an_bottleneck", f"SELECT name, per_core_rate FROM {FIX} WHERE is_parallel OR op = 'batch' ORDER BY per_core_rate LIMIT 1")
def an_bottleneck(spark, sf):
    return P.bottleneck(fix(spark), valid_only=True).select("name", "per_core_rate")


@query("an_strategy", f"SELECT name FROM {FIX} WHERE is_parallel OR op = 'batch' ORDER BY {sql_hash('name', 3)}, name LIMIT 1")
def an_strategy(spark, sf):
    return P.strategy(fix(spark), 3).select("name")


@query("an_autotune_latency", f"SELECT round(sum(cpu_s / elements / parallelism * element_ratio), 6) AS latency, round(1 / sum(cpu_s / elements / parallelism * element_ratio), 6) AS rate FROM {FIX}")
def an_autotune_latency(spark, sf):
    return P.autotune(fix(spark)).select(F.round("latency", 6).alias("latency"), F.round("rate", 6).alias("rate"))


@query("an_udf_share", f"SELECT name, round(coalesce(CASE WHEN op = 'map' THEN cpu_s ELSE 0 END / nullif(cpu_s, 0), 0), 6) AS p FROM {FIX}")
def an_udf_share(spark, sf):
    own = F.when(F.col("op") == "map", F.col("cpu_s")).otherwise(F.lit(0.0))
    return fix(spark).select("name", F.round(F.coalesce(F.try_divide(own, F.col("cpu_s")), F.lit(0.0)), 6).alias("p"))


@query("an_runtime_data", f"SELECT round(sum(cores_used), 6) AS cores, round(sum(cores_used) / 8, 6) AS cpu_util, min(per_core_rate * parallelism) AS observed, count(*) AS stages, round({X8}, 6) AS bound FROM {FIX}")
def an_runtime_data(spark, sf):
    s = P.max_min(fix(spark), 8)
    return s.agg(F.round(F.sum("cores_used"), 6).alias("cores"), F.round(F.sum("cores_used") / 8, 6).alias("cpu_util"), F.min(F.col("per_core_rate") * F.col("parallelism")).alias("observed"), F.count("*").alias("stages"), F.round(F.first("x"), 6).alias("bound"))


@query("an_roofline", "SELECT CAST(range AS BIGINT) AS n, round(CASE WHEN range <= 4 THEN range / 2.0 ELSE 4 / 2.0 END, 6) AS bound FROM range(9)")
def an_roofline(spark, sf):
    """The throughput bound by customers in the system: N / R up to N*."""
    r = P.roofline(21.5, 4.0, 1.0, 300.0, 100.0, 1.5)
    return spark.range(9).select(F.col("id").alias("n"), F.round(F.least("id", F.lit(r["n_star"])) / r["response"], 6).alias("bound"))


@query("an_cache_summary", f"SELECT name, topo, expected_dataset_size AS size, cardinality, is_random FROM {FIX}")
def an_cache_summary(spark, sf):
    return fix(spark).select("name", "topo", F.col("expected_dataset_size").alias("size"), "cardinality", "is_random")


@query("an_cache_candidates", f"SELECT name FROM {FIX} WHERE topo < 3")
def an_cache_candidates(spark, sf):
    return P.cache_candidates(fix(spark)).select("name")


@query("an_cache_choose", "SELECT * FROM (VALUES (4e9::DOUBLE, 'filter'), (3e9::DOUBLE, 'interleave')) v(memory, name)")
def an_cache_choose(spark, sf):
    one = lambda m: P.cache_choice(fix(spark), m).select(F.lit(m).alias("memory"), "name")
    return one(4e9).unionByName(one(3e9))


@query("an_random_nodes", f"SELECT name FROM {FIX} WHERE is_random")
def an_random_nodes(spark, sf):
    return fix(spark).where("is_random").select("name")


@query("an_source_sweep")
def an_source_sweep(spark, sf):
    from ..plans.trace import source_sweep

    return source_sweep(demo(), spark, sf, (1, 2, 4))


@query("an_node_sweep")
def an_node_sweep(spark, sf):
    from ..plans.trace import node_sweep

    return node_sweep(demo(), spark, sf, "decode", (2, 4))


@query("an_graph_compat", "SELECT * FROM (VALUES ('cache_keep', 'added')) v(name, side)")
def an_graph_compat(spark, sf):
    """What a rewrite added to or removed from the plan."""
    from ..operators.joins import differences

    return differences(demo().nodes(spark), demo().insert_cache("keep").nodes(spark), "name")


@query("an_input_hash", "SELECT true AS same, false AS other")
def an_input_hash(spark, sf):
    renamed = PipelineSpec([Stage(f"x_{s.name}", s.op, s.fn) for s in demo().stages])
    return spark.createDataFrame([(demo().input_hash() == renamed.input_hash(), demo().input_hash() == demo().insert_cache("keep").input_hash())], "same boolean, other boolean")


@query("an_cost_query", f"SELECT cache, dollars FROM ({_COST}) ORDER BY dollars LIMIT 1")
def an_cost_query(spark, sf):
    return costs(spark).orderBy("dollars").limit(1).select("cache", F.round("dollars", 6).alias("dollars"))


@query("an_lp_theta_round", f"SELECT name, CAST(greatest(ceil({X8} / per_core_rate), 1) AS BIGINT) AS up, CAST(greatest(round_even({X8} / per_core_rate, 0), 1) AS BIGINT) AS even FROM {FIX}")
def an_lp_theta_round(spark, sf):
    s = P.max_min(fix(spark), 8)
    return s.select("name", P.rounded(F.col("theta")).alias("up"), P.rounded(F.col("theta"), "even").alias("even"))


@query("an_best_pipeline")
def an_best_pipeline(spark, sf):
    from ..plans.trace import best_pipeline

    name, rates = best_pipeline({"plain": demo().build(spark, sf), "wide": demo().set_parallelism({"decode": 4}).build(spark, sf)}, 1.0)
    return spark.createDataFrame([(k, float(v), k == name) for k, v in rates.items()], "name string, rate double, best boolean")


@query("an_predict_bandwidth", "SELECT CAST(range AS DOUBLE) AS x, round(CASE WHEN range < 2 THEN 2051.02 * range + 6396.42 ELSE -34.04 * range + 10503.25 END, 4) AS y FROM range(1, 33)")
def an_predict_bandwidth(spark, sf):
    d = spark.range(1, 33).select(F.col("id").cast("double").alias("x"), *[F.lit(v).alias(n) for n, v in (("m1", 2051.02), ("b1", 6396.42), ("m2", -34.04), ("b2", 10503.25), ("x_thresh", 2.0))])
    return d.select("x", F.round(P.predict_bandwidth("x"), 4).alias("y"))


@query("an_disk_correction", "SELECT 7 AS more, 4 AS same")
def an_disk_correction(spark, sf):
    return spark.createDataFrame([(P.disk_correction(4, 1e6, 100.0, 5e7, 3e7), P.disk_correction(4, 1e6, 100.0, 5e7, 6e7))], "more int, same int")


@query("an_drop_caches", "SELECT CAST(0 AS BIGINT) AS kept")
def an_drop_caches(spark, sf):
    from ..operators.rows import cache

    n = cache(t(spark, sf, "nation"))
    n.count()
    n.unpersist(blocking=True)
    return spark.createDataFrame([(int(n.storageLevel.useMemory),)], "kept long")


@query("trace_node_stats")
def trace_node_stats(spark, sf):
    from ..plans.trace import trace

    return trace(demo(), spark, sf)


def _rewritten(spark, sf, spec):
    """The rewritten pipeline's rows, after its result was found equal to the plain one's."""
    plain, new = demo().build(spark, sf), spec.build(spark, sf)
    if not same_result(plain, new):
        raise ValueError("the rewrite changed the result")
    return new


@query("rw_parallelism", _DEMO)
def rw_parallelism(spark, sf):
    return _rewritten(spark, sf, demo().set_parallelism({"decode": 5, "sums": 2}).raise_parallelism("decode"))


@query("rw_prefetch", _DEMO)
def rw_prefetch(spark, sf):
    return _rewritten(spark, sf, demo().insert_prefetch(4).insert_prefetch(8))


@query("rw_cache", _DEMO)
def rw_cache(spark, sf):
    return _rewritten(spark, sf, demo().insert_cache("keep"))


@query("rw_remove_caches", _DEMO)
def rw_remove_caches(spark, sf):
    return _rewritten(spark, sf, REMOVE_CACHES(demo().insert_cache("decode")))


@query("rw_wrappers", _DEMO)
def rw_wrappers(spark, sf):
    spec = PipelineSpec([*demo().stages, Stage("model", "model", None)])
    return _rewritten(spark, sf, spec.remove_wrappers())


@query("rw_truncate", f"SELECT l_orderkey, l_quantity, l_extendedprice, {_V} AS v FROM lineitem")
def rw_truncate(spark, sf):
    return demo().prefix("decode").build(spark, sf)


@query("rw_reset", _DEMO)
def rw_reset(spark, sf):
    return _rewritten(spark, sf, demo().set_parallelism({"decode": 6}).reset_parallelism())


@query("optimize_pipeline", _DEMO)
def optimize_pipeline(spark, sf):
    from ..plans.trace import optimize

    return _rewritten(spark, sf, optimize(demo(), P.fixture(spark).withColumn("name", F.element_at(F.array(*[F.lit(s.name) for s in demo().stages], F.lit("end")), F.col("topo") + 1)), 8, 4e9))
