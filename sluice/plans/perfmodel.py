"""The performance model: bottleneck, allocation, roofline and cost, as queries over ``node_stats``.

``node_stats`` has a row per stage: name, topo, op, per_core_rate (root elements per core-second), parallelism,
is_parallel, is_random, elements, cpu_s, cores_used, element_ratio, cardinality, bytes_per_elem, expected_dataset_size, parent_name.
A plan has few stages, so windows over a whole plan are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "name string, topo int, op string, per_core_rate double, parallelism int, is_parallel boolean, is_random boolean, elements long, cpu_s double, cores_used double, element_ratio double, cardinality long, bytes_per_elem double, expected_dataset_size double, parent_name string"

# The fixture of the survey, in pipeline order.
FIXTURE = [
    ("interleave", 0, "interleave", 40.0, 1, True, False, 1000, 25.0, 0.5, 1.0, 10_000_000, 120.0, 1.2e9, "map_decode"),
    ("map_decode", 1, "map", 5.0, 1, True, False, 1000, 200.0, 1.0, 1.0, 10_000_000, 300.0, 3.0e9, "filter"),
    ("filter", 2, "filter", 200.0, 1, False, False, 1000, 5.0, 0.1, 1.0, 10_000_000, 290.0, 2.9e9, "map_augment"),
    ("map_augment", 3, "map", 8.0, 1, True, True, 1000, 125.0, 1.0, 1.0, 10_000_000, 290.0, 2.9e9, "batch"),
    ("batch", 4, "batch", 60.0, 1, False, False, 1000, 16.0, 0.3, 1.0, 10_000_000, 290.0, 2.9e9, None),
]


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ranked(stats: DataFrame) -> DataFrame:
    """Slowest first: by the rate that the stage reaches with the cores it has."""
    return stats.withColumn("rate", F.col("per_core_rate") * F.col("parallelism")).withColumn("rank", F.row_number().over(Window.orderBy("rate", "topo")))


def node_table(stats: DataFrame) -> DataFrame:
    """Everything that the statistics say about each stage, slowest first by ``rank``: rates with one core and with those it
    has, busy share, time alone and with the stages before it, elements and bytes in and out, share of time in
    functions of the user, memory of what its cores hold at once, latency of a root element."""
    before = Window.orderBy("topo")
    consumed = F.lag("bytes_per_elem").over(before)
    return ranked(stats).select(
        "name", F.col("rank").cast("long").alias("rank"), "topo", "op", "parallelism", "element_ratio", "cardinality", "expected_dataset_size", "is_random",
        F.col("per_core_rate").alias("core_max_rate"), F.col("rate").alias("parallel_max_rate"), (F.col("cores_used") / F.col("parallelism")).alias("p_busy"),
        F.col("cores_used").alias("num_cores_used"), F.col("cpu_s").alias("processing_time"), F.sum("cpu_s").over(before).alias("aggregate_processing_time"),
        F.when((F.col("op") == "map") & (F.col("cpu_s") > 0), F.lit(1.0)).otherwise(F.lit(0.0)).alias("p_udf"),
        F.col("elements").alias("elements_produced"), F.coalesce(F.lag("elements").over(before), F.lit(0)).alias("elements_consumed"),
        F.col("bytes_per_elem").alias("bytes_produced"), F.coalesce(consumed, F.lit(0.0)).alias("bytes_consumed"), F.coalesce(F.col("bytes_per_elem") / F.nullif(consumed, F.lit(0.0)), F.lit(0.0)).alias("byte_ratio"),
        (F.col("bytes_per_elem") * F.col("elements") / F.nullif(F.col("cpu_s") / F.nullif(F.col("cores_used"), F.lit(0.0)), F.lit(0.0))).alias("bandwidth_used"),
        (F.col("cardinality") / F.nullif(F.first("cardinality").over(before), F.lit(0))).alias("dataset_record_ratio"),
        F.coalesce("parent_name", F.lit("")).alias("parent_name"), (F.col("bytes_per_elem") * F.col("parallelism")).alias("max_memory_used"),
        (F.col("cpu_s") / F.col("elements") / F.col("parallelism") * F.col("element_ratio")).alias("autotune_latency_s"),
    )


def bottleneck(stats: DataFrame, valid_only: bool = False, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The slowest stage; with ``valid_only`` among those that can be given more cores."""
    own = ranked(stats).where(~F.col("name").isin(*ignore)) if ignore else ranked(stats)
    own = own.where(F.col("is_parallel") | (F.col("op") == "batch")) if valid_only else own
    return own.orderBy("rank").limit(1)


def strategy(stats: DataFrame, seed: int) -> DataFrame:
    """A reproducible random choice among the stages that can be given more cores."""
    from ..operators.rows import hash_key

    valid = stats.where(F.col("is_parallel") | (F.col("op") == "batch"))
    return valid.withColumn("_h", hash_key("name", seed)).orderBy("_h", "name").limit(1).drop("_h")


def max_min(stats: DataFrame, cores: float, max_change: float | None = None) -> DataFrame:
    """Cores per stage that maximise the least ``rate * cores``: throughput and the smallest such allocation.

    Closed form: all stages run at the same rate X, the largest at which the cores suffice and no sequential stage
    needs more than one.
    """
    everything = Window.partitionBy()
    total = F.lit(float(cores)) if max_change is None else F.least(F.lit(float(cores)), F.sum("cores_used").over(everything) + max_change)
    x = F.least(total / F.sum(1 / F.col("per_core_rate")).over(everything), F.min(F.when(~F.col("is_parallel"), F.col("per_core_rate"))).over(everything))
    return stats.withColumn("x", x).withColumn("theta", F.col("x") / F.col("per_core_rate"))


def max_min_with_usage(stats: DataFrame, cores: float, cpu_util: float) -> DataFrame:
    """As ``max_min``, but no stage gets less than it uses now; cores used by others are not available.

    Lower bounds m; x solves sum(max(m, x / r)) = available, found at the breakpoints r * m by prefix sums.
    """
    one = Window.partitionBy()
    m = F.when(F.col("is_parallel"), F.col("cores_used")).otherwise(F.least("cores_used", F.lit(1.0)))
    s = stats.withColumn("_m", m)
    avail = F.lit(cores) - F.greatest(F.lit(cpu_util * cores) - F.sum("_m").over(one), F.lit(0.0))
    s = s.withColumn("_avail", F.when(avail <= 0, F.lit(1e-10)).otherwise(avail)).withColumn("_sum", F.sum("_m").over(one))
    s = s.withColumn("_m", F.when(F.col("_sum") > F.col("_avail"), F.col("_m") / (F.col("_sum") / F.col("_avail") + 1e-3)).otherwise(F.col("_m")))
    s = s.withColumn("_b", F.col("per_core_rate") * F.col("_m"))
    upto = Window.orderBy("_b", "topo").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"_inv": F.sum(1 / F.col("per_core_rate")).over(upto), "_rest": F.sum("_m").over(one) - F.sum("_m").over(upto), "_next": F.lead("_b").over(Window.orderBy("_b", "topo"))})
    s = s.withColumn("_x", (F.col("_avail") - F.col("_rest")) / F.col("_inv"))
    ok = (F.col("_x") >= F.col("_b")) & (F.col("_next").isNull() | (F.col("_x") <= F.col("_next")))
    x = F.least(F.max(F.when(ok, F.col("_x"))).over(one), F.min(F.when(~F.col("is_parallel"), F.col("per_core_rate"))).over(one))
    return s.withColumn("x", x).withColumn("theta", F.greatest("_m", F.col("x") / F.col("per_core_rate"))).drop("_m", "_avail", "_sum", "_b", "_inv", "_rest", "_next", "_x")


def rounded(theta: Column, how: str = "ceil") -> Column:
    """Whole cores, one at least; the runner rounds half to even."""
    return F.greatest((F.ceil(theta) if how == "ceil" else F.bround(theta, 0)).cast("long"), F.lit(1).cast("long"))


def cost(stats: DataFrame, min_rate: float, disk_rate_100mb: float, cpu: float, disk: float, gb: float, cores: float = 1e9) -> DataFrame:
    """Dollars an hour of every cache point (and of none) that reaches ``min_rate``; stages up to the cache are free."""
    after = Window.orderBy(F.desc("topo")).rowsBetween(Window.unboundedPreceding, -1)
    theta = F.lit(min_rate) / F.col("per_core_rate")
    s = stats.withColumn("theta", theta).withColumn("fits", F.col("theta") <= F.when(F.col("is_parallel"), F.lit(cores)).otherwise(F.lit(1.0)))
    s = s.withColumns({"above": F.coalesce(F.sum("theta").over(after), F.lit(0.0)), "feasible": F.coalesce(F.min("fits").over(after), F.lit(True))})
    first_random = s.agg(F.min(F.when(F.col("is_random"), F.col("topo"))).alias("_r"))
    points = s.join(F.broadcast(first_random)).where((F.col("_r").isNull() | (F.col("topo") < F.col("_r"))) & F.col("feasible") & (F.col("expected_dataset_size") > 0))
    points = points.select(F.col("name").alias("cache"), (cpu * F.col("above") + gb * F.col("expected_dataset_size") / 1e9).alias("dollars"))
    none = s.agg((cpu * F.sum("theta") + disk * min_rate / disk_rate_100mb).alias("dollars"), F.min("fits").alias("ok")).where("ok").select(F.lit("none").alias("cache"), "dollars")
    return points.unionByName(none)


def cache_candidates(stats: DataFrame) -> DataFrame:
    """Stages of known size before the first random one, in order."""
    first = stats.agg(F.min(F.when(F.col("is_random"), F.col("topo"))).alias("_r"))
    return stats.join(F.broadcast(first)).where((F.col("expected_dataset_size") > 0) & (F.col("_r").isNull() | (F.col("topo") < F.col("_r")))).drop("_r")


def cache_choice(stats: DataFrame, memory: float, share: float = 0.9) -> DataFrame:
    """The candidate closest to the root that fits into the share of memory; strictly smaller."""
    return cache_candidates(stats).where(F.col("expected_dataset_size") < share * memory).orderBy(F.desc("topo")).limit(1)


def autotune(stats: DataFrame) -> DataFrame:
    """Latency of an element as the sum of processing times per element, and the rate it means (-1 without any)."""
    latency = F.sum(F.col("cpu_s") / F.col("elements") / F.col("parallelism") * F.col("element_ratio"))
    return stats.agg(latency.alias("latency")).select("latency", F.when(F.col("latency") > 0, 1 / F.col("latency")).otherwise(F.lit(-1.0)).alias("rate"))


def roofline(x_lp: float, slowest: float, latency_min: float, wait: float, wall: float, rate: float) -> dict[str, float]:
    """Queueing bounds: N* and N customers, response time, bound of the throughput, and the prefetch that fills the gap."""
    visit = 1 / max(slowest, 1e-6)
    n_star, n = latency_min / visit, wait / wall
    response = wait / max(rate * wall, 1e-6)
    return {"n_star": n_star, "n": n, "response": response, "cpu_bound": min(x_lp, n / response if response else float("inf")), "prefetch": float(-(-max(n_star - n, 0) // 1))}


def disk_correction(parallelism: int, bytes_per_root: float, x_lp: float, disk_bandwidth: float, throughput: float) -> int:
    """More readers where the disk is used below what the pipeline could take."""
    use = throughput / min(bytes_per_root * x_lp, disk_bandwidth)
    return int(-(-parallelism / use // 1)) if 0 < use < 1 else parallelism


def least_squares(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Slope and intercept; of a single point the solution of least norm."""
    n, sx, sy, sxx, sxy = F.count(x), F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))
    s = df.groupBy(*(by or [])).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    d = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    m = F.when(F.col("n") == 1, F.col("sxy") / (F.col("sxx") + 1)).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(d, F.lit(0.0)))
    b = F.when(F.col("n") == 1, F.col("sy") / (F.col("sxx") + 1)).otherwise((F.col("sy") - F.col("m") * F.col("sx")) / F.col("n"))
    return s.withColumn("m", m).withColumn("b", b).select(*(by or []), "m", "b")


def piecewise_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(i, m1, b1, m2, b2, x_thresh, error) of the best split into two lines. Only underestimates count, less so far
    from the top; the first of equal errors wins. The points are the few of a bandwidth sweep."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumn("k", F.row_number().over(Window.orderBy("x"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    splits = points.withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int") - 1))).withColumn("left", F.col("k") <= F.col("i"))
    lines = least_squares(splits, "x", "y", ["i", "left"])
    one = lines.where("left").select("i", F.col("m").alias("m1"), F.col("b").alias("b1"))
    two = lines.where("not left").select("i", F.col("m").alias("m2"), F.col("b").alias("b2"))
    thresh = splits.where("left").groupBy("i").agg(F.max("x").alias("x_thresh"))
    both = splits.join(one, "i").join(two, "i").join(thresh, "i")
    fitted = predict_bandwidth("x")
    top = F.max("y").over(Window.partitionBy("i"))
    miss = F.greatest(F.col("y") - fitted, F.lit(0.0))
    both = both.withColumn("e", 1 / (F.abs(F.col("y") - top) + 1) * miss * miss)
    return both.groupBy("i", "m1", "b1", "m2", "b2", "x_thresh").agg(F.avg("e").alias("error")).orderBy("error", "i").limit(1)


def predict_bandwidth(x: str) -> Column:
    return F.when(F.col(x) < F.col("x_thresh"), F.col("m1") * F.col(x) + F.col("b1")).otherwise(F.col("m2") * F.col(x) + F.col("b2"))
