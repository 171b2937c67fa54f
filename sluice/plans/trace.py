"""Measure pipelines: a trace per stage, benchmarks with limits, monitoring, and optimisation by what was measured."""

from __future__ import annotations

import functools
import itertools
import os
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import perfmodel
from .spec import PARALLEL, PipelineSpec, is_random


def trace(spec: PipelineSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_stats`` of a pipeline. Spark fuses narrow stages, so a stage's time is that of the pipeline up to it less
    that of the pipeline before it, 0 at least; each prefix runs once to its end."""
    rows, before, cores = [], 0.0, spark.sparkContext.defaultParallelism
    counts = []
    for k, s in enumerate(spec.stages):
        df = spec.prefix(s.name).build(spark, sf_dir)
        random_ = is_random(df) if s.random is None else s.random
        size = F.sum(F.length(F.to_json(F.struct(*df.columns))))
        began = time.perf_counter()
        n, total = df.agg(F.count(F.lit(1)), size).first()
        took = time.perf_counter() - began
        counts.append(n)
        rows.append([s, k, max(took - before, 1e-6), n, total or 0, random_])
        before = max(before, took)
    root = max(counts[-1], 1)
    out = []
    for s, k, cpu, n, total, random_ in rows:
        parent = spec.stages[k + 1].name if k + 1 < len(spec.stages) else None
        out.append((s.name, k, s.op, root / cpu, s.parallelism, s.op in PARALLEL, random_, n, cpu, cpu / max(before, 1e-6) * cores, n / root, n, total / max(n, 1), float(total), parent))
    return spark.createDataFrame(out, perfmodel.SCHEMA)


def benchmark(df: DataFrame, time_limit_s: float = 62.0, skip_first: int = 0, every: int = 20, tolerance: float = 0.01, least_s: float = 12.0, batch: int = 1000) -> dict:
    """Iterate a result until its end, the time limit, or until the cumulative rate has settled."""
    began, n, settled, past, times, last = time.perf_counter(), 0, False, None, [], time.perf_counter()
    for k, _ in enumerate(df.toLocalIterator(prefetchPartitions=True)):
        if k < skip_first:
            began = last = time.perf_counter()
            continue
        n += 1
        if n % batch == 0:
            now = time.perf_counter()
            times.append(now - last)
            last = now
            if len(times) % every == 0:
                rate = n / (now - began)
                settled = past is not None and abs(past / rate - 1) < tolerance and now - began >= least_s
                past = rate
            if settled or now - began >= time_limit_s:
                break
    took = max(time.perf_counter() - began, 1e-9)
    return {"global_element_rate": n / took, "global_minibatch_rate": n / batch / took, "elements": n, "data_load_times": times, "converged": settled}


class Monitor:
    """Samples processor, memory and I/O use in a thread while a block runs."""

    def __init__(self, every_s: float = 0.1):
        self.every_s, self.samples, self._stop = every_s, [], threading.Event()

    def _run(self) -> None:
        import psutil

        while not self._stop.is_set():
            m, io = psutil.virtual_memory(), psutil.disk_io_counters()
            self.samples.append((time.time(), 0.0, psutil.cpu_percent(), {"memory_used": float(m.used), "memory_percent": m.percent, "io_read": float(io.read_bytes if io else 0), "io_write": float(io.write_bytes if io else 0)}))
            self._stop.wait(self.every_s)

    def __enter__(self) -> Monitor:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.samples, "t double, cpu_frequency double, cpu_percent double, metrics map<string,double>")
        return rows.select(F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "cpu_frequency", "cpu_percent", "metrics")


def iter_trace(df: DataFrame, clock: Callable[[], float] = time.perf_counter) -> Iterable[tuple[int, float, float]]:
    """(id, start, stop) of every pull of a local iterator."""
    it = df.toLocalIterator()
    k = 0
    while True:
        a = clock()
        try:
            next(it)
        except StopIteration:
            return
        yield k, a, clock()
        k += 1


def optimize(spec: PipelineSpec, stats: DataFrame, cores: int, memory: float, caches: bool = True) -> PipelineSpec:
    """Cores by the max-min allocation, then a cache where one fits. The result of the pipeline stays the same."""
    theta = perfmodel.max_min(stats, cores).select("name", perfmodel.rounded(F.col("theta")).alias("n")).collect()
    out = spec.remove_caches().set_parallelism({r.name: r.n for r in theta})
    best = perfmodel.cache_choice(stats, memory).select("name").first() if caches else None
    return out.insert_cache(best[0]) if best else out


def optimize_pipeline(cores: int = 8, memory: float = 4e9, precondition: Callable[..., bool] = lambda *a, **k: True):
    """Decorate a loader that returns a PipelineSpec: trace it, optimise it, build it. The schema must not change.

    The environment can switch it off (SLUICE_OPTIMIZE=0) or leave the caches out (SLUICE_CACHES=0)."""
    def wrap(loader: Callable[..., PipelineSpec]):
        @functools.wraps(loader)
        def run(spark: SparkSession, sf_dir: str, *args, **kwargs) -> DataFrame:
            spec = loader(*args, **kwargs)
            plain = spec.build(spark, sf_dir)
            if os.environ.get("SLUICE_OPTIMIZE", "1") == "0" or not precondition(*args, **kwargs):
                return plain
            best = optimize(spec, trace(spec, spark, sf_dir), cores, memory, os.environ.get("SLUICE_CACHES", "1") != "0").build(spark, sf_dir)
            if best.schema != plain.schema:
                raise ValueError("the optimised pipeline has another schema")
            return best

        return run

    return wrap


def maybe_optimize_pipeline(cores: int = 8, memory: float = 4e9):
    """``optimize_pipeline`` where the environment asks for it (SLUICE_OPTIMIZE=1); else the pipeline as it is."""
    return optimize_pipeline(cores, memory, lambda *a, **k: os.environ.get("SLUICE_OPTIMIZE") == "1")


def trace_pipeline(path: Callable[[SparkSession], str]):
    """Decorate a loader that returns a PipelineSpec: write its trace to ``path(spark)`` and build it."""
    def wrap(loader: Callable[..., PipelineSpec]):
        @functools.wraps(loader)
        def run(spark: SparkSession, sf_dir: str, *args, **kwargs) -> DataFrame:
            spec = loader(*args, **kwargs)
            trace(spec, spark, sf_dir).write.parquet(path(spark))
            return spec.build(spark, sf_dir)

        return run

    return wrap


def find_best_pipeline(grid: dict[str, list], time_limit_s: float = 5.0):
    """Decorate a loader: of the pipelines for all combinations of arguments, return the fastest."""
    def wrap(loader: Callable[..., PipelineSpec]):
        @functools.wraps(loader)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
            built = {repr(c): loader(**c).build(spark, sf_dir) for c in combos}
            return built[best_pipeline(built, time_limit_s)[0]]

        return run

    return wrap


def best_pipeline(candidates: dict[str, DataFrame], time_limit_s: float = 5.0) -> tuple[str, dict[str, float]]:
    """The candidate with the highest rate; all must have the same schema."""
    if len({d.schema.json() for d in candidates.values()}) > 1:
        raise ValueError("candidates differ in schema")
    rates = {k: benchmark(d, time_limit_s)["global_element_rate"] for k, d in candidates.items()}
    return max(rates, key=rates.get), rates


def node_sweep(spec: PipelineSpec, spark: SparkSession, sf_dir: str, name: str, parallelism: Iterable[int] = (2, 4, 8)) -> DataFrame:
    """Rates of one stage alone, its input kept, at several degrees of parallelism."""
    k = [s.name for s in spec.stages].index(name)
    up = PipelineSpec(spec.stages[:k]).build(spark, sf_dir).persist()
    n = up.count()
    rows = []
    for p in parallelism:
        began = time.perf_counter()
        spec.stages[k].fn(up.repartition(p)).write.format("noop").mode("overwrite").save()
        rows.append((name, p, n / (time.perf_counter() - began)))
    up.unpersist()
    return spark.createDataFrame(rows, "name string, parallelism int, rate double")


def source_sweep(spec: PipelineSpec, spark: SparkSession, sf_dir: str, parallelism: Iterable[int] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """Rates of the source alone at several degrees of parallelism."""
    rows = []
    for p in parallelism:
        df = spec.source_only().build(spark, sf_dir)
        n, began = df.count(), time.perf_counter()
        df.coalesce(p).write.format("noop").mode("overwrite").save()
        rows.append((p, n / (time.perf_counter() - began)))
    return spark.createDataFrame(rows, "parallelism int, rate double")
