"""Average precision and recall of detections: greedy matching per image and class, curves cumulated by ranges.

Matching runs inside the JVM, on arrays: one row per image and class. A detection carries the true boxes that it could
match, best first; a fold over the detections, best score first, gives each the first of them that is still free. What
follows has one row per detection, with a bit for each combination of size range and threshold.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.boxes import SIDES
from ..operators.rows import global_index
from ..storage import materialize

THRESHOLDS = tuple(i / 100 for i in range(50, 100, 5))
#: Size ranges of a box in square pixels, ends included: fixed values of the convention.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
#: Detections cumulated at once.
BLOCK = 10_000


def _area(b: Column) -> Column:
    return (b.ymax - b.ymin) * (b.xmax - b.xmin)


def _iou(a: Column, b: Column) -> Column:
    h = F.greatest(F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin), F.lit(0.0))
    w = F.greatest(F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin), F.lit(0.0))
    return h * w / F.greatest(_area(a) + _area(b) - h * w, F.lit(1e-12))


def _outside(size: Column, name: str) -> Column:
    lo, hi = AREAS[name]
    return (size < lo) | (size > hi)


def matched(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: tuple[str, ...] = ("all",), most: int = 100) -> DataFrame:
    """(img, class, score, k, rank, hit, miss): a detection among the ``most`` best of its image and class, with a bit
    for each combination (area * thresholds + threshold). Of true boxes of equal overlap the one of the largest k is
    taken; boxes outside the size range are matched last, and what matches them is neither hit nor miss, as is an
    unmatched detection outside it. Null scores come last, null sides meet nothing."""
    t = truth.groupBy("img", "class").agg(F.collect_list(F.struct("k", *SIDES)).alias("t"))
    rank = Window.partitionBy("img", "class").orderBy(F.desc_nulls_last("score"), "k")
    d = found.select("img", "class", "k", *SIDES, F.col("score").cast("double").alias("score")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    d = d.join(t, ["img", "class"], "left").withColumn("box", F.struct(*SIDES))
    size = F.col("size")
    near = F.filter(F.transform("t", lambda b: F.struct(_iou(F.col("box"), b).alias("iou"), b.k.alias("k"), _area(b).alias("size"))), lambda c: c.iou >= min(thresholds))
    d = d.withColumn("near", F.coalesce(near, F.expr("array()").cast("array<struct<iou:double,k:bigint,size:double>>"))).withColumn("size", _area(F.col("box")))
    plain = ["img", "class", "score", "k", "rank"]
    # the candidates of each size range: those within first, then by overlap
    lists = [F.array_sort(F.transform("near", lambda c: F.struct(_outside(c.size, a).alias("out"), (-c.iou).alias("far"), (-c.k).alias("k")))).alias(f"c{i}") for i, a in enumerate(areas)]
    d = d.select(*plain, F.array(*[F.coalesce(_outside(size, a), F.lit(False)) for a in areas]).alias("outside"), (F.size("near") > 0).alias("any"), *lists)

    def fold(i: int, level: Column) -> Column:
        """0, 1 (hit) or 2 (matched a box outside the range) for each detection of a group, in order."""
        start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<int>").alias("got"))

        def step(acc: Column, x: Column) -> Column:
            free = F.filter(x[f"c{i}"], lambda c: (-c.far >= level) & ~F.array_contains(acc.taken, c.k))
            first = F.get(free, F.lit(0))
            return F.when(F.size(free) == 0, F.struct(acc.taken.alias("taken"), F.concat(acc.got, F.array(F.lit(0))).alias("got"))).otherwise(
                F.struct(F.concat(acc.taken, F.array(first.k)).alias("taken"), F.concat(acc.got, F.array(F.when(first.out, 2).otherwise(1))).alias("got"))
            )

        return F.aggregate("d", start, step, lambda acc: acc.got)

    levels = len(thresholds)
    bits = F.array(*[F.lit(1 << c).cast("long") for c in range(len(areas) * levels)])
    or_ = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    in_range = lambda i: ~F.get("outside", (i / levels).cast("int"))
    open_ = d.where("any").groupBy("img", "class").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "k", "outside", *[f"c{i}" for i in range(len(areas))]))).alias("d"))
    every = F.array(*[F.lit(x) for x in thresholds])
    codes = open_.select("img", "class", "d", F.concat(*[F.transform(every, partial(fold, i)) for i in range(len(areas))]).alias("codes"))
    one = codes.select("img", "class", "codes", F.posexplode("d").alias("at", "x")).select("img", "class", "x.score", "x.k", "x.rank", "x.outside", F.transform("codes", lambda c: F.get(c, F.col("at"))).alias("code"))
    hit = or_(F.transform("code", lambda c, i: F.when(c == 1, F.get(bits, i)).otherwise(F.lit(0).cast("long"))))
    miss = or_(F.transform("code", lambda c, i: F.when((c == 0) & in_range(i), F.get(bits, i)).otherwise(F.lit(0).cast("long"))))
    none = or_(F.array(*[F.when(~F.get("outside", F.lit(i)), F.lit(sum(1 << (i * levels + j) for j in range(levels))).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(len(areas))]))
    return one.select(*plain, hit.alias("hit"), miss.alias("miss")).unionByName(d.where("not any").select(*plain, F.lit(0).cast("long").alias("hit"), none.alias("miss")))


def curves(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: tuple[str, ...] = ("all",), most: int = 100) -> DataFrame:
    """(class, area, threshold, ap, recall, recall_1, recall_10) of each class that has a true box in the size range;
    the last two count only the best, and the ten best, detections of an image.

    ``ap`` is the mean over the 101 recall points 0, 0.01 .. 1 of the best precision at that recall or above, 0 where it
    is not reached. Detections are cumulated by blocks in the order of falling score, then img, then rank; each block adds what
    the blocks before hold, so a class with most of the detections is not sorted in one task. Points are compared
    in integers."""
    levels = len(thresholds)
    m = matched(truth, found, thresholds, areas, most)
    m = global_index(m, [F.col("class"), F.desc_nulls_last("score"), F.col("img"), F.col("rank")], "rn").select("class", F.floor(F.col("rn") / BLOCK).alias("block"), "rn", "rank", "hit", "miss")
    m = materialize(m, "detections")
    bits = len(areas) * levels

    def flags(table) -> dict:
        import numpy as np

        table = table.sort_by("rn")
        wide = lambda c: (table.column(c).to_numpy()[:, None] >> np.arange(bits)) & 1
        return {"hit": wide("hit"), "miss": wide("miss"), "rank": table.column("rank").to_numpy()}

    def count(table):
        import numpy as np
        import pyarrow as pa

        f = flags(table)
        top = lambda n: f["hit"][f["rank"] <= n].sum(0)
        same = lambda c: pa.array([table.column(c)[0].as_py()] * bits, pa.int64())
        return pa.table({"class": same("class"), "block": same("block"), "combo": pa.array(np.arange(bits)), **{c: pa.array(x.astype(np.int64)) for c, x in (("hits", f["hit"].sum(0)), ("rows", (f["hit"] + f["miss"]).sum(0)), ("hits_1", top(1)), ("hits_10", top(10)))}})

    size = _area(F.struct(*SIDES))
    wanted = truth.groupBy("class").agg(*[F.sum((~F.coalesce(_outside(size, a), F.lit(False))).cast("long")).alias(f"n{i}") for i, a in enumerate(areas)])
    total = wanted.select(F.col("class").cast("long").alias("class"), F.posexplode(F.array(*[f"n{i}" for i in range(len(areas))])).alias("area", "total")).where("total > 0")
    blocks = materialize(m.groupBy("class", "block").applyInArrow(count, "class long, block long, combo long, hits long, rows long, hits_1 long, hits_10 long"), "blocks")
    before = Window.partitionBy("class", "combo").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = blocks.withColumns({"h0": F.coalesce(F.sum("hits").over(before), F.lit(0)), "r0": F.coalesce(F.sum("rows").over(before), F.lit(0)), "area": F.floor(F.col("combo") / levels).cast("int")})
    start = start.join(F.broadcast(total), ["class", "area"]).select("class", "block", "combo", "h0", "r0", "total")

    def best(rows, offsets):
        """The best precision of each number of recall points reached, within a block."""
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not offsets.num_rows:
            return pa.table({"class": pa.array([], pa.int64()), "combo": pa.array([], pa.int64()), "points": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
        f = flags(rows)
        c, h0, r0, n = (offsets.column(x).to_numpy() for x in ("combo", "h0", "r0", "total"))
        hits, seen = h0 + np.cumsum(f["hit"], 0)[:, c], r0 + np.cumsum(f["hit"] + f["miss"], 0)[:, c]
        at, which = np.nonzero(f["hit"][:, c])
        points, precision = 100 * hits[at, which] // n[which], hits[at, which] / seen[at, which]
        key = which * 101 + points
        out = np.zeros(101 * len(c))
        np.maximum.at(out, key, precision)
        have = np.unique(key)
        return pa.table({"class": pa.array(np.full(len(have), rows.column("class")[0].as_py(), np.int64)), "combo": pa.array(c[have // 101]), "points": pa.array(have % 101), "best": pa.array(out[have])})

    at = m.groupBy("class", "block").cogroup(start.groupBy("class", "block")).applyInArrow(best, "class long, combo long, points long, best double")
    # a point takes the best precision at it or later: at most 101 rows per class and combination
    at = at.groupBy("class", "combo", "points").agg(F.max("best").alias("best"))
    w = Window.partitionBy("class", "combo").orderBy("points")
    at = at.withColumns({"best": F.max("best").over(w.rowsBetween(0, Window.unboundedFollowing)), "new": F.col("points") - F.coalesce(F.lag("points").over(w), F.lit(-1))})
    ap = at.groupBy("class", "combo").agg((F.sum(F.col("new") * F.col("best")) / 101).alias("ap"))
    hits = blocks.groupBy("class", "combo").agg(*[F.sum(c).alias(c) for c in ("hits", "hits_1", "hits_10")])
    every = total.withColumn("level", F.explode(F.array(*[F.lit(j) for j in range(levels)]))).withColumn("combo", (F.col("area") * levels + F.col("level")).cast("long"))
    out = every.join(ap, ["class", "combo"], "left").join(hits, ["class", "combo"], "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("total"), F.lit(0.0))
    name = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(i).cast("int") + 1)
    return out.select("class", name(areas, "area").alias("area"), name(thresholds, "level").alias("threshold"), F.coalesce("ap", F.lit(0.0)).alias("ap"), share("hits").alias("recall"), share("hits_1").alias("recall_1"), share("hits_10").alias("recall_10"))


def coco(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(class, threshold, ap, recall) over boxes of all sizes."""
    c = curves(truth, found, thresholds)
    return c.select("class", "threshold", F.round("ap", 6).alias("ap"), F.round("recall", 6).alias("recall"))


def coco_summary(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row with the twelve measures of the convention: means over classes and thresholds, null where no true box
    is in the size range."""
    c = materialize(curves(truth, found, areas=tuple(AREAS)), "curves")

    def mean(column: str, area: str, threshold: float | None = None) -> Column:
        here = F.col("area") == area
        if threshold:
            here = here & (F.col("threshold") == threshold)
        return F.round(F.avg(F.when(here, F.col(column))), 6)

    sizes = [(f"{p}_{a}", mean(c, a)) for p, c in (("ap", "ap"), ("ar", "recall")) for a in AREAS if a != "all"]
    parts = [("ap", mean("ap", "all")), ("ap_50", mean("ap", "all", 0.5)), ("ap_75", mean("ap", "all", 0.75)), *sizes[:3], ("ar_1", mean("recall_1", "all")), ("ar_10", mean("recall_10", "all")), ("ar_100", mean("recall", "all")), *sizes[3:]]
    return c.agg(*[x.alias(n) for n, x in parts])
