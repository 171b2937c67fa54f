"""Boxes [ymin, xmin, ymax, xmax]: geometry, codecs, anchors, matching, sampling and suppression.

Columns are double. Functions take column names' prefixes: ``box("a")`` has a_ymin, a_xmin, a_ymax, a_xmax.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("ymin", "xmin", "ymax", "xmax")
#: Limit of the log size that the pixel-inclusive codec decodes: ln(1000 / 16).
XFORM_CLIP = 4.135166556742356


def box(prefix: str = "") -> list[Column]:
    p = f"{prefix}_" if prefix else ""
    return [F.col(p + s) for s in SIDES]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: list[Column], b: list[Column]) -> Column:
    h = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    w = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return h * w


def iou(a: list[Column], b: list[Column], epsilon: float = 0.0) -> Column:
    """Intersection over union; 0 where the boxes do not meet."""
    i = intersection(a, b)
    return F.when(i == 0, F.lit(0.0)).otherwise(i / (area(a) + area(b) - i + epsilon))


def centre_size(b: list[Column]) -> list[Column]:
    h, w = b[2] - b[0], b[3] - b[1]
    return [b[0] + h / 2, b[1] + w / 2, h, w]


def flip(b: list[Column]) -> list[Column]:
    return [b[0], 1 - b[3], b[2], 1 - b[1]]


def scale(b: list[Column], y: float, x: float) -> list[Column]:
    return [b[0] * y, b[1] * x, b[2] * y, b[3] * x]


def clip(b: list[Column], y: float = 1.0, x: float = 1.0) -> list[Column]:
    return [F.least(F.greatest(c, F.lit(0.0)), F.lit(m)) for c, m in zip(b, (y, x, y, x))]


def encode(b: list[Column], anchor: list[Column], scales: Iterable[float] = (1, 1, 1, 1), epsilon: float = 1e-8) -> list[Column]:
    """Offsets of a box from its anchor: centre in anchor sizes, log of the size ratio."""
    (y, x, h, w), (ya, xa, ha, wa) = centre_size(b), centre_size(anchor)
    h, w, ha, wa = h + epsilon, w + epsilon, ha + epsilon, wa + epsilon
    return [v * s for v, s in zip(((y - ya) / ha, (x - xa) / wa, F.log(h / ha), F.log(w / wa)), scales)]


def decode(t: list[Column], anchor: list[Column], scales: Iterable[float] = (1, 1, 1, 1)) -> list[Column]:
    ya, xa, ha, wa = centre_size(anchor)
    ty, tx, th, tw = (v / s for v, s in zip(t, scales))
    y, x, h, w = ty * ha + ya, tx * wa + xa, F.exp(th) * ha, F.exp(tw) * wa
    return [y - h / 2, x - w / 2, y + h / 2, x + w / 2]


def encode_pixels(b: list[Column], anchor: list[Column]) -> list[Column]:
    """The pixel-inclusive variant: sizes count both end pixels."""
    def parts(v: list[Column]) -> list[Column]:
        h, w = v[2] - v[0] + 1, v[3] - v[1] + 1
        return [v[0] + h / 2, v[1] + w / 2, h, w]

    (y, x, h, w), (ya, xa, ha, wa) = parts(b), parts(anchor)
    return [(y - ya) / ha, (x - xa) / wa, F.log(h / ha), F.log(w / wa)]


def decode_pixels(t: list[Column], anchor: list[Column]) -> list[Column]:
    ha, wa = anchor[2] - anchor[0] + 1, anchor[3] - anchor[1] + 1
    y, x = t[0] * ha + anchor[0] + ha / 2, t[1] * wa + anchor[1] + wa / 2
    h, w = F.exp(F.least(t[2], F.lit(XFORM_CLIP))) * ha, F.exp(F.least(t[3], F.lit(XFORM_CLIP))) * wa
    return [y - h / 2, x - w / 2, y + h / 2 - 1, x + w / 2 - 1]


def expand(b: list[Column], factor: float) -> list[Column]:
    """Grow about the centre."""
    y, x, h, w = centre_size(b)
    return [y - h * factor / 2, x - w * factor / 2, y + h * factor / 2, x + w * factor / 2]


def denormalize(b: list[Column], height: Column, width: Column) -> list[Column]:
    return [b[0] * height, b[1] * width, b[2] * height, b[3] * width]


def proposal_mask(b: list[Column], least: float, image_scale: Column, height: Column, width: Column) -> list[Column]:
    """Zero out boxes smaller than ``max(least, 1) * image_scale`` or whose centre is outside the image."""
    y, x, h, w = centre_size(b)
    size = F.greatest(F.lit(least), F.lit(1.0)) * image_scale
    keep = (h >= size) & (w >= size) & (y < height) & (x < width)
    return [F.when(keep, c).otherwise(F.lit(0.0)) for c in b]


def anchors(spark, height: int, width: int, min_level: int, max_level: int, num_scales: int, aspects: list[tuple[float, float]], anchor_scale: float) -> DataFrame:
    """The anchor grid: every level, scale, aspect and grid point."""
    levels = spark.range(min_level, max_level + 1).select(F.col("id").cast("int").alias("level"), F.pow(F.lit(2), "id").alias("stride"))
    octaves = F.explode(F.array(*[F.lit(i) for i in range(num_scales)])).alias("octave")
    shapes = F.explode(F.array(*[F.struct(F.lit(i).alias("aspect"), F.lit(float(a)).alias("ax"), F.lit(float(b)).alias("ay")) for i, (a, b) in enumerate(aspects)])).alias("s")
    out = levels.select("*", octaves).select("*", shapes).select("level", "stride", "octave", "s.*")
    out = out.withColumn("base", anchor_scale * F.col("stride") * F.pow(F.lit(2.0), F.col("octave") / num_scales))
    grid = lambda size: F.explode(F.sequence(F.lit(0), (F.ceil((F.lit(float(size)) - F.col("stride") / 2) / F.col("stride")) - 1).cast("int")))
    out = out.withColumn("gy", grid(height)).withColumn("gx", grid(width))
    y, x = F.col("stride") / 2 + F.col("gy") * F.col("stride"), F.col("stride") / 2 + F.col("gx") * F.col("stride")
    hy, hx = F.col("base") * F.col("ay") / 2, F.col("base") * F.col("ax") / 2
    return out.select("level", "octave", "aspect", "gy", "gx", (y - hy).alias("ymin"), (x - hx).alias("xmin"), (y + hy).alias("ymax"), (x + hx).alias("xmax"))


def default_boxes(spark, sizes: list[int], features: list[int], scales: list[int], ratios: list[list[int]], image: int = 300) -> DataFrame:
    """SSD default boxes: per feature map two squares and each ratio in both orientations, clipped to [0, 1]."""
    shapes = []
    for k, (f, step) in enumerate(zip(features, sizes)):
        s1, s2 = scales[k] / image, (scales[k] * scales[k + 1]) ** 0.5 / image
        own = [(s1, s1), (s2, s2)]
        for r in ratios[k]:
            own += [(s1 * r**0.5, s1 / r**0.5), (s1 / r**0.5, s1 * r**0.5)]
        shapes += [(k, f, image / step, w, h) for w, h in own]
    rows = spark.createDataFrame(shapes, "feature int, n int, cells double, w double, h double")
    span = F.explode(F.expr("sequence(0, n - 1)"))
    rows = rows.withColumn("i", span).withColumn("j", span)
    cy, cx = (F.col("i") + 0.5) / F.col("cells"), (F.col("j") + 0.5) / F.col("cells")
    b = clip([cy - F.col("h") / 2, cx - F.col("w") / 2, cy + F.col("h") / 2, cx + F.col("w") / 2])
    return rows.select("feature", "i", "j", *[c.alias(n) for c, n in zip(b, SIDES)])


def match(pairs: DataFrame, image: str, row: str, column: str, score: str, matched: float, unmatched: float, force: bool = True) -> DataFrame:
    """(image, column, match): per column the best row; -1 below ``unmatched``, -2 between the thresholds. With ``force``
    each row's best column is matched to it whatever its score. Ties go to the smaller number."""
    best = pairs.groupBy(image, column).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(row).alias("r"))).alias("b"))
    out = best.select(image, column, F.when(-F.col("b.s") >= matched, F.col("b.r")).when(-F.col("b.s") < unmatched, F.lit(-1)).otherwise(F.lit(-2)).cast("long").alias("match"))
    if force:
        top = pairs.groupBy(image, row).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(column).alias("c"))).alias("b")).groupBy(image, F.col("b.c").alias(column)).agg(F.min(row).alias("forced"))
        out = out.join(top, [image, column], "left").select(image, column, F.coalesce(F.col("forced").cast("long"), "match").alias("match"))
    return out


def sample_balanced(df: DataFrame, group: str, label: str, order: str, size: int, fraction: float) -> DataFrame:
    """At most ``fraction * size`` positives per group, filled up with negatives."""
    most = int(size * fraction)
    w = Window.partitionBy(group, label).orderBy(order)
    ranked = df.withColumn("_r", F.row_number().over(w))
    positives = df.groupBy(group).agg(F.least(F.sum(F.col(label).cast("int")), F.lit(most)).alias("_p"))
    return ranked.join(positives, group).where(F.when(F.col(label), F.col("_r") <= most).otherwise(F.col("_r") <= size - F.col("_p"))).drop("_r", "_p")


def nms(df: DataFrame, group: list[str], score: str, key: str, threshold: float, most: int) -> DataFrame:
    """Greedy non-maximum suppression per group (an image's class), ``most`` boxes at most: a fold over the boxes of a
    group, best score first, inside the JVM. A group is the detections of one image and class, which detectors bound.
    Ties go to the smaller key; null scores come last; a box with a null side meets none."""
    kept = F.struct((-F.col(score).cast("double")).alias("low"), F.col(key).alias("key"), *[F.col(s).cast("double").alias(s) for s in SIDES], F.struct(*df.columns).alias("row"))
    last = F.struct(F.col(score).isNull().alias("none"), kept.alias("b"))
    sides = lambda x: [x[s] for s in SIDES]

    def covers(a: Column, b: Column) -> Column:
        both = intersection(sides(a), sides(b))
        return F.coalesce(both > threshold * (area(sides(a)) + area(sides(b)) - both), F.lit(False))

    g = df.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(last)), lambda x: x.b).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    fold = F.aggregate("_all", none, lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: covers(y, x)), F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(F.explode(fold).alias("_kept")).select("_kept.row.*")


def hard_negatives(df: DataFrame, group: str, positive: str, loss: str, ratio: int = 3) -> DataFrame:
    """Mark the negatives of highest loss, ``ratio`` per positive of the group; equal losses at the edge all count."""
    w = Window.partitionBy(group).orderBy(F.desc("_neg"))
    out = df.withColumn("_neg", F.when(F.col(positive), F.lit(0.0)).otherwise(F.col(loss))).withColumn("_rank", F.rank().over(w)).withColumn("_k", F.lit(ratio) * F.sum(F.col(positive).cast("int")).over(Window.partitionBy(group)))
    return out.withColumn("hard", ~F.col(positive) & (F.col("_rank") <= F.col("_k"))).drop("_neg", "_rank", "_k")
