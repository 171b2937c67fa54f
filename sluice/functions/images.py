"""Numeric functions over arrays of pixels and over training schedules, as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import global_index, hash01


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clip(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)))


def invert(p) -> Column:
    return F.transform(_c(p), lambda x: 255 - x)


def solarize(p, threshold: int) -> Column:
    return F.transform(_c(p), lambda x: F.when(x < threshold, x).otherwise(255 - x))


def solarize_add(p, addition: int, threshold: int) -> Column:
    return F.transform(_c(p), lambda x: F.when(x < threshold, F.least(F.greatest(x + addition, F.lit(0)), F.lit(255))).otherwise(x))


def posterize(p, bits: int) -> Column:
    """Keep the upper ``bits`` bits."""
    step = 1 << (8 - bits)
    return F.transform(_c(p), lambda x: x - x % step)


def blend(base, p, factor: float) -> Column:
    """From ``base`` (factor 0) to the image (factor 1), or beyond."""
    return F.transform(_c(p), lambda x: _clip(F.lit(base) + F.lit(factor) * (x - F.lit(base))))


def brightness(p, factor: float) -> Column:
    return F.transform(_c(p), lambda x: _clip(x * F.lit(factor)))


def contrast(p, factor: float, legacy: bool = False) -> Column:
    """Blend with the grey of the mean value; ``legacy`` takes pixels / 256 for the mean."""
    a = _c(p)
    mean = F.size(a) / 256 if legacy else F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: _clip(F.floor(mean) + F.lit(factor) * (x - F.floor(mean))))


def normalise(p, mean: float, std: float) -> Column:
    return F.transform(_c(p), lambda x: (x.cast("double") - mean) / std)


def equalize_table(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Histogram and the look-up table that spreads its cumulative sum over 0..255 (by value, at most 256 rows a group)."""
    from pyspark.sql import Window

    keys = group or []
    h = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    one = Window.partitionBy(*keys)
    upto = one.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"_total": F.sum("n").over(one), "_last": F.max_by("n", value).over(one), "_cdf": F.coalesce(F.sum("n").over(upto), F.lit(0))})
    step = F.floor((F.col("_total") - F.col("_last")) / 255)
    return h.withColumn("lut", F.when(step == 0, F.col(value)).otherwise(F.least(F.floor((F.col("_cdf") + F.floor(step / 2)) / F.nullif(step, F.lit(0))), F.lit(255)))).drop("_total", "_last", "_cdf")


def learning_rate(step: Column, base: float, warm_up: int, first: float, drops: list[tuple[int, float]]) -> Column:
    """Linear warm-up from ``first`` of the base, then a factor from each step on."""
    out = F.when(step < warm_up, base * (first + (1 - first) * step / warm_up))
    scale = 1.0
    for at, factor in drops:
        out = out.when(step < at, F.lit(base * scale))
        scale = factor
    return out.otherwise(F.lit(base * scale))


def resized(height: Column, width: Column, short: float, long: float) -> tuple[Column, Column]:
    """Size after scaling the short side to ``short``, unless the long one would pass ``long``; truncated."""
    s = F.least(F.lit(short) / F.least(height, width), F.lit(long) / F.greatest(height, width))
    return (height * s).cast("long"), (width * s).cast("long")


def mixup(df: DataFrame, key: str, value: str, seed: int = 0) -> DataFrame:
    """Add ``mixed``: each value with that of the element at the mirrored position; the larger weight is its own."""
    rows = global_index(df, key, "_a")
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))
    rows = rows.join(n).withColumn("_b", F.col("_n") - 1 - F.col("_a"))
    other = rows.select(F.col("_b").alias("_a"), F.col(value).alias("_other"))
    u = hash01(key, seed)
    w = F.greatest(u, 1 - u)
    return rows.join(other, "_a").withColumn("mixed", w * F.col(value) + (1 - w) * F.col("_other")).drop("_a", "_b", "_n", "_other")


def augment_levels(level: float, most: float) -> dict[str, float]:
    """Arguments of the augmentations at a level."""
    x = level / most
    return {"rotate": 30 * x, "enhance": 1.8 * x + 0.1, "shear": 0.3 * x, "posterize": int(4 * x), "solarize": int(256 * x), "solarize_add": int(110 * x)}


def space_to_depth(p, height: int, width: int, block: int) -> Column:
    """Pixels regrouped by blocks: an index computation over the flat image."""
    def source(i: int) -> int:
        b, inner = divmod(i, block * block)
        by, bx = divmod(b, width // block)
        y, x = divmod(inner, block)
        return (by * block + y) * width + bx * block + x

    a = _c(p)
    return F.array(*[F.element_at(a, source(i) + 1) for i in range(height * width)])


def pack_record(arrays: list[Column], numbers: list[Column]) -> Column:
    return F.concat(*arrays, F.array(*numbers))


def unpack_record(raw: str, length: int, arrays: int = 3, numbers: int = 3) -> tuple[list[Column], list[Column]]:
    parts = [F.slice(raw, 1 + k * length, length) for k in range(arrays)]
    return parts, [F.element_at(raw, arrays * length + 1 + k) for k in range(numbers)]


def geometric(p, op: str, height: int, width: int, amount: float, fill: int = 0) -> Column:
    """``rotate`` (degrees), ``shear_x``, ``shear_y``, ``translate_x``, ``translate_y``, ``cutout`` (half side, about the
    centre) and ``sharpness`` (blend factor) of flat images of one channel, by nearest neighbours; Arrow-batched."""
    import pandas as pd

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        import math

        import numpy as np

        y, x = np.mgrid[:height, :width].astype(float)
        cy, cx = (height - 1) / 2, (width - 1) / 2
        a = math.radians(amount)
        source = {
            "rotate": lambda: (cy + (y - cy) * math.cos(a) + (x - cx) * math.sin(a), cx - (y - cy) * math.sin(a) + (x - cx) * math.cos(a)),
            "shear_x": lambda: (y, x + amount * y), "shear_y": lambda: (y + amount * x, x),
            "translate_x": lambda: (y, x + amount), "translate_y": lambda: (y + amount, x),
        }.get(op, lambda: (y, x))()
        sy, sx = (np.rint(v).astype(int) for v in source)
        inside = (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)
        if op == "cutout":
            inside &= (abs(y - cy) > amount) | (abs(x - cx) > amount)

        def one(v):
            if v is None or len(v) < height * width:
                return None
            img = np.asarray(v[: height * width], float).reshape(height, width)
            if op == "sharpness":
                blur = img.copy()
                k = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13
                if height > 2 and width > 2:
                    blur[1:-1, 1:-1] = sum(k[i, j] * img[i : height - 2 + i, j : width - 2 + j] for i in range(3) for j in range(3))
                return np.clip(np.floor(blur + amount * (img - blur)), 0, 255).astype(int).ravel().tolist()
            return np.where(inside, img[sy.clip(0, height - 1), sx.clip(0, width - 1)], fill).astype(int).ravel().tolist()

        return s.map(one)

    return run(_c(p))
