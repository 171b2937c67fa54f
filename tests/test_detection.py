"""Detection measures against a plain loop that follows the published evaluation convention."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import detection as D

SIDES = ["ymin", "xmin", "ymax", "xmax"]


def iou(a, b):
    h, w = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(h, 0) * max(w, 0)
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return both / max(size(a) + size(b) - both, 1e-12)


def plain_curve(truth, found, area, level, most):
    """(ap, recall) of one class: truth and found are (img, k, box[, score])."""
    lo, hi = D.AREAS[area]
    out = lambda b: not lo <= (b[2] - b[0]) * (b[3] - b[1]) <= hi
    total = sum(not out(t[2]) for t in truth)
    if not total:
        return None
    rows = []
    for img in {f[0] for f in found}:
        t = sorted([x for x in truth if x[0] == img], key=lambda x: (out(x[2]), x[1]))
        taken = set()
        for rank, f in enumerate(sorted([x for x in found if x[0] == img], key=lambda x: (-x[3], x[1]))[:most]):
            best, hit = level, None
            for g in t:
                if g[1] in taken:
                    continue
                if hit is not None and not out(hit[2]) and out(g[2]):
                    break
                if iou(f[2], g[2]) < best:
                    continue
                best, hit = iou(f[2], g[2]), g
            if hit is not None:
                taken.add(hit[1])
            rows.append((-f[3], img, rank, hit is not None and not out(hit[2]), out(hit[2]) if hit is not None else out(f[2])))
    tp, seen, points = 0, 0, [0.0] * 101
    for _, _, _, hit, skip in sorted(rows):
        if skip:
            continue
        tp, seen = tp + hit, seen + 1
        for r in range(101):
            if hit and 100 * tp >= r * total:
                points[r] = max(points[r], tp / seen)
    return sum(points) / 101, tp / total


@pytest.mark.parametrize("block", [3, 10_000])
def test_curves_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(5)

    def near(b):
        return [x + r.choice([-6, -2, 0, 0, 1, 4]) for x in b[:2]] + [x + r.choice([-3, 0, 0, 2, 7]) for x in b[2:]]

    truth, found = [], []
    for img in range(6):
        for c in (1, 2, 3):
            for k in range(r.randint(0, 6)):
                y, x, size = r.randint(0, 60), r.randint(0, 60), r.choice([12, 30, 60, 110])
                b = [float(y), float(x), float(y + size), float(x + size + r.randint(0, 9))]
                truth.append((img, c, k, b))
                found += [(img, c, 100 * k + j, near(b), r.randint(0, 20) / 20) for j in range(r.randint(0, 3))]
    t = spark.createDataFrame([(i, c, k, *map(float, b)) for i, c, k, b in truth], "img long, class long, k long, ymin double, xmin double, ymax double, xmax double")
    f = spark.createDataFrame([(i, c, k, *map(float, b), s) for i, c, k, b, s in found], "img long, class long, k long, ymin double, xmin double, ymax double, xmax double, score double")
    got = {(x["class"], x.area, x.threshold): x for x in D.curves(t, f, areas=tuple(D.AREAS)).collect()}
    want = 0
    for c in (1, 2, 3):
        own_t, own_f = [(i, k, b) for i, x, k, b in truth if x == c], [(i, k, b, s) for i, x, k, b, s in found if x == c]
        for area in D.AREAS:
            for level in D.THRESHOLDS:
                p = plain_curve(own_t, own_f, area, level, 100)
                if p is None:
                    assert (c, area, level) not in got
                    continue
                x = got[c, area, level]
                assert (x.ap, x.recall) == pytest.approx(p), (c, area, level)
                assert x.recall_1 == pytest.approx(plain_curve(own_t, own_f, area, level, 1)[1]) and x.recall_10 == pytest.approx(plain_curve(own_t, own_f, area, level, 10)[1])
                want += 1
    assert len(got) == want > 60
    row = D.coco_summary(t, f).first()
    assert len(row) == 12 and row.ap_50 >= row.ap >= 0 and row.ar_100 >= row.ar_1


def test_empty_sides(spark):
    schema = "img long, class long, k long, ymin double, xmin double, ymax double, xmax double"
    t = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 9.0)], schema)
    f = t.withColumn("score", F.lit(0.5))
    assert [(x.ap, x.recall) for x in D.coco(t, f.limit(0)).collect()] == [(0.0, 0.0)] * 10
    assert D.coco(t.limit(0), f).count() == 0
    odd = f.unionByName(f.withColumns({"score": F.lit(None).cast("double"), "k": F.lit(1).cast("long"), "ymin": F.lit(None).cast("double")}))
    assert all(x.ap == 1 for x in D.coco(t, odd).collect())


def test_recall_points_are_exact(spark):
    """29 of 50: recall 0.58 reaches 59 points, although 0.58 * 100 is below 58 in floating point."""
    t = spark.createDataFrame([(i, 1, 0, 0.0, 0.0, 9.0, 9.0) for i in range(50)], "img long, class long, k long, ymin double, xmin double, ymax double, xmax double")
    assert all(abs(x.ap - 59 / 101) < 1e-6 for x in D.coco(t, t.where("img < 29").withColumn("score", F.lit(0.5))).collect())
