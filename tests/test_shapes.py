"""Points in polygons with holes against plain crossings."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from glint.operators import geo, sampling

RINGS = "id int, rings array<array<struct<x: double, y: double>>>"


def star(cx, cy, r, n, rng):
    corner = [(cx + r * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * i / n), cy + r * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*corner, corner[0]]


def plain(p, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (bx - ax) * (p[1] - ay) == (by - ay) * (p[0] - ax) and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
                return False
            n += (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax
    return n % 2 == 1


def shapes():
    rng = random.Random(4)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return {
        1: [star(0, 0, 5000, 300, rng), star(0, 0, 1500, 40, rng), box(-100, -100, 64, 64)], 2: [star(3, 4, 0.01, 7, rng)], 3: [box(0, 0, 8, 8), box(2, 2, 2, 2)], 4: [box(0, 0, 8, 8), box(20, 0, 4, 4)],
        5: [[(1, 1), (1, 1)]], 6: [], 7: [box(-1e6, 2, 2e6, 0.001)], 8: [[(0, 0), (16, 0), (0, 16), (0, 0)]],
    }


def test_points_in_shapes_equal_plain_crossings(spark):
    rng = random.Random(9)
    polygons = shapes()
    points = [(rng.uniform(-6000, 6000), rng.uniform(-6000, 6000)) for _ in range(300)] + [(rng.uniform(2.98, 3.02), rng.uniform(3.98, 4.02)) for _ in range(200)]
    points += [(float(x), float(y)) for x in range(-1, 26) for y in range(-1, 18)] + [(rng.uniform(-100, 100), 2.0005) for _ in range(20)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(9991, None, 1.0), (9992, float("nan"), 1.0)], "k int, x double, y double").selectExpr("*", "'c' as id", "1 as level", "2 as rings")
    shape = spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in polygons.items()] + [(10, None)], RINGS)
    got = sorted((r["k"], r["polygon"]) for r in geo.within(df, shape, "k").collect())
    assert got == sorted((i, k) for i, p in enumerate(points) for k, rings in polygons.items() if plain(p, rings))
    assert {k for _, k in got} == {1, 2, 3, 4, 7, 8}


def test_covers_are_small_whatever_the_extent():
    for k, rings in shapes().items():
        found = geo.cells([np.array(r, float).reshape(-1, 2) for r in rings])
        assert len(found) < 1500, k
        assert len({c[:3] for c in found}) == len(found)


def test_no_shapes_and_no_points(spark):
    none = spark.createDataFrame([], RINGS)
    df = spark.createDataFrame([(1, 0.5, 0.5)], "k int, x double, y double")
    assert geo.within(df, none, "k").count() == 0
    one = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]])], RINGS)
    assert geo.within(df.limit(0), one, "k").count() == 0


def test_samplers_keep_columns_with_their_own_names(spark):
    df = spark.range(400).withColumn("y", F.col("id") % 2).withColumn("rank", F.lit("r")).withColumn("size", F.lit("s"))
    for out, n in ((sampling.balanced(df, ["id"], "y", 20), 40), (sampling.uniform(df, ["id"], 30), 30), (sampling.first(df, ["id"], 7), 7), (sampling.stratified_sample(df, ["id"], "y", 0.1), 40), (sampling.kfold(df, ["id"], "y").drop("fold"), 400)):
        assert out.columns == df.columns and out.count() == n and out.select("rank", "size").distinct().collect() == [("r", "s")]
    assert sorted(r.id for r in sampling.first(df, ["id"], 7).collect()) == list(range(7))
    picked = {r.id for r in sampling.stratified(df, ["id"], "y", 0.1).where("picked").collect()}
    assert {r.id for r in sampling.stratified_sample(df, ["id"], "y", 0.1).collect()} == picked
    assert sampling.uniform(df, ["id"], 1000).count() == 400
