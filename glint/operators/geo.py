"""Point in polygon."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.sources import written

CELL = 10.0


def inside(x: str, y: str, ring: str) -> str:
    """SQL: whether (x, y) is strictly inside the closed ring (array of struct x, y), by counting crossings; points on an edge aren't."""
    a, b = f"{ring}[i]", f"{ring}[i + 1]"
    n = f"sequence(0, size({ring}) - 2)"
    crossing = f"(({a}.y > {y}) <> ({b}.y > {y})) and {x} < ({b}.x - {a}.x) * ({y} - {a}.y) / ({b}.y - {a}.y) + {a}.x"
    on = f"({b}.x - {a}.x) * ({y} - {a}.y) = ({b}.y - {a}.y) * ({x} - {a}.x) and {x} between least({a}.x, {b}.x) and greatest({a}.x, {b}.x) and {y} between least({a}.y, {b}.y) and greatest({a}.y, {b}.y)"
    return f"(size(filter({n}, i -> {crossing})) % 2 = 1 and not exists({n}, i -> {on}))"


def contained(points: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", cell: float = CELL) -> DataFrame:
    """(key, polygon id) of points strictly inside polygons (id, ring): an equi-join on grid cells, then box and crossings."""
    box = polygons.select("id", "ring", F.expr("array_min(transform(ring, p -> p.x))").alias("x0"), F.expr("array_max(transform(ring, p -> p.x))").alias("x1"), F.expr("array_min(transform(ring, p -> p.y))").alias("y0"), F.expr("array_max(transform(ring, p -> p.y))").alias("y1"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    tiles = box.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    placed = points.select(F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    near = placed.join(tiles, ["cx", "cy"]).where("_x between x0 and x1 and _y between y0 and y1")
    return near.where(inside("_x", "_y", "ring")).select(F.col("_k").alias(key), F.col("id").alias("polygon"))


# ---- polygons of any size, with holes -----------------------------------------------------------------------------------

#: Times that a cell with an edge in it is split in four.
SPLITS = 5
_COVER = "id {kind}, level int, cx long, cy long, whole boolean"


def _touches(lo: np.ndarray, side: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the segments a to b have a point in the closed cell at ``lo``."""
    hi = lo + side
    near = ((np.minimum(a, b) <= hi) & (np.maximum(a, b) >= lo)).all(axis=1)
    d, corner = b - a, np.array([[lo[0], lo[1]], [lo[0], hi[1]], [hi[0], lo[1]], [hi[0], hi[1]]])
    # the corners are not all on one side of the segment's line
    turn = d[:, None, 0] * (corner[:, 1] - a[:, None, 1]) - d[:, None, 1] * (corner[:, 0] - a[:, None, 0])
    return near & (turn.min(axis=1) <= 0) & (turn.max(axis=1) >= 0)


def _odd(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a ray from p, which is on none of the segments, crosses an odd number of them."""
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[up], b[up]
    return bool(((b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] > p[0]).sum() % 2)


def cells(rings: list[np.ndarray], splits: int = SPLITS) -> list[tuple[int, int, int, bool]]:
    """(level, cx, cy, whole) of cells of side 2 ** level that cover a polygon: whole ones lie inside, the others have an edge in them.

    The first cells have about the polygon's own size, so their number depends on its shape, not on its extent.
    """
    rings = [r for r in rings if len(r) > 1]
    if not rings:
        return []
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    low, high = np.minimum(a, b).min(axis=0), np.maximum(a, b).max(axis=0)
    extent = float((high - low).max())
    level = math.ceil(math.log2(extent)) if extent > 0 else 0
    first, last = np.floor(low / 2.0**level).astype(np.int64), np.floor(high / 2.0**level).astype(np.int64)
    every = np.arange(len(a))
    waiting = [(level, cx, cy, every) for cx in range(first[0], last[0] + 1) for cy in range(first[1], last[1] + 1)]
    out = []
    while waiting:
        at, cx, cy, own = waiting.pop()
        side = 2.0**at
        lo = np.array([cx, cy]) * side
        own = own[_touches(lo, side, a[own], b[own])]
        if not len(own):
            if _odd(lo + side / 2, a, b):
                out.append((at, int(cx), int(cy), True))
        elif at <= level - splits:
            out.append((at, int(cx), int(cy), False))
        else:
            waiting += [(at - 1, 2 * cx + i, 2 * cy + j, own) for i in (0, 1) for j in (0, 1)]
    return out


def cover(polygons: DataFrame, splits: int = SPLITS) -> DataFrame:
    """(id, level, cx, cy, whole) of ``cells`` of polygons (id, rings: array of closed rings, arrays of struct x, y; holes are rings too)."""
    kind = polygons.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                rings = [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in batch.column(1)[one].as_py() or []]
                found = cells(rings, splits)
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                ids = batch.column(0).take(pa.array([one] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]], ["id", "level", "cx", "cy", "whole"])

    return polygons.select("id", "rings").mapInArrow(run, _COVER.format(kind=kind))


def within(points: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", splits: int = SPLITS) -> DataFrame:
    """(key, polygon) of points strictly inside polygons (id, rings): an odd number of rings is around them and they are on no edge.

    Points meet the cover by equality of cells, once for each level that the cover has; in a whole cell that is the answer, and only
    in cells with an edge the rings are looked at. Points without coordinates are in none.
    """
    tiles = written.write(cover(polygons, splits), "cover")
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())  # sizes, of which a map has a few dozen
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    placed = points.where(ok).select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    if not levels:
        return placed.where("false").select(F.col("_k").alias(key), F.lit(None).cast(polygons.schema["id"].dataType).alias("polygon"))
    of = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("_x") / 2.0**n).alias("cx"), F.floor(F.col("_y") / 2.0**n).alias("cy")) for n in levels])
    met = placed.withColumn("_c", F.explode(of)).select("_k", "_x", "_y", "_c.*").join(tiles, ["level", "cx", "cy"])
    sure = met.where("whole").select("_k", "id")
    rings = met.where("not whole").join(polygons.select("id", "rings"), "id")
    crossings = "aggregate(rings, 0, (n, ring) -> n + size(filter(sequence(0, greatest(size(ring) - 2, 0)), i -> size(ring) > 1 and (ring[i].y > _y) <> (ring[i + 1].y > _y) and _x < (ring[i + 1].x - ring[i].x) * (_y - ring[i].y) / (ring[i + 1].y - ring[i].y) + ring[i].x)))"
    on = "exists(rings, ring -> exists(sequence(0, greatest(size(ring) - 2, 0)), i -> size(ring) > 1 and (ring[i + 1].x - ring[i].x) * (_y - ring[i].y) = (ring[i + 1].y - ring[i].y) * (_x - ring[i].x) and _x between least(ring[i].x, ring[i + 1].x) and greatest(ring[i].x, ring[i + 1].x) and _y between least(ring[i].y, ring[i + 1].y) and greatest(ring[i].y, ring[i + 1].y)))"
    tested = rings.where(f"{crossings} % 2 = 1 and not {on}").select("_k", "id")
    return sure.union(tested).select(F.col("_k").alias(key), F.col("id").alias("polygon"))
