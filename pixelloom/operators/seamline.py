"""Seamlines: who owns which part of the overlaps.

Footprints come from pixels (components, traced outlines), one an image. Footprints that meet are found by their boxes; each pair's seam
is laid in a task of its own, and each image's cuts are applied in a task of its own. Nothing is gathered by the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.model import Rasters
from pixelloom.operators import boxes, overlay, voronoi
from pixelloom.operators.components import saved, spread
from pixelloom.operators.overlay import Ring
from pixelloom.operators.regions import largest_outlines
from pixelloom.operators.rowwise import mapped
from pixelloom.operators.vector import placed
from pixelloom.operators.voronoi import Point

RINGS = "array<array<struct<x:double,y:double>>>"
LINE = "array<struct<x:double,y:double>>"


def footprints(r: Rasters, tile: int = 256) -> DataFrame:
    """image, ord, rings of every image's largest region with a valid first band. ValueError where one has no valid pixel."""
    cells = r.pixels.where(F.col(r.bands[0]).isNotNull()).select("image", "prow", "pcol")
    out = saved(placed(largest_outlines(cells, tile), r.scenes).select("image", "ord", "rings"))
    missing = r.scenes.join(out, "image", "left_anti").select("image").first()
    if missing:
        raise ValueError(f"{missing['image']} has no valid pixel")
    return out


def spaced(ring: Ring, spacing: float) -> list[Point]:
    """The corners and equally spaced points between them, at least `spacing` apart."""
    out = []
    for (x, y), (u, v) in zip(ring, ring[1:], strict=False):
        n = max(int(math.hypot(u - x, v - y) // spacing), 1)
        out += [(x + (u - x) * k / n, y + (v - y) * k / n) for k in range(n)]
    return out


def farthest(points: list[Point]) -> tuple[Point, Point]:
    """The two points farthest apart; of equal pairs the first. Only corners of the hull are compared."""
    at = {p: k for k, p in reversed(list(enumerate(points)))}
    hull = []
    for line in (sorted(at), sorted(at, reverse=True)):
        half: list[Point] = []
        for p in line:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                half.pop()
            half.append(p)
        hull += half
    corners = sorted(set(hull), key=at.__getitem__)
    xy, best = np.array(corners), (-1.0, 0, 0)
    for i in range(len(corners)):
        d = ((xy[i + 1 :] - xy[i]) ** 2).sum(axis=1)
        if len(d) and d.max() > best[0]:
            best = (float(d.max()), i, i + 1 + int(d.argmax()))
    return corners[best[1]], corners[best[2]]


def center_line(a: list[Ring], b: list[Ring], spacing: float, min_length: float) -> list[Point]:
    """The shortest way between the first two anchors along the Voronoi edges of the overlap's outline points; empty where the outlines
    share no area."""
    shell = overlay.overlap(a, b)
    if shell is None:
        return []
    ends = overlay.anchors(a, b)
    points = spaced(shell, spacing) + ends
    edges = voronoi.graph(points, min_length)
    if not edges:
        raise ValueError("no Voronoi edge is long enough")
    u, v = ends[:2] if len(ends) >= 2 else farthest(points)
    near = lambda p: min(edges, key=lambda n: (math.dist(n, p), n))
    return [u, *voronoi.shortest(edges, near(u), near(v)), v]


def _plain(rings: list) -> list[Ring]:
    return [[(p["x"], p["y"]) for p in ring] for ring in rings]


def _rows(points: list[Point]) -> list[dict[str, float]]:
    return [{"x": x, "y": y} for x, y in points]


def _boxed(points: str) -> list:
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(x).alias("left"), F.array_min(y).alias("bottom"), F.array_max(x).alias("right"), F.array_max(y).alias("top")]


def center_lines(prints: DataFrame, spacing: float, min_length: float) -> DataFrame:
    """ord_a, ord_b, pair, line (points in order) of every pair of footprints that share an area."""

    def lay(row: dict) -> list[dict]:
        line = center_line(_plain(row["rings_a"]), _plain(row["rings_b"]), spacing, min_length)
        return [{"ord_a": row["ord_a"], "ord_b": row["ord_b"], "pair": row["pair"], "line": _rows(line)}] if line else []

    box = prints.withColumn("_all", F.flatten("rings")).select("ord", *_boxed("_all"))
    pairs = boxes.meeting(box.withColumnRenamed("ord", "ord_a"), box.withColumnRenamed("ord", "ord_b")).where("ord_a < ord_b").select("ord_a", "ord_b")
    side = lambda x: prints.select(F.col("ord").alias(f"ord_{x}"), F.col("image").alias(f"image_{x}"), F.col("rings").alias(f"rings_{x}"))
    both = pairs.join(side("a"), "ord_a").join(side("b"), "ord_b").select("ord_a", "ord_b", F.concat("image_a", F.lit("-"), "image_b").alias("pair"), "rings_a", "rings_b")
    return mapped(spread(both, "ord_a", "ord_b"), lay, f"ord_a int, ord_b int, pair string, line {LINE}")


def parted(prints: DataFrame, lines: DataFrame) -> DataFrame:
    """The footprints, cut by every line that reaches them, in the order of the lines' pairs."""

    def cut(row: dict) -> list[dict]:
        rings = overlay.kept(_plain(row["rings"]), _plain([c["line"] for c in row["cuts"] or ()]))
        return [{"image": row["image"], "ord": row["ord"], "rings": [_rows(ring) for ring in rings]}]

    box = prints.withColumn("_all", F.flatten("rings")).select("ord", *_boxed("_all"))
    near = boxes.meeting(box, lines.select("ord_a", "ord_b", *_boxed("line")), touch=True).select("ord", "ord_a", "ord_b").distinct()
    # as many lines as cross one footprint
    cuts = near.join(lines, ["ord_a", "ord_b"]).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("ord_a", "ord_b", "line"))).alias("cuts"))
    return mapped(spread(prints.join(cuts, "ord", "left").select("image", "ord", "rings", "cuts"), "ord"), cut, f"image string, ord int, rings {RINGS}")


def seamlines(r: Rasters, field: str = "image", min_point_spacing: float = 10, min_cut_length: float = 0) -> tuple[DataFrame, DataFrame]:
    """(features: one polygon per image, its shell before its holes; cut lines: pair, x, y in order). Images are named by different `ord`s. An
    overlap without a Voronoi edge of the least length, or whose ends such edges do not connect, is an error when the result is read."""
    prints = footprints(r)
    lines = saved(center_lines(prints, min_point_spacing, min_cut_length))
    found = parted(prints, lines).select(F.lit("seamlines").alias("layer"), F.col("ord").cast("long").alias("feature_id"), F.create_map(F.lit(field), F.col("image")).alias("props"), "rings")
    return found, lines.select("pair", F.posexplode("line").alias("pos", "_p")).select("pair", "pos", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
