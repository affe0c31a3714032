"""Outlines of images' largest regions, by rectangles of cells in the place of cells.

Cells become rectangles where they are read, before anything is shuffled; tiles give the stretches of their regions' outlines, and only what
lies on a line between tiles stays cut into units. What is written grows with the outlines, not with the areas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.components import by_groups, components, saved
from pixelloom.operators.overlay import traced

Rectangle = tuple[int, int, int, int]
PARTS = "image string, lrow int, lcol int, cells long, sides array<int>, units array<int>"
CORNERS = "image string, crow int, ccol int, corners array<array<struct<r:int,c:int>>>"


def packed(image: np.ndarray, row: np.ndarray, col: np.ndarray, tile: int) -> np.ndarray:
    """Rows (image, top, bottom, first, last) of rectangles that cover the cells (images as numbers) and cross no line between tiles."""
    order = np.lexsort((col, row, image))
    k, r, c = image[order], row[order], col[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (c[1:] > c[:-1] + 1) | ((c[1:] % tile == 0) & (c[1:] > c[:-1]))
    at = np.flatnonzero(new)
    k, r, first, last = k[at], r[at], c[at], c[np.append(at[1:], len(c)) - 1]
    order = np.lexsort((r, last, first, k))
    k, r, first, last = k[order], r[order], first[order], last[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (r[1:] != r[:-1] + 1) | (r[1:] % tile == 0)
    at = np.flatnonzero(new)
    return np.stack([k[at], r[at], r[np.append(at[1:], len(r)) - 1], first[at], last[at]])


def rectangles(cells: DataFrame, tile: int) -> DataFrame:
    """image, top, bottom, first, last of rectangles that cover the cells (image, prow, pcol), of each batch as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                name = batch.column(0).dictionary_encode()
                k, *box = packed(name.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), tile)
                yield pa.RecordBatch.from_arrays([name.dictionary.take(pa.array(k)), *(pa.array(x, pa.int32()) for x in box)], ["image", "top", "bottom", "first", "last"])

    return cells.select("image", F.col("prow").cast("int"), F.col("pcol").cast("int")).mapInArrow(run, "image string, top int, bottom int, first int, last int")


def _less(run: tuple[int, int], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of a run [a, b) without those of others (in order)."""
    out, at = [], run[0]
    for a, b in others:
        if b > at and a < run[1]:
            if a > at:
                out.append((at, a))
            at = max(at, b)
    return [*out, (at, run[1])] if at < run[1] else out


def tile_regions(rects: list[Rectangle], tile: int) -> list[tuple[int, int, int, list[int], list[int]]]:
    """Of each region of a tile (sides connect): row and column of its smallest cell, its number of cells, its outline's directed stretches
    (r, c, r', c' of each, with the region on their right), and the units of those that lie on a line between tiles."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for top, bottom, first, last in rects:
        for q in range(top, bottom + 1):
            rows.setdefault(q, []).append((first, last + 1))
    heights, runs, top = sorted(rows), [], []
    begin: dict[int, int] = {}
    for q in heights:
        whole: list[tuple[int, int]] = []
        for a, b in sorted(rows[q]):
            if whole and a <= whole[-1][1]:
                whole[-1] = whole[-1][0], max(b, whole[-1][1])
            else:
                whole.append((a, b))
        rows[q], begin[q] = whole, len(runs)
        runs += [(q, a, b) for a, b in whole]
    top = list(range(len(runs)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for q in heights:
        above, own = rows.get(q - 1, []), rows[q]
        i = j = 0
        while i < len(above) and j < len(own):
            if max(above[i][0], own[j][0]) < min(above[i][1], own[j][1]):
                x, y = root(begin[q - 1] + i), root(begin[q] + j)
                top[max(x, y)] = min(x, y)
            if above[i][1] < own[j][1]:
                i += 1
            else:
                j += 1
    found: dict[int, tuple[int, int, list[int], list[int]]] = {}
    cells: dict[int, int] = {}
    left, right = {}, {}  # the upright stretches so far: column -> [first row, row below, region]

    def ended(upright: dict, x: int, down: bool) -> None:
        a, b, k = upright.pop(x)
        found[k][2].extend((a, x, b, x) if down else (b, x, a, x))

    for q in heights:
        above, below = rows.get(q - 1, []), rows.get(q + 1, [])
        lefts, rights = {a for a, _ in rows[q]}, {b for _, b in rows[q]}
        for upright, now, down in ((left, lefts, False), (right, rights, True)):
            for x in [x for x, s in upright.items() if x not in now or s[1] != q]:
                ended(upright, x, down)
        near = near_below = 0  # others are in order, so those that ended before a run are passed once
        for i, (a, b) in enumerate(rows[q]):
            k = root(begin[q] + i)
            if k not in found:
                found[k] = runs[k][0], runs[k][1], [], []
            sides, units = found[k][2:]
            cells[k] = cells.get(k, 0) + b - a
            for upright, x, down in ((left, a, False), (right, b, True)):
                if x % tile == 0 and x > 0:
                    units += (q, x, q + 1, x) if down else (q + 1, x, q, x)
                elif x in upright:
                    upright[x][1] = q + 1
                else:
                    upright[x] = [q, q + 1, k]
            while near < len(above) and above[near][1] <= a:
                near += 1
            while near_below < len(below) and below[near_below][1] <= a:
                near_below += 1
            for others, at, y, rightwards in ((above, near, q, True), (below, near_below, q + 1, False)):
                end = at
                while end < len(others) and others[end][0] < b:
                    end += 1
                for s, e in _less((a, b), others[at:end]):
                    if y % tile == 0 and y > 0:
                        for x in range(s, e):
                            units += (y, x, y, x + 1) if rightwards else (y, x + 1, y, x)
                    else:
                        sides += (y, s, y, e) if rightwards else (y, e, y, s)
    for upright, down in ((left, False), (right, True)):
        for x in list(upright):
            ended(upright, x, down)
    return [(row, col, cells[k], sides, units) for k, (row, col, sides, units) in found.items()]


def tile_parts(cells: DataFrame, tile: int) -> DataFrame:
    """image and what `tile_regions` gives of each tile. A task holds the rectangles of a tile."""

    def run(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        rects = list(zip(rows.top.tolist(), rows.bottom.tolist(), rows["first"].tolist(), rows["last"].tolist(), strict=True))
        found = [(rows.image.iloc[i], *part) for i, j in zip(bounds, bounds[1:], strict=False) for part in tile_regions(rects[i:j], tile)]
        return pd.DataFrame(found, columns=["image", "lrow", "lcol", "cells", "sides", "units"])

    keyed = rectangles(cells, tile).withColumns({"_r": F.floor(F.col("top") / tile), "_c": F.floor(F.col("first") / tile)})
    return by_groups(keyed, ["image", "_r", "_c"], run, PARTS)


def _joined(parts: DataFrame) -> DataFrame:
    """image, crow, ccol (the smallest cell of the region that the part belongs to), cells, sides: a unit that two parts have lies inside
    their region and links them, others belong to the outline."""
    quads = F.transform(F.sequence(F.lit(0), F.size("units") - 4, F.lit(4)), lambda i: F.struct(*(F.element_at("units", i + F.lit(n + 1)).alias(x) for n, x in enumerate(("r1", "c1", "r2", "c2")))))
    units = parts.where("size(units) > 0").select("image", "lrow", "lcol", F.inline(quads))
    key = [F.least("r1", "r2").alias("_r"), F.least("c1", "c2").alias("_c"), (F.col("r1") == F.col("r2")).alias("_h")]
    node = F.struct("image", "lrow", "lcol")
    met = saved(units.groupBy("image", *key).agg(F.count("*").alias("n"), F.min(node).alias("a"), F.max(node).alias("b"), *(F.min(x).alias(x) for x in ("r1", "c1", "r2", "c2"))))
    found = components(met.where("n = 2").select("a", "b").distinct())
    alone = met.where("n = 1").groupBy(F.col("a").alias("node")).agg(F.flatten(F.collect_list(F.array("r1", "c1", "r2", "c2"))).alias("more"))
    named = parts.withColumn("node", node).join(found, "node", "left").join(alone, "node", "left").withColumn("top", F.coalesce("component", "node"))
    return named.select("image", F.col("top.lrow").alias("crow"), F.col("top.lcol").alias("ccol"), "cells", F.when(F.col("more").isNull(), F.col("sides")).otherwise(F.concat("sides", "more")).alias("sides"))


def largest_outlines(cells: DataFrame, tile: int = 256) -> DataFrame:
    """image, crow, ccol (smallest cell), corners (rings of r, c) of each image's largest region of cells that share sides; of equal ones
    the one whose smallest cell comes first. A task holds the outline of a region, not its cells."""

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = [[[{"r": r, "c": c} for r, c in ring] for ring in traced(list(zip(*[iter(sides)] * 4, strict=True)))] for sides in batch.column(3).to_pylist()]
            kind = pa.list_(pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(corners, kind)], ["image", "crow", "ccol", "corners"])

    parts = saved(tile_parts(cells, tile))
    rank = F.struct("cells", (-F.col("crow")).alias("r"), (-F.col("ccol")).alias("c"))
    if parts.where("size(units) > 0").limit(1).count() == 0:  # no region reaches a line between tiles
        best = parts.withColumnsRenamed({"lrow": "crow", "lcol": "ccol"}).groupBy("image").agg(F.max_by(F.struct("crow", "ccol", "sides"), rank).alias("m")).select("image", "m.*")
    else:
        parts = saved(_joined(parts))
        sizes = parts.groupBy("image", "crow", "ccol").agg(F.sum("cells").alias("cells"))
        first = sizes.groupBy("image").agg(F.max(rank).alias("m")).select("image", (-F.col("m.r")).alias("crow"), (-F.col("m.c")).alias("ccol"))
        best = parts.join(first, ["image", "crow", "ccol"], "left_semi").groupBy("image", "crow", "ccol").agg(F.flatten(F.collect_list("sides")).alias("sides"))
    return best.select("image", "crow", "ccol", "sides").mapInArrow(trace, CORNERS)
