"""Polygons: as masks of pixels, and made from pixels.

`features(layer, feature_id, props MAP, rings ARRAY<ARRAY<STRUCT<x, y>>>)`; rings of a feature count together by the
even-odd rule, so a hole is a ring inside another.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.expressions import bands_of, to_column
from pixelloom.model import Rasters
from pixelloom.operators import boxes, grid, spans
from pixelloom.operators.clipping import shared
from pixelloom.operators.components import by_groups, components, saved, tile_components
from pixelloom.operators.overlay import traced
from pixelloom.operators.rowwise import mapped

FEATURES = "layer string, feature_id long, props map<string,string>, rings array<array<struct<x:double,y:double>>>"


def feature_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows: layer, feature_id, props, rings of (x, y) pairs."""
    return spark.createDataFrame([(layer, i, props, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for layer, i, props, rings in rows], FEATURES)


def box(left: float, bottom: float, right: float, top: float) -> list[list[tuple[float, float]]]:
    return [[(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]]


def edges(features: DataFrame) -> DataFrame:
    """layer, feature_id, ring, x1, y1, x2, y2."""
    rings = features.select("layer", "feature_id", F.posexplode("rings").alias("ring", "points"))
    return rings.select("layer", "feature_id", "ring", F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("e")).select(
        "layer", "feature_id", "ring", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")
    )


def matching(features: DataFrame, scenes: DataFrame, field: str) -> DataFrame:
    """image with each value of the field that contains its name."""
    values = features.select(F.element_at("props", field).alias("value"))
    return boxes.containing(values, "value", scenes.select("image"), "image")


def _near(features: DataFrame, scenes: DataFrame, field: str | None) -> DataFrame:
    """image, its scene and feature (layer, feature_id, rings) of the features whose boxes meet the image's, of those that the field gives it."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    own = features.select("layer", "feature_id", "rings", *([F.element_at("props", field).alias("value")] if field else []), F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))
    # the boxes alone are dealt to cells; rings follow those that meet
    boxed = own.drop("rings").where("left IS NOT NULL")
    near = boxes.meeting(boxed, grid.bounds(scenes).drop("ord"), touch=True).drop("x_min", "x_max", "y_min", "y_max").distinct()
    if field:
        near = near.join(matching(features, scenes, field), ["image", "value"]).drop("value")
    return near.join(features.select("layer", "feature_id", "rings"), ["layer", "feature_id"])


def inside(r: Rasters, features: DataFrame, field: str | None = None, touched: bool = False) -> DataFrame:
    """image, prow, pcol of the pixels whose centre is in a feature; with `touched` also those that an edge crosses.

    Each edge is cut by the scan lines of the image: per (image, row, feature) the sorted crossings, in pairs, are stretches of
    columns inside the feature. Stretches of all features become bits, so a pixel looks at one row of bits, however many
    features there are on its row."""
    mine = _near(features, r.scenes, field)
    e = edges(mine.select(F.col("image").alias("layer"), F.xxhash64("layer", "feature_id").alias("feature_id"), "rings")).withColumnRenamed("layer", "image")
    g = e.join(r.scenes.select("image", "x0", "y0", "res_x", "res_y", "width", "height"), "image")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows whose centre yc has low <= yc < high
    first = F.greatest(F.lit(0), F.ceil((F.col("y0") - high) / F.col("res_y") - F.lit(0.5)).cast("int"))
    last = F.least(F.col("height") - 1, F.floor((F.col("y0") - low) / F.col("res_y") - F.lit(0.5)).cast("int"))
    lines = g.withColumn("first", first).withColumn("last", last).where("first <= last and y1 <> y2").withColumn("prow", F.explode(F.sequence("first", "last")))
    yc = F.col("y0") - (F.col("prow") + F.lit(0.5)) * F.col("res_y")
    crossing = lines.withColumn("yc", yc).where((F.col("yc") >= low) & (F.col("yc") < high)).withColumn("x", F.col("x1") + (F.col("yc") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    # the columns whose centres are at or right of a crossing begin here
    crossing = crossing.withColumn("col", F.greatest(F.lit(0), F.least(F.col("width"), F.ceil((F.col("x") - F.col("x0")) / F.col("res_x") - F.lit(0.5)).cast("int"))))
    cuts = crossing.groupBy("image", "prow", "feature_id").agg(F.sort_array(F.collect_list("col")).alias("cols"))  # as many as a feature's edges on the row
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("cols") / 2).cast("int") - 1), lambda i: F.struct(F.get("cols", 2 * i).alias("first"), (F.get("cols", 2 * i + 1) - 1).alias("last")))
    found = spans.words(cuts.where("size(cols) > 1").select("image", "prow", F.inline(pairs)))
    p = r.pixels.select("image", "prow", "pcol")
    hit = spans.within(p, found)
    return hit if not touched else hit.union(crossed(g).join(p, ["image", "prow", "pcol"], "left_semi").select("image", "prow", "pcol")).distinct()


def crossed(g: DataFrame) -> DataFrame:
    """image, prow, pcol of the cells that an edge runs through: per row the part of the edge within it."""
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")
    rows = g.withColumn("_first", F.greatest(F.lit(0), F.floor((F.col("y0") - top) / F.col("res_y")).cast("int"))).withColumn("_last", F.least(F.col("height") - 1, F.floor((F.col("y0") - bottom) / F.col("res_y")).cast("int"))).where("_first <= _last")
    rows = rows.withColumn("prow", F.explode(F.sequence("_first", "_last")))
    up, down = F.least(top, F.col("y0") - F.col("prow") * F.col("res_y")), F.greatest(bottom, F.col("y0") - (F.col("prow") + 1) * F.col("res_y"))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1")))
    other = F.when(F.col("y1") == F.col("y2"), F.col("x2")).otherwise(at(down))
    col = lambda x: F.floor((x - F.col("x0")) / F.col("res_x")).cast("int")
    cells = rows.withColumn("_a", F.greatest(F.lit(0), col(F.least(at(up), other)))).withColumn("_b", F.least(F.col("width") - 1, col(F.greatest(at(up), other)))).where("_a <= _b")
    return cells.select("image", "prow", F.explode(F.sequence("_a", "_b")).alias("pcol")).distinct()


def mask(r: Rasters, features: DataFrame, mode: str = "include", field: str | None = None, touched: bool = False) -> Rasters:
    """`include` keeps the pixels inside, `exclude` those outside. An image that no feature matches is not masked at all, so a
    layer without features masks nothing."""
    if mode not in ("include", "exclude"):
        raise ValueError("the mode is include or exclude")
    if features.isEmpty():
        return r
    within = inside(r, features, field, touched)
    if mode == "exclude":
        return r.with_pixels(r.pixels.join(within, ["image", "prow", "pcol"], "left_anti").select("image", "prow", "pcol", *r.bands))
    kept = r.pixels.join(within, ["image", "prow", "pcol"], "left_semi").select("image", "prow", "pcol", *r.bands)
    if field is None:
        return r.with_pixels(kept)
    matched = matching(features, r.scenes, field).select("image").distinct()
    return r.with_pixels(kept.union(r.pixels.join(matched, "image", "left_anti").select("image", "prow", "pcol", *r.bands)))


def remapped(value: Column, mapping: dict[float, float | None]) -> Column:
    """Replaces values one entry after the other, so entries can chain; None makes nodata."""
    for old, new in mapping.items():
        value = F.when(value == F.lit(float(old)), F.lit(None if new is None else float(new)).cast("double")).otherwise(value)
    return value


def true_cells(r: Rasters, expression: str, mapping: dict[float, float | None] | None = None) -> DataFrame:
    """image, prow, pcol of the pixels where the expression holds; every band is looked up by its own number."""
    p = r.pixels
    if mapping:
        p = p.withColumns({b: remapped(F.col(b).cast("double"), mapping) for b in bands_of(expression) if b in r.bands})
    return p.where(F.coalesce(to_column(expression, r.bands), F.lit(False))).select("image", "prow", "pcol")


def areas(r: Rasters, cells: DataFrame) -> DataFrame:
    """image, cells, area of what its true pixels dissolve into."""
    return cells.groupBy("image").agg(F.count("*").alias("cells")).join(r.scenes.select("image", (F.col("res_x") * F.col("res_y")).alias("cell")), "image").select("image", "cells", (F.col("cells") * F.col("cell")).alias("area"))


_FILTER = re.compile(r"\s*([<>]=?|==|!=)\s*(\d+(?:\.\d+)?)(%?)\s*")


def size_filter(sized: DataFrame, rule: str, column: str = "area") -> DataFrame:
    """`>4`, `<=10.5`, `>50%`: by area, or by a percentile of all areas."""
    m = _FILTER.fullmatch(rule)
    if not m:
        raise ValueError(f"not a size filter: {rule}")
    if m[3]:
        limit = sized.agg(F.percentile(column, float(m[2]) / 100).alias("_limit"))
        sized = sized.join(limit)
        right = F.col("_limit")
    else:
        right = F.lit(float(m[2]))
    left = F.col(column)
    keep = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[m[1]]
    return sized.where(keep).drop("_limit")


def outline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The unit edges that only one cell of a group has: keys, r1, c1, r2, c2 in corners of the grid."""
    r, c = F.col("prow"), F.col("pcol")
    sides = [(r, c, r, c + 1), (r + 1, c, r + 1, c + 1), (r, c, r + 1, c), (r, c + 1, r + 1, c + 1)]
    unit = cells.select(*keys, F.inline(F.array(*(F.struct(a.alias("r1"), b.alias("c1"), d.alias("r2"), e.alias("c2")) for a, b, d, e in sides))))
    return unit.groupBy(*keys, "r1", "c1", "r2", "c2").count().where("count = 1").drop("count")


def connected(cells: DataFrame, tile: int = 256) -> DataFrame:
    """image, prow, pcol, component: regions of cells that share sides, named by their smallest cell. Tiles are labelled
    alone (they bound what a task holds); labels that meet at tile borders are joined as a small graph."""
    local = saved(tile_components(cells, tile))  # read four times
    local = local.withColumn("node", F.struct("image", "lrow", "lcol"))
    right = local.select("image", "prow", (F.col("pcol") + 1).alias("pcol"), F.col("node").alias("b"))
    below = local.select("image", (F.col("prow") + 1).alias("prow"), "pcol", F.col("node").alias("b"))
    border = local.where((F.col("pcol") % tile == 0) | (F.col("prow") % tile == 0)).select("image", "prow", "pcol", F.col("node").alias("a"))
    links = border.join(right, ["image", "prow", "pcol"]).select("a", "b").union(border.join(below, ["image", "prow", "pcol"]).select("a", "b")).where("a <> b").distinct()
    found = components(links)
    named = local.join(found, "node", "left").withColumn("top", F.coalesce("component", "node"))
    return named.select("image", "prow", "pcol", F.col("top.lrow").alias("crow"), F.col("top.lcol").alias("ccol"))


def outlines(regions: DataFrame) -> DataFrame:
    """image, crow, ccol, corners (rings of r, c) of regions as from `connected`. A task holds the outline of a region, not its cells."""
    q, p = F.col("prow"), F.col("pcol")
    sides = [(q, p, q, p + 1), (q, p + 1, q + 1, p + 1), (q + 1, p + 1, q + 1, p), (q + 1, p, q, p)]
    unit = regions.select("image", "crow", "ccol", F.inline(F.array(*(F.struct(a.alias("r1"), b.alias("c1"), c.alias("r2"), d.alias("c2")) for a, b, c, d in sides))))
    key = [F.least("r1", "r2").alias("_r"), F.least("c1", "c2").alias("_c"), (F.col("r1") == F.col("r2")).alias("_h")]
    edge = unit.groupBy("image", "crow", "ccol", *key).agg(F.count("*").alias("n"), *(F.min(x).alias(x) for x in ("r1", "c1", "r2", "c2"))).where("n = 1")

    def trace(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        first, sides = rows.iloc[bounds[:-1]], list(zip(rows.r1.tolist(), rows.c1.tolist(), rows.r2.tolist(), rows.c2.tolist(), strict=True))
        corners = [[[{"r": a, "c": b} for a, b in ring] for ring in traced(sides[i:j])] for i, j in zip(bounds, bounds[1:], strict=False)]
        return pd.DataFrame({"image": first.image.to_numpy(), "crow": first.crow.to_numpy(), "ccol": first.ccol.to_numpy(), "corners": corners})

    return by_groups(edge, ["image", "crow", "ccol"], trace, "image string, crow int, ccol int, corners array<array<struct<r:int,c:int>>>")


def placed(outlined: DataFrame, scenes: DataFrame) -> DataFrame:
    """image, ord, crow, ccol and the corners as rings of x, y."""
    where = outlined.join(scenes.select("image", "ord", "x0", "y0", "res_x", "res_y"), "image")
    world = F.transform("corners", lambda ring: F.transform(ring, lambda v: F.struct((F.col("x0") + v["c"] * F.col("res_x")).alias("x"), (F.col("y0") - v["r"] * F.col("res_y")).alias("y"))))
    return where.select("image", "ord", "crow", "ccol", world.alias("rings"))


def polygons(r: Rasters, cells: DataFrame, layer: str = "mask", dissolve: bool = True, tile: int = 256) -> DataFrame:
    """True cells as features: one per image, or one per connected region."""
    rows = placed(outlines(connected(cells, tile)), r.scenes)
    props = F.create_map(F.lit("image"), F.col("image"), F.lit("value"), F.lit("1"))
    if dissolve:
        rows = rows.groupBy("image", "ord").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("crow", "ccol", "rings"))), lambda x: x["rings"])).alias("rings"))
        return rows.select(F.lit(layer).alias("layer"), F.col("ord").cast("long").alias("feature_id"), props.alias("props"), "rings")
    number = F.xxhash64("image", "crow", "ccol")
    return rows.select(F.lit(layer).alias("layer"), number.alias("feature_id"), props.alias("props"), "rings")


def buffered(r: Rasters, cells: DataFrame, distance: float) -> DataFrame:
    """image, prow, pcol of the pixels whose cell is within the distance of a true cell's centre line: exact discs around cells. A cell gives
    one stretch a row that its disc reaches; stretches are united as bits."""
    res = r.scenes.agg(F.min("res_x").alias("x"), F.min("res_y").alias("y")).first()
    nr = int(distance // res["y"]) + 1
    reach = []
    for i in range(nr + 1):
        rest = distance**2 - (max(i - 0.5, 0) * res["y"]) ** 2
        if rest < 0:
            break
        j = int(math.sqrt(rest) / res["x"] + 0.5) + 1
        while j and (max(i - 0.5, 0) * res["y"]) ** 2 + (max(j - 0.5, 0) * res["x"]) ** 2 > distance**2:
            j -= 1
        reach.append(j)
    wide = F.array(*map(F.lit, reach))
    rows = cells.select("image", "prow", "pcol", F.explode(F.sequence(F.lit(1 - len(reach)), F.lit(len(reach) - 1))).alias("_up"))
    rows = rows.select("image", (F.col("prow") + F.col("_up")).alias("prow"), "pcol", F.get(wide, F.abs("_up")).alias("_w")).join(r.scenes.select("image", "width", "height"), "image").where("prow >= 0 and prow < height")
    found = spans.words(rows.select("image", "prow", F.greatest(F.lit(0), F.col("pcol") - F.col("_w")).alias("first"), F.least(F.col("width") - 1, F.col("pcol") + F.col("_w")).alias("last")))
    return spans.cells(found)


def merge_keep(layers: dict[str, DataFrame], name_attribute: str | None = None) -> DataFrame:
    """All features, each with its source's name where a name attribute is asked for."""
    out = None
    for name, df in layers.items():
        if name_attribute:
            df = df.withColumn("props", F.map_concat("props", F.create_map(F.lit(name_attribute), F.lit(name))))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merge_union(layers: dict[str, DataFrame], name_attribute: str | None = None, separator: str = ", ") -> DataFrame:
    """All features, named by all sources; geometries stay as they are."""
    out = merge_keep(layers)
    if name_attribute:
        out = out.withColumn("props", F.map_concat("props", F.create_map(F.lit(name_attribute), F.lit(separator.join(layers)))))
    return out


def _boxed(layer: DataFrame, name: str) -> DataFrame:
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    return layer.select(F.col("feature_id").alias(name), F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top")).where("left IS NOT NULL")


def merge_intersection(layers: dict[str, DataFrame]) -> DataFrame:
    """The parts that features of all layers share, by successive overlays; properties that an earlier layer has win. Pairs come from an
    equi-join of the boxes' grid cells; each pair is clipped in a task by a sweep. A part that splits and joins comes in
    several features, none of which overlap."""
    names = list(layers)
    rows = layers[names[0]].select(F.xxhash64("layer", "feature_id").alias("feature_id"), "props", "rings")
    for name in names[1:]:
        other = layers[name].select(F.xxhash64("layer", "feature_id").alias("feature_id"), "props", "rings")
        pairs = boxes.meeting(_boxed(rows, "one"), _boxed(other, "two")).select("one", "two").distinct()
        as_side = lambda df, key, x: df.select(F.col("feature_id").alias(key), F.coalesce("props", F.create_map().cast("map<string,string>")).alias(f"props_{x}"), F.col("rings").alias(f"rings_{x}"))
        both = pairs.join(as_side(rows, "one", "a"), "one").join(as_side(other, "two", "b"), "two")
        mixed = F.map_concat(F.map_filter("props_b", lambda k, _: ~F.map_contains_key("props_a", k)), "props_a")
        rows = mapped(both.select("one", "two", mixed.alias("props"), "rings_a", "rings_b"), _clipped, "feature_id long, props map<string,string>, rings array<array<struct<x:double,y:double>>>")
        rows = saved(rows)
    return rows.select(F.lit("intersection").alias("layer"), "feature_id", "props", "rings")


def _clipped(row: dict) -> list[dict]:
    plain = lambda rings: [[(p["x"], p["y"]) for p in ring] for ring in rings]
    out = []
    for k, ring in enumerate(shared(plain(row["rings_a"]), plain(row["rings_b"]))):
        number = int.from_bytes(hashlib.blake2b(f"{row['one']}/{row['two']}/{k}".encode(), digest_size=8).digest(), "little", signed=True)
        out.append({"feature_id": number, "props": row["props"], "rings": [[{"x": x, "y": y} for x, y in ring]]})
    return out


def merge(layers: dict[str, DataFrame], method: str, name_attribute: str | None = None, separator: str = ", ") -> DataFrame:
    if method == "keep":
        return merge_keep(layers, name_attribute)
    if method == "union":
        return merge_union(layers, name_attribute, separator)
    if method == "intersection":
        return merge_intersection(layers)
    raise ValueError("the method is keep, union or intersection")
