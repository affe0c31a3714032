"""Tiles, overlaps and extents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import boxes


def windows(width: int, height: int, tile_width: int, tile_height: int) -> list[tuple[int, int, int, int]]:
    """(column, row, width, height) of the tiles, row by row; those at the edges are clipped."""
    return [(x, y, min(tile_width, width - x), min(tile_height, height - y)) for y in range(0, height, tile_height) for x in range(0, width, tile_width)]


def tile_shape(window_size: int | tuple[int, int] | None, width: int, height: int) -> tuple[int, int]:
    """(width, height) of a tile: the whole image for None, a square for an int; a pair is (width, height)."""
    if window_size is None:
        return width, height
    return (window_size, window_size) if isinstance(window_size, int) else tuple(window_size)


def tile_ids(window_size: int | tuple[int, int] | None) -> tuple[Column, Column]:
    """tile_row, tile_col of a pixel. They carry meaning where a method works by tile, so they are columns, not partitions."""
    if window_size is None:
        return F.lit(0), F.lit(0)
    w, h = tile_shape(window_size, 0, 0)
    return F.floor(F.col("prow") / F.lit(h)).cast("int"), F.floor(F.col("pcol") / F.lit(w)).cast("int")


def tile_table(scenes: DataFrame, window_size: int | tuple[int, int] | None) -> DataFrame:
    """image, tile_row, tile_col, row_off, col_off, rows, cols of all tiles."""
    w, h = (F.col("width"), F.col("height")) if window_size is None else map(F.lit, tile_shape(window_size, 0, 0))
    rows = scenes.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / h).cast("int") - 1)))
    both = rows.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / w).cast("int") - 1)))
    row_off, col_off = (F.col("tile_row") * h).cast("int"), (F.col("tile_col") * w).cast("int")
    return both.select("image", "tile_row", "tile_col", row_off.alias("row_off"), col_off.alias("col_off"), F.least(h, F.col("height") - row_off).cast("int").alias("rows"), F.least(w, F.col("width") - col_off).cast("int").alias("cols"))


def bounds(scenes: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """image, ord, left, bottom, right, top, and `more` columns."""
    return scenes.select("image", "ord", *more, F.col("x0").alias("left"), (F.col("y0") - F.col("height") * F.col("res_y")).alias("bottom"), (F.col("x0") + F.col("width") * F.col("res_x")).alias("right"), F.col("y0").alias("top"))


def overlaps(scenes: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """image_i, image_j (by name, i < j), the rectangle they share, and `more` of the columns of image i; touching edges do not count. An
    equi-join of grid cells."""
    one, other = bounds(scenes, more).drop("ord"), bounds(scenes).drop("ord")
    return boxes.meeting(one.withColumnRenamed("image", "image_i"), other.withColumnRenamed("image", "image_j")).where("image_i < image_j")


def overlap_windows(scenes: DataFrame) -> DataFrame:
    """The rows and columns of image i that the shared rectangle covers, ends exclusive."""
    col = lambda x: F.floor((x - F.col("x0")) / F.col("res_x")).cast("int")
    row = lambda y: F.floor((F.col("y0") - y) / F.col("res_y")).cast("int")
    found = overlaps(scenes, ("x0", "y0", "res_x", "res_y"))
    return found.select("image_i", "image_j", row(F.col("y_max")).alias("row_min"), row(F.col("y_min")).alias("row_max"), col(F.col("x_min")).alias("col_min"), col(F.col("x_max")).alias("col_max"))


def extent(scenes: DataFrame) -> DataFrame:
    """The rectangle that holds all images, the finest resolution and the size of a canvas of it."""
    e = bounds(scenes).agg(F.min("left").alias("x_min"), F.min("bottom").alias("y_min"), F.max("right").alias("x_max"), F.max("top").alias("y_max"))
    r = scenes.agg(F.min("res_x").alias("res_x"), F.min("res_y").alias("res_y"))
    return e.join(r).select("*", F.ceil((F.col("x_max") - F.col("x_min")) / F.col("res_x")).cast("int").alias("width"), F.ceil((F.col("y_max") - F.col("y_min")) / F.col("res_y")).cast("int").alias("height"))


def compatibility(scenes: DataFrame) -> DataFrame:
    """How many different coordinate systems, band types, nodata values and resolutions there are."""
    return scenes.agg(
        F.count("*").cast("int").alias("images"), F.count_distinct(F.coalesce("crs", F.lit(""))).cast("int").alias("crs"), F.count_distinct(F.coalesce("dtype", F.lit(""))).cast("int").alias("dtypes"),
        F.count_distinct(F.coalesce(F.col("nodata").cast("string"), F.lit("none"))).cast("int").alias("nodatas"), F.count_distinct("res_x", "res_y").cast("int").alias("resolutions"),
    )


def require(scenes: DataFrame, crs: bool = True, nodata: bool = True, resolution: bool = False) -> None:
    """Raises ValueError where images do not fit each other."""
    found = compatibility(scenes).first()
    for wanted, name, what in ((crs, "crs", "coordinate systems"), (nodata, "nodatas", "nodata values"), (resolution, "resolutions", "resolutions")):
        if wanted and found[name] > 1:
            raise ValueError(f"the images have {found[name]} different {what}")


def block_grid(number: int | tuple[int, int], n_images: int, width: float, height: float) -> tuple[int, int]:
    """(rows, columns) of the block grid. A pair is taken as it is. A target per image gives a total; the shorter axis
    follows from the canvas's shape, the longer one takes what the total allows."""
    if not isinstance(number, (int, float)):
        return tuple(number)
    total = number * n_images
    cols = max(1, round(math.sqrt(total * (width / height))))
    rows = max(1, round(total / cols))
    if width > height:
        return rows, max(1, int(total // rows))
    return max(1, int(total // cols)), cols
