"""The engine's operations, one function each, over `Rasters`.

Nothing runs before a result is written or collected, except where a model has to be solved or a file is asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import expressions
from pixelloom.model import Rasters, nodata_to_null, resolve_dtype, resolve_nodata, scenes_of, wrap_cast
from pixelloom.operators import blocks, clouds, grid, regression, restructure, seamline, stats, vector
from pixelloom.plans import validate
from pixelloom.sources import geotiff, tables
from pixelloom.sources.paths import create as create_paths
from pixelloom.sources.paths import match as match_paths
from pixelloom.sources.paths import search as search_paths

__all__ = [
    "align_rasters", "band_math", "cloud_mask", "compare_band_average", "compare_profiles", "compare_profile_pairs", "create_paths", "global_regression", "local_block_adjustment", "mask_rasters",
    "match_paths", "merge_rasters", "merge_vectors", "ndvi", "read", "read_geotiff", "search_paths", "seamlines", "threshold_raster", "values_to_polygons", "write", "write_geotiff",
]


def _masked(r: Rasters, mask: tuple | None) -> Rasters:
    validate.vector_mask(mask)
    return r if mask is None else vector.mask(r, mask[1], mask[0], mask[2] if len(mask) > 2 else None)


def _valid(r: Rasters, custom_nodata: float | None) -> Rasters:
    """The rasters with a custom nodata value as NULL. What sources read has its own nodata as NULL already."""
    validate.nodata(custom_nodata)
    return r if custom_nodata is None else r.with_pixels(nodata_to_null(r.pixels, r.bands, float(custom_nodata)))


def global_regression(r: Rasters, *, vector_mask: tuple | None = None, custom_nodata: float | None = None, output_dtype: str | None = None, model_images: tuple | None = None, mean_factor: float = 1.0, std_factor: float = 1.0, save_adjustments: str | None = None, load_adjustments: str | None = None) -> Rasters:
    """Scales and offsets that make the images agree in their overlaps. Masks act on the statistics only; the model is a
    JSON text file on the driver."""
    validate.factors(mean_factor, std_factor)
    validate.model_images(model_images)
    validate.dtype(output_dtype)
    grid.require(r.scenes)
    spark, r = r.pixels.sparkSession, _valid(r, custom_nodata)
    model = None
    if load_adjustments:
        with open(load_adjustments) as f:
            model = tables.model_tables(spark, f.read())
    anchors = regression.Anchors(model_images[0], tuple(model_images[1])) if model_images else regression.Anchors()
    found, whole, between = regression.parameters(_masked(r, vector_mask), anchors, mean_factor, std_factor, model)
    if save_adjustments:
        with open(save_adjustments, "w") as f:
            f.write(tables.model_json(found, whole, between))
    return regression.apply(r, found, output_dtype)


def local_block_adjustment(r: Rasters, *, vector_mask: tuple | None = None, custom_nodata: float | None = None, window_size: int | tuple[int, int] | None = None, number_of_blocks: int | tuple[int, int] | str = 100, alpha: float = 1.0, correction_method: str = "gamma", save_block_maps: str | None = None, load_block_maps: list[str] | None = None, override_bounds: tuple | None = None, block_valid_pixel_threshold: float = 0.001, output_dtype: str | None = None) -> Rasters:
    """Draws every image towards the mean of all by blocks; values are doubles unless output_dtype names another type. save_block_maps is a folder for the images' block means and the
    canvas; load_block_maps are such folders."""
    validate.blocks(number_of_blocks, alpha, correction_method, block_valid_pixel_threshold, override_bounds)
    validate.window_size(window_size)
    validate.dtype(output_dtype)
    grid.require(r.scenes)
    spark, r = r.pixels.sparkSession, _valid(r, custom_nodata)
    loaded = None
    if load_block_maps:
        shapes = [tuple(spark.read.json(f"{p}/canvas").select("rows", "cols", "x_min", "y_min", "x_max", "y_max").first()) for p in load_block_maps]
        loaded = tables.read_blocks(spark, [f"{p}/means" for p in load_block_maps], shapes)
        if override_bounds and tuple(map(float, override_bounds)) != tuple(map(float, shapes[0][2:])):
            raise ValueError("override_bounds differs from the loaded block maps")
        canvas = blocks.Canvas(*shapes[0])
    else:
        number = blocks.variation_grid(r) if number_of_blocks == "coefficient_of_variation" else number_of_blocks
        canvas = blocks.Canvas.over(r.scenes, number, override_bounds)
    names = [x["image"] for x in r.scenes.orderBy("ord").select("image").collect()]
    if loaded is None:
        local = blocks.means(_masked(r, vector_mask), canvas, block_valid_pixel_threshold)
    else:
        local = blocks.match_loaded(loaded, names)
        known = local.select("image").distinct()
        fresh = replace(r, pixels=r.pixels.join(known, "image", "left_anti").select(*r.pixels.columns))
        local = local.unionByName(blocks.means(_masked(fresh, vector_mask), canvas, block_valid_pixel_threshold))
    if save_block_maps:
        tables.write_blocks(local, f"{save_block_maps}/means")
        row = {"rows": canvas.rows, "cols": canvas.cols, "x_min": float(canvas.x_min), "y_min": float(canvas.y_min), "x_max": float(canvas.x_max), "y_max": float(canvas.y_max)}
        spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(f"{save_block_maps}/canvas")
        local = spark.read.parquet(f"{save_block_maps}/means").select("image", "band", "brow", "bcol", "mean").withColumn("image", F.col("image").cast("string"))
    out = blocks.adjust(r, local, canvas, correction_method, alpha, window_size)
    return out.with_pixels(out.pixels.withColumns({b: wrap_cast(F.col(b), output_dtype) for b in r.bands})) if output_dtype else out


def ndvi(r: Rasters, nir_band: int, red_band: int) -> Rasters:
    return r.with_pixels(expressions.ndvi(r.pixels, f"b{nir_band}", f"b{red_band}").withColumnRenamed("ndvi", "b1"), ("b1",))


def band_math(r: Rasters, expression: str, custom_nodata: float | None = None) -> Rasters:
    r = _valid(r, custom_nodata)
    return r.with_pixels(expressions.band_math(r.pixels, expression, r.bands).withColumnRenamed("value", "b1"), ("b1",))


def threshold_raster(r: Rasters, expression: str, custom_nodata: float | None = None) -> Rasters:
    r = _valid(r, custom_nodata)
    return r.with_pixels(expressions.threshold(r.pixels, expression, r.bands).withColumnRenamed("value", "b1"), ("b1",))


def values_to_polygons(r: Rasters, expression: str, *, value_mapping: dict | None = None, filter_by_polygon_size: str | None = None, polygon_buffer: float = 0.0, dissolve: bool = True) -> DataFrame:
    """Features of an image's true pixels, after the size filter and the buffer: one per image, or one per region. The size
    is that of all an image's true pixels."""
    cells = vector.true_cells(r, expression, value_mapping)
    if filter_by_polygon_size:
        kept = vector.size_filter(vector.areas(r, cells), filter_by_polygon_size)
        cells = cells.join(kept.select("image"), "image", "left_semi")
    if polygon_buffer:
        cells = vector.buffered(r, cells, polygon_buffer)
    return vector.polygons(r, cells, dissolve=dissolve)


def cloud_mask(r: Rasters, red_band: int, green_band: int, nir_band: int, predictor: str | Callable, down_sample: float | None = None) -> DataFrame:
    return clouds.cloud_mask(r, f"b{red_band}", f"b{green_band}", f"b{nir_band}", predictor, down_sample)


def mask_rasters(r: Rasters, vector_mask: tuple | None = None, include_touched_pixels: bool = False) -> Rasters:
    validate.vector_mask(vector_mask)
    if vector_mask is None:
        return r
    return vector.mask(r, vector_mask[1], vector_mask[0], vector_mask[2] if len(vector_mask) > 2 else None, include_touched_pixels)


align_rasters = restructure.align
merge_vectors = vector.merge
seamlines = seamline.seamlines
compare_profiles = stats.profile
compare_profile_pairs = stats.profile_pairs
compare_band_average = stats.difference


def merge_rasters(r: Rasters, name: str = "merged") -> Rasters:
    """One image on the canvas of all; later images win."""
    grid.require(r.scenes)
    e = grid.extent(r.scenes).join(r.scenes.agg(F.min_by("crs", "ord").alias("crs"))).first()
    scene = scenes_of(r.pixels.sparkSession, [{"image": name, "x0": e["x_min"], "y0": e["y_max"], "res_x": e["res_x"], "res_y": e["res_y"], "width": e["width"], "height": e["height"], "nodata": resolve_nodata(r.scenes), "dtype": resolve_dtype(r.scenes) or "float64", "crs": e["crs"]}])
    return Rasters(restructure.mosaic(r).select(F.lit(name).alias("image"), "prow", "pcol", *r.bands), scene, r.bands)


def read(spark: SparkSession, path: str, nodata: float | None = None) -> Rasters:
    return tables.read(spark, path, nodata)


def write(r: Rasters, path: str, nodata: float | None = None, dtype: str | None = None, tile: int = 512) -> None:
    validate.dtype(dtype)
    tables.write(r, path, nodata, dtype, tile)


def read_geotiff(spark: SparkSession, path: str, nodata: float | None = None) -> Rasters:
    return geotiff.read(spark, path, nodata)


def write_geotiff(r: Rasters, folder: str, dtype: str | None = None, nodata: float | None = None, tile: int = 256) -> list[str]:
    """One tiled file per image; its type and nodata are those of the first image unless given."""
    validate.dtype(dtype)
    validate.window_size(tile, cog=True)
    return geotiff.write(r, folder, resolve_dtype(r.scenes, dtype) or "float32", resolve_nodata(r.scenes, nodata), tile)
