"""Data model: pixels, scenes, nodata and dtypes.

A raster is a row set `pixels(image, prow, pcol, b1 ... bN)`; NULL is nodata, an absent row is a pixel without any valid
band. `scenes(image, ord, x0, y0, res_x, res_y, width, height, dtype, nodata, crs)` is the small catalogue of the
images: (x0, y0) is the upper left corner, rows go down, so pixel (r, c) covers x0 + c * res_x and y0 - r * res_y on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCENE_SCHEMA = T.StructType([
    T.StructField("image", T.StringType(), False), T.StructField("ord", T.IntegerType(), False),
    T.StructField("x0", T.DoubleType(), False), T.StructField("y0", T.DoubleType(), False),
    T.StructField("res_x", T.DoubleType(), False), T.StructField("res_y", T.DoubleType(), False),
    T.StructField("width", T.IntegerType(), False), T.StructField("height", T.IntegerType(), False),
    T.StructField("dtype", T.StringType()), T.StructField("nodata", T.DoubleType()), T.StructField("crs", T.StringType()),
])

#: Array type -> (Spark type that holds it, bits, signed); Spark has no unsigned types.
DTYPES = {
    "uint8": ("smallint", 8, False), "int8": ("tinyint", 8, True), "uint16": ("int", 16, False), "int16": ("smallint", 16, True),
    "uint32": ("bigint", 32, False), "int32": ("int", 32, True), "int64": ("bigint", 64, True), "float32": ("float", 0, True), "float64": ("double", 0, True),
}


def wrap_cast(value: Column, dtype: str) -> Column:
    """Truncates toward zero and wraps on overflow, as an array cast does; an SQL cast raises there."""
    kind, bits, signed = DTYPES[dtype]
    if not bits:
        return value.cast(kind)
    whole = value.cast("bigint")
    if bits == 64:
        return whole
    span = F.lit(2**bits).cast("bigint")
    wrapped = F.pmod(whole, span)
    if signed:
        wrapped = F.when(wrapped >= F.lit(2 ** (bits - 1)), wrapped - span).otherwise(wrapped)
    return wrapped.cast(kind)


@dataclass(frozen=True)
class Rasters:
    """Some images: their pixels, their catalogue, the names of their bands."""

    pixels: DataFrame
    scenes: DataFrame
    bands: tuple[str, ...]

    def with_pixels(self, pixels: DataFrame, bands: tuple[str, ...] | None = None) -> Rasters:
        return replace(self, pixels=pixels, bands=bands or self.bands)

    def placed(self, *columns: str) -> DataFrame:
        """Pixels with columns of their scene. The catalogue has a row per image, so Spark sees that it is small and
        broadcasts it by its own size check."""
        keep = self.scenes.select("image", *columns)
        return self.pixels.join(keep, "image")

    def world(self) -> DataFrame:
        """Pixels with the integer key of their cell on the common grid (gx, gy: left and lower edge in pixels) and the
        coordinates of their centre."""
        p = self.placed("x0", "y0", "res_x", "res_y", "ord")
        return p.select(
            "image", "ord", "prow", "pcol", *self.bands,
            F.floor(F.col("x0") / F.col("res_x") + F.col("pcol") + F.lit(0.5)).cast("int").alias("gx"), F.floor(F.col("y0") / F.col("res_y") - F.col("prow") - F.lit(0.5)).cast("int").alias("gy"),
            (F.col("x0") + (F.col("pcol") + F.lit(0.5)) * F.col("res_x")).alias("cx"), (F.col("y0") - (F.col("prow") + F.lit(0.5)) * F.col("res_y")).alias("cy"),
        )

    def long(self) -> DataFrame:
        """image, prow, pcol, band, value: a row per valid band."""
        pairs = ", ".join(f"'{b}', cast({b} as double)" for b in self.bands)
        return self.pixels.select("image", "prow", "pcol", F.expr(f"stack({len(self.bands)}, {pairs}) as (band, value)")).where("value is not null")


def scenes_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    defaults = {"res_x": 1.0, "res_y": 1.0, "dtype": "float64", "nodata": None, "crs": "EPSG:3857"}
    full = [{**defaults, "ord": i, **r} for i, r in enumerate(rows)]
    kinds = {f.name: (float, pa.float64()) if isinstance(f.dataType, T.DoubleType) else (int, pa.int32()) if isinstance(f.dataType, T.IntegerType) else (str, pa.string()) for f in SCENE_SCHEMA}
    columns = {k: pa.array([None if r[k] is None else cast(r[k]) for r in full], kind) for k, (cast, kind) in kinds.items()}
    # as a local relation the planner knows the catalogue's size, and does not shuffle pixels to meet it
    return spark.createDataFrame(pa.table(columns), SCENE_SCHEMA)


def nodata_to_null(pixels: DataFrame, bands: tuple[str, ...], nodata: float | None) -> DataFrame:
    """At a source: the sentinel becomes NULL; rows without a valid band go. Without a sentinel every value is valid."""
    if nodata is None:
        return pixels
    out = pixels.withColumns({b: F.when(F.col(b) != F.lit(nodata), F.col(b)) for b in bands})
    return out.where(F.coalesce(*bands).isNotNull())


def null_to_nodata(pixels: DataFrame, bands: tuple[str, ...], nodata: float | None, dtype: str | None = None) -> DataFrame:
    """At a sink: NULL becomes the sentinel, values take the dtype."""
    filled = {b: F.coalesce(F.col(b), F.lit(nodata)) if nodata is not None else F.col(b) for b in bands}
    return pixels.withColumns({b: wrap_cast(c, dtype) if dtype else c for b, c in filled.items()})


def dense(r: Rasters) -> DataFrame:
    """All cells of all scenes, absent pixels as NULLs."""
    grid = r.scenes.select("image", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("prow"), "width").select("image", "prow", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pcol"))
    return grid.join(r.pixels, ["image", "prow", "pcol"], "left")


def resolve_nodata(scenes: DataFrame, custom: float | None = None) -> float | None:
    """A custom value wins, else the first image's, else none."""
    if custom is not None:
        return custom
    first = scenes.orderBy("ord").select("nodata").first()
    return first["nodata"] if first else None


def resolve_dtype(scenes: DataFrame, custom: str | None = None) -> str | None:
    if custom is not None:
        return custom
    first = scenes.orderBy("ord").select("dtype").first()
    return first["dtype"] if first else None
