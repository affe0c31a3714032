"""Masking, alignment to a common grid, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.model import Rasters
from pixelloom.operators import grid


def target_resolution(scenes: DataFrame, resolution: str = "highest") -> tuple[float, float]:
    """(x, y): the finest, the coarsest or the mean resolution of all images, per axis."""
    f = {"highest": F.min, "lowest": F.max, "average": F.avg}.get(resolution)
    if f is None:
        raise ValueError("the resolution is highest, average or lowest")
    r = scenes.agg(f("res_x").alias("x"), f("res_y").alias("y")).first()
    return r["x"], r["y"]


def snapped(scenes: DataFrame, res_x: float, res_y: float) -> DataFrame:
    """The scenes on grids whose edges are multiples of the resolution: extents grow outward."""
    rx, ry = F.lit(float(res_x)), F.lit(float(res_y))
    left, top = F.floor(F.col("x0") / rx) * rx, F.ceil(F.col("y0") / ry) * ry
    right, bottom = F.ceil((F.col("x0") + F.col("width") * F.col("res_x")) / rx) * rx, F.floor((F.col("y0") - F.col("height") * F.col("res_y")) / ry) * ry
    return scenes.select("image", "ord", left.alias("x0"), top.alias("y0"), rx.alias("res_x"), ry.alias("res_y"), F.round((right - left) / rx).cast("int").alias("width"), F.round((top - bottom) / ry).cast("int").alias("height"), "dtype", "nodata", "crs")


def _cubic(t: Column) -> Column:
    """Cubic convolution with a = -0.5."""
    t = F.abs(t)
    return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(F.lit(0.0))


_KERNELS = {"nearest": (1, None), "bilinear": (2, lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))), "cubic": (4, _cubic)}


def resample(r: Rasters, target: DataFrame, method: str = "bilinear", weights: bool = False) -> Rasters:
    """The images on the target scenes' grids. Every source pixel is sent to the target cells that it has a weight in,
    bounded by the kernel and the ratio of resolutions; weights of valid pixels are normalised per band. With
    `weights` the pixels also have <band>_weight, the sum of those weights."""
    if method not in _KERNELS:
        raise ValueError("the method is nearest, bilinear or cubic")
    reach, kernel = _KERNELS[method]
    t = target.select("image", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "res_x", "res_y", "width", "height")))
    p = r.placed("x0", "y0", "res_x", "res_y").join(t, "image")
    half = reach / 2

    def axis(at: str, origin: str, res: str, sign: int, size: str) -> tuple[Column, Column]:
        """First and last target index whose centre lies within the kernel's reach of this source pixel's centre. The
        position of target centre k in source indices is ((k + .5) * t_res + shift) / res - .5."""
        shift = sign * (F.col(f"t_{origin}") - F.col(origin))
        low = ((F.col(at) + 0.5 - half) * F.col(res) - shift) / F.col(f"t_{res}") - 0.5
        high = ((F.col(at) + 0.5 + half) * F.col(res) - shift) / F.col(f"t_{res}") - 0.5
        return F.greatest(F.lit(0), F.ceil(low).cast("int")), F.least(F.col(f"t_{size}") - 1, F.floor(high).cast("int"))

    def index(k: str, origin: str, res: str, sign: int) -> Column:
        return ((F.col(k) + 0.5) * F.col(f"t_{res}") + sign * (F.col(f"t_{origin}") - F.col(origin))) / F.col(res) - 0.5

    r0, r1 = axis("prow", "y0", "res_y", -1, "height")
    c0, c1 = axis("pcol", "x0", "res_x", 1, "width")
    rows = p.withColumn("_r0", r0).withColumn("_r1", r1).withColumn("_c0", c0).withColumn("_c1", c1).where("_r0 <= _r1 and _c0 <= _c1")
    cells = rows.withColumn("trow", F.explode(F.sequence("_r0", "_r1"))).withColumn("tcol", F.explode(F.sequence("_c0", "_c1")))
    y, x = index("trow", "y0", "res_y", -1), index("tcol", "x0", "res_x", 1)
    if method == "nearest":
        own = (F.floor(y + 0.5) == F.col("prow")) & (F.floor(x + 0.5) == F.col("pcol"))
        return r.with_pixels(cells.where(own).select("image", F.col("trow").alias("prow"), F.col("tcol").alias("pcol"), *r.bands))
    weighted = cells.withColumn("_w", kernel(y - F.col("prow")) * kernel(x - F.col("pcol"))).where("_w <> 0")
    shares = [F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))).alias(f"{b}_weight") for b in r.bands] if weights else []
    sums = weighted.groupBy("image", F.col("trow").alias("prow"), F.col("tcol").alias("pcol")).agg(*shares, *(F.try_divide(F.sum(F.col(b) * F.col("_w")), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) for b in r.bands))
    return r.with_pixels(sums.where(F.coalesce(*r.bands).isNotNull()))


def align(r: Rasters, method: str = "bilinear", tap: bool = False, resolution: str = "highest") -> Rasters:
    """With `tap` all images are resampled to one resolution on edges that are its multiples; without, their grids stay."""
    grid.require(r.scenes, nodata=False)
    if not tap:
        return r
    target = snapped(r.scenes, *target_resolution(r.scenes, resolution))
    out = resample(r, target, method)
    return Rasters(out.pixels, target, r.bands)


def mosaic(r: Rasters) -> DataFrame:
    """prow, pcol and bands on the canvas of all images; the last image in order with a valid value wins, band by band.
    One aggregation with partial results by cell."""
    e = grid.extent(r.scenes)
    p = r.placed("ord", "x0", "y0").join(e.select("x_min", "y_max", F.col("res_x").alias("rx"), F.col("res_y").alias("ry")))
    row = F.col("prow") + F.bround((F.col("y_max") - F.col("y0")) / F.col("ry")).cast("int")
    col = F.col("pcol") + F.bround((F.col("x0") - F.col("x_min")) / F.col("rx")).cast("int")
    placed = p.select(row.alias("prow"), col.alias("pcol"), "ord", *r.bands)
    return placed.groupBy("prow", "pcol").agg(*(F.max_by(b, F.when(F.col(b).isNotNull(), F.col("ord"))).alias(b) for b in r.bands))
