"""Local block adjustment: every image is drawn towards the mean of all, block by block.

Block means are partial and final sums by (image, block); the reference is the mean of the images' means. A pixel is
corrected by the two block maps, interpolated between the four nearest blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.model import Rasters
from pixelloom.operators import boxes, grid


def _lit(x: float) -> Column:
    return F.lit(float(x))


class Canvas:
    """A rectangle cut into rows x cols blocks."""

    def __init__(self, rows: int, cols: int, x_min: float, y_min: float, x_max: float, y_max: float):
        self.rows, self.cols, self.x_min, self.y_min, self.x_max, self.y_max = rows, cols, x_min, y_min, x_max, y_max

    @classmethod
    def over(cls, scenes: DataFrame, number: int | tuple[int, int], rectangle: tuple[float, float, float, float] | None = None) -> Canvas:
        if rectangle is None:
            e = grid.extent(scenes).first()
            rectangle = e["x_min"], e["y_min"], e["x_max"], e["y_max"]
        x_min, y_min, x_max, y_max = rectangle
        return cls(*grid.block_grid(number, scenes.count(), x_max - x_min, y_max - y_min), x_min, y_min, x_max, y_max)

    def block(self) -> tuple[Column, Column]:
        """Block row and column of a pixel's centre (cx, cy)."""
        w, h = (self.x_max - self.x_min) / self.cols, (self.y_max - self.y_min) / self.rows
        at = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v).cast("int")))
        return at((_lit(self.y_max) - F.col("cy")) / _lit(h), self.rows), at((F.col("cx") - _lit(self.x_min)) / _lit(w), self.cols)


def variation_grid(r: Rasters) -> tuple[int, int]:
    """The grid of the coefficient of variation of the first band over all images."""
    s = r.pixels.agg(F.stddev_pop(r.bands[0]).alias("std"), F.avg(r.bands[0]).alias("mean")).first()
    if not s["mean"] or s["std"] is None:
        return 10, 10
    n = max(1, round(10 * (s["std"] / s["mean"]) / (45 / 125)))
    return n, n


def variation(r: Rasters) -> DataFrame:
    """The same as a query: cv (relative to 45/125) and the grid's rows and columns."""
    b = r.bands[0]
    s = r.pixels.agg((F.stddev_pop(b) / F.avg(b) / F.lit(45 / 125)).alias("cv"))
    n = F.greatest(F.lit(1), F.bround(F.col("cv") * F.lit(10.0)).cast("int"))
    return s.select("cv", n.alias("num_row"), n.alias("num_col"))


def means(r: Rasters, canvas: Canvas, threshold: float = 0.001) -> DataFrame:
    """image, band, brow, bcol, mean; blocks with too few valid pixels have none."""
    row, col = canvas.block()
    p = r.world().join(r.scenes.select("image", (F.col("res_x") * F.col("res_y")).alias("cell")), "image").withColumn("brow", row).withColumn("bcol", col)
    sums = p.groupBy("image", "brow", "bcol").agg(F.max("cell").alias("cell"), *(a for b in r.bands for a in (F.sum(b).alias(f"{b}_sum"), F.count(b).alias(f"{b}_n"))))
    block = (canvas.x_max - canvas.x_min) / canvas.cols * ((canvas.y_max - canvas.y_min) / canvas.rows)
    parts = ", ".join(f"'{b}', {b}_sum, {b}_n" for b in r.bands)
    return sums.select("image", "brow", "bcol", "cell", F.expr(f"stack({len(r.bands)}, {parts}) as (band, total, n)")).where((F.col("n") > 0) & (F.col("n") >= _lit(threshold * block) / F.col("cell"))).select("image", "band", "brow", "bcol", (F.col("total") / F.col("n")).alias("mean"))


def reference(local: DataFrame) -> DataFrame:
    """band, brow, bcol, mean: the unweighted mean over images."""
    return local.groupBy("band", "brow", "bcol").agg(F.avg("mean").alias("mean"))


def extents(local: DataFrame) -> DataFrame:
    """image, first and last (exclusive) block row and column with any band."""
    return local.groupBy("image").agg(F.min("brow").alias("row_min"), (F.max("brow") + 1).alias("row_max"), F.min("bcol").alias("col_min"), (F.max("bcol") + 1).alias("col_max"))


def _maps(local: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """image, brow, bcol, l_<band>, r_<band>: both maps of an image within its block rectangle, by equi-joins."""
    ref = reference(local)
    # each image's own rectangle, cell by cell: its size is that of the rectangle, whatever the canvas holds
    cells = extents(local).withColumn("brow", F.explode(F.sequence("row_min", F.col("row_max") - 1))).withColumn("bcol", F.explode(F.sequence("col_min", F.col("col_max") - 1)))
    pick = lambda name, b, c: F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{name}_{b}")
    wide_ref = ref.groupBy("brow", "bcol").agg(*(pick("r", b, "mean") for b in bands))
    wide_local = local.groupBy("image", "brow", "bcol").agg(*(pick("l", b, "mean") for b in bands))
    return cells.select("image", "brow", "bcol").join(wide_ref, ["brow", "bcol"]).join(wide_local, ["image", "brow", "bcol"], "left")


def interpolated(r: Rasters, local: DataFrame, canvas: Canvas) -> DataFrame:
    """Pixels with l_<band> and r_<band>, bilinear between block centres; blocks without a mean are left out of the
    weights. The position is that of the pixel's corner."""
    p = r.placed("x0", "y0", "res_x", "res_y")
    clip = lambda v, n: F.greatest(_lit(0), F.least(_lit(n - 1), v))
    y = clip((_lit(canvas.y_max) - (F.col("y0") - F.col("prow") * F.col("res_y"))) / _lit(canvas.y_max - canvas.y_min) * _lit(canvas.rows) - _lit(0.5), canvas.rows)
    x = clip((F.col("x0") + F.col("pcol") * F.col("res_x") - _lit(canvas.x_min)) / _lit(canvas.x_max - canvas.x_min) * _lit(canvas.cols) - _lit(0.5), canvas.cols)
    p = p.select("image", "prow", "pcol", *r.bands, y.alias("_y"), x.alias("_x")).withColumn("_r", F.floor("_y").cast("int")).withColumn("_c", F.floor("_x").cast("int"))
    maps = _maps(local, r.bands)
    # the four neighbours of every block position, once per map cell instead of once per pixel
    corner = F.inline(F.array(*(F.struct((F.col("brow") - F.lit(i)).alias("_r"), (F.col("bcol") - F.lit(j)).alias("_c"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    names = [f"{m}_{b}" for m in "lr" for b in r.bands]
    near = maps.select("image", *names, corner).groupBy("image", "_r", "_c").agg(*(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(n))).alias(f"{n}_{i}{j}") for n in names for i in (0, 1) for j in (0, 1)))
    fy, fx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    weight = {(i, j): (fy if i else _lit(1) - fy) * (fx if j else _lit(1) - fx) for i in (0, 1) for j in (0, 1)}

    def at(n: str) -> Column:
        cells = [(F.when(F.col(f"{n}_{i}{j}").isNotNull() & (w > 0), w).otherwise(_lit(0)), F.coalesce(F.col(f"{n}_{i}{j}"), _lit(0))) for (i, j), w in weight.items()]
        total, mass = sum((w * v for w, v in cells[1:]), cells[0][0] * cells[0][1]), sum((w for w, _ in cells[1:]), cells[0][0])
        return F.when(mass > 0, total / mass).alias(n)

    return p.join(near, ["image", "_r", "_c"], "left").select("image", "prow", "pcol", *r.bands, *map(at, names))


def adjust(r: Rasters, local: DataFrame, canvas: Canvas, method: str = "gamma", alpha: float = 1.0, window_size: int | tuple[int, int] | None = None) -> Rasters:
    """`linear`: value * reference / local. `gamma`: alpha * value ** (ln reference / ln local); where a tile and band has
    a value, local or reference of 0 or less, all three are lifted by one offset per tile, taken off again after. So the
    tile size is part of gamma's meaning."""
    p = interpolated(r, local, canvas)
    if method == "linear":
        return r.with_pixels(p.select("image", "prow", "pcol", *((F.col(b) * F.try_divide(F.col(f"r_{b}"), F.col(f"l_{b}"))).alias(b) for b in r.bands)))
    if method != "gamma":
        raise ValueError("the method is gamma or linear")
    tile_row, tile_col = grid.tile_ids(window_size)
    p = p.withColumn("_tr", tile_row).withColumn("_tc", tile_col)
    low = {b: F.least(F.col(b), F.when(F.col(b).isNotNull(), F.col(f"l_{b}")), F.when(F.col(b).isNotNull(), F.col(f"r_{b}"))) for b in r.bands}
    # the tiles' minima are partial sums joined back, so no tile is sorted or held as a window
    lows = p.groupBy("image", "_tr", "_tc").agg(*(F.min(c).alias(f"m_{b}") for b, c in low.items()))
    p = p.join(lows, ["image", "_tr", "_tc"])
    out = []
    for b in r.bands:
        lift = F.when(F.col(f"m_{b}") <= 0, F.abs(F.col(f"m_{b}")) + _lit(1)).otherwise(_lit(0))
        power = F.try_divide(F.ln(F.col(f"r_{b}") + lift), F.ln(F.col(f"l_{b}") + lift))
        out.append((_lit(alpha) * F.pow(F.col(b) + lift, power) - lift).alias(b))
    return r.with_pixels(p.select("image", "prow", "pcol", *out))


def match_loaded(loaded: DataFrame, images: list[str]) -> DataFrame:
    """Loaded block maps under the names of the images they are for: an image takes the last map whose name contains
    its own; maps of no image stay, as they count in the reference. loaded has image, band, brow, bcol, mean, pos."""
    maps = loaded.select("image", "pos").distinct()
    wanted = loaded.sparkSession.createDataFrame([(i,) for i in images], "own string")
    fit = maps.join(boxes.containing(maps, "image", wanted, "own"), "image").groupBy("own").agg(F.max_by("image", "pos").alias("image"))
    return loaded.join(fit, "image", "left").select(F.coalesce("own", "image").alias("image"), "band", "brow", "bcol", "mean")


def smoothed(local: DataFrame, sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """Gaussian mean of block means over the neighbours that have one."""
    steps = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    spread = F.inline(F.array(*(F.struct((F.col("brow") + i).alias("r"), (F.col("bcol") + j).alias("c"), F.lit(w).alias("w")) for i, j, w in steps)))
    sums = local.select("image", "band", "mean", spread).groupBy("image", "band", F.col("r").alias("brow"), F.col("c").alias("bcol")).agg((F.sum(F.col("mean") * F.col("w")) / F.sum("w")).alias("mean"))
    return sums.join(local.select("image", "band", "brow", "bcol"), ["image", "band", "brow", "bcol"])
