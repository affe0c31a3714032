"""Statistics of images and of their overlaps. All bands of a pixel row are aggregated in one pass with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.model import Rasters
from pixelloom.operators import grid
from pixelloom.operators.restructure import resample


def _by_band(wide: DataFrame, keys: list[str], bands: tuple[str, ...], names: list[str]) -> DataFrame:
    """Turns columns <band>_<name> into rows."""
    parts = ", ".join(f"'{b}', " + ", ".join(f"{b}_{n}" for n in names) for b in bands)
    return wide.select(*keys, F.expr(f"stack({len(bands)}, {parts}) as (band, {', '.join(names)})"))


def whole(r: Rasters) -> DataFrame:
    """image, band, mean, std (of a sample), size of the valid pixels; zeros where there are none."""
    aggs = [a for b in r.bands for a in (F.avg(b).alias(f"{b}_mean"), F.stddev_samp(b).alias(f"{b}_std"), F.count(b).alias(f"{b}_size"))]
    found = _by_band(r.pixels.groupBy("image").agg(*aggs), ["image"], r.bands, ["mean", "std", "size"])
    every = r.scenes.select("image", F.explode(F.array(*map(F.lit, r.bands))).alias("band"))
    out = every.join(found, ["image", "band"], "left")
    return out.select("image", "band", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def _same_grid(r: Rasters, pairs: DataFrame) -> DataFrame:
    """image_i, image_j and both sides' bands for every cell of the common grid that two images have. An equi-join on the
    cell, not a range join: one exchange of the pixels serves both sides."""
    # cells outside every shared rectangle never reach the exchange
    rectangles = pairs.select(F.explode(F.array("image_i", "image_j")).alias("image"), "x_min", "x_max", "y_min", "y_max").groupBy("image").agg(F.collect_list(F.struct("x_min", "x_max", "y_min", "y_max")).alias("shared"))
    inside = F.exists("shared", lambda s: F.col("cx").between(s["x_min"], s["x_max"]) & F.col("cy").between(s["y_min"], s["y_max"]))
    near = r.world().join(rectangles, "image").where(inside).select("image", "gx", "gy", *r.bands)
    a = near.select(F.col("image").alias("image_i"), "gx", "gy", *(F.col(b).alias(f"i_{b}") for b in r.bands))
    b = near.select(F.col("image").alias("image_j"), "gx", "gy", *(F.col(b).alias(f"j_{b}") for b in r.bands))
    return a.join(b, ["gx", "gy"]).where("image_i < image_j")


def _other_grid(r: Rasters, pairs: DataFrame) -> DataFrame:
    """The same for pairs of different resolutions: image j is resampled bilinearly to image i's grid."""
    name = F.concat("image_i", F.lit("\n"), "image_j")
    grid_of = lambda side: pairs.select(name.alias("pair"), F.col(side).alias("image")).join(r.scenes, "image").drop("image").withColumnRenamed("pair", "image")
    mine = pairs.select(name.alias("pair"), F.col("image_j").alias("image"))
    moved = r.pixels.join(mine, "image").select(F.col("pair").alias("image"), "prow", "pcol", *r.bands)
    onto = resample(Rasters(moved, grid_of("image_j"), r.bands), grid_of("image_i"), "bilinear").pixels
    j = onto.select(F.split("image", "\n")[0].alias("image_i"), F.split("image", "\n")[1].alias("image_j"), "prow", "pcol", *(F.col(b).alias(f"j_{b}") for b in r.bands))
    i = r.pixels.select(F.col("image").alias("image_i"), "prow", "pcol", *(F.col(b).alias(f"i_{b}") for b in r.bands))
    return i.join(j, ["image_i", "prow", "pcol"])


def shared_pixels(r: Rasters, among: DataFrame | None = None) -> DataFrame:
    """image_i, image_j and both sides' bands (i_..., j_...) for every pixel of image i that image j has as well; among:
    the rectangles of the pairs that are wanted, all where it is None."""
    size = lambda side: r.scenes.select(F.col("image").alias(f"image_{side}"), F.col("res_x").alias(f"rx_{side}"), F.col("res_y").alias(f"ry_{side}"))
    pairs = (grid.overlaps(r.scenes) if among is None else among).join(size("i"), "image_i").join(size("j"), "image_j").withColumn("same", (F.col("rx_i") == F.col("rx_j")) & (F.col("ry_i") == F.col("ry_j")))
    columns = ["image_i", "image_j", *(f"{s}_{b}" for s in "ij" for b in r.bands)]
    kinds = {x["same"] for x in pairs.select("same").distinct().collect()}  # of the catalogue
    if False not in kinds:
        same = _same_grid(r, pairs).select(*columns)
        return same if among is None else same.join(among.select("image_i", "image_j"), ["image_i", "image_j"], "left_semi").select(*columns)
    other = _other_grid(r, pairs.where("not same")).select(*columns)
    if True not in kinds:
        return other
    same = _same_grid(r, pairs.where("same")).join(pairs.where("same").select("image_i", "image_j"), ["image_i", "image_j"], "left_semi")
    return same.select(*columns).unionByName(other)


def overlap(r: Rasters, known: DataFrame | None = None) -> DataFrame:
    """image, other, band, mean, std (of a population), size of image's pixels where both are valid, for both directions
    of every overlapping pair; zeros where nothing valid is shared. The pixels of pairs that are known (image, other) are
    not read."""
    pairs = grid.overlaps(r.scenes)
    if known is not None:
        pairs = pairs.join(known.select(F.least("image", "other").alias("image_i"), F.greatest("image", "other").alias("image_j")).distinct(), ["image_i", "image_j"], "left_anti")
    both = {b: F.col(f"i_{b}").isNotNull() & F.col(f"j_{b}").isNotNull() for b in r.bands}
    sides: list[Column] = []
    for b, valid in both.items():
        for s in "ij":
            v = F.when(valid, F.col(f"{s}_{b}"))
            sides += [F.avg(v).alias(f"{b}_{s}_mean"), F.stddev_pop(v).alias(f"{b}_{s}_std")]
        sides.append(F.count(F.when(valid, 1)).alias(f"{b}_size"))
    sums = shared_pixels(r, None if known is None else pairs).groupBy("image_i", "image_j").agg(*sides)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = F.array(*(
        F.struct(F.col(f"image_{s}").alias("image"), F.col(f"image_{o}").alias("other"), F.lit(b).alias("band"), zero(f"{b}_{s}_mean").alias("mean"), zero(f"{b}_{s}_std").alias("std"), F.coalesce(F.col(f"{b}_size"), F.lit(0)).cast("long").alias("size"))
        for b in r.bands for s, o in ("ij", "ji")
    ))
    return pairs.select("image_i", "image_j").join(sums, ["image_i", "image_j"], "left").select(F.inline(rows))


def profile(r: Rasters, bins: int = 4096) -> DataFrame:
    """image, band, median and quartiles, linearly interpolated.

    Exact, without an image's values in one task: counts by bin tell which bins hold the wanted ranks, and only the values
    of those bins are counted one by one."""
    values = F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in r.bands))
    v = r.pixels.select("image", F.inline(values)).where("v is not null")
    ends = v.groupBy("image", "band").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * F.lit(float(bins))), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = v.join(ends, ["image", "band"]).select("image", "band", "v", place.alias("bin"))
    before = lambda by, start: (F.sum("c").over(W.partitionBy(*by).orderBy(start)) - F.col("c")).alias("before")
    counts = placed.groupBy("image", "band", "bin").agg(F.count("*").alias("c")).select("image", "band", "bin", "c", before(("image", "band"), "bin"))
    # the ranks on both sides of each quantile
    sides = []
    for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        at = F.lit(p) * (F.col("n") - 1)
        for rank, weight in ((F.floor(at), 1 - (at - F.floor(at))), (F.floor(at) + 1, at - F.floor(at))):
            sides.append(F.struct(F.lit(q).alias("q"), rank.cast("long").alias("rank"), weight.cast("double").alias("weight")))
    ranks = ends.select("image", "band", F.inline(F.array(*sides))).where("weight > 0")
    in_bin = ranks.join(counts, ["image", "band"]).where("rank >= before and rank < before + c").select("image", "band", "q", "rank", "weight", "bin", "before")
    few = placed.join(in_bin.select("image", "band", "bin").distinct(), ["image", "band", "bin"], "left_semi").groupBy("image", "band", "bin", "v").agg(F.count("*").alias("c"))
    upto = few.select("image", "band", "bin", "v", "c", before(("image", "band", "bin"), "v").alias("inner"))
    found = in_bin.join(upto, ["image", "band", "bin"]).where("rank >= before + inner and rank < before + inner + c")
    quantile = lambda q: F.sum(F.when(F.col("q") == q, F.col("v") * F.col("weight"))).alias(q)
    return found.groupBy("image", "band").agg(quantile("q25"), quantile("median"), quantile("q75"))


def profile_pairs(groups: dict[str, list[Rasters]]) -> DataFrame:
    """label, phase, band, mean before and after; groups that are not pairs are left out."""
    out = None
    for label, pair in groups.items():
        if len(pair) != 2:
            continue
        for phase, r in zip(("before", "after"), pair, strict=True):
            means = _by_band(r.pixels.agg(*(F.avg(b).alias(f"{b}_mean") for b in r.bands)), [], r.bands, ["mean"])
            part = means.select(F.lit(label).alias("label"), F.lit(phase).alias("phase"), "band", "mean")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no group is a pair")
    return out


def difference(r: Rasters, first: str, second: str) -> DataFrame:
    """prow, pcol, diff: the mean over bands of the absolute difference of two images of the same shape, where both have
    the band. Signed arithmetic: unsigned values do not wrap."""
    shapes = r.scenes.where(F.col("image").isin(first, second)).agg(F.count("*").alias("n"), F.count_distinct("width", "height").alias("shapes")).first()
    if shapes["n"] != 2 or shapes["shapes"] != 1:
        raise ValueError("two images of the same shape are needed")
    side = lambda image, s: r.pixels.where(F.col("image") == image).select("prow", "pcol", *(F.col(b).alias(f"{s}_{b}") for b in r.bands))
    both = side(first, "p").join(side(second, "q"), ["prow", "pcol"])
    diffs = [F.abs(F.col(f"q_{b}") - F.col(f"p_{b}")) for b in r.bands]
    total = sum((F.coalesce(d, F.lit(0.0)) for d in diffs[1:]), F.coalesce(diffs[0], F.lit(0.0)))
    n = sum((F.when(d.isNotNull(), 1).otherwise(0) for d in diffs[1:]), F.when(diffs[0].isNotNull(), 1).otherwise(0))
    return both.select("prow", "pcol", F.when(n > 0, total / n).alias("diff")).where("diff is not null")
