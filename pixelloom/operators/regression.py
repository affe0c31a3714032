"""Global regression: one scale and offset per image and band, from the overlaps.

Statistics are aggregations over pixels. The system has two unknowns an image and two rows an overlap; it stays a sparse table,
solved by connected parts of the overlap graph. Applying it is a projection with a join of one row per image.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.model import Rasters, wrap_cast
from pixelloom.operators import sparse, stats
from pixelloom.operators.components import components, saved


@dataclass(frozen=True)
class Anchors:
    """Which images stay as they are: all, those listed, or all but those listed."""

    mode: str = "all"
    images: tuple[str, ...] = ()


def least_change(names: list[str], rows: pd.DataFrame) -> np.ndarray:
    """(scale, offset) of each image from one band's constraint rows.

    Every pair with an anchor asks for equal means and equal deviations in the overlap, weighted by its size; every
    anchor asks to keep its own mean and deviation, with the mean weight of an overlap. The answer is the least-squares
    solution that is nearest to leaving all as it is, so an image without constraints keeps scale 1 and offset 0."""
    n, at = len(names), {name: 2 * i for i, name in enumerate(names)}
    a, goals = np.zeros((2 * len(rows), 2 * n)), np.zeros(2 * len(rows))
    for k, o in enumerate(rows.itertuples()):
        i = at[o.a]
        a[2 * k, [i, i + 1]], a[2 * k + 1, i] = [o.mean_a * o.w, o.w], o.std_a * o.v
        if o.b is None or o.b != o.b:
            goals[[2 * k, 2 * k + 1]] = o.mean_a * o.w, o.std_a * o.v
        else:
            j = at[o.b]
            a[2 * k, [j, j + 1]], a[2 * k + 1, j] = [-o.mean_b * o.w, -o.w], -o.std_b * o.v
    start = np.tile([1.0, 0.0], n)
    size = np.linalg.norm(a, axis=0)  # columns of means and of ones differ by orders of magnitude
    size[size == 0] = 1.0
    rest = goals - a @ start
    step = np.linalg.lstsq(a / size, rest, rcond=1e-12)[0] / size
    if np.linalg.matrix_rank(a / size, tol=1e-12 * max(a.shape)) < 2 * n:  # nearest in the unscaled unknowns
        step = np.linalg.pinv(a, rcond=1e-12) @ rest
    return (start + step).reshape(n, 2)


def _named(r: Rasters, model: dict[str, DataFrame] | None) -> DataFrame:
    """image, ord: the images at hand, and after them those that only the loaded model knows."""
    own = r.scenes.select("image", F.col("ord").cast("long").alias("ord"))
    if not model:
        return own
    more = model["whole_stats"].select("image").distinct().join(own, "image", "left_anti")
    return own.unionByName(more.select("image", F.lit(1 << 40).alias("ord")))


def constraints(named: DataFrame, anchors: Anchors, whole: DataFrame, between: DataFrame, mean_factor: float, std_factor: float) -> DataFrame:
    """band, a, b, w, v, mean_a, std_a, mean_b, std_b, an_a: the weighted constraints that `solve` describes, a row an overlap with an
    anchor, and a row (without b) an anchor."""
    anchored = F.lit(True) if anchors.mode == "all" else F.col("image").isin(list(anchors.images)) == F.lit(anchors.mode == "include")
    marked = named.select("image", "ord", anchored.alias("an")).join(whole.select("image").distinct().withColumn("known", F.lit(True)), "image", "left")
    marked = marked.select("image", "ord", (F.col("an") & F.coalesce("known", F.lit(False))).alias("an"))
    at = lambda x: marked.select(F.col("image").alias(x), F.col("ord").alias(f"ord_{x}"), F.col("an").alias(f"an_{x}"))
    one = between.select("band", F.col("image").alias("a"), F.col("other").alias("b"), F.col("mean").alias("mean_a"), F.col("std").alias("std_a"), "size")
    two = between.select("band", F.col("image").alias("b"), F.col("other").alias("a"), F.col("mean").alias("mean_b"), F.col("std").alias("std_b"))
    pairs = one.join(two, ["band", "a", "b"]).join(at("a"), "a").join(at("b"), "b").where("(ord_a < ord_b OR (ord_a = ord_b AND a < b)) AND (an_a OR an_b)")
    pairs = pairs.select("band", "a", "b", (F.col("size") * mean_factor).cast("double").alias("w"), (F.col("size") * std_factor).cast("double").alias("v"), "mean_a", "std_a", "mean_b", "std_b", "size")
    pairs = saved(pairs)
    pull = pairs.groupBy("band").agg((F.sum("size") / (2 * F.lit(named.count()))).alias("pull"))
    none = F.lit(None).cast("double")
    own = whole.join(marked.where("an"), "image").join(F.broadcast(pull), "band").select("band", F.col("image").alias("a"), F.lit(None).cast("string").alias("b"), F.col("pull").alias("w"), F.col("pull").alias("v"), F.col("mean").alias("mean_a"), F.col("std").alias("std_a"), none.alias("mean_b"), none.alias("std_b"))
    return pairs.drop("size").unionByName(own)


def _dense(rows: DataFrame) -> DataFrame:
    """Each (part, band) by a dense solver, which finds the nearest answer whatever the rank: for parts of few images."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*part.a, *part.b.dropna()})
        found = least_change(names, part)
        return pd.DataFrame({"part": part.part.iloc[0], "band": part.band.iloc[0], "image": names, "scale": found[:, 0], "offset": found[:, 1]})

    return rows.groupBy("part", "band").applyInPandas(run, "part string, band string, image string, scale double, offset double")


def solved(rows: DataFrame, most_dense: int = 100, most_edges: int = 1_000_000) -> DataFrame:
    """image, band, scale, offset of every image that overlaps another.

    The graph of overlaps falls into connected parts, solved apart: those of up to `most_dense` images by a dense solver in a task,
    those of up to `most_edges` overlaps by conjugate gradients in a task, larger ones by conjugate gradients over tables."""
    rows = saved(rows)
    links = rows.where("b IS NOT NULL").select("a", "b").distinct()
    if links.limit(most_dense).count() < most_dense:  # as many links join one image more at most
        return _dense(rows.withColumn("part", F.lit("all")).join(F.broadcast(links.select("a").union(links.select("b")).distinct()), "a", "left_semi")).drop("part")
    parts = components(links).select(F.col("node").alias("a"), F.col("component").alias("part"))
    sizes = links.join(parts, "a").groupBy("part").agg(F.count("*").alias("edges")).join(parts.groupBy("part").agg(F.count("*").alias("images")), "part")
    rows = saved(rows.join(parts, "a").join(sizes, "part"))
    of = lambda c: rows.where(c).drop("edges", "images")
    out = _dense(of(F.col("images") <= most_dense))
    for c, solver in ((F.col("edges") <= most_edges, sparse.solve_parts), (F.col("edges") > most_edges, sparse.solve_spread)):
        large = of((F.col("images") > most_dense) & c)
        if large.limit(1).count():
            out = out.unionByName(solver(*sparse.system(large)))
    return out.drop("part")


def undetermined(rows: DataFrame) -> DataFrame:
    """image, band of the images whose constraints have no deviation and one mean, up to rounding: any scale fits them with some offset.
    An anchor that overlaps no other anchor is not among them: it stays as it is, and the others follow it."""
    pairs, own = rows.where("b IS NOT NULL AND w > 0"), rows.where("b IS NULL")
    side = lambda df, x: df.select(F.col(x).alias("image"), "band", F.col(f"mean_{x}").alias("mean"), F.col(f"std_{x}").alias("std"))
    anchors = own.select("band", F.col("a").alias("image"))
    bound = pairs.join(anchors.withColumnRenamed("image", "a"), ["a", "band"], "left_semi").join(anchors.withColumnRenamed("image", "b"), ["b", "band"], "left_semi").select("band", F.explode(F.array("a", "b")).alias("image"))
    alone = anchors.join(bound, ["image", "band"], "left_anti")
    every = side(pairs, "a").unionByName(side(pairs, "b")).unionByName(side(own, "a")).join(alone, ["image", "band"], "left_anti")
    noise = F.lit(1e-12) * F.max(F.abs("mean"))
    sums = every.groupBy("image", "band").agg(((F.max("std") <= noise) & (F.max("mean") - F.min("mean") <= noise)).alias("_open"))
    return sums.where("_open").select("image", "band")


def parameters(r: Rasters, anchors: Anchors = Anchors(), mean_factor: float = 1.0, std_factor: float = 1.0, model: dict[str, DataFrame] | None = None, most_dense: int = 100, most_edges: int = 1_000_000, keep_undetermined: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(adjustments, whole statistics, overlap statistics). What a loaded model already knows about an image or a pair is
    taken from it, not computed again. All three are small tables that have been written: nothing is aggregated twice.
    What the overlaps leave open (`undetermined`) stays as near to no change as it can, or is NaN without `keep_undetermined`."""
    if anchors.mode not in ("all", "include", "exclude"):
        raise ValueError("anchors are all, include or exclude")
    whole, between = stats.whole, stats.overlap
    if model:
        known = model["whole_stats"]
        fresh = Rasters(r.pixels.join(known.select("image").distinct(), "image", "left_anti"), r.scenes.join(known.select("image").distinct(), "image", "left_anti"), r.bands)
        whole_df = whole(fresh).unionByName(known)
        pairs = model["overlap_stats"].select("image", "other").distinct()
        between_df = between(r, pairs).unionByName(model["overlap_stats"])
    else:
        whole_df, between_df = whole(r), between(r)
    whole_df, between_df = saved(whole_df), saved(between_df)
    rows = constraints(_named(r, model), anchors, whole_df, between_df, mean_factor, std_factor)
    found = solved(rows, most_dense, most_edges)
    if not keep_undetermined:
        marked = found.join(undetermined(rows).withColumn("_open", F.lit(True)), ["image", "band"], "left")
        found = marked.select("image", "band", *(F.when(F.col("_open"), F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in ("scale", "offset")))
    every = r.scenes.select("image").join(r.pixels.sparkSession.createDataFrame([(b,) for b in r.bands], "band string"))
    every = every.join(found, ["image", "band"], "left").select("image", "band", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("offset", F.lit(0.0)).alias("offset"))
    return saved(every), whole_df, between_df


def anchored(between: DataFrame, scenes: DataFrame, anchor: str, keep_undetermined: bool = True) -> DataFrame:
    """The closed form for one anchor, in SQL: every image that overlaps it gets the anchor's deviation and mean in the
    overlap; the others and the anchor stay. So do images without deviation there; without `keep_undetermined` they get the bare ratio:
    NaN, or infinity where the anchor deviates."""
    own = between.where(F.col("other") == anchor).select("image", "band", F.col("mean").alias("m"), F.col("std").alias("s"), "size")
    there = between.where(F.col("image") == anchor).select(F.col("other").alias("image"), "band", F.col("mean").alias("am"), F.col("std").alias("as"))
    scale = F.when(F.col("s") > 0, F.col("as") / F.nullif(F.col("s"), F.lit(0.0))).when(F.col("as") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    found = own.join(there, ["image", "band"]).where("size > 0 and s > 0" if keep_undetermined else "size > 0").select("image", "band", scale.alias("scale"), (F.col("am") - scale * F.col("m")).alias("offset"))
    every = scenes.select("image").join(between.select("band").distinct())
    return every.join(found, ["image", "band"], "left").select("image", "band", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("offset", F.lit(0.0)).alias("offset"))


def apply(r: Rasters, adjustments: DataFrame, dtype: str | None = None) -> Rasters:
    """value * scale + offset of every valid pixel."""
    wide = adjustments.groupBy("image").agg(*(F.max(F.when(F.col("band") == b, F.struct("scale", "offset"))).alias(f"p_{b}") for b in r.bands))
    joined = r.pixels.join(wide, "image")
    moved = {b: F.col(b) * F.col(f"p_{b}.scale") + F.col(f"p_{b}.offset") for b in r.bands}
    return r.with_pixels(joined.select("image", "prow", "pcol", *((wrap_cast(c, dtype) if dtype else c).alias(b) for b, c in moved.items())))
