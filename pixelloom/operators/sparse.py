"""Least squares over images as a graph: every unknown pair (scale, offset) is a node, every overlap an edge.

Constraint rows are a table and stay one. Each image's two unknowns are turned so that its own columns are orthonormal: with
c = the weighted mean of its means, the scale and (offset + c * scale) have no product in the normal equations, so these
have the identity on the diagonal and one 2 x 2 block an edge. Conjugate gradients on them start at no change, hence
never leave the space of changes that some constraint asks for. Parts of the graph that are not connected do not meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.components import saved

#: Directions this much smaller than their image's values are taken as absent: a constant image has no scale of its own.
FLAT = 1e-10


def _sides(rows: DataFrame) -> DataFrame:
    """Each side of each constraint row: keys, image, w and v (weights of means and deviations), mean, std, and the rests of the
    two rows at the start, with the side's sign."""
    w, v = F.col("w"), F.col("v")
    pair = F.col("b").isNotNull()
    rest, rest_std = F.when(pair, -w * (F.col("mean_a") - F.col("mean_b"))).otherwise(F.lit(0.0)), F.when(pair, -v * (F.col("std_a") - F.col("std_b"))).otherwise(F.lit(0.0))
    side = lambda x, sign: F.struct(F.col(x).alias("image"), F.col(f"mean_{x}").alias("mean"), F.col(f"std_{x}").alias("std"), F.lit(float(sign)).alias("sign"))
    both = F.inline(F.when(pair, F.array(side("a", 1), side("b", -1))).otherwise(F.array(side("a", 1))))
    return rows.select("part", "band", w.alias("w"), v.alias("v"), rest.alias("rest"), rest_std.alias("rest_std"), both)


def _turned(rows: DataFrame) -> DataFrame:
    """part, band, image, c, d1, d2: the weighted mean, and the lengths of the image's two turned columns (d1 is 0 where flat)."""
    sides = _sides(rows)
    centre = sides.groupBy("part", "band", "image").agg((F.sum(F.pow("w", 2) * F.col("mean")) / F.sum(F.pow("w", 2))).alias("c"), F.sqrt(F.sum(F.pow("w", 2))).alias("d2"))
    spread = F.sqrt(F.sum(F.pow(F.col("w") * (F.col("mean") - F.col("c")), 2) + F.pow(F.col("v") * F.col("std"), 2)))
    lengths = sides.join(centre, ["part", "band", "image"]).groupBy("part", "band", "image").agg(F.first("c").alias("c"), spread.alias("d1"), F.first("d2").alias("d2"))
    return lengths.withColumn("d1", F.when(F.col("d1") > F.lit(FLAT) * F.abs("c") * F.col("d2"), F.col("d1")).otherwise(F.lit(0.0)))


def _over(x: Column, d: Column) -> Column:
    return F.when(d > 0, x / d).otherwise(F.lit(0.0))


def system(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: part, band, image, c, d1, d2, f1, f2, the right side; edges: part, band, a, b, m11, m12, m21, m22, in both directions).

    rows: part, band, a, b (null where an image is held to itself), w, v, mean_a, std_a, mean_b, std_b."""
    turned = saved(_turned(rows))
    own = _sides(rows).join(turned, ["part", "band", "image"])
    side1 = F.col("sign") * (_over(F.col("w") * (F.col("mean") - F.col("c")), F.col("d1")) * F.col("rest") + _over(F.col("v") * F.col("std"), F.col("d1")) * F.col("rest_std"))
    side2 = F.col("sign") * _over(F.col("w"), F.col("d2")) * F.col("rest")
    right = own.groupBy("part", "band", "image").agg(F.sum(side1).alias("f1"), F.sum(side2).alias("f2"))
    at = lambda x: turned.select("part", "band", F.col("image").alias(x), F.col("c").alias(f"c_{x}"), F.col("d1").alias(f"d1_{x}"), F.col("d2").alias(f"d2_{x}"))
    pairs = rows.where("b IS NOT NULL").join(at("a"), ["part", "band", "a"]).join(at("b"), ["part", "band", "b"])
    alpha = lambda x: _over(F.col("w") * (F.col(f"mean_{x}") - F.col(f"c_{x}")), F.col(f"d1_{x}"))
    sigma = lambda x: _over(F.col("v") * F.col(f"std_{x}"), F.col(f"d1_{x}"))
    omega = lambda x: _over(F.col("w"), F.col(f"d2_{x}"))
    m = [-(alpha("a") * alpha("b") + sigma("a") * sigma("b")), -(alpha("a") * omega("b")), -(omega("a") * alpha("b")), -(omega("a") * omega("b"))]
    there = pairs.select("part", "band", "a", "b", *(x.alias(n) for x, n in zip(m, ("m11", "m12", "m21", "m22"), strict=True)))
    back = there.select("part", "band", F.col("b").alias("a"), F.col("a").alias("b"), "m11", F.col("m21").alias("m12"), F.col("m12").alias("m21"), "m22")
    return saved(turned.join(right, ["part", "band", "image"])), saved(there.unionByName(back))


def _steps(nodes: DataFrame) -> DataFrame:
    """part, band, image, scale, offset from the turned solution (y1, y2). A flat image takes the least change that fits."""
    s, u = _over(F.col("y1"), F.col("d1")), _over(F.col("y2"), F.col("d2"))
    flat = F.col("d1") == 0
    scale = F.when(flat, F.col("c") * u / (1 + F.col("c") * F.col("c"))).otherwise(s)
    offset = F.when(flat, u / (1 + F.col("c") * F.col("c"))).otherwise(u - F.col("c") * s)
    return nodes.select("part", "band", "image", (1 + scale).alias("scale"), offset.alias("offset"))


def gradients(n: int, a: np.ndarray, b: np.ndarray, blocks: np.ndarray, right: np.ndarray, tolerance: float = 1e-13, rounds: int | None = None) -> np.ndarray:
    """The solution y (n x 2) of y + sum of blocks @ y[b] = right by conjugate gradients; its memory is that of the edges."""
    y, r = np.zeros((n, 2)), right.copy()
    p, length = r.copy(), float((r * r).sum())
    first = length
    for _ in range(rounds or 20 * n + 100):
        if length <= tolerance**2 * first:
            break
        q = p.copy()
        moved = np.einsum("kij,kj->ki", blocks, p[b])
        for j in (0, 1):
            q[:, j] += np.bincount(a, moved[:, j], n)
        bend = float((p * q).sum())
        if bend <= 0:  # no direction left that a constraint sees
            break
        y += length / bend * p
        r -= length / bend * q
        length, before = float((r * r).sum()), length
        p = r + length / before * p
    return y


def solve_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every (part, band) in a task of its own: for parts whose number of edges is bounded."""

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(own.image)
        a, b = names.get_indexer(links.a), names.get_indexer(links.b)
        y = gradients(len(own), a, b, links[["m11", "m12", "m21", "m22"]].to_numpy().reshape(-1, 2, 2), own[["f1", "f2"]].to_numpy())
        return own.assign(y1=y[:, 0], y2=y[:, 1])

    schema = "part string, band string, image string, c double, d1 double, d2 double, f1 double, f2 double, y1 double, y2 double"
    keys = ["part", "band"]
    return _steps(nodes.select("part", "band", "image", "c", "d1", "d2", "f1", "f2").groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(run, schema))


def _scalars(rows: DataFrame, **sums: Column) -> DataFrame:
    """One row a part and band."""
    return rows.groupBy("part", "band").agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def solve_spread(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-11, rounds: int = 500) -> DataFrame:
    """The same steps over tables, for parts of any size: a step is a join of the edges with the direction, summed by image, and two sums a
    part. Parts that have converged leave the rounds."""
    dot = lambda x, y: F.col(f"{x}1") * F.col(f"{y}1") + F.col(f"{x}2") * F.col(f"{y}2")
    keep = ["part", "band", "image", "c", "d1", "d2"]
    state = nodes.select(*keep, F.lit(0.0).alias("y1"), F.lit(0.0).alias("y2"), F.col("f1").alias("r1"), F.col("f2").alias("r2"), F.col("f1").alias("p1"), F.col("f2").alias("p2"))
    first = saved(_scalars(state, first=dot("r", "r")))
    state = state.join(F.broadcast(first), ["part", "band"]).withColumn("length", F.col("first"))
    done: DataFrame | None = None
    for step in range(rounds + 1):
        over = (F.col("length") <= F.lit(tolerance**2) * F.col("first")) if step < rounds else F.lit(True)
        ended = state.where(over).select(*keep, "y1", "y2")
        done = ended if done is None else done.unionByName(ended)
        state = state.where(~over)
        if state.limit(1).count() == 0:
            break
        sent = edges.join(state.select("part", "band", F.col("image").alias("b"), "p1", "p2"), ["part", "band", "b"])
        moved = sent.groupBy("part", "band", F.col("a").alias("image")).agg(F.sum(F.col("m11") * F.col("p1") + F.col("m12") * F.col("p2")).alias("q1"), F.sum(F.col("m21") * F.col("p1") + F.col("m22") * F.col("p2")).alias("q2"))
        q = state.join(moved, ["part", "band", "image"], "left").withColumns({x: F.col(f"p{x[1]}") + F.coalesce(x, F.lit(0.0)) for x in ("q1", "q2")})
        q = saved(q)
        rate = _scalars(q, bend=dot("p", "q"))
        q = q.join(F.broadcast(rate), ["part", "band"]).withColumn("alpha", F.when(F.col("bend") > 0, F.col("length") / F.col("bend")).otherwise(F.lit(0.0)))
        q = saved(q.withColumns({**{f"y{j}": F.col(f"y{j}") + F.col("alpha") * F.col(f"p{j}") for j in (1, 2)}, **{f"r{j}": F.col(f"r{j}") - F.col("alpha") * F.col(f"q{j}") for j in (1, 2)}}))
        after = _scalars(q, after=dot("r", "r"))
        q = q.join(F.broadcast(after), ["part", "band"])
        # without a direction that a constraint sees the part is at its end
        q = q.withColumns({**{f"p{j}": F.col(f"r{j}") + F.col("after") / F.col("length") * F.col(f"p{j}") for j in (1, 2)}, "length": F.when(F.col("bend") > 0, F.col("after")).otherwise(F.lit(0.0))})
        state = saved(q.select(*keep, "y1", "y2", "r1", "r2", "p1", "p2", "first", "length"))
    return _steps(done)


