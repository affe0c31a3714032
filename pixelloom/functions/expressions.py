"""Pixel expressions: a checked subset of Python's syntax becomes a Column. Nothing is evaluated as code.

Bands are names (b1, b2, ...), `np.` functions may be written with or without the prefix, and `P%bK` is a percentile
of band K. Operators keep Python's precedence: comparisons joined by & or | need parentheses.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PERCENT = re.compile(r"(\d+(?:\.\d+)?)%(b\d+)\b")
_BAND = re.compile(r"\bb\d+\b")


def _either(f: Callable) -> Callable:
    """NULL if any argument is NULL, unlike least and greatest."""
    return lambda *xs: F.when(_all(xs), f(*xs))


def _all(xs: tuple) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


FUNCTIONS: dict[str, Callable] = {
    "abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arctan": F.atan,
    "floor": F.floor, "ceil": F.ceil, "round": F.bround, "isnan": F.isnan, "where": lambda c, a, b: F.when(c.isNotNull(), F.when(c, a).otherwise(b)),
    "minimum": _either(F.least), "maximum": _either(F.greatest), "clip": _either(lambda v, a, b: F.greatest(a, F.least(v, b))), "power": F.pow,
}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: F.pow, ast.FloorDiv: _floor_div, ast.Mod: lambda a, b: a - _floor_div(a, b) * b}
_LOGICAL = {ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: lambda a, b: a != b}
_COMPARE = {ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def bands_of(text: str) -> list[str]:
    return sorted(set(_BAND.findall(text)), key=lambda b: int(b[1:]))


def to_column(text: str, bands: tuple[str, ...]) -> Column:
    """The expression over double columns of these bands. ValueError for anything else."""

    def go(node: ast.AST) -> Column:
        match node:
            case ast.Expression():
                return go(node.body)
            case ast.Constant(value=v) if isinstance(v, (bool, int, float)):
                return F.lit(v) if isinstance(v, bool) else F.lit(float(v))
            case ast.Name(id=name) if name in bands:
                return F.col(name).cast("double")
            case ast.BinOp(op=op) if type(op) in _BINARY:
                return _BINARY[type(op)](go(node.left), go(node.right))
            case ast.BinOp(op=op) if type(op) in _LOGICAL:
                return _LOGICAL[type(op)](go(node.left), go(node.right))
            case ast.BoolOp():
                joined = operator.and_ if isinstance(node.op, ast.And) else operator.or_
                out = go(node.values[0])
                for v in node.values[1:]:
                    out = joined(out, go(v))
                return out
            case ast.UnaryOp(op=ast.USub()):
                return -go(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return go(node.operand)
            case ast.UnaryOp(op=ast.Invert() | ast.Not()):
                return ~go(node.operand)
            case ast.Compare():
                out, left = None, go(node.left)
                for op, right in zip(node.ops, map(go, node.comparators), strict=True):
                    one = _COMPARE[type(op)](left, right)
                    out, left = one if out is None else out & one, right
                return out
            case ast.Call(keywords=[]):
                f = node.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("np", "numpy") else None
                if name in FUNCTIONS:
                    return FUNCTIONS[name](*map(go, node.args))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]}")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text}") from e
    return go(tree)


def band_math(pixels: DataFrame, text: str, bands: tuple[str, ...], name: str = "value") -> DataFrame:
    """image, prow, pcol and the value; NULL where any band of the expression is. Reads only those bands."""
    used = tuple(b for b in bands_of(text) if b in bands)
    value = to_column(text, bands)
    valid = _all(tuple(F.col(b) for b in used)) if used else F.lit(True)
    return pixels.select("image", "prow", "pcol", F.when(valid, value).alias(name)).where(F.col(name).isNotNull())


def ndvi(pixels: DataFrame, nir: str, red: str) -> DataFrame:
    n, r = F.col(nir).cast("double"), F.col(red).cast("double")
    return pixels.select("image", "prow", "pcol", ((n - r) / (n + r + F.lit(1e-9))).alias("ndvi")).where("ndvi is not null")


def cutoffs(pixels: DataFrame, wanted: list[tuple[float, str]], bins: int = 1000) -> DataFrame:
    """image, q_0, q_1, ...: per image and (percent, band) the left edge of the first of `bins` equal bins whose running
    count reaches the percentage. Two aggregations; what is sorted are bins, not pixels. An image whose valid values are
    all equal has no histogram: an error when the plan runs."""
    out = None
    for k, (percent, band) in enumerate(wanted):
        v = pixels.select("image", F.col(band).cast("double").alias("v")).where("v is not null")
        ends = v.groupBy("image").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        flat = F.raise_error(F.concat(F.lit(f"no range of values for a percentile of {band}: "), "image"))
        ends = ends.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(flat.cast("double")))
        span = F.col("high") - F.col("low")
        place = F.least(F.floor((F.col("v") - F.col("low")) / span * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
        counts = v.join(ends, "image").select("image", "low", "high", "n", place.alias("bin")).groupBy("image", "low", "high", "n", "bin").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy("image").orderBy("bin"))
        reached = counts.withColumn("upto", upto).where(F.col("upto") >= F.lit(percent / 100) * F.col("n")).groupBy("image", "low", "high").agg(F.min("bin").alias("bin"))
        part = reached.select("image", (F.col("low") + F.col("bin") * (span / F.lit(float(bins)))).alias(f"q_{k}"))
        out = part if out is None else out.join(part, "image", "full")
    return out


def threshold(pixels: DataFrame, text: str, bands: tuple[str, ...]) -> DataFrame:
    """image, prow, pcol, value 0 or 1; pixels with any band missing are left out."""
    wanted: list[tuple[float, str]] = []

    def named(m: re.Match) -> str:
        wanted.append((float(m[1]), m[2]))
        return f"b{900_000 + len(wanted) - 1}"

    plain = _PERCENT.sub(named, text)
    marks = tuple(f"b{900_000 + k}" for k in range(len(wanted)))
    valid = pixels.where(_all(tuple(F.col(b) for b in bands)))
    if wanted:
        q = cutoffs(pixels, wanted)
        valid = valid.join(q.select("image", *(F.col(f"q_{k}").alias(m) for k, m in enumerate(marks))), "image")
    return valid.select("image", "prow", "pcol", to_column(plain, bands + marks).cast("int").alias("value"))
