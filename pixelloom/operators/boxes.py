"""Pairs of rectangles that meet, and of names that contain others, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(df: DataFrame) -> DataFrame:
    """The power of two that a box's longer side fits into."""
    side = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), F.lit(2.0**-60))
    return df.withColumn("_level", F.ceil(F.log2(side)).cast("int"))


def _in_cells(df: DataFrame) -> DataFrame:
    """A row for each cell of size 2 ** _at that the box touches: two by two at most, as the box is no larger."""
    size = F.pow(F.lit(2.0), F.col("_at"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
    return df.withColumn("_x", F.explode(span("left", "right"))).withColumn("_y", F.explode(span("bottom", "top")))


#: Rows of one side that a task of a join gets, on average.
ROWS = 250_000


def _dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Tasks by the counted rows: a shuffle's own number goes by its compressed bytes, and cells of a regular grid compress to almost none."""
    return df if rows <= ROWS else df.repartition(-(-rows // ROWS), *keys)


def meeting(a: DataFrame, b: DataFrame, touch: bool = False) -> DataFrame:
    """All columns of both, left, bottom, right and top as x_min, y_min, x_max, y_max of the shared rectangle, for every pair of boxes that
    share an area (or a point, with `touch`). The other columns' names differ.

    A hierarchy of grids: each box lies in cells of its own size, up to four, and looks into the cells of every larger size that the
    other table has. A pair is reported in the cell of its shared rectangle's lower left corner alone. No nested loop, and no
    box is copied more often than there are sizes."""
    a, b = _level(a), _level(b)
    of_a, of_b = ({r["_level"]: r["count"] for r in df.groupBy("_level").count().collect()} for df in (a, b))  # as many as powers of two
    box = ("left", "bottom", "right", "top")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"_{name}_{c}" for c in box} | {"_level": f"_{name}_level"})

    def large(df: DataFrame, name: str) -> DataFrame:
        return side(_in_cells(df.withColumn("_at", F.col("_level"))), name)

    def probes(df: DataFrame, name: str, other: dict[int, int], same: bool) -> DataFrame:
        sizes = F.array(*(F.lit(x) for x in sorted(other))).cast("array<int>")
        wanted = F.filter(sizes, lambda x: x >= F.col("_level") if same else x > F.col("_level"))
        return side(_in_cells(df.withColumn("_at", F.explode(wanted))), name)

    def most(own: dict[int, int], other: dict[int, int], same: bool) -> int:
        """Rows of the larger side, each box in four cells of a size at most."""
        return 4 * max(sum(other.values()), sum(n * sum(x > level or (same and x == level) for x in other) for level, n in own.items()))

    keys, size = ["_at", "_x", "_y"], F.pow(F.lit(2.0), F.col("_at"))
    into_a, into_b = most(of_b, of_a, True), most(of_a, of_b, False)
    both = _dealt(large(a, "a"), keys, into_a).join(_dealt(probes(b, "b", of_a, True), keys, into_a), keys)
    both = both.unionByName(_dealt(probes(a, "a", of_b, False), keys, into_b).join(_dealt(large(b, "b"), keys, into_b), keys))
    low = lambda c: F.greatest(f"_a_{c}", f"_b_{c}")
    high = lambda c: F.least(f"_a_{c}", f"_b_{c}")
    less = (lambda x, y: x <= y) if touch else (lambda x, y: x < y)
    meet = less(low("left"), high("right")) & less(low("bottom"), high("top"))
    here = (F.floor(low("left") / size) == F.col("_x")) & (F.floor(low("bottom") / size) == F.col("_y"))
    kept = [c for c in (*a.columns, *b.columns) if c not in (*box, "_level")]
    return both.where(meet & here).select(*kept, low("left").alias("x_min"), high("right").alias("x_max"), low("bottom").alias("y_min"), high("top").alias("y_max"))


GRAM = 8


def _grams(text: Column, n: int | Column) -> Column:
    """The different stretches of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n) if isinstance(n, int) else n)))


def containing(texts: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """Different pairs of values of `text` and `key` such that the text contains the key; no nulls, and an empty key is in every text.

    Each key is looked up by one of its stretches of GRAM characters, the one that fewest keys have (a shorter key by itself), among
    the stretches of the texts, and then verified."""
    own = keys.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    full = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    size = F.least(F.length("_key"), F.lit(GRAM))
    grams = own.where("_key <> ''").select("_key", size.alias("_n"), F.explode(_grams(F.col("_key"), size)).alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count("*").alias("_count"))
    chosen = grams.join(counts, "_gram").groupBy("_key").agg(F.min_by("_gram", F.struct("_count", "_gram")).alias("_gram"))
    lengths = [r["_n"] for r in grams.select("_n").distinct().collect()]  # GRAM at most
    seen = None
    for n in lengths:
        part = full.where(F.length("_text") >= n).select("_text", F.explode(_grams(F.col("_text"), n)).alias("_gram"))
        seen = part if seen is None else seen.unionByName(part)
    empty = full.join(own.where("_key = ''")).select(F.col("_text").alias(text), F.col("_key").alias(key))
    if seen is None:
        return empty
    found = seen.join(chosen, "_gram").where(F.col("_text").contains(F.col("_key"))).select(F.col("_text").alias(text), F.col("_key").alias(key))
    return found.unionByName(empty)
