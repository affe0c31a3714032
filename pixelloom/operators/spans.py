"""Stretches of columns as bits: a row of a grid is cut into words of 64 columns, so unions are bitwise aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64


def words(spans: DataFrame) -> DataFrame:
    """image, prow, word, bits of all columns between first and last (both included) of spans(image, prow, first, last); columns are not
    negative."""
    cut = spans.where("first <= last").withColumn("word", F.explode(F.sequence(F.floor(F.col("first") / BITS), F.floor(F.col("last") / BITS))))
    low, high = F.greatest(F.col("first") - F.col("word") * BITS, F.lit(0)).cast("int"), F.least(F.col("last") - F.col("word") * BITS, F.lit(BITS - 1)).cast("int")
    bits = F.call_function("shiftleft", F.lit(-1).cast("long"), low).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(BITS - 1) - high))
    return cut.select("image", "prow", "word", bits.alias("bits")).groupBy("image", "prow", "word").agg(F.bit_or("bits").alias("bits"))


def cells(found: DataFrame) -> DataFrame:
    """image, prow, pcol of the bits that are set."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("long")) == 1))
    return found.select("image", "prow", "word", bit.alias("bit")).select("image", "prow", (F.col("word") * BITS + F.col("bit")).cast("int").alias("pcol"))


def within(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """The pixels whose bit is set: an equi-join by row and word, one row of bits at most for each pixel."""
    hit = F.call_function("shiftright", F.col("bits"), (F.col("pcol") % BITS).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return pixels.withColumn("word", F.floor(F.col("pcol") / BITS)).join(found, ["image", "prow", "word"]).where(hit).select(*pixels.columns)
