"""Statistics of growing pixel tables: every micro-batch adds its counts, means and squared deviations from them, so an
image's statistics are current without reading its old pixels again, and large values lose no digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partials(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """image, band, n, mean, deviations (the sum of their squares)."""
    aggs = [a for b in bands for a in (F.count(b).alias(f"{b}_n"), F.avg(b).alias(f"{b}_mean"), (F.var_pop(b) * F.count(b)).alias(f"{b}_deviations"))]
    parts = ", ".join(f"'{b}', {b}_n, {b}_mean, {b}_deviations" for b in bands)
    return pixels.groupBy("image").agg(*aggs).select("image", F.expr(f"stack({len(bands)}, {parts}) as (band, n, mean, deviations)"))


def follow(stream: DataFrame, bands: tuple[str, ...], folder: str, checkpoint: str):
    """A streaming query that appends each micro-batch's partial sums under its number; a repeated batch overwrites its own."""

    def add(batch: DataFrame, number: int) -> None:
        partials(batch, bands).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """image, band, mean, std (of a sample), size over all batches so far."""
    parts = spark.read.parquet(folder).where("n > 0")
    means = parts.groupBy("image", "band").agg(F.sum("n").alias("size"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("whole"))
    apart = F.col("mean") - F.col("whole")
    s = parts.join(means, ["image", "band"]).groupBy("image", "band", "size", "whole").agg(F.sum(F.col("deviations") + F.col("n") * apart * apart).alias("spread"))
    spread = F.col("spread")
    return s.select("image", "band", F.col("whole").alias("mean"), F.when(F.col("size") > 1, F.sqrt(spread / (F.col("size") - 1))).otherwise(F.lit(0.0)).alias("std"), "size")
