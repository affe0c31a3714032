"""Scenes made from the relational test tables: three overlapping images of lineitem's values by key remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.model import Rasters, scenes_of
from pixelloom.operators.components import spread

#: image, order, left and upper edge in units of half a scene
PLACES = (("A", 0, 0.0, 1.0), ("N", 1, 0.5, 1.0), ("R", 2, 0.25, 1.5))
BANDS = ("b1", "b2", "b3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_of(spark: SparkSession) -> int:
    """Pixels per side of a scene: the setting pixelloom.side, 32 where it is unset."""
    return int(spark.conf.get("pixelloom.side", "32"))


def catalogue(spark: SparkSession, side: int | None = None, places: tuple = PLACES) -> DataFrame:
    side = side or side_of(spark)
    return scenes_of(spark, [{"image": image, "ord": k, "x0": x * side, "y0": y * side, "width": side, "height": side} for image, k, x, y in places])


def scenes(spark: SparkSession, sf_dir: str, side: int | None = None, places: tuple = PLACES) -> Rasters:
    """side x side pixels with holes along a diagonal pattern and an empty corner."""
    side = side or side_of(spark)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), (F.col("l_orderkey") % side).cast("int").alias("prow"), (F.col("l_partkey") % side).cast("int").alias("pcol"), "l_quantity", "l_extendedprice", "l_discount")
    there = items.where(((7 * F.col("prow") + F.col("pcol")) % 11 != 0) & ~((F.col("prow") < side // 4) & (F.col("pcol") < side // 4)))
    pixels = there.groupBy("image", "prow", "pcol").agg(F.max("l_quantity").alias("b1"), F.max("l_extendedprice").alias("b2"), F.max("l_discount").alias("b3"))
    return Rasters(pixels, catalogue(spark, side, places), BANDS)


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of as many images as there are parts: each overlaps some neighbours, however large the table is."""
    key, size = F.col("p_partkey"), F.col("p_size")
    height = (F.lit(8) + key % 40).cast("int")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("image"), key.cast("int").alias("ord"), (F.floor(key / 40) * 15 + size % 7).cast("double").alias("x0"), ((key % 40) * 20 + height).cast("double").alias("y0"),
        F.lit(1.0).alias("res_x"), F.lit(1.0).alias("res_y"), (F.lit(8) + size).cast("int").alias("width"), height.alias("height"), F.lit("float64").alias("dtype"), F.lit(None).cast("double").alias("nodata"), F.lit("EPSG:3857").alias("crs"),
    )


def neighbours(spark: SparkSession, sf_dir: str) -> Rasters:
    """Two images a part, side by side with some columns in common and apart from other parts' images: whole, by lines and columns alone."""
    key, size = F.col("p_partkey"), F.col("p_size")
    one = table(spark, sf_dir, "part").select(key.alias("key"), (F.lit(8) + size % 5 * 2).cast("int").alias("width"), (F.lit(2) + size % 3 * 2).cast("int").alias("common"), (F.lit(18) + key % 3 * 2).cast("int").alias("height"))
    sides = one.withColumn("right", F.explode(F.array(F.lit(0), F.lit(1))))
    cat = sides.select(
        F.concat(F.lit("p"), F.col("key").cast("string"), F.when(F.col("right") == 1, "r").otherwise("l")).alias("image"), (2 * F.col("key") + F.col("right")).cast("int").alias("ord"),
        ((F.col("key") % 1000) * 64 + F.col("right") * (F.col("width") - F.col("common"))).cast("double").alias("x0"), (F.floor(F.col("key") / 1000) * 64).cast("double").alias("y0"),
        F.lit(1.0).alias("res_x"), F.lit(1.0).alias("res_y"), "width", "height", F.lit("float64").alias("dtype"), F.lit(None).cast("double").alias("nodata"), F.lit("EPSG:3857").alias("crs"),
    )
    # a few megabytes of parts are hundreds of millions of pixels: their bytes would ask for too few tasks
    rows = spread(cat.select("image", "width", "height"), "image").select("image", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("prow"))
    return Rasters(rows.select("image", "prow", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pcol"), F.lit(1.0).alias("b1")), cat, ("b1",))


def box_layer(rows: DataFrame, layer: str, props: dict) -> DataFrame:
    """Features of rows with id, left, bottom, right, top."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner("left", "bottom"), corner("right", "bottom"), corner("right", "top"), corner("left", "top"), corner("left", "bottom"))
    pairs = [x for k, v in props.items() for x in (F.lit(k), v)]
    return rows.select(F.lit(layer).alias("layer"), F.col("id").cast("long").alias("feature_id"), F.create_map(*pairs).alias("props"), F.array(ring).alias("rings"))


def layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two layers of boxes, of the parts and of the customers, on a plane that grows with the tables."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    one = table(spark, sf_dir, "part").select(k.alias("id"), "p_brand", ((k % 100) * 10).alias("left"), (F.floor(k / 100) * 10).alias("bottom"), ((k % 100) * 10 + 4 + F.col("p_size") % 9).alias("right"), (F.floor(k / 100) * 10 + 7).alias("top"))
    two = table(spark, sf_dir, "customer").select(c.alias("id"), "c_mktsegment", ((c % 100) * 10 + F.col("c_nationkey") % 7).alias("left"), (F.floor(c / 100) * 10 + c % 5).alias("bottom"), ((c % 100) * 10 + F.col("c_nationkey") % 7 + 6).alias("right"), (F.floor(c / 100) * 10 + c % 5 + 3).alias("top"))
    return {"one": box_layer(one, "one", {"id": F.col("id").cast("string")}), "two": box_layer(two, "two", {"id": F.col("id").cast("string"), "kind": F.col("c_mktsegment")})}
