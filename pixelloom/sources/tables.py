"""Sources and sinks: pixel tables, block maps, models, vector layers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.model import Rasters, nodata_to_null, null_to_nodata
from pixelloom.operators.vector import FEATURES

MODEL = "map<string,struct<adjustments:map<string,struct<scale:double,offset:double>>,whole_stats:map<string,struct<mean:double,std:double,size:bigint>>,overlap_stats:map<string,map<string,struct<mean:double,std:double,size:bigint>>>>>"


def write(r: Rasters, path: str, nodata: float | None = None, dtype: str | None = None, tile: int = 512) -> None:
    """Pixels by image, ordered by tile within files, so that a window's rows are in few row groups; and the catalogue."""
    p = null_to_nodata(r.pixels, r.bands, nodata, dtype).withColumn("tile", F.floor(F.col("prow") / tile) * F.lit(1_000_000) + F.floor(F.col("pcol") / tile))
    p.repartition("image", "tile").sortWithinPartitions("image", "tile", "prow", "pcol").drop("tile").write.mode("overwrite").partitionBy("image").parquet(f"{path}/pixels")
    r.scenes.write.mode("overwrite").parquet(f"{path}/scenes")


def read(spark: SparkSession, path: str, nodata: float | None = None) -> Rasters:
    pixels = spark.read.parquet(f"{path}/pixels").withColumn("image", F.col("image").cast("string"))
    bands = tuple(sorted((c for c in pixels.columns if re.fullmatch(r"b\d+", c)), key=lambda b: int(b[1:])))
    return Rasters(nodata_to_null(pixels.select("image", "prow", "pcol", *bands), bands, nodata), spark.read.parquet(f"{path}/scenes"), bands)


def write_blocks(local: DataFrame, path: str) -> None:
    local.write.mode("overwrite").partitionBy("image").parquet(path)


def read_blocks(spark: SparkSession, paths: list[str], shapes: list[tuple] | None = None) -> DataFrame:
    """Block means of several maps; all shapes and extents have to agree."""
    if shapes and len(set(shapes)) > 1:
        raise ValueError("the block maps differ in shape or extent")
    out = None
    for pos, path in enumerate(paths):
        df = spark.read.parquet(path).withColumn("pos", F.lit(pos))
        out = df if out is None else out.unionByName(df)
    return out


def model_json(adjustments: DataFrame, whole: DataFrame, between: DataFrame) -> str:
    """The model of a regression: per image its adjustments, its statistics and those of its overlaps, by band. Its size is
    images x bands."""
    out: dict = {}
    for r in adjustments.collect():
        out.setdefault(r["image"], {"adjustments": {}, "whole_stats": {}, "overlap_stats": {}})["adjustments"][r["band"]] = {"scale": r["scale"], "offset": r["offset"]}
    for r in whole.collect():
        if r["image"] in out:
            out[r["image"]]["whole_stats"][r["band"]] = {"mean": r["mean"], "std": r["std"], "size": int(r["size"])}
    for r in between.collect():
        if r["image"] in out:
            out[r["image"]]["overlap_stats"].setdefault(r["other"], {})[r["band"]] = {"mean": r["mean"], "std": r["std"], "size": int(r["size"])}
    return json.dumps(out, indent=1)


def check_model(text: str) -> dict:
    """ValueError for each missing piece."""
    model = json.loads(text)
    if not isinstance(model, dict) or not model:
        raise ValueError("the model has no images")
    for image, parts in model.items():
        for part, keys in (("adjustments", ("scale", "offset")), ("whole_stats", ("mean", "std", "size"))):
            if part not in parts:
                raise ValueError(f"{image} has no {part}")
            for band, values in parts[part].items():
                if missing := [k for k in keys if k not in values]:
                    raise ValueError(f"{image}, {part}, {band}: no {missing[0]}")
        if "overlap_stats" not in parts:
            raise ValueError(f"{image} has no overlap_stats")
        for other, bands in parts["overlap_stats"].items():
            for band, values in bands.items():
                if missing := [k for k in ("mean", "std", "size") if k not in values]:
                    raise ValueError(f"{image}, {other}, {band}: no {missing[0]}")
    return model


def model_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """adjustments, whole_stats, overlap_stats of a checked model."""
    check_model(text)
    images = spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json("text", MODEL)).alias("image", "m"))
    one = lambda part, names: images.select("image", F.explode(f"m.{part}").alias("band", "v")).select("image", "band", *(f"v.{n}" for n in names))
    pairs = images.select("image", F.explode("m.overlap_stats").alias("other", "bands")).select("image", "other", F.explode("bands").alias("band", "v")).select("image", "other", "band", "v.mean", "v.std", "v.size")
    return {"adjustments": one("adjustments", ("scale", "offset")), "whole_stats": one("whole_stats", ("mean", "std", "size")), "overlap_stats": pairs}


def read_geojson(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Polygons and multipolygons of a GeoJSON file as features; a multipolygon's rings count together."""
    shape = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("f")).select(F.posexplode("f.features").alias("pos", "f"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", one)).otherwise(F.flatten(F.from_json("f.geometry.coordinates", many)))
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select(F.lit(layer).alias("layer"), F.col("pos").cast("long").alias("feature_id"), F.coalesce("f.properties", F.expr("map()").cast("map<string,string>")).alias("props"), points.alias("rings"))


def write_geojson(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line."""
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("props").alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry")))).write.mode("overwrite").text(path)


_POINT = r"(-?[0-9.eE+-]+) +(-?[0-9.eE+-]+)"


def from_wkt(df: DataFrame, column: str, layer: str) -> DataFrame:
    """Polygons in WKT as features: feature_id, props and the text come from the table."""
    inner = F.regexp_replace(F.regexp_replace(F.col(column), r"^\s*POLYGON\s*\(\s*\(", ""), r"\)\s*\)\s*$", "")
    ring = lambda text: F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.struct(F.regexp_extract(p, _POINT, 1).cast("double").alias("x"), F.regexp_extract(p, _POINT, 2).cast("double").alias("y")))
    return df.select(F.lit(layer).alias("layer"), F.col("feature_id").cast("long").alias("feature_id"), "props", F.transform(F.split(inner, r"\)\s*,\s*\("), ring).alias("rings"))


__all__ = ["FEATURES", "read", "write", "read_blocks", "write_blocks", "model_json", "model_tables", "check_model", "read_geojson", "write_geojson", "from_wkt"]
