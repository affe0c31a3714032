"""Paths: searching, making names from templates, matching one list to another."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import boxes


def search(folder: str, pattern: str, recursive: bool = False, match_to: tuple[list[str], str] | None = None) -> list[str]:
    """Sorted; match_to (references, regex) aligns the result with a list of references."""
    found = sorted(glob.glob(os.path.join(folder, "**", pattern) if recursive else os.path.join(folder, pattern), recursive=recursive))
    return match(found, *match_to) if match_to else found


def listed(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """The same in a store that Spark reads: path, length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length").orderBy("path")


def base_name(ref: str) -> str:
    """The file name without its extension."""
    return os.path.splitext(re.split(r"[\\/]", ref)[-1])[0]


def create(folder: str, template: str, refs: list[str], symbol: str = "$", create_folders: bool = True) -> list[str]:
    out = [os.path.join(folder, template.replace(symbol, base_name(r))) for r in refs]
    if create_folders:
        for p in out:
            os.makedirs(os.path.dirname(p) or ".", exist_ok=True)
    return out


def match(candidates: list[str], references: list[str], regex: str) -> list[str | None]:
    """For each reference the candidate whose key (group 1 of the regex, or the match) is in its base name: the first key
    wins, the last candidate of a key counts."""
    keys: dict[str, str] = {}
    for path in candidates:
        if m := re.search(regex, os.path.basename(path)):
            keys[m[1] if m.re.groups else m[0]] = path
    return [next((p for k, p in keys.items() if k in os.path.basename(ref)), None) for ref in references]


def resolve(mode: str, value: list[str] | str | tuple, **options) -> list[str]:
    """`search`, `create`, `match` or `name`; a list is taken as it is."""
    if isinstance(value, list):
        return value
    if mode == "search":
        return search(*((value,) if isinstance(value, str) else value), **options)
    if mode == "create":
        return create(*value, **options)
    if mode == "match":
        return match(*value, **options)
    if mode == "name":
        return [base_name(value)]
    raise ValueError("the mode is search, create, match or name")


def base_column(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^\\/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def create_column(folder: str, template: str, ref: Column, symbol: str = "$") -> Column:
    return F.concat_ws("/", F.lit(folder), F.replace(F.lit(template), F.lit(symbol), base_column(ref)))


def match_table(candidates: DataFrame, references: DataFrame, regex: str) -> DataFrame:
    """The same on tables (pos, path): ref_pos, ref, path. Names are joined by rare stretches of the keys, not by a nested loop."""
    name = lambda c: F.regexp_extract(c, r"([^\\/]*)$", 1)
    group = 1 if re.compile(regex).groups else 0
    keyed = candidates.where(name(F.col("path")).rlike(regex)).select("pos", "path", F.regexp_extract(name(F.col("path")), regex, group).alias("key"))
    keys = keyed.groupBy("key").agg(F.min("pos").alias("first"), F.max_by("path", "pos").alias("path"))
    refs = references.select(F.col("pos").alias("ref_pos"), F.col("path").alias("ref"))
    refs = refs.withColumn("name", name(F.col("ref")))
    fit = refs.join(boxes.containing(refs, "name", keys, "key").join(keys, "key"), "name", "left")
    return fit.groupBy("ref_pos", "ref").agg(F.min_by("path", "first").alias("path"))
