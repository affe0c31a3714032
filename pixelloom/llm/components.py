"""Connected components of a graph given as pairs of node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Scratch


def _salted(rows: DataFrame, few: DataFrame, on: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """A join with few, whose key is unique, in which the rows of one key are dealt to several tasks: a large group's rows
    all have the same label."""
    dealt = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(dealt, [on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, component (its smallest node) for every node of edges(a, b).

    Each round every node takes the smallest label among its own and its neighbours', then its label's label: the
    number of rounds grows with the logarithm of a component's diameter. All state stays in tables of node ids; hot
    nodes are pre-aggregated before the shuffle, or salted."""
    both = scratch.save(f"{tag}-edges", edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = scratch.save(f"{tag}-labels-0", both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    step = 0
    while True:
        step += 1
        near = _salted(both, labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("hop"), F.col("component").alias("was"))
        # a root that has a smaller neighbour hands it to all that carry its label
        roots = hooked.where("hop < was").groupBy("was").agg(F.min("hop").alias("parent"))
        moved = _salted(hooked, roots, "was", "left").select("node", F.least("hop", F.coalesce("parent", "hop")).alias("hop"), "was")
        ends = labels.select(F.col("node").alias("hop"), F.col("component").alias("further"))
        new = scratch.save(f"{tag}-labels-{step}", _salted(moved, ends, "hop", "left").select("node", F.least("hop", F.coalesce("further", "hop")).alias("component"), "was"))
        changed = new.where("component <> was").limit(1).count()
        scratch.drop(f"{tag}-labels-{step - 1}")
        labels = new.select("node", "component")
        if not changed:
            scratch.drop(f"{tag}-edges")
            return labels
