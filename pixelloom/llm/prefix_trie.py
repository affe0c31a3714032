"""The trie of conversations' prefixes, with totals of its subtrees by leaf-peeling message passing.

1. Turns get their positions by running counts over ranges of (conversation, turn, role, text); then texts are left behind
   and a turn is two 64-bit hashes and its length. Every conversation c is rebuilt: the first h turns of
   conversation c - c % `family`, then its own turns after its first h; h = crc32(decimal c) % `heads`.
2. A prefix is named by the exclusive-or of its turns' hashes, each mixed with its depth: a running total, so that one long
   conversation is no single task's work. Nodes are one aggregation by that name, with partial sums, so a
   first turn that all conversations share costs no more than another.
3. Nodes that are prefixes of the same longest member (the smallest id among the longest) form a path. Paths are peeled:
   each holds its number of child paths not yet complete and what those sent; a path without any is complete and sends
   its totals to the node above its top, until only the root's path finishes. A child path is shorter than the path
   it hangs on, so a snapshot log of growing conversations is one path, and rounds are at most the square root
   of twice the number of nodes (few in practice). State shrinks from round to round and stays in tables.
4. Running sums from the bottom of each path, with what its children sent, give every node's totals.

Lists of a node's ending conversations are hashed as streams of sorted blocks, so memory does not grow with them.

Defined results: turns are ordered by turn (null first), then role, then text; a null role or text is empty. Repeated turns are
turns of their own; rows without a conversation id belong to none. % has the dividend's sign. Very long texts are
hashed as they are. Without conversations there is no root and no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Scratch, tidy
from pixelloom.llm.scans import lookup, running

_BLOCK = 1024


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, t1, t2 (hashes of role and text), n (code points of the text), pos (from 1)."""
    clean = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marks = {f"t{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)}
    keep = {"conv_id": F.col("conv_id"), **marks, "n": F.length("text").cast("long"), "one": F.lit(1).cast("long")}
    out = running(clean, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], scratch, "placed", keep, sums=("one",))
    return out.select("conv_id", "t1", "t2", "n", F.col("run_one").alias("pos"))


def _convs(placed: DataFrame, family: int, heads: int) -> DataFrame:
    """conv_id, size (its own turns), h, base, have (turns that the base gives), length (of the rebuilt conversation)."""
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("size"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    own = sizes.select("conv_id", "size", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    have = F.least("h", F.coalesce("base_size", F.lit(0)))
    return own.join(bases, "base", "left").select("conv_id", "size", "h", "base", have.alias("have"), (have + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))


def rebuilt(turns: DataFrame, scratch: Scratch, family: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, d, t1, t2, n, length for every turn of every rebuilt conversation, and a row of depth 0 for each."""
    placed = _placed(turns, scratch)
    convs = scratch.save("convs", _convs(placed, family, heads))
    total = convs.agg(F.sum("size")).collect()[0][0] or 0
    own = lookup(placed, convs.select("conv_id", "h", "have", "length", "size"), ["conv_id"], "size", total).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("have")).alias("d"), "t1", "t2", "n", "length")
    # a base serves at most 2 * family - 1 conversations
    first = placed.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    given = convs.where("have > 0").join(first, "base").where("pos <= have").select("conv_id", F.col("pos").alias("d"), "t1", "t2", "n", "length")
    zero = F.lit(0).cast("long")
    return own.unionByName(given).unionByName(convs.select("conv_id", zero.alias("d"), zero.alias("t1"), zero.alias("t2"), zero.alias("n"), "length"))


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns with k1, k2 (the name of the prefix that ends here) and p1, p2 (of the one before)."""
    mixed = {f"x{i}": F.when(F.col("d") > 0, F.xxhash64("d", f"t{i}")).otherwise(F.lit(0)).cast("long") for i in (1, 2)}
    keep = {c: F.col(c) for c in ("conv_id", "d", "n", "length")} | mixed
    out = running(turns, ["conv_id"], [F.col("d")], scratch, "prefixes", keep, xors=("x1", "x2"))
    before: list[Column] = [F.col(f"run_x{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return out.select("conv_id", "d", "n", "length", F.col("run_x1").alias("k1"), F.col("run_x2").alias("k2"), *before)


def _nodes(prefixes: DataFrame) -> DataFrame:
    """One row a prefix: k1, k2, p1, p2, conv_id, depth, n_convs, n, rep (its longest member) and rep_length."""
    longest = F.max(F.struct("length", (-F.col("conv_id")).alias("minus")))
    seen = prefixes.groupBy("k1", "k2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.min("n").alias("n"), longest.alias("long"))
    return seen.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n", (-F.col("long.minus")).alias("rep"), F.col("long.length").alias("rep_length"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 from (k1, k2, conv_id): SHA-256 of the ids in ascending order, comma-joined. Ids go in sorted blocks of at
    most 1,024 and are hashed as a stream, so a task holds one block however many conversations end at a node."""
    block = F.floor(F.col("conv_id") / F.lit(_BLOCK)).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    blocks = ends.groupBy("k1", "k2", block).agg(ids)

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if key == (k1, k2):
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, digest.hexdigest())])

    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids").mapInArrow(tidy(run), "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])


def peel(paths: DataFrame, scratch: Scratch, tag: str = "peel") -> list[DataFrame]:
    """The complete paths of each round, with totals. paths: path, parent (null for the root's), spot, remaining (child paths), leaves, saved.

    Each round the paths without remaining children are complete; their totals, summed by parent in the tasks first,
    reach the parents, whose counters go down. Complete paths leave the state."""
    done, step, pending = [], 0, scratch.save(f"{tag}-0", paths)
    while pending.limit(1).count():
        complete = pending.where("remaining = 0")
        sent = complete.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        got = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias(own)
        left = pending.where("remaining > 0").join(sent, "path", "left")
        step += 1
        left = scratch.save(f"{tag}-{step}", left.select("path", "parent", "spot", (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining"), got("leaves", "more_leaves"), got("saved", "more_saved")))
        done.append(complete)
        pending = left
    return done


def trie(turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(turns.sparkSession, "trie")
    prefixes = _prefixes(rebuilt(turns, scratch, family, heads), scratch)
    ends = scratch.save("ends", ends_digest(prefixes.where("d = length").select("k1", "k2", "conv_id")))
    nodes = scratch.save("nodes", _nodes(prefixes))
    for name in ("placed", "prefixes", "convs"):
        scratch.drop(name)
    below = nodes.where("depth > 0")
    children = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    parents = children.join(nodes.select("k1", "k2", F.col("conv_id").alias("parent_conv_id"), F.col("rep").alias("parent")), ["k1", "k2"]).withColumnsRenamed({"k1": "p1", "k2": "p2"})
    found = lookup(below.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n", "rep", "rep_length"), parents, ["p1", "p2"], "children", below.count()).drop("p1", "p2")
    root = nodes.where("depth = 0").select("k1", "k2", "conv_id", "depth", "n_convs", "n", "rep", "rep_length", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("long").alias("parent"))
    known = scratch.save("known", found.unionByName(root))
    scratch.drop("nodes")

    own = ((F.col("n_convs") - 1) * F.col("n")).alias("saved")
    tops = known.where(F.col("parent").isNull() | (F.col("parent") != F.col("rep"))).select(F.col("rep").alias("path"), "parent", (F.col("depth") - 1).alias("spot"))
    inside = known.groupBy(F.col("rep").alias("path")).agg(F.sum(own).alias("saved"))
    hanging = tops.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("remaining"))
    paths = tops.join(inside, "path").join(hanging, "path", "left").select("path", "parent", "spot", F.coalesce("remaining", F.lit(0)).alias("remaining"), F.lit(1).cast("long").alias("leaves"), "saved")
    done = peel(paths, scratch)
    if not done:
        return known.select("conv_id", "depth", "parent_conv_id", "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    complete = done[0]
    for more in done[1:]:
        complete = complete.unionByName(more)
    sent = complete.where("parent IS NOT NULL").groupBy(F.col("parent").alias("rep"), F.col("spot").alias("depth")).agg(F.count("*").alias("hang"), F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
    plus = lambda value, got: (value + F.coalesce(got, F.lit(0))).cast("long")
    held = known.join(sent, ["rep", "depth"], "left")
    held = held.select("*", plus(F.when(F.col("depth") == F.col("rep_length"), 1).otherwise(0), "got_leaves").alias("leaves"), plus(own, "got_saved").alias("saved"), plus(F.when(F.col("depth") < F.col("rep_length"), 1).otherwise(0), "hang").alias("n_children"))
    keep = {c: F.col(c) for c in ("rep", "k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved")}
    out = running(held, ["rep"], [F.col("depth").desc()], scratch, "totals", keep, sums=("leaves", "saved"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.join(ends, ["k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    result = scratch.save("result", out)
    scratch.keep("result")
    return result
