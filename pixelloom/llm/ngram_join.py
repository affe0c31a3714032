"""N-gram Jaccard join with count-vector R-trees.

A document is the set of hashes of its distinct `k`-word shingles (words: runs of non-white-space after lower-casing
A-Z; with fewer than k words, the whole sequence is one shingle). Two documents link when
100 * |A & B| >= percent * |A | B|.

1. One pass profiles all documents: set size and 128-bit set hash, and the shingles that are frequent within blocks.
   Documents with equal sets form a class; the smallest id stands for it.
2. Cells. Ordered by (frequency, hash), the first n - ceil(percent * n / 100) + 1 shingles of two linked sets have one
   in common, whatever the order is. So only documents that share such a shingle, a cell, can link. Frequent shingles
   come last, so common passages open few cells; that table only orders, no result depends on it. Cells with equal
   members are one.
3. Members are points of counts per hash group. First every document takes, among up to eight seeds of its cells, the one
   with the highest overlap bound. Seeds are found by one aggregation and sent to the tasks among which a cell's
   members are dealt, each member to one, so this is linear; verified, these pairs join most groups of copies.
   Then each cell that still holds several components is searched with R-trees over the points, which skip nodes by
   the summed coordinate minima and nodes of one component; the pairs that survive are verified on the full sets.
   Large cells are dealt as pairs of chunks. A component that fills chunks has chunks of its own, which are not paired with
   each other, so that a large group of copies in a cell with few others costs no more than its size.

No link between components is lost, no group's pairs are all emitted, and nothing per document is sent to the driver.

Defined results: null, empty or blank texts have an empty set and stand alone; equal sets link; repeated rows are
repeated in the result with one component; a row without an id has no component; other columns are ignored. Ids name
one text each: a row that repeats an id with another text keeps its own set size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import HashedWords, Scratch, cut_count, mix, tidy
from pixelloom.llm.components import components
from pixelloom.llm.count_tree import CountTree, count_vector, enough

_M = np.uint64(0x9FB21C651E98DF25)
_EMPTY = np.empty(0, np.uint64)


class Shingles(HashedWords):
    """Sets of many texts at once, from the Arrow buffers: no string is made of a text or a word."""

    def __init__(self, k: int):
        super().__init__()
        self.k = k

    def _sets(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, text = self.words(raw, ends)
        k, many = self.k, np.bincount(text, minlength=len(ends))
        out = words[: max(0, len(words) - k + 1)].copy()
        for j in range(1, k):
            out *= _M
            out ^= out >> np.uint64(32)
            out += words[j : len(words) - k + 1 + j]
        inside = text[: len(out)] == text[k - 1 :]
        out, own = mix(out[inside]), text[: len(out)][inside]
        if len(short := np.flatnonzero((many > 0) & (many < k))):
            at, more = np.concatenate([[0], np.cumsum(many)]), []
            for i in short:
                whole = np.array([many[i]], np.uint64)
                for w in words[at[i] : at[i + 1]]:
                    whole = mix(whole * _M + w)
                more.append(whole[0])
            order = np.argsort(np.concatenate([own, short]), kind="stable")
            out, own = np.concatenate([out, np.array(more, np.uint64)])[order], np.concatenate([own, short])[order]
        cuts = np.searchsorted(own, np.arange(len(ends) + 1))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            out[i:j].sort()
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
        return out[new], np.bincount(own[new], minlength=len(ends))

    def of(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(number of the first text, the sets of it and those after it), in blocks. A set: sorted distinct hashes."""
        for i, raw, ends in self.blocks(texts):
            values, sizes = self._sets(raw, ends)
            yield i, np.split(values, np.cumsum(sizes)[:-1])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], list(columns))


def profile(docs: DataFrame, k: int, block: int = 2_000_000, often: int = 3) -> DataFrame:
    """kind 0: a document's id, set size, set hash. kind 1: a shingle and its count, where it occurs in `often` documents
    of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size = Shingles(k), [], 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held or [_EMPTY]), return_counts=True)
            tokens, counts = tokens[counts >= often], counts[counts >= often]
            zero = np.zeros(len(tokens), np.int64)
            return _table(kind=np.ones(len(tokens), np.int32), a=_long(tokens), b=counts.astype(np.int64), c=zero, d=zero)

        for batch in batches:
            n, c, d = [], [], []
            for _, block_sets in shingles.of(batch.column(1)):
                held += block_sets
                for found in block_sets:
                    x, y = struct.unpack("<qq", xxhash.xxh3_128_digest(found.tobytes()))
                    n.append(len(found))
                    c.append(x)
                    d.append(y)
                    size += len(found)
                if size >= block:
                    yield frequent()
                    held, size = [], 0
            yield _table(kind=np.zeros(len(n), np.int32), a=batch.column(0), b=np.array(n, np.int64), c=np.array(c, np.int64), d=np.array(d, np.int64))
        yield frequent()

    return docs.mapInArrow(tidy(run), "kind int, a long, b long, c long, d long")


def cells(docs: DataFrame, k: int, percent: int, order: pa.Table) -> DataFrame:
    """token, doc_id, often: the shingles that open cells. order: frequent shingles and their counts."""
    frequent, times = order.column(0).to_numpy().view(np.uint64), order.column(1).to_numpy()
    by = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[by], times[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (known, counts) = Shingles(k), sent.value
        for batch in batches:
            tokens, ids, often, size = [], [], [], 0
            doc_ids = batch.column(0).to_pylist()
            for doc_id, found in ((doc_ids[i + k], f) for i, block_sets in shingles.of(batch.column(1)) for k, f in enumerate(block_sets)):
                n = len(found)
                if doc_id is None or n == 0:
                    continue
                first = n - (percent * n + 99) // 100 + 1
                weight = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    weight = np.where(known[at] == found, counts[at], 0)
                rare = np.flatnonzero(weight == 0)
                if len(rare) >= first:  # the set is sorted by hash
                    chosen = rare[:first]
                else:
                    chosen = np.lexsort((found, weight))[:first]
                tokens.append(found[chosen])
                often.append(weight[chosen] > 0)
                ids.append(np.full(first, doc_id, np.int64))
                size += first
                if size > 500_000:
                    yield _table(token=_long(np.concatenate(tokens)), doc_id=np.concatenate(ids), often=np.concatenate(often))
                    tokens, ids, often, size = [], [], [], 0
            if tokens:
                yield _table(token=_long(np.concatenate(tokens)), doc_id=np.concatenate(ids), often=np.concatenate(often))

    return docs.mapInArrow(tidy(run), "token long, doc_id long, often boolean")


def shared(opened: DataFrame) -> DataFrame:
    """token, doc_id, once each, without the tokens that one document alone has. A frequent token needs no look: its rows
    are salted and stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ids = np.empty(0, np.int64), np.empty(0, np.int64)  # the last row, undecided
        was = False  # whether its token has been seen before it
        for batch in batches:
            new, docs, often = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if len(new) == 0:
                continue
            t, d, o = np.concatenate([token, new]), np.concatenate([ids, docs]), np.concatenate([[False] * len(token), often]).astype(bool)
            # repeated rows of a document would count twice in a cell's size and cancel in the hash of its members
            once = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
            t, d, o = t[once], d[once], o[once]
            same = t[1:] == t[:-1]
            keep = np.concatenate([[was and len(token) > 0], same])
            keep[:-1] |= same
            keep |= o
            yield _table(token=t[:-1][keep[:-1]], doc_id=d[:-1][keep[:-1]])
            token, ids, was = t[-1:], d[-1:], bool(keep[-1])
        if was:
            yield _table(token=token, doc_id=ids)

    salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(0)
    return opened.repartition(F.col("token"), salt).sortWithinPartitions("token", "doc_id").mapInArrow(tidy(run), "token long, doc_id long")


def points(docs: DataFrame, k: int, groups: int) -> DataFrame:
    """doc_id, counts: one byte a group where that holds the counts, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in batches:
            for at, found in shingles.of(batch.column(1)):
                counts = [count_vector(f, groups) for f in found]
                yield _table(doc_id=batch.column(0)[at : at + len(found)], counts=pa.array([(c.astype(np.uint8) if c.max() < 256 else c).tobytes() for c in counts], pa.binary()))

    return docs.mapInArrow(tidy(run), "doc_id long, counts binary")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in batches:
            for at, found in shingles.of(batch.column(1)):
                yield _table(doc_id=batch.column(0)[at : at + len(found)], tokens=pa.array([f.tobytes() for f in found], pa.binary()))

    return docs.mapInArrow(tidy(run), "doc_id long, tokens binary")


def small(df: DataFrame, most: int) -> DataFrame:
    """Marked to be broadcast where it has at most that many rows; joined by a shuffle otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first `keys` columns, of sorted batches."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in range(keys))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = reduce(np.logical_or, [np.diff(batch.column(c).to_numpy(zero_copy_only=False)) != 0 for c in range(keys)])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = batch.slice(i, j - i)
            if held and (n > 0 or key(held[-1], 0) != key(part, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _points(rows: pa.Table, groups: int) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.uint8 if len(c) == groups else np.uint32).astype(np.int64) for c in rows.column("counts").to_pylist()])


def leaders(members: DataFrame, located: DataFrame, percent: int, groups: int, seeds: int = 8, chunk: int = 512) -> DataFrame:
    """a, b: for document b the most promising earlier document a, by overlap bound, among the seeds of its cells: the
    smallest ids of `seeds` classes by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[float, int]] = {}

        def out() -> pa.RecordBatch:
            return _table(a=np.array([-v[1] for v in found.values()], np.int64), b=np.array(list(found), np.int64), score=np.array([v[0] for v in found.values()], np.float64))

        for rows in _groups(batches, 2):
            ids, points, seed = rows.column("doc_id").to_numpy(), _points(rows, groups), rows.column("seed").to_numpy()
            n, rest = points.sum(1), np.flatnonzero(~seed)
            for s in np.flatnonzero(seed):
                later = rest[ids[rest] > ids[s]]
                bound = np.minimum(points[s], points[later]).sum(1)
                good = enough(bound, n[s], n[later], percent)
                for i, k in zip(later[good].tolist(), bound[good].tolist(), strict=True):
                    b, mark = int(ids[i]), (k / float(n[s] + n[i]), -int(ids[s]))
                    if mark > found.get(b, (0.0, 0)):
                        found[b] = mark
            if len(found) > 100_000:
                yield out()
                found.clear()
        yield out()

    kind = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(seeds))
    first = members.groupBy("cell", "size").agg(*(F.min(F.when(kind == i, F.col("doc_id"))).alias(f"s{i}") for i in range(seeds)))
    parts = lambda: F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    sent = first.select("cell", F.explode(F.sequence(F.lit(0), parts() - 1)).alias("part"), F.array(*(f"s{i}" for i in range(seeds))).alias("s")).select("cell", "part", F.explode("s").alias("doc_id")).where("doc_id is not null")
    own = members.select("cell", F.pmod(F.xxhash64("doc_id"), parts()).cast("int").alias("part"), "doc_id")
    both = own.withColumn("seed", F.lit(False)).unionByName(sent.withColumn("seed", F.lit(True))).join(located, "doc_id")
    best = both.select("cell", "part", "seed", "doc_id", "counts").repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(tidy(run), "a long, b long, score double")
    return best.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")


def dealt(members: DataFrame, chunk: int, most_broadcast: int) -> DataFrame:
    """Every member (cell, size, doc_id, component) to the tasks x, y of its cell: one, or pairs of chunks. `own` is the
    chunk that it is in."""
    whole = members.where(F.col("size") <= chunk).select("cell", "doc_id", "component", *(F.lit(0).alias(c) for c in ("own", "x", "y")))
    wide = members.where(F.col("size") > chunk)
    # a component of half a chunk or more has chunks of its own; the others share some, each in one
    counts = wide.groupBy("cell", "component").agg(F.count("*").alias("n"))
    large = counts.where(2 * F.col("n") >= chunk).withColumn("k", F.ceil(F.col("n") / F.lit(chunk)).cast("int"))
    large = large.withColumn("first", (F.sum("k").over(W.partitionBy("cell").orderBy("component")) - F.col("k")).cast("int"))
    cells = counts.groupBy("cell").agg(F.sum(F.when(2 * F.col("n") >= chunk, F.ceil(F.col("n") / F.lit(chunk))).otherwise(0)).cast("int").alias("taken"), F.ceil(F.sum(F.when(2 * F.col("n") < chunk, F.col("n")).otherwise(0)) / F.lit(chunk)).cast("int").alias("shared"))
    placed = wide.join(small(cells, most_broadcast), "cell").join(small(large.drop("n"), most_broadcast), ["cell", "component"], "left")
    own = F.when(F.col("k").isNotNull(), F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("k"))).otherwise(F.col("taken") + F.pmod(F.xxhash64("component"), F.greatest("shared", F.lit(1)))).cast("int")
    total, none = F.col("taken") + F.col("shared"), F.expr("cast(array() as array<int>)")
    upto = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(none)
    others = F.when(F.col("k").isNull(), upto(F.lit(0), total - 1)).otherwise(F.concat(upto(F.lit(0), F.col("first") - 1), upto(F.col("first") + F.col("k"), total - 1)))
    pairs = placed.select("cell", "doc_id", "component", own.alias("own"), F.explode(others).alias("other"))
    return whole.unionByName(pairs.select("cell", "doc_id", "component", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))


def tree_pairs(members: DataFrame, located: DataFrame, percent: int, groups: int, most_broadcast: int, chunk: int = 512) -> DataFrame:
    """a, b: the pairs of different components in a cell that the R-tree's bounds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
            ids, own, label, points = rows.column("doc_id").to_numpy(), rows.column("own").to_numpy(), rows.column("component").to_numpy(), _points(rows, groups)
            if (label == label[0]).all():
                continue
            sides = [own == x] if x == y else [own == x, own == y]
            trees = [CountTree(points[s], label[s]) for s in sides if s.any()]
            if len(trees) < len(sides):
                continue
            p, q = ids[sides[0]], ids[sides[-1]]
            for i, j, _ in trees[0].pairs(trees[-1], percent):
                yield _table(a=np.minimum(p[i], q[j]), b=np.maximum(p[i], q[j]))

    columns = dealt(members, chunk, most_broadcast).join(located, "doc_id").select("cell", "x", "y", "own", "doc_id", "component", "counts")
    return columns.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, tag: str, most_broadcast: int, load: int = 64) -> DataFrame:
    """The pairs whose sets are similar. Only the sets of documents in pairs are made; those of the b of an a go to the
    same task as a's, an a of many is dealt to several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, []  # a, salt; the sets of a
        for batch in batches:
            a, b = [], []
            for key, salt, doc_id, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (key, salt) != last:
                    last, first = (key, salt), []
                found = np.frombuffer(tokens, np.uint64)
                if doc_id == key:
                    first.append(found)
                    continue
                for other in first:
                    if enough(len(np.intersect1d(other, found, assume_unique=True)), len(other), len(found), percent):
                        a.append(key)
                        b.append(doc_id)
                        break
            yield _table(a=np.array(a, np.int64), b=np.array(b, np.int64))

    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(load)).cast("int").alias("salts"))
    children = pairs.join(salts, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("doc_id"))
    heads = salts.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("doc_id"))
    places = scratch.save(f"{tag}-places", children.union(heads))
    full = sets(docs.join(small(places.select("doc_id").distinct(), most_broadcast), "doc_id", "left_semi"), k)
    rows = full.join(small(places, most_broadcast), "doc_id").select("key", "salt", "doc_id", "tokens")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id").mapInArrow(tidy(run), "a long, b long")


def join(docs: DataFrame, k: int = 5, percent: int = 80, groups: int = 512, id_col: str = "doc_id", text_col: str = "text", ordered: int = 500_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), class_id (the smallest id with the same
    set) of every document."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    seen = scratch.save("profile", profile(docs, k))
    frequent = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
    own = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "c", "d")
    # sets that are unlike all others need no second look
    classes = own.where("n_shingles > 0 and doc_id is not null").groupBy("c", "d", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.save("classes", classes)

    # `ordered` bounds what is sent: it only orders shingles, all of them take part
    opened = cells(docs, k, percent, frequent.where(F.col("n") >= cut_count(frequent, "n", ordered)).toArrow())
    common = scratch.save("shared", shared(opened).join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sizes = common.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("t")).where("size > 1")
    alone = sizes.groupBy("size", "s", "t").agg(F.min("token").alias("token")).select("token", "size")
    members = scratch.save("members", common.join(alone, "token").select(F.col("token").alias("cell"), "size", "doc_id"))

    near = docs.join(small(members.select("doc_id").distinct(), most_broadcast), "doc_id", "left_semi")
    located = scratch.save("points", points(near, k, groups))
    first = scratch.save("leaders", leaders(members, located, percent, groups))
    links = scratch.save("links", verified(first, docs, k, percent, scratch, "first", most_broadcast))
    found = components(links, scratch, "first").withColumnRenamed("node", "doc_id")
    labelled = scratch.save("labelled", members.join(found, "doc_id", "left").select("cell", "size", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    several = labelled.groupBy("cell").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("cell")
    rest = tree_pairs(scratch.save("several", labelled.join(several, "cell", "left_semi")), located, percent, groups, most_broadcast)
    rest = scratch.save("rest", rest.join(first, ["a", "b"], "left_anti"))
    links = scratch.save("all-links", links.union(verified(rest, docs, k, percent, scratch, "rest", most_broadcast)))
    found = scratch.save("components", components(links, scratch, "second").select(F.col("node").alias("class_id"), "component"))
    stands = classes.join(found, "class_id", "left").select("c", "d", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    result = own.join(stands, ["c", "d", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
    )
    result = scratch.save("result", result)
    scratch.keep("result")
    return result


def keep_one(docs: DataFrame, most_broadcast: int = 1_000_000, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stand for their component (its smallest id), all columns kept. Of rows that repeat such an id one
    stays; rows without an id all stay."""
    found = join(docs, most_broadcast=most_broadcast, id_col=id_col, **options)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(small(dropped, most_broadcast), id_col, "left_anti").select(*docs.columns)
    again = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col)
    if again.limit(1).count() == 0:
        return kept
    once = kept.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(once)
