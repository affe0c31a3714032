"""Vector code compression: product codes whose nearest entries are found with a vantage-point tree for each part position.

Vectors become integers, floor(`scale` * x), and are cut into `parts` equal stretches. Each part position has a codebook of at most
`entries` integer entries; it starts as that part of the vectors with the smallest ids and is trained by `rounds` rounds
of exact k-means: assign to the nearest entry (squared distance, ties to the lower index), then replace each used entry
by the componentwise floor of its parts' mean. The codes are the nearest entries of the last codebooks.

A round is one aggregation: each task walks the trees for its batches and gives one partial sum per part, entry and
component, whatever its rows; what reaches the driver is the codebooks' own size. Vectors are never shuffled, so hot
vectors and labels do not matter. Errors summed by label are an aggregation that is joined back: labels are sent to the
tasks up to a counted `most_broadcast`, beyond that joined by a shuffle with salted rows.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. The dimension is the most
frequent length among the kept rows (the larger of equals); vectors of another length, of a length that `parts`
does not divide, or with a component of `LIMIT` or more after scaling have a null code and error and train nothing. Rows with one
id are rows of their own, taken in the order of their components; a null id comes last. With fewer vectors than entries
the codebooks are smaller; an empty table gives no row. Equal labels, nulls together, share a sum; one that would leave
the range of long is null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.ball_tree import Tree
from pixelloom.llm.common import tidy

#: Scaled components stay below this, so that squared distances of up to 512 components are exact in 64 bits.
LIMIT = 1 << 26


def _usable(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """The rows that are kept, with `q`, the scaled integers (null where a component is too large)."""
    good = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    small = F.forall(F.col(vector), lambda x: F.abs(x.cast("double")) < F.lit(LIMIT / scale))
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))
    return vectors.where(good).withColumn("q", F.when(small, scaled))


def _dimension(rows: DataFrame) -> int:
    """The most frequent length; an aggregation by length, whose rows are few: lengths are counted in the tasks."""
    found = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return found[0]["n"] if found else 0


def _trees(books: np.ndarray) -> list[Tree]:
    return [Tree(book) for book in books]


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """rows x parts x width of a list column without nulls whose lists have one length."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), parts, width)


def _sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x width, as exact Python integers) and counts of the vectors assigned to each entry."""
    parts, entries, width = books.shape

    def run(batches):
        trees, sums, counts = _trees(books), np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            points = _parts(batch.column(0), parts, width)
            for p in range(parts):
                index, _ = trees[p].nearest(points[:, p])
                counts[p] += np.bincount(index, minlength=entries)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    sums[p][used] += np.add.reduceat(points[order, p], starts, axis=0)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

    totals = rows.select("q").mapInArrow(tidy(run), "p int, e int, n long, s array<long>").groupBy("p", "e")
    out = totals.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]).alias("s")).collect()
    sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), object)
    for r in out:
        sums[r["p"], r["e"]], counts[r["p"], r["e"]] = [int(x) for x in r["s"]], r["n"]
    return sums, counts


def train(rows: DataFrame, id_column: str, dim: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks, parts x entries x width, from rows with the integers `q` of `dim` components."""
    first = rows.orderBy(F.col(id_column).asc_nulls_last(), "q").select("q").limit(entries).collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums, counts = _sums(rows, books)
        for p, e in zip(*np.nonzero(counts), strict=True):
            books[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
    return books


def digest_of(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The columns of rows but `q`, and `code`, `error`."""
    parts, _, width = books.shape
    kept = [c for c in rows.columns if c != "q"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "q")

    def run(batches):
        trees = _trees(books)
        for batch in batches:
            points = _parts(batch.column(batch.schema.get_field_index("q")), parts, width)
            codes, error = np.empty((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p in range(parts):
                codes[:, p], best = trees[p].nearest(points[:, p])
                error += best
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=[*kept, "code", "error"])

    return rows.mapInArrow(tidy(run), f"{schema}, code string, error long")


def _by_label(coded: DataFrame, most_broadcast: int, salts: int = 16) -> DataFrame:
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("error").alias("_known"))
    sums = sums.select(F.col("label").alias("_label"), F.when(F.col("_known") > 0, F.col("label_error")).alias("label_error"))
    same: Column = F.col("label").eqNullSafe(F.col("_label"))
    if coded.select("label").distinct().limit(most_broadcast + 1).count() <= most_broadcast:
        return coded.join(F.broadcast(sums), same, "left").drop("_label")
    dealt = sums.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return rows.join(dealt, same & (F.col("_salt") == F.col("_other")), "left").drop("_label", "_salt", "_other")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", most_broadcast: int = 1_000_000) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and the row's label. At most 256 entries a codebook."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    rows = _usable(vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("_vector"), F.col(label).alias("label")), "_vector", scale).drop("_vector")
    dim = _dimension(rows.where("q IS NOT NULL"))
    fits = F.coalesce(F.size("q") == dim, F.lit(False)) & F.lit(dim % parts == 0)
    good = rows.where(fits)
    if dim % parts == 0:
        books = train(good, "vec_id", dim, parts, entries, rounds)
        coded = _assigned(good, books)
    else:
        books = np.empty((parts, 0, 0), np.int64)
        coded = good.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    others = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return _by_label(coded.unionByName(others), most_broadcast).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"), "label")


def decode(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """The columns of codes and `vector`: the entries that the code names, scaled back. A null code gives a null vector."""
    width = books.shape[2]
    pool = F.array(*[F.array(*[F.lit(x / scale) for x in entry]) for entry in books.reshape(-1, width).tolist()])
    chosen = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + F.lit(p * books.shape[1]) for p in range(books.shape[0])]
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.flatten(F.array(*[F.get(pool, i) for i in chosen]))))
