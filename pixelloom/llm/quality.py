"""Quality rules with DataFrame functions only: base counts per document, then robust multivariate outliers.

Base: words are runs of non-white-space. A document fails it with fewer than `min_words` words or with more than half
of its words inside repeated 3-word windows.

Outliers: the documents that pass the base rules give vectors of five transformed statistics (logarithms of words, word
length, symbol rate, duplicate-line rate, repeated-word rate), kept as whole 256ths so that sums are exact and every
run gives the same estimates. Each language and source has a minimum-covariance-determinant estimate:

1. Three starts: medians with interquartile ranges; plain moments; moments of the statistics' hyperbolic tangents around the
   medians, which bound what an outlier adds.
2. A concentration step takes the three quarters of the rows that are nearest by Mahalanobis distance, in bins of about
   3 %, and re-estimates mean and scatter from them. After two steps each group keeps the start whose scatter has the
   smallest determinant; then steps go on until no group's determinant falls any more (`most_steps` at most).
3. Estimates are shrunk: to what a source gathers, `prior` rows that are distributed as its language's estimate are added, to a
   language's as many of that of all documents. So a source of one document is judged too, mostly by its language, a large
   one by itself, and there is no size from which on groups are treated otherwise.

One aggregation by (group, bin) gives both the cut and the moments of all levels and starts, so no group's rows ever
meet in one task, whatever share a hot source has. Standard deviations have least values, so that a statistic that is
constant in a group does not reject every other value of it. A document is rejected where its squared distance, made
consistent for the normal distribution, exceeds `cutoff`, the 0.999999 quantile of chi-squared with five degrees of freedom.

Defined results: null, empty and blank texts have zero counts and fail the base; null languages and sources form groups
of their own; repeated rows are all judged; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import Scratch

WHITE = " \t\n\x0b\f\r"
NAMES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: 0.75 / P(chi-squared with 7 degrees <= 0.75-quantile with 5 degrees): makes the scatter of the nearest three quarters consistent.
CONSISTENCY = 1.412
FLOOR = (0.25, 0.15, 0.5, 0.3, 0.24)  # least standard deviation of each statistic: each can still reject alone within its range
CUTOFF = 35.888  # the 0.999999 quantile of chi-squared with 5 degrees of freedom
GROUP = ("level", "lang", "source")  # level 0: all documents, 1: a language, 2: a source within it
_D = range(len(NAMES))
_LOWER = [(i, j) for i in _D for j in range(i + 1)]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the base counts of every document; a narrow projection."""
    trimmed = F.btrim(F.coalesce(docs[text_col], F.lit("")), F.lit(WHITE))
    read = docs.select(docs[id_col].alias("doc_id"), docs["lang"].alias("lang"), docs["source"].alias("source"), docs[text_col].alias("text"), trimmed.alias("trimmed"))
    words = F.when(F.col("trimmed") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = read.select("doc_id", "lang", "source", words.alias("w"), lines.alias("lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("symbols"))
    # positions get as many low bits as they need; the others hold the window's hash
    cut = cut.withColumn("n", F.size("w")).withColumn("bits", F.ceil(F.log2(F.size("w") + F.lit(2))).cast("int"))
    marks = F.expr("transform(slice(w, 1, greatest(n - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), bits) | cast(i as bigint))")
    marked = cut.select(
        "doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.coalesce("symbols", F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), "bits", "w", F.sort_array(marks).alias("m"),
    )
    # equal hashes are looked up in the words: long texts leave few bits for them
    word = lambda x, k: f"get(w, cast({x} & (shiftleft(1L, bits) - 1L) as int) + {k})"
    same = lambda y: f"(shiftright(x, bits) = shiftright({y}, bits) and " + " and ".join(f"{word('x', k)} = {word(y, k)}" for k in range(3)) + ")"
    twice = F.expr(f"filter(m, (x, i) -> {same('get(m, i - 1)')} or {same('get(m, i + 1)')})")
    found = marked.withColumn("twice", twice).withColumn("starts", F.expr("sort_array(transform(twice, x -> x & (shiftleft(1L, bits) - 1L)))"))
    covered = F.expr("aggregate(starts, struct(-3L as last, 0L as total), (a, p) -> struct(p as last, a.total + least(3L, p - a.last) as total), a -> a.total)")
    out = found.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.alias("n_repeat_words"))
    return out


def _features(c: DataFrame) -> DataFrame:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (F.log(1 + F.col("n_words")), F.log(chars / n), F.log(1 + 1000 * F.col("n_symbols") / chars), F.log(1 + 10 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.log(1 + 10 * F.col("n_repeat_words") / n))
    return c.select("*", *(F.round(256 * v).cast("long").alias(name) for v, name in zip(values, NAMES, strict=True)))


def _distance(scale: float) -> Column:
    """Squared Mahalanobis distance: forward substitution with the Cholesky factor of the group's scatter."""
    z: list[Column] = []
    for i, name in enumerate(NAMES):
        v = F.col(name) - F.col(f"mu_{i}")
        for j in range(i):
            v = v - F.col(f"l_{i}_{j}") * z[j]
        z.append(v / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0]) / F.lit(scale)


def _factor(moments: DataFrame) -> DataFrame:
    """mu_i, the Cholesky factor l_i_j and the scatter's log-determinant from n, s_i and q_i_j, one column after the other."""
    keys = [*GROUP, "start", "rows"]
    out = moments.select(*keys, *((F.col(f"s_{i}") / F.col("n")).alias(f"mu_{i}") for i in _D), *((F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * (F.col(f"s_{j}") / F.col("n"))).alias(f"v_{i}_{j}") for i, j in _LOWER))
    for i in _D:
        out = out.withColumn(f"v_{i}_{i}", F.greatest(F.col(f"v_{i}_{i}"), F.lit((256 * FLOOR[i]) ** 2)))
    for i, j in _LOWER:
        rest = F.col(f"v_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}_{j}"))
    size = F.round(sum((F.log(f"l_{i}_{i}") for i in _D[1:]), F.log("l_0_0")), 6)
    return out.select(*keys, size.alias("size"), *(f"mu_{i}" for i in _D), *(f"l_{i}_{j}" for i, j in _LOWER))


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """a joined with b where the names are equal, null being equal to null; b's own names go."""
    b = b.withColumnsRenamed({n: f"_{n}" for n in names})
    on = [a[n].eqNullSafe(b[f"_{n}"]) for n in names]
    return a.join(b, on, how).drop(*(f"_{n}" for n in names))


def _levels(rows: DataFrame) -> DataFrame:
    """Every row in the groups of all levels."""
    none = F.lit(None).cast("string")
    groups = F.array(*(F.struct(F.lit(n).alias("level"), a.alias("lang"), b.alias("source")) for n, a, b in ((0, none, none), (1, F.col("lang"), none), (2, F.col("lang"), F.col("source")))))
    others = [c for c in rows.columns if c not in ("lang", "source")]
    return rows.select(F.explode(groups).alias("_g"), *others).select(*(F.col(f"_g.{k}").alias(k) for k in GROUP), *others)


def _sums(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s_{i}") for i in _D), *(F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i, j in _LOWER)]


_MOMENTS = ["n", *(f"s_{i}" for i in _D), *(f"q_{i}_{j}" for i, j in _LOWER)]


def pooled(sums: DataFrame, prior: float) -> DataFrame:
    """The sums with `prior` rows of the language, and the language's with as many of all documents, added."""

    def added(own: DataFrame, more: DataFrame, names: tuple[str, ...]) -> DataFrame:
        m = more.select(*names, *(F.col(c).alias(f"_{c}") for c in _MOMENTS))
        both = _same(own, m, names)
        return both.select(*GROUP, "start", "rows", *((F.col(c) + F.lit(prior) * (F.col(f"_{c}") / F.col("_n"))).alias(c) for c in _MOMENTS))

    sums = sums.select(*GROUP, "start", "rows", *(F.col(c).cast("double").alias(c) for c in _MOMENTS))
    top = sums.where("level = 0")
    langs = added(sums.where("level = 1"), top, ("start",))
    return top.unionAll(langs).unionAll(added(sums.where("level = 2"), langs, ("start", "lang")))


def starts(rows: DataFrame, scratch: Scratch, prior: float) -> DataFrame:
    """The parameters that each group starts from."""
    long = rows.select("lang", "source", F.posexplode(F.array(*NAMES)).alias("i", "x"))
    seen = _levels(long.groupBy("lang", "source", "i", "x").agg(F.count("*").alias("c"))).groupBy(*GROUP, "i", "x").agg(F.sum("c").alias("c"))
    order = W.partitionBy(*GROUP, "i")
    placed = seen.withColumn("rows", F.sum("c").over(order)).withColumn("upto", F.sum("c").over(order.orderBy("x")))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("rows"), F.col("x")))
    q = placed.groupBy(*GROUP, "i").agg(F.max("rows").alias("rows"), at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    one = lambda i, what: F.max(F.when(F.col("i") == i, what))
    middle = scratch.save("middle", q.groupBy(*GROUP).agg(F.max("rows").alias("rows"), *(one(i, F.col("mid").cast("double")).alias(f"m_{i}") for i in _D), *(one(i, F.greatest((F.col("high") - F.col("low")) / F.lit(1.349), F.lit(256.0 * FLOOR[i]))).alias(f"w_{i}") for i in _D)))
    quartiles = middle.select(*GROUP, F.lit(0).alias("start"), "rows", F.lit(0.0).alias("size"), *(F.col(f"m_{i}").alias(f"mu_{i}") for i in _D), *((F.col(f"w_{i}") if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in _LOWER))
    near = _same(_levels(rows), middle, GROUP)
    bounded = [F.round(1024 * F.tanh((F.col(n) - F.col(f"m_{i}")) / F.col(f"w_{i}"))).cast("long") for i, n in enumerate(NAMES)]
    plain = _sums([F.col(n) for n in NAMES])
    whole = near.groupBy(*GROUP, "rows").agg(*plain, *(c.alias(f"t{name}") for c, name in zip(_sums(bounded)[1:], _MOMENTS[1:], strict=True)))
    whole = scratch.save("whole", whole)
    moments = whole.select(*GROUP, F.lit(1).alias("start"), "rows", *(F.col(c).cast("double").alias(c) for c in _MOMENTS))
    # back from tangents: sums of m + w * t / 1024
    t = lambda c: F.col(f"t{c}") / F.lit(1024.0)
    m, w = (lambda i: F.col(f"m_{i}")), (lambda i: F.col(f"w_{i}"))
    turned = _same(whole, middle.drop("rows"), GROUP).select(
        *GROUP, F.lit(2).alias("start"), "rows", "n", *((F.col("n") * m(i) + w(i) * t(f"s_{i}")).alias(f"s_{i}") for i in _D),
        *((F.col("n") * m(i) * m(j) + m(i) * w(j) * t(f"s_{j}") + m(j) * w(i) * t(f"s_{i}") + w(i) * w(j) * (t(f"q_{i}_{j}") / F.lit(1024.0))).alias(f"q_{i}_{j}") for i, j in _LOWER),
    )
    gathered = scratch.save("gathered", moments.unionAll(turned))
    return scratch.save("starts", quartiles.unionAll(_factor(pooled(gathered, prior))))


def concentrated(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """The sums of the nearest `share` of each group's rows."""
    near = _same(_levels(rows), params.drop("size"), GROUP).withColumn("bin", F.floor(32 * F.log(1 + _distance(1.0))).cast("int"))
    keys = [*GROUP, "start", "rows"]
    binned = near.groupBy(*keys, "bin").agg(*_sums([F.col(n) for n in NAMES]))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*GROUP, "start").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = binned.withColumn("before", before).where(F.col("before") < F.ceil(share * F.col("rows")))
    return inside.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in _MOMENTS))


def estimate(rows: DataFrame, scratch: Scratch, share: float, prior: float, most_steps: int) -> DataFrame:
    """Mean and Cholesky factor of each group."""
    params = starts(rows, scratch, prior)
    names = [c for c in params.columns if c not in (*GROUP, "size", "start")]

    def step(name: str, params: DataFrame) -> DataFrame:
        return _factor(pooled(scratch.save(f"sums-{name}", concentrated(rows, params, share)), prior))

    def least(candidates: DataFrame) -> DataFrame:
        """Each group's parameters with the smallest determinant; of equal ones the lowest start."""
        return candidates.groupBy(*GROUP).agg(F.min(F.struct("size", "start", *names)).alias("_p")).select(*GROUP, *(F.col(f"_p.{c}").alias(c) for c in ("size", "start", *names)))

    params = scratch.save("first", step("first", params))
    params = scratch.save("second", least(step("second", params)).withColumn("start", F.lit(0)))
    for k in range(most_steps):
        new = step(str(k), params).withColumn("start", F.lit(1))
        chosen = scratch.save(f"step-{k}", least(params.unionByName(new)))
        if chosen.where("start = 1").isEmpty():
            break
        params = chosen.withColumn("start", F.lit(0))
    return params


def judge(docs: DataFrame, min_words: int = 50, share: float = 0.75, prior: float = 200.0, most_steps: int = 12, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base counts, base_failed, distance2 (null where the base failed) and kept, of every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    base = counts(docs).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = scratch.save("features", _features(base))
    passed = rows.where("not base_failed").select("lang", "source", *NAMES)
    params = scratch.save("params", estimate(passed, scratch, share, prior, most_steps).where("level = 2").drop("level", "start", "rows", "size"))
    far = _same(rows, params, ("lang", "source"), "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance(CONSISTENCY)))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"))
