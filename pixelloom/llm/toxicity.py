"""Toxicity of texts after noisy-channel deobfuscation.

Channel: a writer hides letters behind look-alikes (1diot, m0ron), puts separators between them (s.c.u.m, t r a s h) or
repeats them (stuuupid). A suspicious string becomes a lattice: at each position the letters that may stand behind the
character, or nothing (separators, repeats). Viterbi decoding under a character trigram model finds the likeliest
letters; the restored words are scored with the text's own.

Learning reads every labelled row (held-out rows left out), in aggregations with partial sums. Texts that are copies of one another
as a whole (`line_dedup.groups`: exact ones, and near ones by verified sketches) count as one together: each row weighs 1 / the
rows of its group. A common beginning, end or notice makes no copies. Words and their beginnings (4 to 6
letters) get log-odds by label where toxic documents of weight `support` have them; the character model is trained on the
words, the toxic ones weighted up; a logistic regression on three sums of log-odds, fitted across halves, gives the
probability. Weights are summed as integers, so the model does not depend on the rows' order. It has at most `most`
features and the trigrams of letters that occur, so it can be broadcast. Language, source, id and label are never inputs
of a score.

Defined results: null and empty texts get the score of a text without features, which is below 0.5; without labelled rows of both kinds,
or words that tell them apart, every score is 0; repeated rows are scored alike and count as one; a label that is null or not 0/1 is left out, of two labels of one id the lower counts; extra columns stay in
`keep_clean` and are ignored by `score`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Scratch, looked_up, release, tidy
from pixelloom.llm.line_dedup import _joined, groups, many, mark_of

#: A row's whole weight: parts of up to 16 equal rows are exact; thresholds bear SLACK for the rounding of others.
ONE = 720_720 << 8
SLACK = ONE // 1000

#: Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
_SIGNS = re.escape("".join(LOOKALIKES))
_WORD = re.compile(r"[^\W\d_]+")
_LEET = re.compile(rf"(?=.*[^\W\d_])(?=.*[{_SIGNS}])[\w{_SIGNS}]{{3,}}")
_SPACED = re.compile(rf"(?<!\w)[^\W_](?:[ .\-_*~]{{1,2}}[^\W_]|[ .\-_*~]{{1,2}}[{_SIGNS}]){{2,}}(?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_MORE = re.compile(r"([^\W\d_])\1{3,}")  # more repeats say no more than three
_OUTSIDE = re.compile(rf"[^\w{_SIGNS}]+")
_EDGES = ".,;:?\"'()[]"


#: Longer runs are decoded in stretches of so many characters, each half over the one before.
STRETCH = 48


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The whole text, or overlapping stretches of it."""
    return [text] if len(text) <= size else [text[i : i + size] for i in range(0, len(text) - size // 2, size // 2)]


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class CharModel:
    """Trigram model of letters with interpolation; ^ begins and $ ends a word."""

    three: Counter = field(default_factory=Counter)
    two: Counter = field(default_factory=Counter)
    one: Counter = field(default_factory=Counter)
    before: Counter = field(default_factory=Counter)
    total: float = 0.0
    _known: dict = field(default_factory=dict)

    def train(self, words: dict[str, float]) -> CharModel:
        for word, weight in words.items():
            a, b = "^", "^"
            for c in word + "$":
                self.add(a, b, c, weight)
                a, b = b, c
        return self

    def add(self, a: str, b: str, c: str, weight: float) -> None:
        self.three[a, b, c] += weight
        self.two[b, c] += weight
        self.one[c] += weight
        self.before[a, b] += weight
        self.before[b] += weight
        self.total += weight

    def cost(self, a: str, b: str, c: str) -> float:
        if (a, b, c) not in self._known:
            p = 0.7 * self.three[a, b, c] / max(self.before[a, b], 1e-9) + 0.25 * self.two[b, c] / max(self.before[b], 1e-9) + 0.05 * (self.one[c] + 1) / (self.total + 100)
            self._known[a, b, c] = -math.log(max(p, 1e-12))
        return self._known[a, b, c]


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, and the channel's cost; '' is nothing."""
    out = []
    for i, c in enumerate(text):
        if c.isalpha():
            options = [(c, 0.0)]
            if i and text[i - 1] == c:
                options.append(("", 0.5))
        else:
            options = [(x, 1.0) for x in LOOKALIKES.get(c, "")]
            if not c.isdigit():
                options.append(("", 0.7))
        out.append(options or [("", 1.5)])
    return out


def decode(text: str, model: CharModel) -> str:
    """The likeliest letters behind the text: Viterbi over states of the last two letters."""
    best: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    for options in lattice(text):
        new: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (cost, so_far) in best.items():
            for c, channel in options:
                state = (b, c) if c else (a, b)
                at = cost + channel + (model.cost(a, b, c) if c else 0.0)
                if state not in new or at < new[state][0]:
                    new[state] = (at, so_far + c)
        best = new
    return min((cost + model.cost(a, b, "$"), word) for (a, b), (cost, word) in best.items())[1]


class Tokens(dict):
    """token -> (word, log-odds) of the words in it, restored ones too, that speak for toxicity; tokens without such words
    are in `clean`. Bounded."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__()
        self.model, self.most, self.clean = model, most, set()

    def of(self, tokens: set[str]) -> dict[str, float]:
        """word -> log-odds of the words in all of them."""
        return {w: v for t in tokens.difference(self.clean) for w, v in self[t]}

    def __missing__(self, token: str) -> tuple[tuple[str, float], ...]:
        if len(self) + len(self.clean) >= self.most:
            self.clear()
            self.clean.clear()
        core = token.strip(_EDGES)
        plain = core.isalpha() and "(" not in token  # one word and signs outside the channel
        words = [core] if plain else _WORD.findall(token)
        if self.model.chars.total:
            for part in () if plain else {core, *_OUTSIDE.split(token)}:
                bare = _MORE.sub(r"\1\1\1", part)
                if not bare.isalpha() and _LEET.fullmatch(bare):
                    words += [decode(x, self.model.chars) for x in (*stretches(bare), *stretches(bare.rstrip("!|$+")))]
            for word in list(words):
                if _REPEATED.search(word):
                    words += [decode(x, self.model.chars) for x in stretches(_MORE.sub(r"\1\1\1", word))]
        found = tuple((w, v) for w in words if (v := self.model.best(w)) > 0)
        if found:
            self[token] = found
        else:
            self.clean.add(token)
        return found


@dataclass
class Model:
    weights: dict[str, float]
    chars: CharModel
    beta: list[float]
    tokens: Tokens | None = None

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Highest log-odds, their damped sum, and their sum relative to the text's size."""
        if self.tokens is None:
            self.tokens = Tokens(self)
        text = (text or "").lower()
        tokens = set(text.split())
        found = self.tokens.of(tokens)
        if self.chars.total:
            for m in _SPACED.finditer(text):
                # a one-letter word of its own may stand before or after the spaced one
                for part in (x for whole in (m[0], m[0][2:].lstrip(" .-_*~"), m[0][:-1].rstrip(" .-_*~")) for x in stretches(whole)):
                    word = decode(part, self.chars)
                    if (v := self.best(word)) > 0:
                        found[word] = v
                    # two spaced words in a row read as one: either may be a word with weight
                    for half in {h for i in range(3, len(word) - 2) for h in (word[:i], word[i:])}:
                        if (v := self.weights.get(half, 0.0)) > 0:
                            found[half] = v
        total = math.fsum(found.values())
        return max(found.values(), default=0.0), math.log1p(total), total / math.sqrt(1 + len(tokens))

    def best(self, word: str) -> float:
        get = self.weights.get
        n = len(word)
        out = get(word, 0.0)
        if n > 4:
            out = max(out, get(word[:4] + "*", 0.0))
            if n > 5:
                out = max(out, get(word[:5] + "*", 0.0))
                if n > 6:
                    out = max(out, get(word[:6] + "*", 0.0))
        return out

    def score(self, text: str | None) -> float:
        if not self.beta:
            return 0.0
        x = self.beta[0] + sum(b * v for b, v in zip(self.beta[1:], self.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """text, toxic, mark (the text's hash) of every labelled row that is not held out."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    once = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    rows = looked_up(rows, once, "doc_id") if once.count() <= most else rows.join(once, "doc_id")
    return rows.select("text", "toxic", mark_of(F.col("text")).alias("mark"))


def _weighted(train: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """text, toxic, weight, half of the rows of _labelled: those of one group of copies weigh as much as one, and are in one half."""
    grouped = groups(train, scratch, most // 100)
    sizes = train.groupBy("mark").agg(F.count("*").alias("n")).join(grouped, "mark", "left").select("mark", "n", F.coalesce("low", "mark").alias("low"))
    sizes = scratch.save("sizes", sizes)
    totals = sizes.groupBy("low").agg(F.sum("n").alias("rows"))
    weight = F.greatest(F.lit(1), F.round(F.lit(float(ONE)) / F.col("rows"))).cast("long")
    weights = scratch.save("weights", sizes.join(totals, "low").select("mark", weight.alias("weight"), F.col("low").bitwiseAND(1).cast("int").alias("half")))
    scratch.keep("train", "sizes", "weights")
    if weights.count() <= most:
        rows = looked_up(train, weights, "mark")
    else:
        rows = _joined(train, weights, "mark", "inner", 0, heavy=sizes.where(F.col("n") > many(train.count())))
    # kept as a table: Python steps on top of one another have a worker process each, which live on in all later stages
    rows = scratch.save("rows", rows.select("text", "toxic", "weight", "half"))
    scratch.drop("train")
    return rows


def _counts(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Of each word and beginning: its occurrences as a word, and the documents that have it by half (0, 1) and label (c, t),
    all in weights. Tasks count up to `most` features before they send them."""

    schema = "feature string, at int, n long, docs long"

    def sent(found: dict[tuple[int, int], tuple[Counter, Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (at, weight), (times, have, begun) in found.items():
            names, n = [*times, *(f + "*" for f in begun)], [*times.values()] + [0] * len(begun)
            docs = [have[w] for w in times] + [*begun.values()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([at] * len(n), pa.int32()), *(pa.array(np.array(x, np.int64) * weight) for x in (n, docs))], ["feature", "at", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for batch in batches:
            for text, toxic, weight, half in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = _words(text.as_py())
                if not words:
                    continue
                some, (times, have, begun) = set(words), found.setdefault((2 * half + toxic, weight), (Counter(), Counter(), Counter()))
                size -= len(times) + len(begun)
                times.update(words)
                have.update(some)
                begun.update({w[:4] for w in some if len(w) > 4} | {w[:5] for w in some if len(w) > 5} | {w[:6] for w in some if len(w) > 6})
                size += len(times) + len(begun)
                if size >= most:
                    yield from sent(found)
                    found, size = {}, 0
        yield from sent(found)

    of = lambda at: F.sum(F.when(F.col("at") == at, F.col("docs")).otherwise(0))
    return rows.mapInArrow(tidy(run), schema).groupBy("feature").agg(F.sum("n").alias("n"), *(of(at).alias(c) for at, c in enumerate(("c0", "t0", "c1", "t1"))))


def _log_odds(counts: DataFrame, clean: Column, toxic: Column, n: tuple[float, float], support: int, most: int) -> dict[str, float]:
    """The features with the highest log-odds; n are the documents of either label."""
    odds = F.log((toxic / ONE + 0.5) / (n[1] + 1)) - F.log((clean / ONE + 0.5) / (n[0] + 1))
    chosen = counts.select("feature", clean.alias("c"), toxic.alias("t"), odds.alias("odds")).where((F.col("t") >= support * ONE - SLACK) & (F.col("odds") >= 2.0))
    rows = chosen.orderBy(F.desc("odds"), F.desc("feature")).limit(most).collect()
    return {r.feature: math.log((r.t / ONE + 0.5) / (n[1] + 1)) - math.log((r.c / ONE + 0.5) / (n[0] + 1)) for r in rows}


def _trigrams(counts: DataFrame, most: int = 50_000) -> dict[str, float]:
    """Sums over the words that occur more than once: trigram -> square roots of the words' occurrences."""
    part = float(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for word, weight in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                word = f"^^{word.as_py()}$"
                for i in range(len(word) - 2):
                    found[word[i : i + 3]] += weight
                if len(found) >= most:
                    yield _batch("trigram string, weight long", list(found.items()))
                    found = Counter()
        if found:
            yield _batch("trigram string, weight long", list(found.items()))

    words = counts.where(F.col("n") > ONE + SLACK).select("feature", F.round(F.sqrt(F.col("n") / ONE) * part).cast("long").alias("weight"))
    sums = words.mapInArrow(tidy(run), "trigram string, weight long").groupBy("trigram").agg(F.sum("weight").alias("weight"))
    return {r.trigram: r.weight / part for r in sorted(sums.collect())}


def _evidence(rows: DataFrame, parts: list[Model]) -> DataFrame:
    """x0, x1, x2 (evidence by the model of the other half), toxic, weight of all rows with these."""
    sent = rows.sparkSession.sparkContext.broadcast(parts)
    schema = "x0 double, x1 double, x2 double, toxic int, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value
        for batch in batches:
            found: Counter = Counter()
            for text, toxic, weight, half in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                found[(*parts[1 - half].evidence(text.as_py()), toxic)] += weight
            if found:
                yield _batch(schema, [(*x, weight) for x, weight in found.items()])
        for part in parts:
            part.tokens = None

    return rows.mapInArrow(tidy(run), schema).groupBy("x0", "x1", "x2", "toxic").agg(F.sum("weight").alias("weight"))


def _logistic(rows: DataFrame, ridge: float = 0.01, steps: int = 30) -> list[float]:
    """Ridge regression by Newton's steps. More evidence never lowers the score: features whose weight comes out negative
    are left out, the lowest first."""
    used = [0, 1, 2]
    while True:
        beta = _newton(rows, used, ridge, steps)
        low = int(np.argmin(beta[1:])) if used else 0
        if not used or beta[1 + low] >= 0:
            out = [0.0] * 4
            out[0] = min(round(float(beta[0]), 6), -0.1)  # a text without evidence is not toxic, whatever share of the labels is
            for k, b in zip(used, beta[1:], strict=True):
                out[k + 1] = round(float(b), 6)  # beyond the noise of sums in another order
            return out
        del used[low]


def _newton(rows: DataFrame, used: list[int], ridge: float, steps: int) -> np.ndarray:
    """Each step is one aggregation of all rows."""
    x = [F.lit(1.0), *(F.col(f"x{k}") for k in used)]
    at, beta = range(len(x)), np.zeros(len(x))
    for _ in range(steps):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        known = rows.withColumn("p", 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))).withColumn("w", F.col("weight") / ONE)
        sums = known.agg(
            *(F.sum(F.col("w") * x[i] * (F.col("p") - F.col("toxic"))) for i in at),
            *(F.sum(F.col("w") * x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i in at for j in at),
        ).first()
        gradient = np.array(sums[: len(x)]) + ridge * beta
        step = np.linalg.solve(np.array(sums[len(x) :]).reshape(len(x), -1) + ridge * np.eye(len(x)), gradient)
        beta -= step
        if np.abs(step).max() < 1e-7:  # the next step is less than a rounding error
            break
    return beta


def learned(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", support: int = 5, most: int = 20_000, most_broadcast: int = 1_000_000) -> Model:
    """Fitted on all labelled rows but those of the held-out fold. Labels and weights are sent as sorted arrays up to `most_broadcast`
    counted rows, else joined by a shuffle; tables of copies are broadcast up to a hundredth of that."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    try:
        train = scratch.save("train", _labelled(docs, labels, folds, held, id_col, text_col, most_broadcast))
        rows = _weighted(train, scratch, most_broadcast)
        sizes = {(r.half, r.toxic): r.weight / ONE for r in rows.groupBy("half", "toxic").agg(F.sum("weight").alias("weight")).collect()}
        n = [tuple(sizes.get((half, k), 0.0) for k in (0, 1)) for half in (0, 1)]
        both = (n[0][0] + n[1][0], n[0][1] + n[1][1])
        if not all(both):
            return Model({}, CharModel(), [])
        counts = scratch.save("counts", _counts(rows).where((F.col("n") > ONE + SLACK) | (F.col("t0") + F.col("t1") >= support * ONE - SLACK)))
        weights = _log_odds(counts, F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"), both, support, most)
        if not weights:  # nothing tells the labels apart: their shares alone reject nobody
            return Model({}, CharModel(), [])
        parts = [Model(_log_odds(counts, F.col(f"c{half}"), F.col(f"t{half}"), n[half], support, most), CharModel(), []) for half in (0, 1)]
        beta = _logistic(scratch.save("evidence", _evidence(rows, parts)))
        chars, trigrams = CharModel(), _trigrams(counts)
        for key, weight in trigrams.items():
            chars.add(*key, weight)
        toxic = {w: v for w, v in weights.items() if not w.endswith("*")}
        lift = 0.25 * sum(v for key, v in trigrams.items() if key.startswith("^^")) / max(1e-9, sum(toxic.values()))
        return Model(weights, chars.train({w: lift * v for w, v in toxic.items()}), beta)
    finally:
        scratch.drop()
        release()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability that the text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])
        model.tokens = None  # the worker process lives on in other stages, which need the memory

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score(docs, learned(docs, labels, folds=folds, held=held, id_col=id_col, text_col=text_col), id_col, text_col)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % folds == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, all columns kept."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))
        model.tokens = None

    return docs.mapInArrow(tidy(run), docs.schema)
