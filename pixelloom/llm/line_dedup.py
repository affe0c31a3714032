"""Line dedup by a log-template tree.

A line of a document goes down a tree of fixed depth: by its number of tokens, then by its first `lead` tokens; tokens with
digits are variable fields and count as equal. At the leaf the rest is cut into `parts` stretches. A line has one
template of all stretches and, where each stretch has a token (`lead + parts` tokens at least, and one more), one for each
stretch left open, which generalises fields that vary inside it. All keys of a line come from its own tokens, so the
tree needs no order of lines and no leaf is ever held in one place.

A template recurs when `min_docs` texts that are no copies of one another have it; `min_long` texts suffice for templates of
`long_from` tokens, which do not meet by chance, while templates of fewer than `short_to` tokens need `min_short`. All lines
of recurring templates are dropped, be they alone or in blocks, in every document, copies included.

Copies are the near-duplicate stage's business, so each group of them counts as about one text. A text has `bands` bands: the
least hash of the 5-word shingles of each third of it, three together. Near copies share a third's least shingle with about
their similarity s, hence a band with 1 - (1 - s ** 3) ** bands, over 0.9999 at 0.8. A band only proposes: a text is linked to
the one with the smallest hash in the band if at least AGREE of their sketches are equal, the least hashes of the word
pairs of each third by `pairs` hash functions. Scattered edits leave most pairs of words alone (0.9 of them at 0.8), while
pages that have whole lines in common, but other lines between them, share no more pairs than longer shingles. Connected texts
are a group, counted by its smallest text alone.

Everything is found by aggregations with partial sums. Recurring templates are sent as sorted arrays up to a counted `most`; beyond
that they are joined, to the keys of texts and then to the texts.

Defined results: null and empty texts stay; blank lines stay, and lines of variable fields alone; a text whose lines all
go becomes empty; equal texts count once; ids play no part, so null or repeated ids do no harm; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import HashedWords, Scratch, looked_up, mix, release, tidy
from pixelloom.llm.components import components

_Q = 0xA0761D6478BD642F
_FIELD, _OPEN = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)
#: One odd factor for each band: the order of the products is the order of its hashes.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_ORDINARY, _LONG, _SHORT = 0, 1, 2  # the low bits of a key

#: Share of the sketch of word pairs that copies have in common at least.
AGREE = 35 / 48

RULES = {"min_docs": 3, "min_long": 2, "min_short": 10}
_SHAPE = {"lead": 3, "parts": 4, "long_from": 50, "short_to": 5, "bands": 24, "shingle": 5, "pairs": 16}


class Lines(HashedWords):
    """The template keys of the lines of many texts, and the sketches of the texts."""

    def __init__(self, lead: int, parts: int, long_from: int, short_to: int, bands: int, shingle: int, pairs: int):
        super().__init__(block=250_000)  # arrays of a block take up to a hundred bytes for each of its bytes
        self.lead, self.parts, self.long_from, self.short_to, self.bands, self.shingle, self.pairs = lead, parts, long_from, short_to, bands, shingle, pairs
        self.rise = self.fall = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.rise) < n:
            for name, base in (("rise", _Q), ("fall", pow(_Q, -1, 2**64))):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.cumprod(out, dtype=np.uint64))

    def of(self, texts: pa.Array, sketched: bool = False) -> Iterator[tuple]:
        """In blocks: number of the first text and of texts; of each line that has words its text, line number within it
        and keys (parts + 1 each; 0: none); the sketches of the texts, if wanted (a row of bands each)."""
        for first, raw, ends in self.blocks(texts):
            words, own, i, j = self.placed(raw, ends)
            digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
            fields = digits[j] > digits[i]
            words = np.where(fields, _FIELD, words)
            breaks = np.concatenate([[0], np.cumsum(raw == 10)])
            line = breaks[i] - breaks[np.concatenate([[0], ends[:-1]])][own]
            new = np.ones(len(words), bool)
            new[1:] = (line[1:] != line[:-1]) | (own[1:] != own[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(words))[: len(a)]
            self._powers(len(words) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.rise[: len(words)], dtype=np.uint64)])
            span = lambda x, y: mix((sums[y] - sums[x]) * self.fall[x] + (y - x).astype(np.uint64))  # noqa: E731, B023
            n = b - a
            head = np.minimum(n, self.lead)
            leaf = mix(span(a, a + head) * np.uint64(_Q) + n.astype(np.uint64))
            cuts = [a + head + (n - head) * q // self.parts for q in range(self.parts + 1)]
            opened = mix(_OPEN + np.arange(self.parts, dtype=np.uint64))
            stretches = [mix(span(cuts[q], cuts[q + 1]) + np.uint64(q + 1)) for q in range(self.parts)]
            total = sum(stretches[1:], stretches[0].copy())
            keys = np.stack([mix(leaf + total), *(mix(leaf + (total - s) + opened[q]) for q, s in enumerate(stretches))], 1)
            kind = np.where(n >= self.long_from, _LONG, np.where(n < self.short_to, _SHORT, _ORDINARY)).astype(np.uint64)
            keys = (keys & np.uint64(2**64 - 4)) | kind[:, None]
            keys[n <= self.lead + self.parts, 1:] = 0
            plain = np.concatenate([[0], np.cumsum(~fields)])
            keys[plain[b] == plain[a]] = 0
            yield first, len(ends), own[a], line[a], keys, self._sketches(own, len(ends), span) if sketched else None

    def _thirds(self, sizes: np.ndarray, span, k: int, factors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By hash function: the texts that have words, and the least hash of the k-word shingles of each third of them."""
        ends = np.cumsum(sizes)
        shingles = np.maximum(sizes - k + 1, np.minimum(sizes, 1))  # a shorter text is one shingle
        upto = np.cumsum(shingles)
        text = np.repeat(np.arange(len(sizes)), shingles)
        at = (ends - sizes)[text] + np.arange(len(text)) - (upto - shingles)[text]
        hashes = span(at, np.minimum(at + k, ends[text]))
        has = np.flatnonzero(shingles)
        if len(has):
            n, start = shingles[has], (upto - shingles)[has]
            low = start[:, None] + np.minimum(n[:, None] * np.arange(3) // 3, n[:, None] - 1)
            high = np.maximum(start[:, None] + n[:, None] * np.arange(1, 4) // 3, low + 1)
            bounds = np.stack([low, high], 2).ravel()
            padded = np.append(hashes, np.uint64(2**64 - 1))
            for f in range(factors):
                yield has, np.minimum.reduceat(padded * _FACTORS[f], bounds)[::2].reshape(-1, 3)

    def _sketches(self, own: np.ndarray, count: int, span) -> tuple[np.ndarray, np.ndarray]:
        """The bands of each text (a row of `bands`), and its sketch (a row of 3 * pairs, 32 bits of each least hash)."""
        sizes = np.bincount(own, minlength=count)
        out, sketch = np.zeros((count, self.bands), np.uint64), np.zeros((count, self.pairs, 3), np.uint32)
        for band, (has, least) in enumerate(self._thirds(sizes, span, self.shingle, self.bands)):
            out[has, band] = mix(mix(mix(least[:, 0]) + least[:, 1]) + least[:, 2] + np.uint64(band))
        for f, (has, least) in enumerate(self._thirds(sizes, span, 2, self.pairs)):
            sketch[has, f] = (mix(least) >> np.uint64(32)).astype(np.uint32)
        return out, sketch.reshape(count, -1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), _signed(values))


def mark_of(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def profile(docs: DataFrame, shape: dict, text_col: str = "text") -> DataFrame:
    """mark (the text's hash), bands, sketch, keys (once each) of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Lines(**shape)
        for batch in batches:
            marks = batch.column(1)
            for first, count, text, _, keys, (bands, sketch) in reader.of(batch.column(0), sketched=True):
                own, flat = np.repeat(text, keys.shape[1]), keys.ravel()
                own, flat = own[flat != 0], flat[flat != 0]
                order = np.lexsort((flat, own))
                own, flat = own[order], flat[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (flat[1:] != flat[:-1])
                some = np.bincount(text, minlength=count) > 0
                sizes = np.bincount(own[new], minlength=count)[some]
                yield pa.RecordBatch.from_arrays([marks.slice(first, count).filter(pa.array(some)), _lists(bands[some].ravel(), np.full(len(sizes), bands.shape[1])), pa.array([x.tobytes() for x in sketch[some]], pa.binary()), _lists(flat[new], sizes)], ["mark", "bands", "sketch", "keys"])

    return docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"), mark_of(docs[text_col]).alias("mark")).mapInArrow(tidy(run), "mark long, bands array<long>, sketch binary, keys array<long>")


def _joined(rows: DataFrame, few: DataFrame, on: str, how: str, most: int, salts: int = 32, heavy: DataFrame | None = None) -> DataFrame:
    """rows joined with few, whose key is unique: by a join's broadcast table up to `most` / 10 counted rows, by sorted arrays up to `most`
    where few is of whole numbers, else by a shuffle in which rows of one key are dealt to `salts` tasks. heavy: the few keys with
    many rows, where they are known; the others are not dealt then."""
    n = few.count()
    if n <= most // 10:
        return rows.join(F.broadcast(few), on, how)
    if n <= most and how != "left" and all(t in ("int", "bigint") for _, t in few.dtypes):
        return looked_up(rows, few, on, how)
    if heavy is None:
        dealt = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.withColumn("_salt", F.floor(F.rand(1) * salts).cast("int")).join(dealt, [on, "_salt"], how).drop("_salt")
    mark = F.broadcast(heavy.select(on, F.lit(True).alias("_heavy")))
    dealt = few.join(mark, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_heavy"), salts - 1).otherwise(0)))).drop("_heavy")
    salted = rows.join(mark, on, "left").withColumn("_salt", F.when(F.col("_heavy"), F.floor(F.rand(1) * salts).cast("int")).otherwise(0)).drop("_heavy")
    return salted.join(dealt, [on, "_salt"], how).drop("_salt")


def many(rows: int) -> int:
    """A key with more rows of these is dealt to several tasks: such keys are few, however many rows there are."""
    return max(1_000, rows // 200)


def groups(docs: DataFrame, scratch: Scratch, most: int = 1_000_000, text_col: str = "text", shape: dict | None = None) -> DataFrame:
    """mark (`mark_of` the text), low: the texts that are copies of others as a whole, and the smallest mark of their group."""
    found = scratch.save("sketches", profile(docs, _SHAPE | (shape or {}), text_col).drop("keys"))
    return copies(found, scratch, most).select(F.col("node").alias("mark"), F.col("component").alias("low"))


def copies(found: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """node (the mark of a text that has copies), component (the smallest mark of its group). found: mark, bands, sketch.

    A text has a pair for each different smallest text in its bands, `bands` at most; sketches of texts that are the smallest of some
    other's band are sent to the pairs up to a counted number, beyond that shuffled, those of many pairs dealt to several tasks."""
    flat = found.select(F.explode("bands").alias("band"), "mark")
    groups = flat.groupBy("band").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "low", "n")
    groups, often = scratch.save("bands", groups), many(found.count())
    pairs = scratch.save("pairs", _joined(flat, groups.drop("n"), "band", "inner", most, heavy=groups.where(F.col("n") > often)).where("mark > low").select("mark", "low").distinct())
    once = found.groupBy("mark").agg(F.first("sketch").alias("sketch"))
    lows = scratch.save("lows", once.join(pairs.select(F.col("low").alias("mark")).distinct(), "mark", "left_semi").withColumnsRenamed({"mark": "low", "sketch": "other"}))
    both = _joined(pairs.join(once, "mark"), lows, "low", "inner", most // 2, heavy=pairs.groupBy("low").count().where(F.col("count") > often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [(np.frombuffer(a.as_py(), np.uint32) == np.frombuffer(b.as_py(), np.uint32)).mean() >= AGREE for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    links = both.select("mark", "low", "sketch", "other").mapInArrow(tidy(run), "mark long, low long")
    return components(links.select(F.col("mark").alias("a"), F.col("low").alias("b")), scratch, "group")


def templates(docs: DataFrame, scratch: Scratch, min_docs: int, min_long: int, min_short: int, most: int, shape: dict, text_col: str = "text") -> DataFrame:
    """key, docs of the templates that recur."""
    found = scratch.save("texts", profile(docs, shape, text_col))
    once = found.groupBy("mark").agg(F.first("keys").alias("keys"))
    counted = _joined(once, scratch.save("copies", copies(found, scratch, most).where("component < node").select(F.col("node").alias("mark"))), "mark", "left_anti", most)
    kind = F.col("key").bitwiseAND(F.lit(3))
    least = F.when(kind == _LONG, min_long).when(kind == _SHORT, min_short).otherwise(min_docs)
    return scratch.save("templates", counted.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= least))


def _without(column: pa.Array, gone: dict[int, set[int]]) -> dict[int, str]:
    """The texts that lose lines: their place, what is left."""
    return {t: "\n".join([x for i, x in enumerate(column[t].as_py().split("\n")) if i not in numbers]) for t, numbers in gone.items()}


def _changed(batch: pa.RecordBatch, at: int, size: int | None, changed: dict[int, str]) -> list[pa.Array]:
    columns = list(batch.columns)
    if changed:
        columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(batch.column(at).to_pylist())], pa.string())
        if size is not None:
            columns[size] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(batch.column(size).to_pylist())], batch.column(size).type)
    return columns


def _hits(reader: Lines, column: pa.Array, known) -> dict[int, set[int]]:
    """text -> numbers of its lines that `known(first, text, keys)` marks."""
    gone: dict[int, set[int]] = {}
    for first, _, text, line, keys, _ in reader.of(column.fill_null("")):
        hit = known(first, text, keys)
        for t, i in zip(text[hit].tolist(), line[hit].tolist(), strict=True):
            gone.setdefault(first + t, set()).add(i)
    return gone


def drop(docs: DataFrame, keys: np.ndarray, shape: dict, text_col: str = "text") -> DataFrame:
    """The documents without the lines that have one of these template keys; n_chars, where there is one, follows."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))
    at, size = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Lines(**shape), sent.value

        def hit(first: int, text: np.ndarray, keys: np.ndarray) -> np.ndarray:
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return ((known[place] == keys) & (keys != 0)).any(1)

        for batch in batches:
            column = batch.column(at)
            yield pa.RecordBatch.from_arrays(_changed(batch, at, size, _without(column, _hits(reader, column, hit))), batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


_KEYS = "keys of recurring templates"


def drop_joined(docs: DataFrame, found: DataFrame, often: DataFrame, scratch: Scratch, most: int, shape: dict, text_col: str = "text") -> DataFrame:
    """The same with any number of keys: each text gets its own ones by two joins. found: `profile`; often: the keys."""
    own = found.groupBy("mark").agg(F.first("keys").alias("keys")).select("mark", F.explode("keys").alias("key"))
    own = scratch.save("own", _joined(own, often.select("key"), "key", "left_semi", most).groupBy("mark").agg(F.collect_list("key").alias(_KEYS)))
    rows = _joined(docs.withColumn("mark of the text", mark_of(docs[text_col])), own.withColumnRenamed("mark", "mark of the text"), "mark of the text", "left", most).select(_KEYS, *docs.columns)
    at, size = rows.columns.index(text_col), rows.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Lines(**shape)
        for batch in batches:
            column, lists = batch.column(at), batch.column(0).to_pylist()

            def hit(first: int, text: np.ndarray, keys: np.ndarray, lists=lists) -> np.ndarray:
                known = [set(lists[first + t] or ()) for t in range(int(text.max(initial=-1)) + 1)]
                return np.array([any(k in known[t] for k in row) for t, row in zip(text.tolist(), keys.view(np.int64).tolist(), strict=True)], bool)

            yield pa.RecordBatch.from_arrays(_changed(batch, at, size, _without(column, _hits(reader, column, hit)))[1:], batch.schema.names[1:])

    return rows.mapInArrow(tidy(run), docs.schema)


def dedup(docs: DataFrame, most: int = 1_000_000, shape: dict | None = None, text_col: str = "text", **rules) -> DataFrame:
    """The documents without the lines of recurring templates, all columns kept."""
    scratch, shape = Scratch(docs.sparkSession, "line-dedup"), _SHAPE | (shape or {})
    often = templates(docs, scratch, most=most, shape=shape, text_col=text_col, **(RULES | rules))
    total = often.count()
    if total == 0:
        scratch.drop()
        return docs
    if total <= most:
        keys = often.select("key").toArrow().column("key").to_numpy()
        scratch.drop()
        release()
        return drop(docs, keys, shape, text_col)
    scratch.keep("texts", "templates")
    return drop_joined(docs, docs.sparkSession.read.parquet(scratch.path("texts")), often, scratch, most, shape, text_col)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines and n_kept (lines with a word), kept_sha256 (of the text that is left) of every document."""
    count = lambda c: F.regexp_count(F.concat(F.lit("\n"), F.coalesce(c, F.lit(""))), F.lit(r"\n[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]")).cast("long")
    out = dedup(docs.select("doc_id", "text", count("text").alias("n_lines")), **options)
    return out.select("doc_id", "n_lines", count("text").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
