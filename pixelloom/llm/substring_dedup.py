"""Substring dedup by level-wise doubling.

A window is `w` consecutive words (runs of non-white-space, unchanged) of one document. Each word that is covered by a window
whose words also start somewhere in a document with a smaller id is removed; windows are judged on the input.

1. One pass over the texts gives each document its words' SHA-256 and its anchors: of the stretches of ceil(w / 4) words
   in each window, the one with the least hash, the leftmost of equals. Equal windows have equal anchors at equal places, and
   there are about eight anchors per w words. Documents with equal words form a class that its smallest id stands for; the
   others lose whatever windows cover, so copies take no further part.
2. Levels. Anchors whose words occur in one document alone fall out. Those that repeat are extended to ceil(w / 2) words, to
   the right and to the left; whatever repeats to the right is extended to w words, to twice that, and so on, until no
   candidates survive. A window of at least w words that repeats in a smaller document settles all windows in it.
3. Windows of w words that no longer one settles, but whose anchor and its extensions inside the window all repeat, are compared
   themselves, wherever they start. The smallest document with a window is never settled on it, so nothing is missed.
4. Documents with settled or repeated windows are rewritten.

Levels are aggregations of (hash, smallest id, greatest id, count) with partial sums, joined back to their rows; hashes that
many rows have are sent to the rows (10,000 of them at most), so a passage in a third of all documents is dealt like any
other. Hashes of candidates are of 64 bits, those that decide of 96. Texts move only where a document still has a candidate.
Ids of such documents are broadcast up to a counted `most_broadcast`, to leave out other texts before the shuffle.

Defined results: null texts have no words; texts with fewer than w words keep all. A null id neither loses words nor makes others lose any.
Rows with one id are no smaller documents to each other, be they equal or not. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import _BASE, HashedWords, Scratch, _powers, mix, small_batches, tidy
from pixelloom.llm.scans import lookup

_OTHER = 0x9E6C63D0876A9A47
_KEY = ["doc_id", "mark"]


class _Windows:
    """Hashes of word windows of a block of texts; positions count the block's words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1)
        zero = np.zeros(1, np.uint64)
        self.one = np.concatenate([zero, np.cumsum(hashes * self.up[:n], dtype=np.uint64)])
        self.two = np.concatenate([zero, np.cumsum(mix(hashes ^ np.uint64(_OTHER)) * self.up[:n], dtype=np.uint64)])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.one[start + length] - self.one[start]) * self.down[start] + np.uint64(length)).view(np.int64)

    def second(self, start: np.ndarray, length: int) -> np.ndarray:
        return (mix((self.two[start + length] - self.two[start]) * self.down[start]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """For each i the leftmost place of the least of values[i : i + span]."""
    n = len(values) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, size = np.arange(len(values)), 1
    while size < span:
        step = min(size, span - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at[:n]


def _inside(starts: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
    """Starts of the windows of w words that lie in one text."""
    room = np.maximum(0, counts - w + 1)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())


def _minimal(windows: _Windows, starts: np.ndarray, counts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window of w words, place of its anchor)."""
    k = -(-w // 4)
    n = int(counts.sum())
    where = _inside(starts, counts, w)
    if not len(where):
        return where, where
    return where, _least(windows.at(np.arange(n - k + 1), k), w - k + 1)[where]


def _blocks(texts: pa.Array, reader: HashedWords):
    """(number of the first text, of the one after the last, _Windows, first word and number of words of each text)."""
    for first, raw, ends in reader.blocks(texts):
        hashes, number = reader.words(raw, ends)
        counts = np.bincount(number, minlength=len(ends))
        yield first, first + len(ends), _Windows(hashes), np.concatenate([[0], np.cumsum(counts)[:-1]]), counts


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(values)).cast(pa.list_(pa.array(values).type))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def profile(docs: DataFrame, w: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, words_sha256, at and gram: place and hash of each anchor."""

    def run(batches):
        reader = HashedWords(fold=False)
        for batch in batches:
            texts = batch.column(2)
            for first, end, windows, starts, counts in _blocks(texts, reader):
                where, anchor = _minimal(windows, starts, counts, w)
                places = np.unique(anchor)
                owner = np.searchsorted(starts, places, side="right") - 1
                owner = owner if not len(places) else np.maximum(owner, 0)
                share = np.bincount(owner, minlength=len(counts))
                part = texts.slice(first, end - first).cast(pa.large_binary())
                shas = [hashlib.sha256(b" ".join(t.as_py().split())).hexdigest() for t in part]
                grams = windows.at(places, -(-w // 4))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(counts.astype(np.int64)), pa.array(shas), _lists((places - starts[owner]).astype(np.int32), share), _lists(grams, share)],
                    names=["doc_id", "mark", "n_words", "words_sha256", "at", "gram"],
                )

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, mark long, n_words long, words_sha256 string, at array<int>, gram array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _shared(rows: DataFrame, on: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(low: the smallest id, n, for each key of several ids; how many rows have such keys)."""
    seen = rows.groupBy(*on).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high")
    table = scratch.save(name, seen)
    return table, table.agg(F.sum("n")).collect()[0][0] or 0


def _of_candidates(docs: DataFrame, keyed: DataFrame, most_broadcast: int) -> DataFrame:
    """keyed (its key is _KEY) with the texts."""
    texts = _texts(docs)
    if keyed.count() <= most_broadcast:
        texts = texts.join(F.broadcast(keyed.select(*_KEY)), _KEY, "left_semi")
    return texts.join(keyed, _KEY)


def _grown(texts: DataFrame, w: int) -> DataFrame:
    """For each anchor of `at`: the hashes of its extensions: `left`, and r1, r2 to the right, by ceil(w / 2), w, 2 w ... words."""
    k, half = -(-w // 4), -(-w // 2)

    def run(batches):
        reader = HashedWords(fold=False)
        for batch in batches:
            batch = {n: batch.column(n) for n in ("doc_id", "mark", "text", "at")}
            for first, end, windows, starts, counts in _blocks(batch["text"], reader):
                at, share = _flat(batch["at"].slice(first, end - first))
                owner = np.repeat(np.arange(len(counts)), share)
                place, room = at + starts[owner], counts[owner] - at
                sizes = [half] + list(itertools.takewhile(lambda n: n <= room.max(initial=0), (w << j for j in range(40))))
                fits = np.stack([room >= n for n in sizes], axis=1)
                one, two = np.zeros(fits.shape, np.int64), np.zeros(fits.shape, np.int32)
                for j, n in enumerate(sizes):
                    good = place[fits[:, j]]
                    one[fits[:, j], j], two[fits[:, j], j] = windows.at(good, n), windows.second(good, n)
                back = at >= half - k
                left = np.zeros(len(at), np.int64)
                left[back] = windows.at(place[back] - (half - k), half)
                levels = fits.sum(1)
                take = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["mark"].take(take), pa.array(at.astype(np.int32)), pa.array(left, mask=~back), _lists(one[fits], levels), _lists(two[fits], levels)], names=["doc_id", "mark", "at", "left", "r1", "r2"])

    return texts.mapInArrow(tidy(run), "doc_id long, mark long, at int, left long, r1 array<long>, r2 array<int>")


def _open_windows(texts: DataFrame, w: int) -> DataFrame:
    """doc_id, mark, p, c1, c2: start and hashes of each window of w words that may repeat and that no settled span holds."""
    k, half = -(-w // 4), -(-w // 2)

    def run(batches):
        reader = HashedWords(fold=False)
        for batch in batches:
            batch = {n: batch.column(n) for n in ("doc_id", "mark", "text", "right_at", "left_at", "span_from", "span_to")}
            for first, end, windows, starts, counts in _blocks(batch["text"], reader):
                n = int(counts.sum())

                def placed(name):
                    at, share = _flat(batch[name].slice(first, end - first))
                    return at + np.repeat(starts, share)

                right, left, settled = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
                right[placed("right_at")], left[placed("left_at")] = True, True
                np.maximum.at(settled, placed("span_from"), placed("span_to"))
                settled = np.maximum.accumulate(settled)
                p, a = _minimal(windows, starts, counts, w)
                good = ((p + w < a + half) | right[a]) & ((p > a - (half - k)) | left[a]) & (settled[p] < p + w)
                p = p[good]
                owner = np.searchsorted(starts + counts, p, side="right")
                take = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["mark"].take(take), pa.array((p - starts[owner]).astype(np.int32)), pa.array(windows.at(p, w)), pa.array(windows.second(p, w))], names=["doc_id", "mark", "p", "c1", "c2"])

    return texts.mapInArrow(tidy(run), "doc_id long, mark long, p int, c1 long, c2 int")


def _spans(docs: DataFrame, anchors: DataFrame, w: int, scratch: Scratch, most_broadcast: int) -> DataFrame:
    """doc_id, mark, begin, end: stretches of words that lie in windows repeated in a smaller document."""
    rows = anchors.select("doc_id", "mark", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("doc_id", "mark", "x.at", "x.gram")
    shared, total = _shared(rows, ["gram"], scratch, "level-0")
    alive = lookup(rows, shared.drop("low"), ["gram"], "n", total).groupBy(*_KEY).agg(F.collect_list("at").alias("at"))
    alive = scratch.save("alive", alive)
    state = scratch.save("grown", _grown(_of_candidates(docs, alive, most_broadcast), w))
    scratch.drop("level-0")

    lefts = state.where("left IS NOT NULL").select(*_KEY, "at", "left")
    shared, total = _shared(lefts, ["left"], scratch, "left")
    left_ok = scratch.save("left-ok", lookup(lefts, shared.drop("low"), ["left"], "n", total).select(*_KEY, F.col("at").alias("left_at")))

    settled, right_ok, level = None, None, 0
    state = state.drop("left")
    while True:
        now = state.where(F.size("r1") > level).select("*", F.element_at("r1", level + 1).alias("c1"), F.element_at("r2", level + 1).alias("c2"))
        shared, total = _shared(now, ["c1", "c2"], scratch, f"shared-{level}")
        if not total:
            break
        state = scratch.save(f"state-{level}", lookup(now, shared, ["c1", "c2"], "n", total).drop("c1", "c2"))
        if level:
            size = w << (level - 1)
            more = state.where("low < doc_id").select(*_KEY, F.col("at").alias("begin"), (F.col("at") + size).alias("end"))
            settled = more if settled is None else settled.unionByName(more)
        else:
            right_ok = state.select(*_KEY, F.col("at").alias("right_at"))
        state, level = state.drop("low"), level + 1
    scratch.drop("grown")

    spark, empty = docs.sparkSession, "doc_id long, mark long, "
    right_ok = right_ok if right_ok is not None else spark.createDataFrame([], empty + "right_at int")
    settled = settled if settled is not None else spark.createDataFrame([], empty + "begin int, end int")
    # for each start only the longest settled span matters
    settled = scratch.save("settled", settled.groupBy(*_KEY, "begin").agg(F.max("end").alias("end")))
    none = F.lit(None).cast("int")
    facts = right_ok.select(*_KEY, "right_at", none.alias("left_at"), none.alias("begin"), none.alias("end"))
    facts = facts.unionByName(left_ok.select(*_KEY, none.alias("right_at"), "left_at", none.alias("begin"), none.alias("end")))
    facts = facts.unionByName(settled.select(*_KEY, none.alias("right_at"), none.alias("left_at"), "begin", "end"))
    known = facts.groupBy(*_KEY).agg(F.collect_list("right_at").alias("right_at"), F.collect_list("left_at").alias("left_at"), F.collect_list(F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))).alias("span"))
    known = known.where("size(right_at) + size(left_at) > 0").select(*_KEY, "right_at", "left_at", F.col("span.begin").alias("span_from"), F.col("span.end").alias("span_to"))
    known = scratch.save("known", known)
    opened = scratch.save("open", _open_windows(_of_candidates(docs, known, most_broadcast), w))
    shared, total = _shared(opened, ["c1", "c2"], scratch, "shared-open")
    found = lookup(opened, shared, ["c1", "c2"], "n", total).where("low < doc_id").select(*_KEY, F.col("p").alias("begin"), (F.col("p") + w).alias("end"))
    return settled.unionByName(found)


def repeated_spans(docs: DataFrame, w: int, scratch: Scratch, most_broadcast: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(the profile of every row with `first`, the smallest id with the same words; for documents that are the first of theirs and
    share windows with smaller ones: doc_id, mark, and the stretches `begin`, `end` of their words, which may overlap).

    Where first < doc_id, all words are covered. Texts with fewer than w words have no `first`."""
    small_batches(docs.sparkSession)
    seen = scratch.save("profile", profile(docs, w))
    able = seen.where(f"n_words >= {int(w)} AND doc_id IS NOT NULL")
    lowest = able.groupBy("words_sha256").agg(F.min(F.struct("doc_id", "mark")).alias("lowest"), F.count("*").alias("n"), F.first("at").alias("at"), F.first("gram").alias("gram"))
    classes = scratch.save("classes", lowest.select("words_sha256", F.col("lowest.doc_id").alias("doc_id"), F.col("lowest.mark").alias("mark"), "n", "at", "gram"))
    spans = _spans(docs, classes.select("doc_id", "mark", "at", "gram"), w, scratch, most_broadcast)
    lists = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "end")).alias("span")).select(*_KEY, F.col("span.begin").alias("begin"), F.col("span.end").alias("end"))
    lists = scratch.save("lists", lists)
    # rows of the same id and words, but other white space, lose the same
    named = lists.join(classes.select(*_KEY, "words_sha256"), _KEY).drop("mark")
    firsts = classes.select("words_sha256", F.col("doc_id").alias("first"), "n")
    total = firsts.agg(F.sum("n")).collect()[0][0] or 0
    rows = lookup(seen.drop("at", "gram"), firsts, ["words_sha256"], "n", total, how="left")
    marks = seen.where("doc_id IS NOT NULL").select("doc_id", "mark", "words_sha256").distinct()
    return rows, scratch.save("spans", marks.join(named, ["doc_id", "words_sha256"]).drop("words_sha256"))


def _rewritten(texts: DataFrame, column: str, as_text: bool) -> DataFrame:
    """doc_id, mark, n_words, n_removed and the kept words, joined by spaces, or their SHA-256."""

    def run(batches):
        for batch in batches:
            out = []
            for text, begin, end in zip(batch.column("text").cast(pa.large_binary()), batch.column("begin"), batch.column("end"), strict=True):
                words = text.as_py().split()
                edges = np.bincount(begin.values.to_numpy(), minlength=len(words) + 1) - np.bincount(end.values.to_numpy(), minlength=len(words) + 1)
                covered = np.cumsum(edges)[:-1] > 0
                kept = b" ".join(itertools.compress(words, ~covered))
                out.append((len(words), int(covered.sum()), kept.decode() if as_text else hashlib.sha256(kept).hexdigest()))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "mark", "n_words", "n_removed", column])

    return texts.mapInArrow(tidy(run), f"doc_id long, mark long, n_words long, n_removed long, {column} string")


def digest(docs: DataFrame, w: int = 50, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces) for every row."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows, spans = repeated_spans(docs, w, scratch, most_broadcast)
    out = _rewritten(_of_candidates(docs, spans, most_broadcast), "kept_sha256", False).drop("mark")
    whole = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    removed = F.when(whole, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed")
    kept = F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("words_sha256")).alias("kept_sha256")
    rest = rows.join(spans.select(*_KEY), _KEY, "left_anti").select("doc_id", "n_words", removed, kept)
    result = scratch.save("result", rest.unionByName(out))
    scratch.keep("result")
    return result


def remove(docs: DataFrame, w: int = 50, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with the repeated stretches cut out of `text`: the kept words, joined by spaces. Texts that lose nothing stay as they are; texts
    that lose all become empty, or are dropped by the caller. Needs the columns doc_id and text; all others are kept."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows, spans = repeated_spans(docs, w, scratch, most_broadcast)
    new = _rewritten(_of_candidates(docs, spans, most_broadcast), "_kept", True).select("doc_id", "mark", "_kept")
    empty = rows.where("first < doc_id").select("doc_id", "mark", F.lit("").alias("_kept"))
    changed = new.unionByName(empty).dropDuplicates(_KEY).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(changed, (F.col("doc_id") == F.col("_id")) & (mark == F.col("_mark")), "left")
    return joined.select(*(F.coalesce("_kept", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
