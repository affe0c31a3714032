"""Benchmark decontamination by a broadcast hash set of the benchmark's word n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is `n` consecutive words of an
item; an item of fewer words is one window. Documents are scanned by a rolling hash over windows whose words all occur
in the benchmark; a hash hit is verified word by word.

The benchmark is broadcast only in parts of at most `part_chars` characters: its size is measured first, and a larger
one is cut into parts by a hash of the item, each scanned in a pass of its own. Every pass is a narrow map, so hot
sources or copies need no shuffle. What is dropped or cut is decided on the hits of all parts together.

Defined results: null and empty texts have no words and no hits; items without words have no windows; items
without an id hit as others do and count as one, null, among the items found; repeated rows give repeated results; an
empty benchmark hits nothing; the columns besides id and text are kept by `remove` and ignored by `scan`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Scratch, tidy

#: Lower-cases A-Z; bytes 00-2F, 3A-60 (after folding) and 7B-7F separate words.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 0x30 <= b <= 0x39 or 65 <= b <= 90 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class Windows:
    """The n-grams of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items_of: dict[bytes, set[str | None]] = defaultdict(set)
        lengths = defaultdict(set)
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded(text).split()], np.int32)
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                self.items_of[ids[i : i + k].tobytes()].add(item_id)
                lengths[k].add(ids[i : i + k].tobytes())
        self.by_length = {k: np.unique(self.hashes(np.array([np.frombuffer(w, np.int32) for w in sorted(ws)]))) for k, ws in sorted(lengths.items())}

    @staticmethod
    def hashes(windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), np.uint64)
        for j in range(windows.shape[1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + windows[:, j].astype(np.uint64)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str | None]]:
        """Which words are hit (None: no word), and by which items."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        known, hit, items = np.concatenate([[0], np.cumsum(ids > 0)]), None, set()
        for k, hashes in self.by_length.items():
            starts = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else []
            if len(starts) == 0:
                continue
            got = self.hashes(ids[starts[:, None] + np.arange(k)])
            at = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            for i in starts[hashes[at] == got]:
                if found := self.items_of.get(ids[i : i + k].tobytes()):
                    items |= found
                    hit = np.zeros(len(ids), bool) if hit is None else hit
                    hit[i : i + k] = True
        return hit, items


_BUILT: dict = {}
_SPANS = "spans of all parts"


def _windows(key: str, items: list, n: int) -> Windows:
    """Built once in a worker; the broadcast holds only the items' texts."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Windows(items, n)
    return _BUILT[key]


def runs(hit: np.ndarray) -> list[list[int]]:
    """[first word, word after the last] of each run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_chars: int) -> list[DataFrame]:
    """The items, in parts of about part_chars bytes at most: what is broadcast at once."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, math.ceil(2 * chars / part_chars)) if chars > part_chars else 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) for part in range(parts)]


def _pass(rows: DataFrame, items: DataFrame, key: str, n: int, last: bool) -> DataFrame:
    """Adds what these items hit to the spans and items of the rows; the last pass leaves the text behind."""
    sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, sent.value, n)
        for batch in batches:
            out = []
            for text, spans, items in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = folded(text.as_py()).split()
                hit, found = windows.scan(words)
                if hit is not None:
                    for i, j in spans:
                        hit[i:j] = True
                    spans, items = runs(hit), sorted(found | set(items), key=lambda x: (x is None, x or ""))
                out.append((len(words), spans, items))
            columns = [batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))]
            names = ["doc_id", "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(columns if last else [*columns, batch.column("text")], names if last else [*names, "text"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, spans array<array<int>>, items array<string>" + ("" if last else ", text string"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = 32_000_000) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words), items (ids of the items found, sorted; null last) of every document."""
    scratch, parts = Scratch(docs.sparkSession, "decontaminate"), _parts(benchmark, item_col, item_text_col, part_chars)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.expr("cast(array() as array<array<int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for i, items in enumerate(parts):
        rows = _pass(rows, items, f"{scratch.root}/{i}", n, i == len(parts) - 1)
        if i < len(parts) - 1:
            rows = scratch.save(str(i), rows)
    return rows


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the runs of words; a line break stands where a run stood."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    where = [m.span() for m in _WORD.finditer(folded(text))]
    for i, j in spans:
        out.append(raw[at : where[i][0]])
        at = where[j - 1][1]
    return b"\n".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = 32_000_000) -> DataFrame:
    """The documents without the hit spans, all columns kept; a document that has at least drop_share of its words hit
    goes. What stays holds no window any more: cutting is repeated until nothing is hit. Where an n_chars column is
    there, it follows the text."""
    scratch, parts = Scratch(docs.sparkSession, "remove"), _parts(benchmark, item_col, item_text_col, part_chars)
    if len(parts) == 1:
        return _cleaned(docs, parts[0], f"{scratch.root}/0", n, drop_share, text_col)
    done, names = [], docs.columns
    for turn in count():
        rows = docs.select(F.expr("cast(array() as array<array<int>>)").alias(_SPANS), *names)
        for i, items in enumerate(parts):
            rows = scratch.save(f"{turn}-{i}", _marked(rows, items, f"{scratch.root}/{i}", n, text_col))
            if i:
                scratch.drop(f"{turn}-{i - 1}")
        done.append(rows.where(F.size(_SPANS) == 0).select(*names))
        # the share is of the text as it came; what is cut may join words to new windows, of any part
        docs = scratch.save(f"{turn}-cut", _cut(rows.where(F.size(_SPANS) > 0), drop_share if turn == 0 else None, text_col))
        if docs.isEmpty():
            return reduce(DataFrame.unionAll, done)


def _marked(rows: DataFrame, items: DataFrame, key: str, n: int, text_col: str) -> DataFrame:
    """Adds what these items hit to the spans of the rows."""
    sent, at = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]), rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, sent.value, n)
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at), batch.column(0).to_pylist(), strict=True):
                hit, _ = windows.scan(folded(text.as_py()).split())
                if hit is not None:
                    for i, j in spans:
                        hit[i:j] = True
                    spans = runs(hit)
                out.append(spans)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.int32()))), *batch.columns[1:]], batch.schema.names)

    return rows.mapInArrow(tidy(run), rows.schema)


def _cut(rows: DataFrame, drop_share: float | None, text_col: str) -> DataFrame:
    """The rows without their spans; those with at least drop_share of their words hit go."""
    at, size = rows.columns.index(text_col), rows.columns.index("n_chars") if "n_chars" in rows.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, columns = batch.column(at).to_pylist(), batch.column(0).to_pylist(), list(batch.columns)
            keep = [drop_share is None or sum(j - i for i, j in s) < drop_share * len(folded(t).split()) for t, s in zip(texts, spans, strict=True)]
            texts = [cut(t, s) for t, s in zip(texts, spans, strict=True)]
            columns[at] = pa.array(texts, pa.string())
            if size is not None:
                columns[size] = pa.array([len(t) for t in texts], batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns[1:], batch.schema.names[1:]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.drop(_SPANS).schema)


def _cleaned(docs: DataFrame, items: DataFrame, key: str, n: int, drop_share: float, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    at, size = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, sent.value, n)
        for batch in batches:
            texts, keep, changed = batch.column(at).to_pylist(), [], {}
            for i, text in enumerate(texts):
                words = folded(text).split()
                hit, _ = windows.scan(words)
                if hit is None:
                    keep.append(True)
                    continue
                keep.append(bool(hit.sum() < drop_share * len(words)))
                while keep[-1] and hit is not None:
                    text = cut(text, runs(hit))
                    hit, _ = windows.scan(folded(text).split())
                changed[i] = text
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string())
                if size is not None:
                    lengths = batch.column(size).to_pylist()
                    columns[size] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(lengths)], batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The counts of `scan`, and one hash of the items found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s[1] - s[0]))
    return scan(docs, benchmark, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
