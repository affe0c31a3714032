"""A hidden Markov language model.

Tokens: words (runs of non-white-space, A-Z lower-cased) as 64-bit hashes, then one end token. Words are dealt to
`buckets` buckets by hash; `states` latent states emit buckets, and a bucket emits its words by add-one counts:
P(text) = P_HMM(buckets) * product of (c + 1) / (C + V + 1), with c the word's count, C and V the bucket's tokens and
distinct words in the training documents. So the tables of the model are bounded while the counts of words cover the
whole corpus.

1. The counts of all training tokens, by map-side and reduce-side sums.
2. Baum-Welch. States start from the contexts of the buckets: how often each class of buckets comes before and after, counted
   over all training documents, a table of fixed size; weighted k-means over its rows tells the states apart. Then every round runs
   forward and backward over all training documents, in numpy over many pieces of `piece` tokens at once. A document's pieces are joined
   exactly: products of its pieces' transfer matrices give what the pass knows at each border. Expected counts are
   summed per task and then across partitions, in slices of the tables. Rounds end when the likelihood of a token gains less than
   `least_gain`, after `iterations` at most.
3. Scoring. The scaled forward recursion over whole documents, many at a time, gives exact likelihoods. Counts of the
   `known` most frequent words are broadcast in one table of fixed size; the other tokens are joined with all counts
   in a shuffle by word, so none is left out. No such word has more than a share of about 1 / `known` of all tokens, so no
   task of the join gets more.

Defined results: null and empty texts have the end token alone; without training documents all counts are zero and
the states stay uniform; repeated rows are scored alike; a null id belongs to the training rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import HashedWords, Scratch, cut_count, mix, tidy


class Params:
    """start (K), move (K, K), emit (buckets + 1, K): the last bucket is the end token's."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


class Counts:
    """Expected counts, the logarithm of the likelihood, and the number of tokens."""

    def __init__(self, buckets: int, states: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, buckets + 1))
        self.log, self.n = 0.0, 0

    def add(self, pieces: list[np.ndarray], first: list[bool], model: Params, before: np.ndarray | None = None, after: np.ndarray | None = None) -> None:
        """One forward-backward pass over pieces of similar length. `first` tells which begin a document; for the others `before` has the
        states' chances after the piece before, and `after` has what the pieces behind say about each piece's last state."""
        if not pieces:
            return
        k, n, m, begins = len(model.start), len(pieces), self.emit.shape[1], np.array(first)
        last = np.array([len(p) for p in pieces]) - 1
        longest, full = int(last.max()) + 1, int(last.min())
        at = np.full((longest, n), m, np.int64)
        for i, p in enumerate(pieces):
            at[: len(p), i] = p
        real = at < m
        # a step's numbers lie state by state, so that all operations run along the pieces; beyond its end a piece's chances of emission are 1
        emit, forward, scale = np.empty((longest, k, n)), np.empty((longest, k, n)), np.empty((longest, n))
        for s in range(k):
            emit[:, s] = np.append(model.emit[:, s], 1.0)[at]
        turned = np.ascontiguousarray(model.move.T)
        stay = np.tile(model.start, (n, 1)) if before is None else np.where(begins[:, None], model.start, before @ model.move)
        for t in range(longest):
            np.multiply(stay.T if t == 0 else turned @ forward[t - 1], emit[t], out=forward[t])
            forward[t].sum(0, out=scale[t])
            forward[t] /= scale[t]
        self.log += float(np.log(scale[real]).sum())
        self.n += int(last.sum()) + n
        ends = np.ones((k, n)) if after is None else np.ascontiguousarray((after / (forward[last, :, np.arange(n)] * after).sum(1, keepdims=True)).T)
        back, steps = np.ones((k, n)), np.zeros((k, k))
        ending = np.bincount(last, minlength=longest)
        for t in range(longest - 1, -1, -1):
            if ending[t]:
                here = last == t
                back[:, here] = ends[:, here]
            weighted = emit[t]
            weighted *= back
            weighted /= scale[t]
            forward[t] *= back  # what was the forward probability is needed no more
            if t > full:
                weighted *= real[t]
            if t:
                steps += forward[t - 1] @ weighted.T
                back = model.move @ weighted
            elif before is not None:
                steps += before[~begins].T @ weighted[:, ~begins].T
        self.move += model.move * steps
        self.start += forward[0][:, begins].sum(1)
        flat = at.ravel()
        for s in range(k):
            self.emit[s] += np.bincount(flat, weights=forward[:, s].ravel(), minlength=m + 1)[:m]

    def params(self, base: np.ndarray, weight: float = 20.0) -> Params:
        """Estimates, drawn a little towards the buckets' shares in the corpus."""
        emit = self.emit + weight * base + 1e-6 * base.mean()
        move = self.move + 1.0
        start = self.start + 1.0
        return Params(start / start.sum(), move / move.sum(1, keepdims=True), np.ascontiguousarray((emit / emit.sum(1, keepdims=True)).T))


def transfers(pieces: list[np.ndarray], first: list[bool], model: Params) -> np.ndarray:
    """The product of each piece's steps, K x K up to a factor: row vectors of chances before it become those after it."""
    k, n = len(model.start), len(pieces)
    order = np.argsort([-len(p) for p in pieces], kind="stable")
    lengths = np.array([len(pieces[i]) for i in order])
    at = np.zeros((lengths[0], n), np.int64)
    for j, i in enumerate(order):
        at[: lengths[j], j] = pieces[i]
    emit, turned = np.empty((lengths[0], k, n)), np.ascontiguousarray(model.move.T)
    for s in range(k):
        emit[:, s] = model.emit[:, s][at]
    # state after, state before, piece: one product of matrices a step
    found = np.where(np.array(first)[order], np.eye(k)[:, :, None], turned[:, :, None]) * emit[0][:, None, :]
    ended = np.empty((k, k, n))
    for t in range(1, lengths[0]):
        now = int(np.searchsorted(-lengths, -t, side="left"))  # how many are longer than t
        if now < n:
            ended[:, :, now:n], found, n = found[:, :, now:], found[:, :, :now], now
        found = (turned @ found.reshape(k, -1)).reshape(k, k, n)
        found *= emit[t][:, None, :n]
        if t % 8 == 0:
            found /= found.sum((0, 1))
    ended[:, :, :n] = found
    out = np.empty((len(pieces), k, k))
    out[order] = (ended / ended.sum((0, 1))).transpose(2, 1, 0)
    return out


class Documents(HashedWords):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def of(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, word hashes, number of words of each text) in blocks."""
        for i, raw, ends in self.blocks(texts):
            words, own = self.words(raw, ends)
            yield i, words, np.bincount(own, minlength=len(ends))

    def sequences(self, words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The buckets of each document, the end's last."""
        b = (words & np.uint64(self.buckets - 1)).astype(np.int32)
        return [np.append(s, np.int32(self.buckets)) for s in np.split(b, np.cumsum(sizes)[:-1])] if len(sizes) else []


class PieceBatches:
    """Collects documents in pieces and passes them on, those of similar length together."""

    def __init__(self, counts: Counts, model: Params, piece: int, most: int = 250_000):
        self.counts, self.model, self.piece, self.most = counts, model, piece, most
        self.pieces: list[np.ndarray] = []
        self.first: list[bool] = []
        self.held = 0

    def add(self, sequence: np.ndarray) -> None:
        for i in range(0, len(sequence), self.piece):
            self.pieces.append(sequence[i : i + self.piece])
            self.first.append(i == 0)
        self.held += len(sequence)
        if self.held >= 4 * self.most:
            self.flush()

    def _groups(self, chosen: list[int]) -> Iterator[list[int]]:
        group: list[int] = []
        for i in sorted(chosen, key=lambda i: len(self.pieces[i])):
            if group and ((len(group) + 1) * len(self.pieces[i]) > self.most or len(self.pieces[i]) > 1.5 * len(self.pieces[group[0]]) + 8):
                yield group
                group = []
            group.append(i)
        if group:
            yield group

    def _borders(self) -> tuple[np.ndarray, np.ndarray]:
        """(chances of the states before each piece, what is behind each piece)."""
        n, k = len(self.pieces), len(self.model.start)
        before, after, found = np.tile(self.model.start, (n, 1)), np.ones((n, k)), np.empty((n, k, k))
        followed = [*(not f for f in self.first[1:]), False]
        parts = [i for i in range(n) if followed[i] or not self.first[i]]
        for group in self._groups(parts):
            found[group] = transfers([self.pieces[i] for i in group], [self.first[i] for i in group], self.model)
        for i in parts:
            if followed[i]:
                state = before[i] @ found[i]
                before[i + 1] = state / state.sum()
        for i in reversed(parts):
            if not self.first[i]:
                state = found[i] @ after[i]
                after[i - 1] = state / state.sum()
        return before, after

    def flush(self) -> None:
        before, after = self._borders()
        for group in self._groups(list(range(len(self.pieces)))):
            self.counts.add([self.pieces[g] for g in group], [self.first[g] for g in group], self.model, before[group], after[group])
        self.pieces, self.first, self.held = [], [], 0


def likelihoods(sequences: list[np.ndarray], model: Params, most: int = 1_000_000) -> np.ndarray:
    """Natural logarithm of the probability of each sequence: scaled forward recursion, many sequences at once."""
    out = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    i = 0
    while i < len(order):
        longest = len(sequences[order[i]])
        group = order[i : i + max(1, most // longest)]
        i += len(group)
        lengths = np.array([len(sequences[g]) for g in group])
        at = np.zeros((longest, len(group)), np.int32)
        for j, g in enumerate(group):
            at[: lengths[j], j] = sequences[g]
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # how many are longer than t
        total, state = np.zeros(len(group)), None
        for t in range(longest):
            n = active[t]
            state = (model.start if t == 0 else state[:n] @ model.move) * model.emit[at[t, :n]]
            scale = state.sum(1)
            state /= scale[:, None]
            total[:n] += np.log(scale)
        out[group] = total
    return out


def vocabulary(docs: DataFrame, buckets: int, block: int = 3_000_000) -> DataFrame:
    """token, c: the counts of all words in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Documents(buckets), [], 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "c"])

        for batch in batches:
            for _, words, _ in reader.of(batch.column(0)):
                held.append(words)
                size += len(words)
                if size >= block:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return docs.select("text").mapInArrow(tidy(run), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _summed(docs: DataFrame, tables: Callable[[Iterator[pa.Array]], list[np.ndarray]], slices: int) -> list[np.ndarray] | None:
    """The sums over all tasks of each task's tables, flat, which cross the network in slices; None without any task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in enumerate(tables(batch.column(0) for batch in batches)):
            parts = [p.tobytes() for p in np.array_split(own.ravel(), slices)]
            yield pa.RecordBatch.from_arrays([pa.array([number * slices + i for i in range(slices)], pa.int32()), pa.array(parts, pa.binary())], ["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(raw.as_py(), np.float64)
                sums[i] = sums[i] + new if i in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "sums"])

    schema = "slice int, sums binary"
    summed = docs.select("text").mapInArrow(tidy(run), schema).repartition(slices, "slice").mapInArrow(tidy(add), schema)
    got = {r["slice"]: np.frombuffer(r["sums"], np.float64) for r in summed.collect()}  # a few tables of fixed size
    return [np.concatenate([got[i + j] for j in range(slices)]) for i in range(0, len(got), slices)] or None


def contexts(docs: DataFrame, tokens: np.ndarray, buckets: int, own: int = 16, dealt: int = 16, slices: int = 32) -> np.ndarray:
    """How often each class of buckets comes before and after each bucket: (buckets + 1, 2 * classes). The `own` most frequent buckets
    are classes of their own, the others are dealt to `dealt` by hash."""
    width = own + dealt
    of = own + (mix(np.arange(buckets + 1, dtype=np.uint64)) % np.uint64(dealt)).astype(np.int64)
    of[np.argsort(-tokens, kind="stable")[:own]] = np.arange(min(own, buckets + 1))

    def tables(texts: Iterator[pa.Array]) -> list[np.ndarray]:
        reader, found = Documents(buckets), np.zeros((buckets + 1) * 2 * width)

        def add(sequences: list[np.ndarray]) -> None:
            if not sequences:
                return
            flat, ends = np.concatenate(sequences).astype(np.int64), np.cumsum([len(s) for s in sequences])
            inner = np.ones(len(flat) - 1, bool)
            inner[ends[:-1] - 1] = False  # from one document's end to the next one's beginning
            left, right = flat[:-1][inner], flat[1:][inner]
            cells = np.concatenate([right * 2 * width + of[left], left * 2 * width + width + of[right]])
            found[:] += np.bincount(cells, minlength=len(found))

        held: list[np.ndarray] = []
        for text in texts:
            for _, words, sizes in reader.of(text):
                held += reader.sequences(words, sizes)
                if sum(map(len, held)) > 1_000_000:
                    add(held)
                    held = []
        add(held)
        return [found]

    got = _summed(docs, tables, slices)
    return np.zeros((buckets + 1, 2 * width)) if got is None else got[0].reshape(buckets + 1, 2 * width)


def initial(docs: DataFrame, base: np.ndarray, states: int, buckets: int, rounds: int = 25) -> Params:
    """States that differ: groups of buckets with like contexts, by k-means over roots of shares (so that distances are Hellinger's),
    weighted by the buckets' tokens; seeds are the bucket in the middle, then ever the one with the most weighted distance."""
    seen = contexts(docs, base, buckets)
    weight = seen.sum(1)
    smooth = seen + 8 * seen.sum(0) / max(1.0, weight.sum())
    rows = np.sqrt(smooth / np.maximum(smooth.sum(1, keepdims=True), 1e-300))
    apart = lambda c: np.maximum(((rows[:, None, :] - c[None]) ** 2).sum(2), 0) if len(c) == 1 else np.stack([((rows - x) ** 2).sum(1) for x in c], 1)
    centres = (weight[:, None] * rows).sum(0, keepdims=True) / max(1.0, weight.sum())
    centres = rows[[int(np.argmin(apart(centres)[:, 0] - 1e-12 * weight))]]
    while len(centres) < states:
        centres = np.vstack([centres, rows[int(np.argmax(weight * apart(centres).min(1)))]])
    for _ in range(rounds):
        mine = apart(centres).argmin(1)
        for s in range(states):
            if (total := weight[mine == s].sum()) > 0:
                centres[s] = (weight[mine == s, None] * rows[mine == s]).sum(0) / total
    mine = apart(centres).argmin(1)
    emit = base[:, None] * np.where(mine[:, None] == np.arange(states), 1.0, 0.6 / max(1, states - 1))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Params(np.full(states, 1 / states), move, emit / emit.sum(0, keepdims=True))


def baum_welch(docs: DataFrame, model: Params, base: np.ndarray, buckets: int, piece: int, slices: int = 32) -> tuple[Params, float]:
    """(the model after one round over all documents, the logarithm of a token's likelihood, on average, before it)."""
    states, sent = len(model.start), docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def tables(texts: Iterator[pa.Array]) -> list[np.ndarray]:
        reader, counts = Documents(buckets), Counts(buckets, states)
        pieces = PieceBatches(counts, Params(*sent.value), piece)
        for text in texts:
            for _, words, sizes in reader.of(text):
                for s in reader.sequences(words, sizes):
                    pieces.add(s)
        pieces.flush()
        return [counts.emit, np.concatenate([counts.start, counts.move.ravel(), [counts.log, counts.n]])]

    counts, got = Counts(buckets, states), _summed(docs, tables, slices)
    if got is not None:
        counts.emit, rest = got[0].reshape(states, buckets + 1), got[1]
        counts.start, counts.move = rest[:states], rest[states:-2].reshape(states, states)
        counts.log, counts.n = rest[-2], rest[-1]
    return counts.params(base), counts.log / max(1.0, counts.n)


class Slots:
    """Counts of frequent words in a table with one place per slot of the hash; a word whose place a more frequent one has is in
    a sorted list, which only words that the table doesn't hold are looked up in."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, bits: int = 21):
        self.mask, order = np.uint64((1 << bits) - 1), np.argsort(counts, kind="stable")
        tokens, counts = tokens.view(np.uint64)[order], counts[order]
        slot = (tokens >> np.uint64(20)) & self.mask
        self.tokens, self.counts = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.tokens[slot], self.counts[slot] = tokens, counts
        left = (self.tokens[slot] != tokens).nonzero()[0]
        left = left[np.argsort(tokens[left], kind="stable")]
        self.others, self.other_counts = tokens[left], counts[left]

    def get(self, words: np.ndarray) -> np.ndarray:
        """The counts, 0 where unknown here."""
        slot = (words >> np.uint64(20)) & self.mask
        out = np.where(self.tokens[slot] == words, self.counts[slot], 0)
        if len(self.others) and (missed := (out == 0).nonzero()[0]).size:
            at = np.minimum(np.searchsorted(self.others, words[missed]), len(self.others) - 1)
            out[missed] = np.where(self.others[at] == words[missed], self.other_counts[at], 0)
        return out


def is_held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def _with(rows: DataFrame, more: DataFrame) -> DataFrame:
    """A left join by id and mark in which null ids are equal."""
    m = more.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
    return rows.join(m, rows["doc_id"].eqNullSafe(m["_doc_id"]) & (rows["mark"] == m["_mark"]), "left").drop("_doc_id", "_mark")


def scored(docs: DataFrame, states: int = 6, buckets: int = 32_768, folds: int = 7, held: int = 2, iterations: int = 4, least_gain: float = 0.005, piece: int = 256, known: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "hmm")
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    train = docs.where(~is_held_out(F.col("doc_id"), folds, held))
    words = scratch.save("vocabulary", vocabulary(train, buckets))
    end = train.count()
    # tokens and distinct words of each bucket: a table of fixed size
    per_bucket = words.groupBy(F.col("token").bitwiseAND(F.lit(buckets - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for r in per_bucket:
        tokens[r["b"]], distinct[r["b"]] = r["c"], r["v"]
    tokens[buckets], distinct[buckets] = end, 1
    n, v = int(tokens.sum()), int(distinct.sum()) if end else 0
    base = (tokens + distinct + 1) / (tokens + distinct + 1).sum()

    model, reached = initial(train, base, states, buckets), -np.inf
    for _ in range(iterations):
        model, now = baum_welch(train, model, base, buckets, piece)
        if now - reached < least_gain:
            break
        reached = now

    top = words.where(F.col("c") >= cut_count(words, "c", known)).select("token", "c").toArrow()
    slots = Slots(top.column("token").to_numpy(), top.column("c").to_numpy())
    sent = spark.sparkContext.broadcast((model.start, model.move, model.emit, slots, np.log10(tokens + distinct + 1), end))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, slots, logs, end = sent.value
        reader, model = Documents(buckets), Params(start, move, emit)
        ids, held_sequences, rows, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            chance = likelihoods(held_sequences, model) / np.log(10)
            tokens = np.array([len(s) for s in held_sequences], np.int64)
            within = np.array([logs[s].sum() for s in held_sequences])
            known, found = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.float64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(tokens), pa.array(known), pa.array(found), pa.array(chance - within)], ["doc_id", "mark", "n_tokens", "n_known", "logs", "chance"])

        for batch in batches:
            batch_ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, words, sizes in reader.of(batch.column(1)):
                counts, own = slots.get(words), np.repeat(np.arange(len(sizes)), sizes)
                known = np.bincount(own, weights=counts > 0, minlength=len(sizes)) + (end > 0)
                logged = np.bincount(own, weights=np.log10(counts + 1), minlength=len(sizes)) + np.log10(end + 1)
                held_sequences += reader.sequences(words, sizes)
                ids += batch_ids[i : i + len(sizes)]
                rows += list(zip(known.tolist(), logged.tolist(), marks[i : i + len(sizes)], strict=True))
                size += len(words)
                if size > 4_000_000:
                    yield out()
                    ids, held_sequences, rows, size = [], [], [], 0
        if ids:
            yield out()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, reader = sent.value[3], Documents(buckets)
        for batch in batches:
            for i, words, sizes in reader.of(batch.column(1)):
                left = slots.get(words) == 0
                own = pa.array(i + np.repeat(np.arange(len(sizes)), sizes)[left])
                yield pa.RecordBatch.from_arrays([pa.array(words[left].view(np.int64)), batch.column(0).take(own).cast(pa.int64()), batch.column(2).take(own)], ["token", "doc_id", "mark"])

    # what is joined is shared among the rows of one id and text; rows without an id are told apart by their texts
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    seen = marked.mapInArrow(tidy(forward), "doc_id long, mark long, n_tokens long, n_known long, logs double, chance double")
    seen = scratch.save("seen", seen)
    times = seen.groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    found = marked.mapInArrow(tidy(rare), "token long, doc_id long, mark long").join(words, "token").groupBy("doc_id", "mark").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    both = _with(_with(seen, times), found)
    more = lambda c: F.coalesce(F.col(c) / F.coalesce("times", F.lit(1)), F.lit(0))
    logs = F.col("logs") + more("more_logs")
    return both.select(
        "doc_id", is_held_out(F.col("doc_id"), folds, held).alias("held_out"), "n_tokens", (F.col("n_known") + F.round(more("more"))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("chance") + logs).alias("score"),
    )
