"""Language model and toxicity."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import hmm_lm, line_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(rows):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in rows}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


@pytest.mark.parametrize("known", [500_000, 5])
def test_base_score(docs_of, prose, known):
    """With few known words most counts come through the join."""
    rows = [(i, prose(5 + 13 * i % 200, i)) for i in range(60)] + [(100, None), (101, ""), (102, "unseen-word-1 unseen-word-2")]
    out = {r.doc_id: r for r in hmm_lm.scored(docs_of(rows), buckets=256, known=known).collect()}
    for i, want in brute_base(rows).items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert math.isfinite(r.score)


def test_rare_words_of_rows_without_id(docs_of, prose):
    """Rows without an id get the same counts whether words are broadcast or joined, repeated texts too."""
    rows = [(i, prose(5 + 13 * i % 200, i)) for i in range(30)] + [(None, prose(n, 70 + n)) for n in (3, 40, 40, 90)] + [(None, None), (None, ""), (2**53 + 1, prose(30, 5))]
    # the training rows' ids only decide the fold: unlike ones in the place of null stand for the same corpus
    train = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = brute_base([(train[k] if i is None else i, t) for k, (i, t) in enumerate(rows)])
    key = lambda held, *counts: (held, *counts[:3], round(counts[3], 6))
    for known in (500_000, 5):
        out = hmm_lm.scored(docs_of(rows), buckets=256, known=known).collect()
        assert sorted(key(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out) == sorted(key(*v) for v in want.values())


def test_repeated_rows_and_odd_rows(docs_of, odd):
    out = hmm_lm.scored(docs_of(odd), buckets=64, known=2).collect()
    assert len(out) == len(odd)
    assert len({(r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in out if r.doc_id == 8}) == 1
    assert hmm_lm.scored(docs_of([]), buckets=64).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    only = hmm_lm.scored(docs_of([(i, "a b") for i in held]), buckets=64).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in only)


def random_model(k, m, seed):
    r = np.random.default_rng(seed)
    p = lambda *s: r.dirichlet(np.ones(s[-1]), s[:-1] or None)
    return hmm_lm.Params(p(k), p(k, k), np.ascontiguousarray(p(k, m).T))


def test_forward_recursion_is_exact():
    model, r = random_model(3, 5, 1), np.random.default_rng(2)
    sequences = [r.integers(0, 5, n).astype(np.int32) for n in (1, 2, 5, 7, 3)]
    for s, got in zip(sequences, hmm_lm.likelihoods(sequences, model, most=8), strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert got == pytest.approx(math.log(total), rel=1e-9)


def test_expected_counts_and_rising_likelihood():
    model, r = random_model(2, 4, 3), np.random.default_rng(4)
    sequences = [r.integers(0, 4, n).astype(np.int32) for n in (4, 6, 3, 6, 1)]
    counts = hmm_lm.Counts(3, 2)
    counts.add(sequences, [True] * 5, model)
    emit, move, start = np.zeros((2, 4)), np.zeros((2, 2)), np.zeros(2)
    for s in sequences:
        paths = {}
        for path in np.ndindex(*[2] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            start[path[0]] += p / total
            for t, k in enumerate(path):
                emit[k, s[t]] += p / total
                if t:
                    move[path[t - 1], k] += p / total
    assert np.allclose(counts.emit, emit) and np.allclose(counts.move, move) and np.allclose(counts.start, start)
    last = -1e9
    for _ in range(5):
        now = hmm_lm.likelihoods(sequences, model).sum()
        assert now >= last - 0.05
        last = now
        counts = hmm_lm.Counts(3, 2)
        counts.add(sequences, [True] * 5, model)
        model = hmm_lm.Params(counts.start / counts.start.sum(), counts.move / counts.move.sum(1, keepdims=True), np.ascontiguousarray((counts.emit / counts.emit.sum(1, keepdims=True)).T))


def test_pieces_join_exactly():
    """Documents cut into pieces give the counts and the likelihood of whole ones."""
    model, r = random_model(3, 6, 5), np.random.default_rng(6)
    sequences = [r.integers(0, 6, n).astype(np.int32) for n in (1, 4, 5, 9, 40, 23)]
    whole, cut = hmm_lm.Counts(5, 3), hmm_lm.Counts(5, 3)
    for s in sequences:
        whole.add([s], [True], model)
    pieces = hmm_lm.PieceBatches(cut, model, 4, most=30)
    for s in sequences:
        pieces.add(s)
    pieces.flush()
    assert all(np.allclose(getattr(whole, n), getattr(cut, n), rtol=1e-9) for n in ("start", "move", "emit"))
    assert cut.log == pytest.approx(hmm_lm.likelihoods(sequences, model).sum(), rel=1e-9) and cut.n == whole.n == sum(map(len, sequences))


def test_contexts_count_all_neighbours(docs_of, prose):
    rows = [(i, prose(5 + 3 * i, i)) for i in range(40)] + [(50, None), (51, "")]
    found = [s for _, s in brute_sequences([t for _, t in rows], 16)]
    got = hmm_lm.contexts(docs_of(rows).repartition(4), np.bincount(np.concatenate(found), minlength=17), 16, 17, 1)
    near = np.zeros((17, 17))
    for s in found:
        np.add.at(near, (s[1:], s[:-1]), 1)
    of = np.empty(17, int)
    of[np.argsort(-np.bincount(np.concatenate(found), minlength=17), kind="stable")] = np.arange(17)
    want = np.zeros((17, 36))
    want[:, of], want[:, 18 + of] = near, near.T
    assert np.array_equal(got, want)


def test_slots_keep_every_word():
    r = np.random.default_rng(1)
    words, counts = r.integers(1, 2**63, 500).astype(np.uint64), np.arange(1, 501)
    slots = hmm_lm.Slots(words.view(np.int64), counts, bits=6)
    assert np.array_equal(slots.get(words), counts) and not slots.get(words + np.uint64(1)).any()


def brute_sequences(texts, buckets):
    """Words and buckets of each text, the end's last."""
    reader, out = hmm_lm.Documents(buckets), []
    for t in texts:
        words = WORD.findall(low(t))
        hashes = [int(h) for w in words for _, found, _ in reader.of(pa.array([w])) for h in found]
        out.append((words, [h & (buckets - 1) for h in hashes] + [buckets]))
    return out


def test_whole_score_equals_brute_force(docs_of, prose, monkeypatch):
    """Training over all partitions equals training in one place; a score is the forward recursion of the trained model and
    the words' shares of their buckets."""
    buckets, piece, models = 64, 16, []
    first, step = hmm_lm.initial, hmm_lm.baum_welch
    monkeypatch.setattr(hmm_lm, "initial", lambda *a: models.append((first(*a), a[1])) or models[-1][0])
    monkeypatch.setattr(hmm_lm, "baum_welch", lambda *a: models.append((step(*a)[0], a[2])) or (models[-1][0], float(len(models))))
    rows = [(i, prose(5 + 13 * i % 90, i)) for i in range(60)] + [(100, None), (101, ""), (7, prose(40, 7)), (102, "Unseen words here")]
    rows += [(200 + i, prose(30, 5)) for i in range(6)]
    out = sorted(hmm_lm.scored(docs_of(rows).repartition(5), states=3, buckets=buckets, piece=piece, known=7).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    rows.sort(key=lambda r: (r[0], len(WORD.findall(low(r[1])))))
    found = brute_sequences([t for _, t in rows], buckets)
    train = [f for (i, _), f in zip(rows, found, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(models) == 5
    for (before, _), (after, base) in zip(models, models[1:], strict=False):
        counts = hmm_lm.Counts(buckets, 3)
        for _, s in train:
            counts.add([np.array(s, np.int32)], [True], before)
        want = counts.params(base)
        assert all(np.allclose(getattr(after, n), getattr(want, n), rtol=1e-9) for n in ("start", "move", "emit"))
    model, c = models[-1][0], Counter(w for words, _ in train for w in words)
    tokens, distinct, of = Counter(b for _, s in train for b in s), Counter(), {w: b for words, s in found for w, b in zip(words, s, strict=False)}
    distinct.update(of[w] for w in c)
    distinct[buckets] = 1
    for r, (words, s) in zip(out, found, strict=True):
        p, total = model.start * model.emit[s[0]], 0.0
        for b in s[1:]:
            total += math.log10(p.sum())
            p = (p / p.sum()) @ model.move * model.emit[b]
        total += math.log10(p.sum())
        seen = [c[w] for w in words] + [len(train)]
        assert r.score == pytest.approx(total + sum(math.log10((n + 1) / (tokens[b] + distinct[b] + 1)) for n, b in zip(seen, s, strict=True)), rel=1e-9)


def test_model_beats_unigrams_on_held_out_texts(docs_of, prose):
    """Two languages: states that tell them apart predict better."""
    words = [[prose(1, 1000 * k + i, stem=k * "x" + "q") for i in range(60)] for k in (0, 1)]
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(words[i % 2]) for _ in range(120))) for i in range(200)]
    out = [r for r in hmm_lm.scored(docs_of(rows), buckets=4096, states=4).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.fixture(scope="module")
def labelled(prose):
    bad = ["idiot", "moron", "scum", "loser"]
    rows = [(i, prose(60, i) + (f" {bad[i % 4]} {prose(10, 1000 + i)} {bad[(i + 1) % 4]}." if i % 5 == 0 else "")) for i in range(600)]
    return rows, [(i, int(i % 5 == 0)) for i, _ in rows]


def test_toxicity(spark, docs_of, labelled, prose):
    rows, labels = labelled
    hidden = ["you m0r0n there", "what an 1d10t", "s.c.u.m of it", "a l o s e r again", "stop it idiooot"]
    hidden += ["*m0ron* there", "an id10t/nobody", "1diot-like it is", "s c u m i d i o t", "stop it idi" + "o" * 60 + "t"]
    more = [(10_000 + i, f"{prose(30, 5000 + i)} {t}") for i, t in enumerate(hidden)] + [(20_000, None), (20_001, ""), (1, rows[1][1])]
    table = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.judged(docs_of(rows + more), table).collect()
    assert len(out) == len(rows) + len(more)
    by = {r.doc_id: r for r in out}
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert [by[10_000 + i].predicted for i in range(len(hidden))] == [1] * len(hidden)
    assert by[20_000].predicted == by[20_001].predicted == 0 and all(0 <= r.score <= 1 for r in out)
    assert by[0].held_out == (zlib.crc32(b"0") % 5 == 0)


def test_held_out_labels_are_not_learned(spark, docs_of, labelled):
    rows, labels = labelled
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    tables = [spark.createDataFrame(x, "doc_id long, toxic int") for x in (labels, turned)]
    assert [toxicity.learned(docs_of(rows), t).beta for t in tables][0] == toxicity.learned(docs_of(rows), tables[1]).beta


def brute_learning(rows, labels):
    """Log-odds, sums of the character model and the regression's gradient at beta, from all rows at once."""
    words = {i: toxicity._WORD.findall((t or "").lower()) for i, t in rows}
    y = {i: k for i, k in labels if zlib.crc32(str(i).encode()) % 5}
    # groups of exact Jaccard similarity 0.8 or more; fixtures have no others above 0.5
    texts = dict(rows)
    mark = {i: int(hashlib.md5((texts[i] or "").encode()).hexdigest()[:15], 16) for i in y}
    sets = {mark[i]: frozenset(zip(*(words[i][k:] for k in range(5)), strict=False)) for i in y}
    low, having = {m: m for m in sets}, {}
    for m, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(m)
    pairs = [(m, o) for m, s in sets.items() for o, n in Counter(o for x in s for o in having[x] if o < m).items() if 5 * n >= 4 * (len(s) + len(sets[o]) - n)]
    for _ in range(4):
        for m, o in pairs:
            low[m] = low[o] = min(low[m], low[o])
    size = Counter(low[mark[i]] for i in y)
    weight = {i: 1 / size[low[mark[i]]] for i in y}
    half = {i: low[mark[i]] & 1 for i in y}

    def odds(ids):
        n, have = [sum(weight[i] for i in ids if y[i] == k) for k in (0, 1)], (Counter(), Counter())
        for i in ids:
            for f in {f for w in words[i] for f in toxicity.word_features(w)}:
                have[y[i]][f] += weight[i]
        found = {f: math.log((a + 0.5) / (n[1] + 1)) - math.log((have[0][f] + 0.5) / (n[0] + 1)) for f, a in have[1].items() if a >= 5 - 1e-9}
        return {f: v for f, v in found.items() if v >= 2}

    weights, parts = odds(list(y)), [toxicity.Model(odds([i for i in y if half[i] == h]), toxicity.CharModel(), []) for h in (0, 1)]
    x = np.array([(1.0, *parts[1 - half[i]].evidence(texts[i])) for i in y])
    counts = Counter()
    for i in y:
        for w in words[i]:
            counts[w] += weight[i]
    chars = {w: math.sqrt(n) for w, n in counts.items() if n > 1 + 1e-9}
    lift = 0.25 * sum(chars.values()) / sum(v for w, v in weights.items() if w[-1] != "*")
    for w, v in weights.items():
        if w[-1] != "*":
            chars[w] = chars.get(w, 0.0) + lift * v

    def slope(beta):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        return x.T @ (np.array(list(weight.values())) * (p - np.array(list(y.values())))) + 0.01 * beta

    return weights, toxicity.CharModel().train(chars), slope


@pytest.mark.parametrize("copies", [1, 4])
def test_every_labelled_row_is_learned(spark, docs_of, prose, copies):
    """More rows than a bounded sample would hold; a word that few of them have; copies count as one row together."""
    r = random.Random(3)
    bad = ["idiot", "moron", "scum", "loser"]
    kinds = {i: r.random() < 0.15 for i in range(11_000 if copies == 1 else 1_500)}
    rows = [(i, " ".join([prose(10, i), *([r.choice(bad), r.choice(bad)] if toxic and r.random() < 0.9 else [r.choice(bad)] if r.random() < 0.01 else []), prose(10, 50_000 + i)])) for i, toxic in kinds.items()]
    rows += [(100_000 + i, f"{prose(10, 200_000 + i)} Blorgle {prose(9, 300_000 + i)}") for i in range(12)]
    labels = [(i, int(toxic)) for i, toxic in kinds.items()] + [(100_000 + i, 1) for i in range(12)]
    again = [(i + 1_000_000 * k, t) for i, t in rows[::3] for k in range(1, copies)]
    y = dict(labels)
    labels += [(i, y[i % 1_000_000]) for i, _ in again]
    rows += again
    model = toxicity.learned(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weights, chars, slope = brute_learning(rows, labels)
    assert "blorgle" in model.weights and set(model.weights) == set(weights)
    assert all(model.weights[f] == pytest.approx(v, abs=1e-5) for f, v in weights.items())
    for name in ("three", "two", "one", "before"):
        assert getattr(model.chars, name) == pytest.approx(dict(getattr(chars, name)), rel=1e-5)
    beta = np.array(model.beta)
    assert beta[0] < -0.1 and (beta[1:] >= 0).all() and beta.any()
    assert np.abs(slope(beta)[[True, *(beta[1:] > 0)]]).max() < 1e-3


@pytest.mark.parametrize(("head", "foot", "toxic_only"), [(12, 0, False), (0, 12, False), (30, 30, False), (0, 12, True)])
def test_common_beginnings_and_ends_are_no_copies(spark, docs_of, labelled, prose, head, foot, toxic_only):
    rows, labels = labelled
    bad = {i for i, k in labels if k}
    rows = [(i, t if toxic_only and i not in bad else f"{prose(head, 1)} {t} {prose(foot, 2)}") for i, t in rows]
    out = {r.doc_id: r for r in toxicity.judged(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(out[i].predicted, k) for i, k in labels if out[i].held_out]
    assert sum(p == k for p, k in held) >= 0.97 * len(held)


@pytest.mark.parametrize("where", ["head", "foot"])
def test_site_notices_on_given_documents(spark, where):
    """sf0.1's labelled rows with one line before or after every text: as good as without."""
    sf = "/root/testdata/sf0.1"
    line = "This site is run by the harbour council and its friends all rights are theirs alone"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    new = F.concat_ws("\n", *([F.lit(line), "text"] if where == "head" else ["text", F.lit(line)]))
    out = toxicity.judged(docs.withColumn("text", new).repartition(8), labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    found = {(r.toxic, r.predicted): r["count"] for r in out}
    assert found[1, 1] >= 85 and found.get((0, 1), 0) <= 2


def test_long_runs_are_decoded(spark, docs_of, labelled, prose):
    rows, labels = labelled
    model = toxicity.learned(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = ["x1" * 40 + "_" + "1d10t", "1" * 3 + "m0r0n" + "zq" * 60, " ".join("qz" * 30 + "idiot" + "xy" * 20), "w" * 30 + "idiooot"]
    assert all(model.evidence(f"{prose(20, 3)} {t}")[0] >= 0 for t in long)
    for n in (10, 48, 49, 71, 72, 73, 500):
        parts = toxicity.stretches("".join(chr(65 + i % 50) for i in range(n)))
        assert all(len(p) <= 48 for p in parts) and sum(map(len, parts)) >= n
        assert all(any("".join(chr(65 + j % 50) for j in range(i, i + 20)) in p for p in parts) for i in range(n - 19))


def test_repeated_tables_are_learned_alike(spark, docs_of, labelled):
    rows, labels = labelled
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = (toxicity.learned(docs_of(x), table) for x in (rows, rows + rows[::-1]))
    assert one.weights == two.weights and one.beta == two.beta and one.chars.three == two.chars.three
    shuffled = toxicity.learned(docs_of(rows), table.union(table.where("toxic = 1")), most_broadcast=0)
    assert one.weights == shuffled.weights and one.beta == shuffled.beta and one.chars.three == shuffled.chars.three


def test_labels_and_weights_never_become_join_tables_of_the_driver(spark, docs_of, labelled):
    rows, labels = labelled
    docs, table = docs_of([*rows, *rows[:50], (None, "no id")]), spark.createDataFrame([*labels, (-5, 1)], "doc_id long, toxic int")
    sent, shuffled = (toxicity._labelled(docs, table, 5, 0, "doc_id", "text", most) for most in (1_000_000, 0))
    assert "Join" not in sent._jdf.queryExecution().toString()
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, shuffled.collect()))
    none = table.where("doc_id is null")
    assert toxicity._labelled(docs, none, 5, 0, "doc_id", "text", 10).count() == 0


def test_stages_of_learning_have_one_python_step(spark, docs_of, labelled, monkeypatch):
    """Each Python step of a stage has worker processes of its own, which stay in memory for all later stages."""
    plans = {}
    for name in ("_counts", "_evidence"):

        def seen(*args, name=name, real=getattr(toxicity, name)):
            out = real(*args)
            plans[name] = out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
            return out

        monkeypatch.setattr(toxicity, name, seen)
    rows, labels = labelled
    assert toxicity.learned(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).weights
    assert plans == {"_counts": 1, "_evidence": 1}


def test_lines_are_read_in_small_blocks(prose):
    """What a worker holds at once while it reads lines, and that blocks change nothing."""
    texts = pa.array([prose(400, i) for i in range(100)] * 15)
    reader, whole = line_dedup.Lines(**line_dedup._SHAPE), line_dedup.Lines(**line_dedup._SHAPE)
    whole.block = texts.nbytes + 1
    tracemalloc.start()
    parts = [(keys, *sketches) for *_, keys, sketches in reader.of(texts, sketched=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ((*_, keys, sketches),) = whole.of(texts, sketched=True)
    assert all((np.concatenate(got) == want).all() for got, want in zip(zip(*parts, strict=True), (keys, *sketches), strict=True))
    assert peak < 50e6


def test_heavy_keys_alone_are_dealt(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)], "key long, at long")
    few = spark.createDataFrame([(k, 10 * k) for k in range(5)], "key long, value long")
    heavy = rows.groupBy("key").count().where("count > 50")
    for how in ("inner", "left_semi", "left_anti", "left"):
        found = (line_dedup._joined(rows, few, "key", how, most, heavy=heavy).select("at").collect() for most in (10, 0))
        assert len({tuple(sorted(r["at"] for r in x)) for x in found}) == 1


def test_transfers_of_pieces_of_any_length():
    rng = np.random.default_rng(5)
    p = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) + 0.01)
    model = hmm_lm.Params(p(3), p(3, 3), np.ascontiguousarray(p(3, 8).T))
    pieces = [rng.integers(0, 8, n).astype(np.int32) for n in (1, 30, 2, 2, 17, 1, 30, 9)]
    first = [i % 3 == 0 for i in range(len(pieces))]
    for piece, begins, got in zip(pieces, first, hmm_lm.transfers(pieces, first, model), strict=True):
        want = np.eye(3) if begins else model.move
        for t, x in enumerate(piece):
            want = (want @ model.move if t else want) * model.emit[x]
        assert got == pytest.approx(want / want.sum(), rel=1e-9)


def test_many_keys_never_become_a_join_table_of_the_driver(spark):
    rows = spark.createDataFrame([(k % 50 if k % 7 else None, k) for k in range(300)], "key long, at long")
    few = spark.createDataFrame([(k, 10 * k) for k in range(0, 60, 3)], "key long, value long")
    for how in ("inner", "left_semi", "left_anti"):
        hashed, sent, shuffled = (line_dedup._joined(rows, few, "key", how, most) for most in (200, 100, 0))
        assert "Join" in hashed._jdf.queryExecution().toString() and "Join" not in sent._jdf.queryExecution().toString()
        assert sorted(map(tuple, hashed.collect()), key=str) == sorted(map(tuple, sent.collect()), key=str) == sorted(map(tuple, shuffled.collect()), key=str)


def test_toxicity_without_labels(spark, docs_of, odd):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.judged(docs_of(odd), empty).collect()
    assert len(out) == len(odd) and {r.score for r in out} == {0.0}
    assert toxicity.judged(docs_of([]), empty).count() == 0
    kept = toxicity.keep_clean(docs_of(odd), toxicity.learned(docs_of(odd), empty))
    assert kept.count() == len(odd) and kept.columns == docs_of([]).columns


def test_decoding_needs_the_model():
    chars = toxicity.CharModel().train({"idiot": 5.0, "trash": 5.0, "hello": 3.0, "moron": 5.0})
    assert [toxicity.decode(x, chars) for x in ("1d10t", "t r a s h", "tr4$h", "mooorooon", "hello")] == ["idiot", "trash", "trash", "moron", "hello"]
