import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import ngram_join
from pixelloom.llm.count_tree import CountTree, count_vector, enough

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(a), root(b)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def copies(prose, seed=3):
    """Groups of exact and near copies, a chain, and texts that only share a passage."""
    r, rows, i = random.Random(seed), [], 0
    passage = prose(30, 99)
    for g in range(12):
        words = prose(r.randint(20, 300), 100 + g).split()
        for _ in range(r.choice([1, 2, 3, 12])):
            new = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                new[r.randrange(len(new))] = f"edit{i}"
            rows.append((i, " ".join(new)))
            i += 1
    chain = prose(100, 7).split()
    for step in range(8):
        rows.append((i, " ".join(chain[2 * step : 2 * step + 80])))
        i += 1
    for s in range(25):
        rows.append((i, f"{prose(40, 500 + s)} {passage} {prose(40, 600 + s)}"))
        i += 1
    r.shuffle(rows)
    return rows


def test_matches_brute_force(docs_of, prose):
    rows = copies(prose)
    assert got(ngram_join.join(docs_of(rows))) == brute(rows)


def test_without_broadcasts_and_in_chunks(docs_of, prose, monkeypatch):
    """The ways for large inputs give the same: no broadcast of ids, cells dealt as pairs of chunks."""
    real, first = ngram_join.dealt, ngram_join.leaders
    monkeypatch.setattr(ngram_join, "dealt", lambda members, chunk, most: real(members, 3, most))
    monkeypatch.setattr(ngram_join, "leaders", lambda *args: first(*args, seeds=2, chunk=3))
    rows = copies(prose, 4)
    assert got(ngram_join.join(docs_of(rows), most_broadcast=0)) == brute(rows)


@pytest.mark.parametrize("most", [0, 1000])
def test_dealing_pairs_all_components(spark, most):
    """Members of different components meet in a task, whatever fills the cell; a component that fills it goes out once
    for each chunk of the others, not for each of its own."""
    r = random.Random(2)
    cells = {1: [0] * 300 + [1, 2, 3], 2: [r.randrange(40) for _ in range(100)], 3: [0] * 50 + [1] * 50 + [2] * 4, 4: [7] * 60, 5: [1, 2, 2]}
    rows = [(c, len(labels), 1000 * c + i, 10 * c + k) for c, labels in cells.items() for i, k in enumerate(labels)]
    out = ngram_join.dealt(spark.createDataFrame(rows, "cell long, size long, doc_id long, component long"), 10, most).collect()
    tasks = {}
    for x in out:
        assert x.own in (x.x, x.y)
        tasks.setdefault((x.cell, x.x, x.y), {})[x.doc_id] = x.own
    met = set()
    for (_, x, y), members in tasks.items():
        a, b = [d for d, o in members.items() if o == x], [d for d, o in members.items() if o == y]
        met |= {(min(p, q), max(p, q)) for p in a for q in b}
    for c, labels in cells.items():
        for i, p in enumerate(labels):
            for j in range(i):
                assert p == labels[j] or (1000 * c + j, 1000 * c + i) in met
    assert sum(x.cell == 1 for x in out) <= 300 + 3 * 31 and not any(x.cell == 4 for x in out)


@pytest.mark.parametrize(("k", "percent"), [(2, 50), (3, 95)])
def test_other_parameters(docs_of, prose, k, percent):
    rows = copies(prose, 5)[:60]
    assert got(ngram_join.join(docs_of(rows), k=k, percent=percent)) == brute(rows, k, percent)


def test_odd_rows(docs_of, odd):
    out = ngram_join.join(docs_of(odd)).collect()
    assert len(out) == len(odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_shingles for r in by[1] + by[2] + by[3]] == [0, 0, 0]
    assert [by[i][0].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert [(r.n_shingles, r.component_id) for r in by[8]] == [(1, 8), (1, 8)]
    assert by[None][0].component_id is None


def test_repeated_rows_keep_every_link(docs_of, prose):
    """Cells of different documents stay apart where all of their rows, or some, are repeated."""
    rows = copies(prose, 6)
    assert got(ngram_join.join(docs_of(rows + rows))) == brute(rows)
    assert got(ngram_join.join(docs_of(rows + rows[::2] + rows[::2]))) == brute(rows)


def test_empty_table(docs_of):
    assert ngram_join.join(docs_of([])).count() == 0
    assert ngram_join.keep_one(docs_of([])).count() == 0


def test_keep_one(docs_of, prose):
    text = prose(200, 1)
    rows = [(5, text), (3, text + " end"), (5, text), (7, None), (None, text), (None, "zz"), (9, "a b"), (9, "a b")]
    df = docs_of(rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 9), (True, 0), (True, 0)]


def test_other_names(spark, prose):
    """The id column may have any name; an unused doc_id column stays as it is."""
    text = prose(100, 1)
    df = spark.createDataFrame([(5, text, "x"), (6, f"{text} end", "y"), (7, prose(100, 2), "z")], "own long, body string, doc_id string")
    kept = ngram_join.keep_one(df, id_col="own", text_col="body")
    assert kept.columns == df.columns and sorted((r.own, r.doc_id) for r in kept.collect()) == [(5, "x"), (7, "z")]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.sampled_from([50, 80, 90]))
def test_tree_misses_no_pair(seed, n, percent):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, (4, 40), np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.integers(4)][: r.integers(1, 40)], r.integers(0, 2**63, r.integers(0, 6), np.int64).astype(np.uint64)])) for _ in range(n)]
    points, sizes = np.stack([count_vector(s, 16) for s in sets]), np.array([len(s) for s in sets])
    tree = CountTree(points, fan=4)
    found = {(min(i, j), max(i, j)) for a, b, _ in tree.pairs(tree, percent) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(n):
        for j in range(i + 1, n):
            if enough(np.array([len(np.intersect1d(sets[i], sets[j]))]), sizes[i], sizes[j], percent)[0]:
                assert (i, j) in found
