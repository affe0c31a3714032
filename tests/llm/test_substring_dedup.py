"""Substring dedup against a version in plain Python, and planted passages."""

import hashlib
import random
import re

import numpy as np
import pytest

from pixelloom.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, w):
    """(doc_id, number of words, number of removed words, SHA-256 of the kept ones)."""
    lowest, texts = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in texts:
        for p in range(len(words) - w + 1 if i is not None else 0):
            key = tuple(words[p : p + w])
            lowest[key] = min(i, lowest.get(key, i))
    out = []
    for i, words in texts:
        gone = set()
        for p in range(len(words) - w + 1 if i is not None else 0):
            if lowest[tuple(words[p : p + w])] < i:
                gone.update(range(p, p + w))
        kept = " ".join(x for j, x in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def results(frame, w):
    return sorted(map(tuple, substring_dedup.digest(frame, w).collect()), key=str)


@pytest.mark.parametrize("w", [2, 5, 8, 50])
def test_equals_brute_force_on_pasted_texts(spark, docs_of, w):
    """Texts pasted from few pieces of all lengths, so that repeats begin and end everywhere."""
    r = random.Random(w)
    words = [f"w{i}" for i in range(40 * w)]
    pieces = [[r.choice(words[: 3 if k % 7 == 0 else None]) for _ in range(r.randint(1, 4 * w))] for k in range(30)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(r.randint(0, 8)):
            text += r.choice(pieces) if r.random() < 0.7 else [r.choice(words) for _ in range(r.randint(1, 2 * w))]
        rows.append((r.randint(0, 200), (" " if i % 3 else "\n\t").join(text)))
    rows += [(300 + i, rows[i % 9][1]) for i in range(40)]
    assert results(docs_of(rows).repartition(5), w) == brute(rows, w)


def test_equals_brute_force_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert results(docs, 50) == brute(rows, 50)
    assert results(docs, 10) == brute(rows, 10)


def test_odd_rows(spark, docs_of, odd, prose):
    same = prose(80, 5)
    rows = [*odd, (20, "a " * 300), (21, "a " * 120), (22, "b " + "a " * 49), (23, "a " * 49), (23, "a " * 70), (24, same), (24, same.replace(" ", "\n")), (25, same), (25, same + " more"), (None, same), (11, odd[5][1] + " end")]
    assert results(docs_of(rows), 50) == brute(rows, 50)
    assert substring_dedup.digest(docs_of([])).count() == 0
    assert results(docs_of([(1, None), (2, "")]), 50) == brute([(1, None), (2, "")], 50)


def test_ids_sent_and_shuffled_give_the_same(spark, docs_of, prose):
    shared = prose(90, 9)
    rows = [(i, f"{prose(30, 100 + i)} {shared if i % 3 == 0 else ''} {prose(40, 200 + i)}") for i in range(40)]
    out = sorted(map(tuple, substring_dedup.digest(docs_of(rows), 50, most_broadcast=0).collect()), key=str)
    assert out == brute(rows, 50) and sum(x[2] for x in out) >= 13 * 90


def test_removed_texts(spark, docs_of, prose):
    shared = prose(60, 3)
    rows = [(1, f"x  {shared}\ny"), (2, f"{prose(5, 4)} {shared} {prose(5, 5)}"), (3, f"x {shared} y"), (4, "un\ttouched  text"), (5, None), (6, f"x {shared}  y")]
    out = {r.doc_id: r for r in substring_dedup.remove(docs_of(rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text == f"{prose(5, 4)} {prose(5, 5)}" and out[3].text == "" and out[4].text == rows[3][1] and out[5].text is None and out[6].text == ""
    assert out[2].keep == "k2" and out[2].component == "y"


def test_hot_passage_is_dealt(spark, docs_of, prose):
    """A passage in every document, copies of one document, and one line that all share."""
    passage, copy = prose(70, 1), prose(120, 2)
    rows = [(i, f"{prose(20, 1000 + i)} {passage} {prose(20, 5000 + i)}") for i in range(150)] + [(1000 + i, copy) for i in range(200)]
    assert results(docs_of(rows), 50) == brute(rows, 50)


def test_least_places():
    r = np.random.default_rng(0)
    for span in (1, 2, 3, 7, 38):
        values = r.integers(0, 5, 200)
        assert substring_dedup._least(values, span).tolist() == [p + int(values[p : p + span].argmin()) for p in range(201 - span)]
    assert len(substring_dedup._least(np.arange(3), 5)) == 0
