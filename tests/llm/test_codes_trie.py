"""Vector codes and the conversation trie, against versions in plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import ball_tree, prefix_trie, scans, vector_codes
from pixelloom.llm.common import Scratch


def brute_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Codes by comparing every part with every entry, in Python integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(float(x) * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(q, p) for _, q, _ in kept[:entries]] for p in range(parts)]
    near = lambda q, p: min((apart(cut(q, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, q, _ in kept:
                groups.setdefault(near(q, p)[1], []).append(cut(q, p))
            for k, members in groups.items():
                books[p][k] = [sum(m[j] for m in members) // len(members) for j in range(width)]
    out, sums = [], {}
    for i, q, label in kept:
        found = [near(q, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join("%02x" % k for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest, label) for i, c, e, label in out), key=str)


def vectors(n, dim=16, seed=0):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [float(np.float32(x + r.gauss(0, 0.2))) for x in r.choice(centres)], r.choice([1, 2, None])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, q string, _salt int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "q", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_codes_equal_brute_force(spark, rounds):
    rows = vectors(300)
    rows += [(7, rows[7][1], 1), (None, rows[3][1], 2), (400, None, 1), (401, [*rows[0][1][:-1], None], 1), (402, [*rows[0][1][:-1], float("nan")], 1), (403, [*rows[0][1][:-1], float("-inf")], None)]
    out = vector_codes.compress(frame(spark, rows).repartition(5), rounds=rounds).collect()
    assert sorted(map(tuple, out), key=str) == brute_codes(rows, rounds=rounds)


def test_codes_of_ties_copies_and_few_rows(spark):
    same = [(i, [0.5] * 8, 1) for i in range(40)]
    assert sorted(map(tuple, vector_codes.compress(frame(spark, same)).collect()), key=str) == brute_codes(same)
    few = vectors(3, 8, 2)
    assert sorted(map(tuple, vector_codes.compress(frame(spark, few)).collect()), key=str) == brute_codes(few)
    # labels joined by a shuffle
    some = vectors(50, 8, 5)
    assert sorted(map(tuple, vector_codes.compress(frame(spark, some), most_broadcast=0).collect()), key=str) == brute_codes(some)


def test_codes_of_odd_rows(spark):
    rows = vectors(60, 8, 3)
    out = {r.vec_id: r for r in vector_codes.compress(frame(spark, [*rows, (100, [1.0] * 7, 1), (101, [], 1), (102, [1e30] + [0.0] * 7, 9)])).collect()}
    want = {r[0]: r for r in brute_codes(rows)}
    assert all(tuple(out[i]) == want[i] for i in want)
    assert all(out[i].code is None and out[i].error is None for i in (100, 101, 102)) and out[102].label_error is None
    assert vector_codes.compress(frame(spark, []).limit(0)).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, None)])).count() == 0
    assert [(r.code, r.error) for r in vector_codes.compress(frame(spark, [(1, [], 1), (2, [], 1)])).collect()] == [("00" * 8, 0)] * 2
    assert [r.code for r in vector_codes.compress(frame(spark, [(1, [1.0] * 7, 1)])).collect()] == [None]


def test_decoded_vectors_are_the_entries(spark):
    rows = frame(spark, vectors(80, 16, 4))
    kept = vector_codes._usable(rows.select("vec_id", "embedding"), "embedding", 4096)
    books = vector_codes.train(kept, "vec_id", 16)
    out = vector_codes.decode(vector_codes._assigned(kept.select("vec_id", "q"), books).join(kept.select("vec_id", "q"), "vec_id"), books)
    for r in out.collect():
        assert sum((round(v * 4096) - q) ** 2 for v, q in zip(r.vector, r.q, strict=True)) == r.error


def test_tree_is_exact_and_prunes():
    r = np.random.default_rng(1)
    for spread in (1, 3, 10_000):
        entries = r.integers(-spread, spread + 1, (64, 4))
        points = np.concatenate([r.integers(-spread, spread + 1, (500, 4)), entries])
        tree = ball_tree.Tree(entries)
        index, best = tree.nearest(points)
        every = ((points[:, None] - entries) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
    assert tree.compared < 0.8 * len(points) * len(entries)
    big = np.array([0, 1, 2, 3, 2**60 - 1, 2**60, (2**30 - 1) ** 2 - 1, (2**30 - 1) ** 2])
    assert [int(x) for x in ball_tree.floor_roots(big)] == [math.isqrt(int(x)) for x in big]
    assert [int(x) for x in ball_tree.ceil_roots(big)] == [math.isqrt(int(x) - 1) + 1 if x else 0 for x in big]


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    nodes, kids = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "conv_id long, turn long, role string, text string, d int, n string, pos int")


def test_trie_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefix_trie.trie(table).collect())) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (1, None, "a", None), (1, None, "a", None), (1, 0, None, "t"), (-3, 1, "u", "q"), (-103, 1, "z", "é🙂" * 30_000), (7, 5, "u", "b"), (7, 5, "u", "a")]
    rows += [(200, i, "u", x) for i, x in enumerate("abcdef")]
    rows += [(201 + i, j, "u", f"w{j if j < i else j + 100}") for i in range(40) for j in range(i % 9)]
    rows += [(1000 + i, j, "u", "same") for i in range(25) for j in range(i)]  # a log of one growing conversation
    rows += [(5000 + i, j, "u", f"copy {j}") for i in range(2_100) for j in range(2)]  # a large group of copies
    assert sorted(map(tuple, prefix_trie.trie(talk(spark, rows)).collect())) == brute_trie(rows)
    assert prefix_trie.trie(talk(spark, []).limit(0)).count() == 0
    assert prefix_trie.trie(talk(spark, [(None, 1, "u", "x")])).count() == 0


def test_one_conversation_may_fill_many_tasks(spark):
    """Positions and names of a conversation of thousands of turns come from several ranges."""
    rows = [(100, i, "u", f"t{i % 7}") for i in range(6_000)] + [(101, i, "u", f"t{i % 7}") for i in range(3_000)]
    frame = talk(spark, rows).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _many_tasks(spark, frame)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _many_tasks(spark, frame):
    scratch = Scratch(spark, "test")
    counted = scans.running(frame, ["conv_id"], [F.col("turn")], scratch, "x", {"conv_id": F.col("conv_id"), "turn": F.col("turn"), "one": F.lit(1).cast("long")}, sums=("one",))
    assert counted.where("run_one <> turn + 1").count() == 0 and counted.count() == 9_000
    assert spark.read.parquet(scratch.path("x")).where("conv_id = 100").select("_pid").distinct().count() > 1
    out = {(r.conv_id, r.depth): r for r in prefix_trie.trie(frame).collect()}
    assert len(out) == 6_001 and out[100, 0].n_convs == 2 and out[100, 0].n_leaves == 1


def test_peeling_takes_as_many_rounds_as_paths_are_nested(spark):
    """A caterpillar: each path hangs on the one before."""
    rows = [(i, i - 1 if i else None, 0, 1 if i < 9 else 0, 1, i) for i in range(10)]
    done = prefix_trie.peel(spark.createDataFrame(rows, "path long, parent long, spot long, remaining long, leaves long, saved long"), Scratch(spark, "test"))
    assert len(done) == 10 and [r.saved for r in done[-1].collect()] == [45]
