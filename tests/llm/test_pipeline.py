import public_tokenizers as P
import pytest
import tiktoken
from test_filters import BENCH, brute_dedup, low, marks_of
from test_ngram_join import brute

import __spark_entry__ as entry
import corpus_pipeline
from pixelloom.llm import byte_bpe, toxicity


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after


def brute_cut(text, windows):
    """The text without benchmark windows, None if half of its words or more are hit."""
    first = True
    while True:
        found = list(BENCH.finditer(low(text)))
        words, hit = [m[0] for m in found], set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if tuple(words[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
        if not hit:
            return text
        if first and 2 * len(hit) >= len(words):
            return None
        first, out, at = False, [], 0
        for i in sorted(hit):
            if i - 1 not in hit:
                out.append(text[at : found[i].start()])
            at = found[i].end()
        text = "\n".join([*out, text[at:]])


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if model.score(r.text) < 0.5]
    clean = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id")
    texts = brute_dedup(*marks_of(clean))
    rows = [(i, t) for (i, _), t in zip(rows, texts, strict=True)]
    groups = brute(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = BENCH.findall(low(r.text))
        windows |= {tuple(w[j : j + min(10, len(w))]) for j in range(len(w) - min(10, len(w)) + 1) if w}
    rows = [(i, c) for i, t in rows if (c := brute_cut(t, windows)) is not None]
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = [(i, coder.encode_ordinary(t)) for i, t in rows]
    out = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.ids) for r in out] == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out) and 0 < len(out) < docs.count()


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("kind", ["odd", "repeated", "empty"])
def test_stages_bear_odd_rows(spark, docs_of, odd, prose, tmp_path, kind):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table; further columns stay."""
    rows = [*odd, *((100 + i, prose(60, 100 + i)) for i in range(30))]
    docs = {"odd": docs_of(rows).unionByName(spark.createDataFrame([(None,) * 8], docs_of([]).schema)), "repeated": docs_of(rows + rows), "empty": docs_of([])}[kind]
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(100 + i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 999)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    before = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        before = after
    assert {100 + i for i in range(30)} <= {r.doc_id for r in before.collect()} or kind == "empty"
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == before.count() and all(r.round_trip for r in out.collect())
    # rows without an id stay, of repeated ones with an id one
    assert kind == "empty" or out.where("doc_id is null").count() == docs.where("doc_id is null").count()
    assert out.where("doc_id is not null").count() == out.where("doc_id is not null").select("doc_id").distinct().count()
