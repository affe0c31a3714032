"""DuckDB SQL of substring dedup, the vector codes and the conversation trie."""

from __future__ import annotations


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds unrolled as tables: every part against every entry, the least by (distance, index), exact means by floor."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST({scale} AS DOUBLE) * x) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS rn FROM kept)",
        f"cut AS (SELECT rn, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v FROM numbered, range({parts}) AS r(p))",
        f"book0 AS (SELECT p, CAST(rn AS INTEGER) AS e, v FROM cut WHERE rn < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} AS (SELECT rn, p, v, least_one.e AS e, least_one.d AS d FROM
                (SELECT c.rn, c.p, c.v, min({{'d': list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS least_one
                 FROM cut c JOIN book{i} b USING (p) GROUP BY c.rn, c.p, c.v))"""
        )
        if i < rounds:
            steps.append(
                f"""sums{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS v FROM
                    (SELECT p, e, k, sum(v[k]) AS s, count(*) AS n FROM near{i}, range(1, (SELECT max(len(v)) FROM cut) + 1) AS r(k) GROUP BY p, e, k) GROUP BY p, e)"""
            )
            steps.append(f"book{i + 1} AS (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM book{i} b LEFT JOIN sums{i} s USING (p, e))")
    steps += [
        f"codes AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rn)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM numbered JOIN codes USING (rn), digest"


def _crc32_table() -> str:
    """The 256 remainders of the reflected polynomial 0xEDB88320, by eight shifts of each byte."""
    step = lambda x: f"xor({x} >> 1, CASE WHEN {x} & 1 = 1 THEN 3988292384 ELSE 0 END)"
    tables = ["c0 AS (SELECT i, CAST(i AS BIGINT) AS x FROM range(256) AS r(i))"]
    tables += [f"c{k + 1} AS (SELECT i, {step('x')} AS x FROM c{k})" for k in range(8)]
    return ", ".join(tables) + ", crc AS (SELECT list(x ORDER BY i) AS t FROM c8)"


def prefix_trie(family: int = 100, heads: int = 6) -> str:
    """Prefixes as lists of numbered turns; each node's own value is added to all prefixes of its smallest member up to it."""
    return f"""WITH {_crc32_table()},
turns AS (SELECT conv_id, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS w, length(coalesce(text, '')) AS n,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {family} AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {heads} AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
given AS (SELECT c.conv_id, t.pos AS d, t.w, t.n FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
haves AS (SELECT conv_id, h, (SELECT count(*) FROM given g WHERE g.conv_id = convs.conv_id) AS have FROM convs),
rebuilt AS (SELECT * FROM given UNION ALL SELECT t.conv_id, t.pos - h.h + h.have, t.w, t.n FROM turns t JOIN haves h USING (conv_id) WHERE t.pos > h.h),
seqs AS (SELECT conv_id, d, n, list(w) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM rebuilt UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
lengths AS (SELECT conv_id, max(d) AS len FROM seqs GROUP BY conv_id),
nodes AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n FROM seqs GROUP BY key, d),
ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM seqs JOIN lengths USING (conv_id) WHERE d = len GROUP BY key),
kids AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
totals AS (SELECT s.key, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.n) AS saved FROM own o JOIN seqs s ON s.conv_id = o.conv_id AND s.d <= o.d GROUP BY s.key)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own o JOIN totals t ON t.key = o.key LEFT JOIN nodes p ON o.d > 0 AND p.key = o.key[1:o.d - 1] LEFT JOIN ends e ON e.key = o.key"""


def substring_dedup(w: int = 50) -> str:
    """Every window as a list of words, and the smallest document that has it."""
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, doc_id, p, sha256(array_to_string(ws[p:p + {w - 1}], ' ')) AS mark FROM (SELECT *, unnest(range(1, len(ws) - {w - 2})) AS p FROM d WHERE doc_id IS NOT NULL)),
lows AS (SELECT *, min(doc_id) OVER (PARTITION BY mark) AS low FROM windows),
gone AS (SELECT r, list(DISTINCT i) AS js FROM (SELECT r, unnest(range(p, p + {w})) AS i FROM lows WHERE low < doc_id) GROUP BY r),
kept AS (SELECT d.r, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d) d
         ANTI JOIN (SELECT r, unnest(js) AS i FROM gone) g ON g.r = d.r AND g.i = d.i GROUP BY d.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
