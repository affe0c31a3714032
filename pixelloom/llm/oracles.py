"""SQL for the queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

from pixelloom.llm import common, oracles_codes
from pixelloom.llm.licenses import TEMPLATES, bigrams, limits
from pixelloom.llm import line_dedup as lines
from pixelloom.llm.quality import CONSISTENCY, CUTOFF, FLOOR, NAMES

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4],' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-4,1)+1)) AS i FROM w WHERE len(ws)>0) u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh=b.sh AND a.doc_id<b.doc_id GROUP BY 1,2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*k>=80*(x.n+y.n-k)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, other) AS (SELECT a, b FROM f UNION SELECT r.node, f.b FROM r JOIN f ON r.other=f.a),
c AS (SELECT node, min(other) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n,0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id=d.doc_id LEFT JOIN c ON c.node=d.doc_id"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bi AS (SELECT item, ws, least(10,len(ws)) AS k, unnest(range(1, len(ws)-least(10,len(ws))+2)) AS i FROM b WHERE len(ws)>0),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i+k-1],' ') AS win FROM bi),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws)-k+2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(ws)>=k),
h AS (SELECT doc_id, i, bw.k, item FROM (SELECT doc_id, i, k, array_to_string(ws[i:i+k-1],' ') AS win FROM di) x JOIN bw ON bw.k=x.k AND bw.win=x.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i,i+k)) AS pos FROM h) y GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) z GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id=d.doc_id LEFT JOIN it ON it.doc_id=d.doc_id"""


def licences(percent: int = 80) -> str:
    """Units as ranges of non-blank lines; runs only of texts that have enough bigrams of some template as a whole."""
    grams = [bigrams(text) for _, text in TEMPLATES]
    low, high = limits(TEMPLATES, percent)
    rows = ",".join(f"({k},'{TEMPLATES[k][0]}',{len(g)},'{a} {b}')" for k, g in enumerate(grams) for a, b in g)
    return rf"""WITH t AS MATERIALIZED (SELECT * FROM (VALUES {rows}) AS v(k,name,size,gram)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT r, i, row_number() OVER (PARTITION BY r ORDER BY i) AS k, ws FROM (SELECT r, i, list_filter(string_split(ls[i], ' '), lambda w: w<>'') AS ws FROM (SELECT r, ls, unnest(range(1, len(ls)+1)) AS i FROM d) a) b WHERE len(ws)>0),
w AS (SELECT r, k, j, ws[j] AS word FROM (SELECT r, k, ws, unnest(range(1, len(ws)+1)) AS j FROM l) a),
g AS MATERIALIZED (SELECT r, k, next_k, word || ' ' || next_word AS gram FROM (SELECT r, k, word, lead(k) OVER o AS next_k, lead(word) OVER o AS next_word FROM w WINDOW o AS (PARTITION BY r ORDER BY k, j)) a WHERE next_word IS NOT NULL),
m AS (SELECT DISTINCT r FROM (SELECT g.r, t.k, any_value(t.size) AS size, count(DISTINCT g.gram) AS n FROM g JOIN t ON t.gram=g.gram GROUP BY 1,2) a WHERE n*{200 - percent}>=size*{percent}),
c AS MATERIALIZED (SELECT l.r, i, k, sum(len(ws)) OVER (PARTITION BY l.r ORDER BY k) AS upto, len(ws) AS n FROM l JOIN m ON m.r=l.r),
u AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT r, k AS a, k AS b FROM c UNION SELECT r, min(k), max(k) FROM c GROUP BY r, i-k UNION SELECT x.r, x.k, y.k FROM c x JOIN c y ON y.r=x.r AND y.k>=x.k AND y.k<=x.k+{high + 1} AND y.upto-x.upto+x.n<={high + 1}) z),
e AS MATERIALIZED (SELECT DISTINCT u.id, u.r, g.gram FROM u JOIN g ON g.r=u.r AND g.k>=u.a AND g.next_k<=u.b),
n AS (SELECT id, r, count(*) AS n FROM e GROUP BY 1,2 HAVING count(*) BETWEEN {low} AND {high}),
s AS (SELECT n.r, t.k, t.name, max(2e0*shared/(n.n+t.size)) AS dice FROM (SELECT e.id, t.k, count(*) AS shared FROM e JOIN t ON t.gram=e.gram GROUP BY 1,2) q JOIN n ON n.id=q.id JOIN (SELECT DISTINCT k,name,size FROM t) t ON t.k=q.k
 WHERE 100*2e0*shared/(n.n+t.size)>={percent} GROUP BY 1,2,3),
o AS (SELECT r, arg_max(name, dice*1000-k*0.0000001) AS licence, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM s GROUP BY 1)
SELECT d.doc_id, licence, round(coalesce(dice,0e0),6) AS dice, coalesce(licences,'') AS licences FROM d LEFT JOIN o ON o.r=d.r"""


def quality(min_words: int = 50, share: float = 0.75, prior: float = 200.0, most_steps: int = 12, cutoff: float = CUTOFF) -> str:
    """The base counts, the three starts and every concentration step, one after the other. After a step that lowers no
    determinant all others do the same, so all are written out."""
    d, names, k = range(len(NAMES)), NAMES, f"{prior!r}"
    lower = [(i, j) for i in d for j in range(i + 1)]
    moments = ["n", *(f"s_{i}" for i in d), *(f"q_{i}_{j}" for i, j in lower)]
    chain = []
    for i in d:
        rest = f"({names[i]}-mu_{i})" + "".join(f"-l_{i}_{j}*z_{j}" for j in range(i))
        chain.append(f"({rest})/l_{i}_{i} AS z_{i}")
    z, total = ", ".join(chain), "+".join(f"z_{i}*z_{i}" for i in d)
    same = lambda a, b, cols=("level", "lang", "source"): " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)
    groups = "level, lang, source"
    sums = lambda x: ", ".join(["count(*) AS n", *(f"sum({x(i)}) AS s_{i}" for i in d), *(f"sum({x(i)}*{x(j)}) AS q_{i}_{j}" for i, j in lower)])

    def factor(source: str, at: str) -> list[str]:
        """CTEs: sums with those of the levels above, then mean, factor, log-determinant."""
        added = lambda own, more: ", ".join(f"CAST({own}.{m} AS DOUBLE)+{k}*({more}.{m}/{more}.n) AS {m}" for m in moments)
        plain = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in moments)
        floors = [f"greatest(q_{i}_{i}/n-s_{i}/n*(s_{i}/n),{(256 * FLOOR[i]) ** 2!r}) AS v_{i}_{i}" if i == j else f"q_{i}_{j}/n-s_{i}/n*(s_{j}/n) AS v_{i}_{j}" for i, j in lower]
        steps = []
        for i, j in lower:
            rest = f"v_{i}_{j}" + "".join(f"-l_{i}_{c}*l_{j}_{c}" for c in range(j))
            steps.append(f"sqrt(greatest({rest},1e0)) AS l_{i}_{i}" if i == j else f"({rest})/l_{j}_{j} AS l_{i}_{j}")
        size = "+".join(f"ln(l_{i}_{i})" for i in d)
        return [
            f"a{at} AS MATERIALIZED (SELECT {groups}, start, n_rows, {plain} FROM {source} WHERE level=0)",
            f"g{at} AS MATERIALIZED (SELECT x.level, x.lang, x.source, x.start, x.n_rows, {added('x', 'a')} FROM {source} x JOIN a{at} a ON a.start=x.start WHERE x.level=1)",
            f"o{at} AS MATERIALIZED (SELECT * FROM a{at} UNION ALL SELECT * FROM g{at} UNION ALL SELECT x.level, x.lang, x.source, x.start, x.n_rows, {added('x', 'g')} FROM {source} x JOIN g{at} g ON g.start=x.start AND g.lang IS NOT DISTINCT FROM x.lang WHERE x.level=2)",
            f"p{at} AS MATERIALIZED (SELECT {groups}, start, n_rows, {', '.join(f's_{i}/n AS mu_{i}' for i in d)}, {', '.join(floors)}, {', '.join(steps)}, round({size},6) AS size FROM o{at})",
        ]

    def concentrated(params: str, at: str) -> list[str]:
        return [
            f"d{at} AS MATERIALIZED (SELECT f.{', f.'.join(('level', 'lang', 'source'))}, p.start, p.n_rows, {', '.join(f'f.{n}' for n in names)}, {z} FROM h f JOIN {params} p ON {same('f', 'p')})",
            f"b{at} AS MATERIALIZED (SELECT {groups}, start, n_rows, CAST(floor(32*ln(1e0+({total}))) AS INT) AS bin, {sums(lambda i: names[i])} FROM d{at} GROUP BY 1,2,3,4,5,6)",
            f"i{at} AS MATERIALIZED (SELECT *, coalesce(sum(n) OVER (PARTITION BY {groups}, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM b{at})",
            f"s{at} AS MATERIALIZED (SELECT {groups}, start, n_rows, {', '.join(f'sum({m}) AS {m}' for m in moments)} FROM i{at} WHERE before<ceil({share}*n_rows) GROUP BY 1,2,3,4,5)",
        ]

    pick = lambda i, what: f"max(CASE WHEN i={i} THEN {what} END)"
    middle = ", ".join([*(f"{pick(i, 'CAST(mid AS DOUBLE)')} AS m_{i}" for i in d), *(f"{pick(i, f'greatest((high-low)/1.349e0,{256.0 * FLOOR[i]!r})')} AS w_{i}" for i in d)])
    tangent = lambda i: f"CAST(round(1024*tanh(({names[i]}-m_{i})/w_{i})) AS BIGINT)"
    turned = ", ".join(["n", *(f"n*m_{i}+w_{i}*(s_{i}/1024e0) AS s_{i}" for i in d), *(f"n*m_{i}*m_{j}+m_{i}*w_{j}*(s_{j}/1024e0)+m_{j}*w_{i}*(s_{i}/1024e0)+w_{i}*w_{j}*(q_{i}_{j}/1024e0/1024e0) AS q_{i}_{j}" for i, j in lower)])
    columns = f"{groups}, start, n_rows, {', '.join(f'mu_{i}' for i in d)}, {', '.join(f'l_{i}_{j}' for i, j in lower)}"
    newer = columns.replace(" start,", " 1 AS start,")
    least = lambda rows: f"SELECT {columns.replace(' start,', ' 0 AS start,')}, size FROM (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY size, start) AS place FROM ({rows}) a) b WHERE place=1"
    parts = [
        rf"""w AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(coalesce(text,''), '[#*$%&|<>]')) AS n_symbols,
 list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents)""",
        "t AS (SELECT doc_id, i, array_to_string(ws[i:i+2],' ') AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-1)) AS i FROM w WHERE len(ws)>2) u)",
        "r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i,i+3)) AS pos FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS k FROM t) a WHERE k>1) b GROUP BY 1)",
        "c AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws,'')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines)-len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words,0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id=w.doc_id)",
        f"""f AS MATERIALIZED (SELECT *, n_words<{min_words} OR 100*n_repeat_words>50*n_words AS base_failed, CAST(round(256*ln(1e0+n_words)) AS BIGINT) AS {names[0]}, CAST(round(256*ln(CAST(greatest(word_chars,1) AS DOUBLE)/greatest(n_words,1))) AS BIGINT) AS {names[1]}, CAST(round(256*ln(1e0+1000e0*n_symbols/greatest(word_chars,1))) AS BIGINT) AS {names[2]},
 CAST(round(256*ln(1e0+10e0*n_dup_lines/greatest(n_lines,1))) AS BIGINT) AS {names[3]}, CAST(round(256*ln(1e0+10e0*n_repeat_words/greatest(n_words,1))) AS BIGINT) AS {names[4]} FROM c)""",
        f"h AS MATERIALIZED (SELECT level, CASE WHEN level>0 THEN lang END AS lang, CASE WHEN level>1 THEN source END AS source, {', '.join(names)} FROM f, (VALUES (0),(1),(2)) AS v(level) WHERE NOT base_failed)",
        f"x AS ({' UNION ALL '.join(f'SELECT {groups}, {i} AS i, {names[i]} AS x FROM h' for i in d)})",
        f"y AS (SELECT *, row_number() OVER (PARTITION BY {groups}, i ORDER BY x) AS k, count(*) OVER (PARTITION BY {groups}, i) AS n FROM x)",
        f"q AS (SELECT {groups}, i, n, min(CASE WHEN k>=0.25e0*n THEN x END) AS low, min(CASE WHEN k>=0.5e0*n THEN x END) AS mid, min(CASE WHEN k>=0.75e0*n THEN x END) AS high FROM y GROUP BY 1,2,3,4,5)",
        f"mid AS MATERIALIZED (SELECT {groups}, max(n) AS n_rows, {middle} FROM q GROUP BY 1,2,3)",
        f"plain AS MATERIALIZED (SELECT {groups}, 1 AS start, count(*) AS n_rows, {sums(lambda i: names[i])} FROM h GROUP BY 1,2,3)",
        f"bent AS MATERIALIZED (SELECT h.level, h.lang, h.source, count(*) AS n_rows, {sums(tangent)} FROM h JOIN mid ON {same('h', 'mid')} GROUP BY 1,2,3)",
        f"turned AS MATERIALIZED (SELECT bent.level, bent.lang, bent.source, 2 AS start, bent.n_rows, {turned} FROM bent JOIN mid ON {same('bent', 'mid')})",
        *factor("plain", "_1"),
        *factor("turned", "_2"),
        f"starts AS MATERIALIZED (SELECT {groups}, 0 AS start, n_rows, {', '.join(f'm_{i} AS mu_{i}' for i in d)}, {', '.join((f'w_{i}' if i == j else '0e0') + f' AS l_{i}_{j}' for i, j in lower)} FROM mid UNION ALL SELECT {columns} FROM p_1 UNION ALL SELECT {columns} FROM p_2)",
        *concentrated("starts", "_3"),
        *factor("s_3", "_3"),
        *concentrated("p_3", "_4"),
        *factor("s_4", "_4"),
        f"v0 AS MATERIALIZED ({least('SELECT * FROM p_4')})",
    ]
    for step in range(1, most_steps + 1):
        parts += [*concentrated(f"v{step - 1}", f"_{step + 4}"), *factor(f"s_{step + 4}", f"_{step + 4}")]
        parts.append(f"v{step} AS MATERIALIZED ({least(f'SELECT {columns}, size FROM v{step - 1} UNION ALL SELECT {newer}, size FROM p_{step + 4}')})")
    parts.append(f"e AS (SELECT f.*, {z} FROM f LEFT JOIN v{most_steps} p ON p.level=2 AND {same('f', 'p', ('lang', 'source'))})")
    far = f"({total})/{CONSISTENCY!r}"
    return f"WITH {', '.join(parts)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN NOT base_failed THEN round({far},3) END AS distance2, NOT base_failed AND coalesce({far},0e0)<={cutoff!r} AS kept FROM e"


def _scrambled(rows: str, keep: str) -> str:
    """The finaliser of splitmix64 of column x, step by step."""
    times = lambda x, c: f"CAST(CAST({x} AS UHUGEINT)*{c}::UHUGEINT%18446744073709551616::UHUGEINT AS UBIGINT)"
    return (
        f"SELECT {keep}, xor(x, x>>31) AS x FROM (SELECT {keep}, {times('x', 0x94D049BB133111EB)} AS x FROM (SELECT {keep}, xor(x, x>>27) AS x FROM "
        f"(SELECT {keep}, {times('x', 0xBF58476D1CE4E5B9)} AS x FROM (SELECT {keep}, xor(x, x>>30) AS x FROM ({rows}) a) b) c) d) e"
    )


def line_dedup(shape: dict = lines._SHAPE, rules: dict = lines.RULES) -> str:
    """Templates as strings: the same tree, with lists in the place of hashes. Sketches by the same hashes, in 128-bit
    arithmetic. A space stands for a token with digits."""
    lead, parts, bands, k = shape["lead"], shape["parts"], range(shape["bands"]), shape["shingle"]
    whole = lambda x: f"CAST(({x})%18446744073709551616::UHUGEINT AS UBIGINT)"
    wide = lambda x: f"CAST({x} AS UHUGEINT)"
    lower = _LOWER.replace("coalesce(text,'')", "line")
    stretches = ", ".join(f"array_to_string(rest[len(rest)*{q}//{parts}+1:len(rest)*{q + 1}//{parts}],' ') AS p{q}" for q in range(parts))
    key = lambda q: "n || '|' || head" + "".join(f" || chr(10) || {'p' + str(i) if i != q else repr('* ' + str(q))}" for i in range(parts))
    keys = " UNION ALL ".join([f"SELECT mark, idx, n, {key(None)} AS key FROM s", *(f"SELECT mark, idx, n, {key(q)} FROM s WHERE n>{lead + parts}" for q in range(parts))])
    values = ",".join(f"({b},{int(v)}::UBIGINT)" for b, v in enumerate(common._VALUES))
    def least(k: int, factors: int, tag: str) -> list[str]:
        """lq<tag>: the least hash of the k-word shingles of each third of a text, by hash function."""
        sums = "+".join(f"{wide(f'coalesce(h{i},0)')}*{pow(lines._Q, i, 2**64)}::UHUGEINT%18446744073709551616::UHUGEINT" for i in range(k))
        return [
            f"sh{tag} AS (SELECT mark, pos, n, {', '.join(f'lead(h,{i}) OVER o AS h{i}' for i in range(k))} FROM w JOIN hw ON hw.word=w.word WINDOW o AS (PARTITION BY mark ORDER BY pos))",
            f"sc{tag} AS MATERIALIZED ({_scrambled(f'SELECT mark, pos, greatest(n-{k - 1},1) AS n, {whole(f'{sums}+{wide(f'least(n,{k})')}')} AS x FROM sh{tag} WHERE pos<greatest(n-{k - 1},1)', 'mark, pos, n')})",
            f"rg{tag} AS (SELECT DISTINCT mark, q, least(n*q//3,n-1) AS low, greatest(least(n*q//3,n-1)+1,n*(q+1)//3) AS high FROM sc{tag}, (VALUES (0),(1),(2)) AS v(q))",
            f"lq{tag} AS MATERIALIZED (SELECT sc{tag}.mark, q, {', '.join(f'min({whole(f'{wide(chr(120))}*{int(lines._FACTORS[b])}::UHUGEINT')}) AS b{b}' for b in range(factors))} FROM sc{tag} JOIN rg{tag} ON rg{tag}.mark=sc{tag}.mark AND pos>=low AND pos<high GROUP BY 1,2)",
        ]

    ctes = [
        "d AS MATERIALIZED (SELECT text, CAST('0x' || substr(md5(text),1,15) AS BIGINT) AS mark FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) u)",
        "l AS (SELECT mark, idx, string_split(text, chr(10))[idx] AS line FROM (SELECT mark, text, unnest(range(1, len(string_split(text, chr(10)))+1)) AS idx FROM d) v)",
        rf"k AS MATERIALIZED (SELECT mark, idx, line, list_transform(regexp_extract_all({lower}, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN ' ' ELSE w END) AS ws FROM l)",
        f"s AS MATERIALIZED (SELECT mark, idx, len(ws) AS n, array_to_string(ws[1:{lead}],' ') AS head, {stretches} FROM (SELECT *, ws[{lead + 1}:] AS rest FROM k WHERE len(list_filter(ws, lambda w: w<>' '))>0) e)",
        f"t AS MATERIALIZED ({keys})",
        # words, and the hash of each different one
        "w AS MATERIALIZED (SELECT mark, row_number() OVER (PARTITION BY mark ORDER BY idx, j)-1 AS pos, count(*) OVER (PARTITION BY mark) AS n, ws[j] AS word FROM (SELECT mark, idx, ws, unnest(range(1, len(ws)+1)) AS j FROM k) a)",
        "o AS (SELECT DISTINCT word FROM w WHERE word<>' ')",
        f"pw(i, p) AS (SELECT 0::BIGINT, 1::UBIGINT UNION ALL SELECT i+1, {whole(f'{wide(chr(112))}*{common._BASE}::UHUGEINT')} FROM pw WHERE i+1<(SELECT max(octet_length(encode(word))) FROM o))",
        f"vb(b, v) AS (VALUES {values})",
        f"hs AS (SELECT word, {whole(f'{wide(chr(115))}+{wide(chr(110))}')} AS x FROM (SELECT word, max(size) AS n, sum({whole(f'{wide(chr(118))}*{wide(chr(112))}')}) AS s FROM (SELECT word, octet_length(encode(word)) AS size, hex(encode(word)) AS hx, unnest(range(0, octet_length(encode(word)))) AS i FROM o) a JOIN vb ON b=CAST('0x' || substr(hx,2*i+1,2) AS INT) JOIN pw ON pw.i=a.i GROUP BY 1) c)",
        f"hw AS MATERIALIZED (SELECT word, x AS h FROM ({_scrambled('SELECT * FROM hs', 'word')}) z UNION ALL SELECT ' ', {int(lines._FIELD)}::UBIGINT)",
        *least(k, len(bands), ""),
        *least(2, shape["pairs"], "2"),
        "ls AS (" + " UNION ALL ".join(f"SELECT mark, {b} AS band, max(CASE WHEN q=0 THEN b{b} END) AS x, max(CASE WHEN q=1 THEN b{b} END) AS y, max(CASE WHEN q=2 THEN b{b} END) AS z FROM lq GROUP BY 1" for b in bands) + ")",
        f"l1 AS (SELECT mark, band, z, {whole(f'{wide(chr(120))}+{wide(chr(121))}')} AS x FROM ({_scrambled('SELECT * FROM ls', 'mark, band, y, z')}) f)",
        f"l2 AS (SELECT mark, band, {whole(f'{wide(chr(120))}+{wide(chr(122))}+{wide('band')}')} AS x FROM ({_scrambled('SELECT * FROM l1', 'mark, band, z')}) f)",
        f"bk AS MATERIALIZED ({_scrambled('SELECT * FROM l2', 'mark, band')})",
        "pr AS (SELECT DISTINCT mark, low FROM (SELECT mark, min(mark) OVER (PARTITION BY x) AS low FROM bk) a WHERE mark>low)",
        f"ln AS (SELECT mark, low FROM (SELECT pr.mark, pr.low, sum({'+'.join(f'CAST(a.b{b}=o.b{b} AS INT)' for b in range(shape["pairs"]))}) AS same FROM pr JOIN lq2 a ON a.mark=pr.mark JOIN lq2 o ON o.mark=pr.low AND o.q=a.q GROUP BY 1,2) c WHERE same>={3 * shape['pairs'] * lines.AGREE!r}-1e-9)",
        "nb AS (SELECT mark AS a, low AS b FROM ln UNION SELECT low, mark FROM ln)",
        "cc(mark, root) AS (SELECT a, a FROM nb UNION SELECT nb.b, cc.root FROM cc JOIN nb ON nb.a=cc.mark)",
        "cp AS (SELECT mark FROM cc GROUP BY 1 HAVING min(root)<mark)",
        f"r AS (SELECT key FROM t WHERE mark NOT IN (SELECT mark FROM cp) GROUP BY key HAVING count(DISTINCT mark)>=CASE WHEN max(n)>={shape['long_from']} THEN {rules['min_long']} WHEN max(n)<{shape['short_to']} THEN {rules['min_short']} ELSE {rules['min_docs']} END)",
        "g AS (SELECT DISTINCT mark, idx FROM t JOIN r ON r.key=t.key)",
        "f AS (SELECT k.mark, count(*) FILTER (WHERE len(ws)>0) AS n_lines, count(*) FILTER (WHERE len(ws)>0 AND g.mark IS NULL) AS n_kept, coalesce(string_agg(line, chr(10) ORDER BY k.idx) FILTER (WHERE g.mark IS NULL), '') AS kept FROM k LEFT JOIN g ON g.mark=k.mark AND g.idx=k.idx GROUP BY 1)",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT x.doc_id, coalesce(n_lines,0) AS n_lines, coalesce(n_kept,0) AS n_kept, sha256(coalesce(kept,'')) AS kept_sha256 FROM documents x LEFT JOIN d ON d.text=x.text LEFT JOIN f ON f.mark=d.mark"


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN, "op3_quality": quality(), "op6_decontaminate": DECONTAMINATE, "op7_line_dedup": line_dedup(), "op10_licenses": licences(), "op11_substring_dedup": oracles_codes.substring_dedup(), "op12_prefix_trie": oracles_codes.prefix_trie(), "op13_vector_codes": oracles_codes.vector_codes()}
