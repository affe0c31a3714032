"""Secret scan: fixed rules, and sliding-window Shannon entropy over candidate strings.

Rules (`base`), leftmost and non-overlapping per kind: `assign`, a keyword, `:` or `=`, and a value of at least 12
characters; `access`, AKIA and capitals or digits, 18 characters at least; `hex`, 16 or more of 0-9a-f.

Entropy: candidates are runs of [A-Za-z0-9+/_=-]. Within a candidate the longest parts of one character class (hex
digits; letters and digits; all base64 characters) are looked at. A window of `width` characters slides over a part;
counts per character are updated by one step in and one out, so the entropy of each window costs constant time. Windows
at or above the class's threshold, merged, make an `entropy` span. The allow-list suppresses what is known to be
harmless: numbers, UUIDs, words joined by - _ / or +, placeholders, and strings without both letters and digits. Spans
inside a rule's span add nothing and are left out.

Positions are code points, ends exclusive. Defined results: null and empty texts have no spans; texts are scanned whole;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.llm.common import tidy

KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: class -> its parts, least entropy in bits of a window
CLASSES = {"hex": (re.compile(r"[0-9a-fA-F]+"), 3.0), "alnum": (re.compile(r"[A-Za-z0-9]+"), 3.75), "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9)}
ALLOWED = re.compile(
    r"[0-9+/_=-]*"  # numbers
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUIDs
    r"|[A-Za-z]*+[0-9]{0,4}+(?:[+/_=-]++[A-Za-z]*+[0-9]{0,4}+)*+"  # words, perhaps numbered, joined; no step is tried twice
    r"|.*(?:example|placeholder|changeme|your|xxxx|1234567890|abcdefgh).*",
    re.I | re.A,
)


def windows(text: str, width: int, least: float) -> Iterator[tuple[int, int]]:
    """Merged windows of text whose entropy is `least` at least, by incremental counts."""
    if len(text) < width:
        return
    term = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1  # total: sum of c log c; entropy = log(width) - total / width
    most = width * (math.log2(width) - least) + 1e-9
    for i, char in enumerate(text):
        if i >= width:  # out first, so that no count exceeds the window
            gone = text[i - width]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
        c = counts.get(char, 0)
        total += term[c + 1] - term[c]
        counts[char] = c + 1
        if i >= width - 1 and total <= most:
            if start >= 0 and i - width + 1 > end:
                yield start, end
                start = -1
            start, end = (i - width + 1 if start < 0 else start), i + 1
    if start >= 0:
        yield start, end


def spans(text: str, width: int = 20) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added): start, end, kind of each."""
    base, added = [], []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for candidate in _CANDIDATE.finditer(text):
        run, at = candidate[0], candidate.start()
        # the kinds below are runs inside a run of candidate characters, so no match crosses its ends
        base += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(run) if len(m[0]) >= 18]
        base += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(run) if len(m[0]) >= 16]
        if len(run) >= width and not ALLOWED.fullmatch(run):
            found: list[tuple[int, int]] = []
            for parts, least in CLASSES.values():
                for m in parts.finditer(run):
                    if len(m[0]) >= width and not ALLOWED.fullmatch(m[0]):
                        found += [(at + m.start() + i, at + m.start() + j) for i, j in windows(m[0], width, least)]
            merged: list[list[int]] = []
            for i, j in sorted(found):
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], j)
                else:
                    merged.append([i, j])
            added += [(i, j, "entropy") for i, j in merged]
    return base, outside(added, base)


def outside(added: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans, in order of their starts, that lie in no span of base: one walk along both."""
    out, rest, reach = [], sorted(base), 0
    at = 0
    for i, j, kind in added:
        while at < len(rest) and rest[at][0] <= i:
            reach, at = max(reach, rest[at][1]), at + 1
        if reach < j:
            out.append((i, j, kind))
    return out


def _text(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{i}:{j}" for i, j, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; a narrow map."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, added = spans(text.as_py() or "", width)
                kinds = [x[2] for x in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_text(base).encode()).hexdigest(), _text(base + added)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(5))], schema=schema)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
