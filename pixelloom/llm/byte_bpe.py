"""Byte-level BPE with a sentencepiece BPE model that is serialised here from a rank file.

Every byte is mapped to one printable character, so each vocabulary entry becomes a sentencepiece piece; a piece's
score is its negative rank, so sentencepiece merges in rank order, leftmost first, as byte-level BPE does. The
normaliser is the identity. Text is cut into pre-tokens by a pattern; every pre-token is encoded on its own. Decoding
maps ids back to bytes. Most of the time goes by the pre-token, repeated or new: a repeated one costs a lookup and a share of a
join, a new one its call of the model and slices of arrays.

Defined results: null and empty texts have no ids, the sha256 of the empty string twice. Texts of any length are
processed whole. Repeated rows give repeated results. Extra columns are dropped by `digest` and kept by `encode`
callers that select them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelloom.llm.common import Generations, tidy


def byte_characters() -> list[str]:
    """One printable, non-space character for each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {}, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field."""
    if isinstance(value, float):
        import struct

        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is <unk>, piece i+1 the token with the i-th rank."""
    chars = byte_characters()
    pieces = [_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in token)) + _field(2, -float(rank)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos or pad
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


_CLASS = r"\\[pP]\{\w+\}|\\[sS]"
_ESCAPE = r"\\[^\w\s]|\\[rnt]"
_SET = rf"\[\^?(?:{_CLASS}|{_ESCAPE}|[^\\\[\]^-](?:-[^\\\[\]-])?)+\]"
#: What `re` and `regex` read alike, but for the classes: literals, sets, groups, lookaheads and repeats.
_ALIKE = re.compile(rf"(?:{_SET}|{_CLASS}|{_ESCAPE}|\((?:\?[:!=]|(?!\?))|\{{\d+,?\d*\}}|[^\\\[\](){{}}]|\))*")


@functools.cache
def narrowed(pattern: str, limit: int) -> re.Pattern | None:
    """The pattern for texts of code points below limit, with `regex`'s classes written out, for Python's `re`: that reads a
    set of few code points from a small table. None where the two might differ."""
    if not _ALIKE.fullmatch(pattern):
        return None
    characters = "".join(map(chr, range(limit)))

    def members(name: re.Match) -> str:
        runs = [m.span() for m in regex.finditer(f"(?:{name[0]})+", characters)] or [(limit, limit + 1)]  # one that never comes
        return "".join(f"\\U{i:08x}-\\U{j - 1:08x}" for i, j in runs)

    def part(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(rf"{_ESCAPE}|({_CLASS})", lambda x: members(x) if x[1] else x[0], m[0])
        return f"[{members(m)}]" if m[1] else m[0]

    return re.compile(re.sub(rf"{_ESCAPE}|({_CLASS})|{_SET}", part, pattern))


class ByteBpe:
    """Encoder and decoder. What pre-tokens become is remembered: the ids as 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 140_000):
        self.pattern = regex.compile(pattern)
        self.ascii, self.latin, self.plane = (narrowed(pattern, limit) or self.pattern for limit in (0x80, 0x100, 0x10000))
        self.chars = np.array([ord(c) for c in byte_characters()], "<u4")
        self.ids = np.array([-1, *sorted(ranks.values())], np.int32)  # of each piece
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        # the bytes of all ids one after the other, where each begins and how many it has
        many = max(self.bytes_of, default=-1) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(many)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(many)), np.uint8)
        self.names = np.array([f"{i} " for i in range(many)], "S")
        self.ranks, self.known = ranks, Generations(self._entries, most)

    def pre_tokens(self, text: str) -> list[str]:
        """All matches of the pattern."""
        if text.isascii():
            return self.ascii.findall(text)
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            return (self.plane if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.pattern).findall(text)

    def _entries(self, pre_tokens: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "surrogatepass") for t in pre_tokens]
        # a pre-token that is a token stays one, reachable by merges or not
        whole = list(map(self.ranks.get, raw))
        rest = [r for r, i in zip(raw, whole, strict=True) if i is None]
        mapped = self.chars[np.frombuffer(b"".join(rest), np.uint8)].tobytes().decode("utf-32-le")
        pieces = self.model.encode([mapped[i:j] for i, j in pairwise(accumulate(map(len, rest), initial=0))], num_threads=1)
        ids = self.ids[np.fromiter(chain.from_iterable(pieces), np.int32)].tobytes()
        made = (ids[4 * i : 4 * j] for i, j in pairwise(accumulate(map(len, pieces), initial=0)))
        return [next(made) if i is None else np.int32(i).tobytes() for i in whole]

    def forget(self) -> None:
        """At the end of a task: a worker process lives on in other stages, which need the memory."""
        self.known.young, self.known.old = {}, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_array(self, ids: np.ndarray) -> bytes:
        """The same of an array."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.flat[places].tobytes()

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by spaces."""
        return self.names[ids].tobytes().translate(None, b"\0")[:-1]

    def arrays(self, texts: list[str | None], block: int = 1_000_000) -> Iterator[np.ndarray]:
        """The ids of each text. Blocks of about a million characters bound what is held at once."""
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(self.pre_tokens(text or ""))
            size += len(text or "")
            if size >= block or i == len(texts) - 1:
                known = self.known.ensure(set().union(*held))
                for pre_tokens in held:
                    yield np.frombuffer(b"".join(map(known.__getitem__, pre_tokens)), np.int32)
                held, size = [], 0

    def encode(self, text: str | None) -> list[int]:
        return next(self.arrays([text])).tolist()


_BUILT: dict = {}


def bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _BUILT[path, pattern]


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: a narrow map, without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.arrays(texts), strict=True):
                rows.append((doc_id, len(ids), hashlib.sha256(coder.written(ids)).hexdigest(), hashlib.sha256(coder.decode_array(ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)
        coder.forget()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_rows(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Every row with n_tokens, ids and round_trip (whether the ids decode to the text's bytes) in place of its text; columns
    of these names that were there go."""
    docs = docs.select(*(c for c in docs.columns if c == text_col or c not in ("n_tokens", "ids", "round_trip")))
    at = docs.columns.index(text_col)
    others = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*others, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(read_ranks(path), pattern, 45_000)  # of this task alone: the worker lives on in stages that need the memory
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts, rows = part.column(at).to_pylist(), []
                for text, ids in zip(texts, coder.arrays(texts), strict=True):
                    rows.append((len(ids), ids, coder.decode_array(ids) == (text or "").encode("utf-8", "surrogatepass")))
                columns = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.bool_())], [*(f.name for f in others), "n_tokens", "ids", "round_trip"])

    return docs.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of the ids; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(i.as_py() or []).decode("utf-8", "replace") for i in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
