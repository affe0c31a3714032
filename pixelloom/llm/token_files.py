"""Token ids in seekable zstandard files.

A file holds one independent zstandard frame per document (its ids, little-endian unsigned 32-bit), then a skippable
frame with the document ids, then the seek table of the public seekable format: compressed size, size and checksum
(low 32 bits of XXH64 of the content) of each frame, and a footer. A reader needs the tail of the file and the frames of
the documents it asks for. Documents are in ascending order of their id, within and across files.

Text is encoded by the `tokenizers` library. The vocabulary's pattern never matches across white space, so runs of
other characters are encoded one by one and remembered.

Defined results: null and empty texts have only the end id; repeated rows are all written, next to each other;
documents without an id come first; an empty table gives no files and no rows. Task retries write new files; only those
named in the manifest count.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.byte_bpe import byte_characters
from pixelloom.llm.common import Generations, HashedWords, Scratch, tidy

# Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class Writer:
    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.table, self.ids = bytearray(), []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.packer.compress(content)
        self.stream.write(frame)
        self.table += struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.ids.append(-(2**63) if doc_id is None else doc_id)

    def close(self) -> None:
        index = self.packer.compress(np.array(self.ids, "<i8").tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table += struct.pack("<III", len(index) + 8, 0, 0)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(self.table) + 9) + bytes(self.table) + struct.pack("<IBI", len(self.ids) + 1, HAS_CHECKSUMS, SEEKABLE_MAGIC))
        self.stream.close()


class Reader:
    """Random access by document: reads the tail first, later only the frames asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        file.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(file.read(12 * frames), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        file.seek(int(self.offsets[-2]) + 8)
        self.unpacker = zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(self.unpacker.decompress(file.read(int(self.table[-1, 0]) - 8)), "<i8")

    def __len__(self) -> int:
        return len(self.ids)

    def content(self, i: int) -> bytes:
        self.file.seek(int(self.offsets[i]))
        out = self.unpacker.decompress(self.file.read(int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
        if len(out) != self.table[i, 1] or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return out

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this id."""
        i, j = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return [np.frombuffer(self.content(k), "<u4") for k in range(i, j)]


def open_file(uri: str) -> Reader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path))


_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def pieces_of(run: str) -> list[str] | None:
    """What the vocabulary's pattern makes of a run of printable ASCII and composed Latin letters, which its normaliser
    only lower-cases. None: other runs, which go through the library's whole chain."""
    if not run.isprintable() or max(run) > "\u024f" or "\u0130" in run or "<|" in run:
        return None
    if run.isalpha():
        return [run.lower()]
    if run[:-1].isalpha():
        return [run[:-1].lower(), run[-1]]
    return _PIECES.findall(run.lower())


class WordIds(HashedWords):
    """The ids of many texts at once. Runs of non-white-space are known by 64-bit hashes in a table with one place per slot;
    a run that is not there is encoded and takes its place. Runs' ids lie in one array, from which texts are gathered."""

    def __init__(self, path: str, end_id: int, most: int = 800_000, bits: int = 21):
        super().__init__(fold=False)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if not all(t.content.startswith("<|") for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("added tokens have to begin with <|")
        self.model, self.chars = self.library.model, "".join(byte_characters())
        self.pieces, self.end = Generations(self._merged, most=300_000), np.array([end_id], "<u4").tobytes()
        self.most, self.mask = most, np.uint64((1 << bits) - 1)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.number = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
        self.starts, self.sizes, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(0, "<u4")
        self.used, self.runs = 0, 1

    def _merged(self, pieces: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.chars))]).tobytes() for p in pieces]

    def _encode(self, runs: list[bytes]) -> list[bytes]:
        texts = [r.decode("utf-8", "replace") for r in runs]
        plain = list(map(pieces_of, texts))
        ids = self.pieces.ensure({p for pieces in plain if pieces for p in pieces})
        rest = iter(self.library.encode_batch_fast([t for t, pieces in zip(texts, plain, strict=True) if pieces is None], add_special_tokens=False))
        return [np.array(next(rest).ids, "<u4").tobytes() if pieces is None else ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces]) for pieces in plain]

    def _grown(self, name: str, n: int) -> np.ndarray:
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros(max(n, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def _numbers(self, words: np.ndarray, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The number of each word's ids."""
        slot = (words >> np.uint64(20)) & self.mask
        out = self.number[slot]
        lost = np.flatnonzero(self.hashes[slot] != words)
        if len(lost) == 0:
            return out
        new, at, back = np.unique(words[lost], return_index=True, return_inverse=True)
        if self.runs + len(new) > self.most and self.runs > 1:
            self._clear()
            return self._numbers(words, raw, first, last)
        data, n = raw.tobytes(), self.runs
        made = self._encode([data[i:j] for i, j in zip(first[lost[at]].tolist(), last[lost[at]].tolist(), strict=True)])
        sizes = np.array([len(m) // 4 for m in made], np.int32)
        flat = np.frombuffer(b"".join(made), "<u4")
        ends = np.cumsum(sizes)
        self._grown("starts", n + len(new))[n : n + len(new)] = self.used + ends - sizes
        self._grown("sizes", n + len(new))[n : n + len(new)] = sizes
        self._grown("ids", self.used + len(flat))[self.used : self.used + len(flat)] = flat
        self.used, self.runs = self.used + len(flat), n + len(new)
        out[lost] = n + back
        self.hashes[slot[lost[at]]], self.number[slot[lost[at]]] = new, n + np.arange(len(new))
        return out

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, the end's last."""
        for _, raw, ends in self.blocks(texts):
            words, own, first, last = self.placed(raw, ends)
            number = self._numbers(words, raw, first, last)
            sizes = self.sizes[number].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.ids[np.repeat(self.starts[number] - upto[:-1], sizes) + np.arange(upto[-1])]
            cuts = upto[np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(ends)))])]
            for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                yield ids[i:j].tobytes() + self.end


_CODERS: dict = {}


def coder(path: str, end_id: int) -> WordIds:
    if (path, end_id) not in _CODERS:
        _CODERS[path, end_id] = WordIds(path, end_id)
    return _CODERS[path, end_id]


def encoded(texts: list[str | None], path: str, end_id: int) -> Iterator[bytes]:
    yield from coder(path, end_id).encoded(pa.array(texts, pa.string()))


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents; gives the manifest: file, n_docs, n_tokens, first_id, last_id. Evaluate it once
    (save it): evaluating it writes the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri, tokens = None, f"{folder}/{uuid.uuid4().hex}.zst", 0
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), coder(path, end_id).encoded(batch.column(1)), strict=True):
                if writer is None:
                    fs, target = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(os.path.dirname(target), recursive=True)
                    writer = Writer(fs.open_output_stream(target, compression=None))
                writer.add(doc_id, content)
                tokens += len(content) // 4
        if writer is not None:
            writer.close()
            first, last = (None if i == -(2**63) else i for i in (writer.ids[0], writer.ids[-1]))
            yield pa.RecordBatch.from_pylist([{"file": uri, "n_docs": len(writer.ids), "n_tokens": tokens, "first_id": first, "last_id": last}], pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    ordered = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(tidy(run), "file string, n_docs long, n_tokens long, first_id long, last_id long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of the manifest, each frame verified."""
    before = W.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows = open_file(uri), []
                for i in range(len(reader)):
                    content = reader.content(i)
                    doc_id = int(reader.ids[i])
                    rows.append((None if doc_id == -(2**63) else doc_id, start, len(content) // 4, zlib.crc32(content)))
                    start += len(content) // 4
                    if len(rows) == 20_000 or i == len(reader) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=schema)
                        rows = []

    return files.select("file", "before").repartition(max(1, manifest.count()), "file").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    return read(scratch.save("manifest", write(docs, scratch.path("files"), path, end_id)))
