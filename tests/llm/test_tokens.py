import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
import tiktoken
from tokenizers import Tokenizer

from pixelloom.llm import byte_bpe, token_files
from pixelloom.llm.common import Scratch

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def strange():
    out = ["", "a" * 3000, "\x1c \x1d\x85x y  z\n\n\t", "日本語テキスト" * 20, "🙂🙂 x", " <unk> <s> ▁ a▁b", "\x00\x01"]
    return out + [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}" for c in [*range(0x250), *range(0x2000, 0x2100), 0x3000, 0xFEFF, 0xFFFD]]


def test_byte_bpe_equals_reference(reference, prose):
    coder = byte_bpe.bpe(RANKS, P.PATTERN)
    for text in [*strange(), prose(500)]:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_byte_bpe_forgets_and_still_equals(reference, prose):
    coder = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN, most=10)
    for s in range(20):
        assert coder.encode(prose(50, s)) == reference.encode_ordinary(prose(50, s))


def test_byte_bpe_cuts_by_small_tables():
    """Texts of low code points are cut by Python's `re` with the classes written out: the same pre-tokens, in less time."""
    coder = byte_bpe.bpe(RANKS, P.PATTERN)
    assert len({coder.ascii, coder.latin, coder.plane, coder.pattern}) == 4
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for text in [*strange(), plane, " ".join(plane), "a" + "'".join(plane), "1 ".join(plane), "a\ud800 b", plane + "🙂 x"]:
        assert coder.pre_tokens(text) == coder.pattern.findall(text)
    assert byte_bpe.narrowed(r"[\p{Han}x]+|\p{Han}|\[\s|\]{2,}", 0x80).findall("ax[ ]]") == ["x", "[ ", "]]"]
    assert [byte_bpe.narrowed(p, 0x80) for p in (r"(?i:a)", r"\w+", r"[\s-a]", "[[:alpha:]]", "(?:a){e<=1}", r"\X")] == [None] * 6
    other = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), r"\w+|\W+")
    assert other.ascii is other.pattern and other.pre_tokens("ab, c") == ["ab", ", ", "c"]


def test_byte_bpe_models_only_new_pre_tokens(reference, prose):
    """The model is not called for pre-tokens that are tokens, nor again for those of two generations of 140,000."""
    coder, seen = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN), []

    class Counting:
        def encode(self, pieces, model=coder.model, **options):
            seen.extend(pieces)
            return model.encode(pieces, **options)

    coder.model = Counting()
    assert coder.encode("hello there") == reference.encode_ordinary("hello there") and seen == []
    letters = str.maketrans("0123456789", "ghijklmnop")
    text = " ".join(f"zq{i:x}q" for i in range(100_000)).translate(letters)
    first = coder.encode(text)
    new = len(seen)
    for i in range(2):
        coder.encode(" ".join(f"zqx{i}x{j:x}q" for j in range(100_000)).translate(letters))
        seen.clear()
        assert coder.encode(text) == first and seen == []
    assert new > 99_000 and coder.written(np.array(first, np.int32)) == " ".join(map(str, first)).encode() and coder.written(np.zeros(0, np.int32)) == b""


def test_byte_bpe_digest(docs_of, odd, reference):
    rows = byte_bpe.digest(docs_of(odd), RANKS, P.PATTERN).collect()
    assert len(rows) == len(odd)
    for r, (i, text) in zip(rows, odd, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digest(docs_of([]), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_round_trip(docs_of, odd):
    rows = [x for x in odd if x[1] is not None]
    back = byte_bpe.decode(byte_bpe.encode(docs_of(rows), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert [(r.doc_id, r.text) for r in back] == rows
    kept = byte_bpe.encoded_rows(docs_of(odd), RANKS, P.PATTERN)
    assert "keep" in kept.columns and all(r.round_trip for r in kept.collect())


def test_runs_encode_as_the_library_does(prose):
    library = Tokenizer.from_file(WORDS)
    texts = [*strange(), " <|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ.", "İstanbul", "ﬁ ①²½", "é café ́x", "IT'S we'll X'S '", prose(400)]
    for text, ids in zip(texts, token_files.encoded(texts, WORDS, 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_token_files(docs_of, odd):
    library = Tokenizer.from_file(WORDS)
    rows = token_files.round_trip(docs_of(odd), WORDS).collect()
    assert len(rows) == len(odd)
    start = 0
    order = sorted(odd, key=lambda x: (x[0] is not None, x[0] or 0))
    for r, (i, text) in zip(sorted(rows, key=lambda r: r.start), order, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(docs_of([]), WORDS).count() == 0


def test_seekable_file(spark, docs_of, prose, tmp_path):
    scratch = Scratch(spark, "test-files")
    manifest = scratch.save("manifest", token_files.write(docs_of([(i, prose(20, i)) for i in range(40)]), scratch.path("files"), WORDS)).collect()
    library = Tokenizer.from_file(WORDS)
    seen = 0
    for m in manifest:
        reader = token_files.open_file(m.file)
        seen += len(reader)
        for i in reader.ids.tolist()[::7]:
            assert reader.find(i)[0].tolist() == [*library.encode(prose(20, i), add_special_tokens=False).ids, 2]
        assert reader.find(1000) == []
    assert seen == 40
    fs, path = pafs.FileSystem.from_uri(manifest[0].file)
    raw = bytearray(fs.open_input_file(path).read())
    raw[8] ^= 255
    (tmp_path / "bad.zst").write_bytes(raw)
    with pytest.raises(Exception):
        token_files.open_file(f"file://{tmp_path}/bad.zst").content(0)


def test_clashing_columns_go(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", 3)], "n_tokens long, body string, ids int, text string, keep int")
    out = byte_bpe.encoded_rows(df, RANKS, P.PATTERN, text_col="body")
    assert out.columns == ["text", "keep", "n_tokens", "ids", "round_trip"]
    row = out.first()
    assert (row.text, row.keep, row.n_tokens, row.round_trip) == ("x", 3, len(row.ids), True)


def test_decoding_uses_the_ids(docs_of):
    """A wrong id decodes to other bytes."""
    coder = byte_bpe.bpe(RANKS, P.PATTERN)
    ids = np.array(coder.encode("hello there 🙂"), np.int32)
    assert coder.decode_array(ids) == coder.decode(ids.tolist()) == "hello there 🙂".encode() and coder.decode_array(ids[:0]) == b""
    assert coder.decode_array(ids[1:]) != "hello there 🙂".encode()
