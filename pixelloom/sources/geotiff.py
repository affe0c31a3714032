"""GeoTIFF files: read into pixels by ranges of bytes, written by many tasks.

Strips and tiles, both byte orders, classic and big files; uncompressed, deflate, LZW and PackBits; horizontal predictor.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pixelloom.model import DTYPES, SCENE_SCHEMA, Rasters, null_to_nodata
from pixelloom.operators import grid
from pixelloom.operators.components import saved

# Fixed values of the file format: tag numbers, and field types by number.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIE, KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (3, 32): "float32", (3, 64): "float64"}
_LISTS = {STRIP_OFFSETS, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES}


class Ranges:
    """A file that is read by ranges, through Arrow's file systems; `count` is how many bytes were asked for."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
        self.file, self.count = fs.open_input_file(path), 0

    def __call__(self, at: int, n: int) -> bytes:
        self.count += n
        return self.file.read_at(n, at)


def tags(get: Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image. The places and sizes of blocks, long lists in large files, stay where
    they are: (place in the file, code, count) instead of the values."""
    start = get(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", start[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), start[8:16] if big else start[4:8])[0]
    n, at = (struct.unpack(order + "Q", get(at, 8))[0], at + 8) if big else (struct.unpack(order + "H", get(at, 2))[0], at + 2)
    out: dict[int, tuple] = {}
    size, inline = (20, 8) if big else (12, 4)
    entries = get(at, size * n)
    for i in range(n):
        entry = entries[size * i : size * (i + 1)]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + inline])[0]
        if kind not in FIELDS:
            continue
        code = FIELDS[kind]
        length = count * struct.calcsize("=" + code)
        place = at + size * i + 4 + inline
        raw = entry[4 + inline : 4 + inline + length]
        if length > inline:
            place = struct.unpack(order + ("Q" if big else "I"), entry[4 + inline :])[0]
        if tag in _LISTS:
            out[tag] = (place, code, count)
            continue
        if length > inline:
            raw = get(place, length)
        out[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(order + code * count, raw)
    return order, out


def unlzw(data: bytes) -> bytes:
    out, table, code_bits, bits, held, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < code_bits:
            continue
        bits -= code_bits
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            del table[258:]
            code_bits, last = 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        code_bits = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


_UNPACK = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpackbits}


def header(image: str, order: int, t: dict[int, tuple]) -> dict:
    """The scene of a file, and its number of bands."""
    scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIE, (0.0, 0.0, 0.0, 0.0, float(t[HEIGHT][0]), 0.0))
    keys = t.get(KEYS, ())
    code = next((keys[i + 3] for k in (3072, 2048) for i in range(4, len(keys) - 3, 4) if keys[i] == k and keys[i + 1] == 0), None)
    return {
        "image": image, "ord": order, "x0": float(tie[3] - tie[0] * scale[0]), "y0": float(tie[4] + tie[1] * scale[1]), "res_x": float(scale[0]), "res_y": float(scale[1]), "width": t[WIDTH][0], "height": t[HEIGHT][0],
        "dtype": KINDS[t.get(FORMAT, (1,))[0], t.get(BITS, (1,))[0]], "nodata": float(t[NODATA][0]) if NODATA in t else None, "crs": f"EPSG:{code}" if code else None, "bands": t.get(SAMPLES, (1,))[0],
    }


class Blocks:
    """The strips or tiles of a file; each is read by its own range. Strips that are not compressed are cut into shorter ones, so a window
    of a file with one long strip does not read it all."""

    def __init__(self, get: Callable[[int, int], bytes]):
        self.get = get
        self.order, t = tags(get)
        self.width, self.height, self.samples = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
        self.kind = np.dtype(KINDS[t.get(FORMAT, (1,))[0], t.get(BITS, (1,))[0]]).newbyteorder(self.order)
        tiled = TILE_OFFSETS in t
        self.w, self.h = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (self.width, min(self.height, t.get(STRIP_ROWS, (self.height,))[0]))
        self.places, self.sizes = (t[TILE_OFFSETS], t[TILE_BYTES]) if tiled else (t[STRIP_OFFSETS], t[STRIP_BYTES])
        self.apart = t.get(PLANAR, (1,))[0] == 2
        self.per = 1 if self.apart else self.samples
        compression, self.predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
        self.unpack = _UNPACK.get(compression)
        if self.unpack is None or self.predictor > 2:
            raise ValueError("this compression is not supported")
        row = self.width * self.per * self.kind.itemsize
        self.cut = None
        if not tiled and compression == 1:
            self.cut, self.h = self.h, max(1, min(self.h, (1 << 20) // max(1, row)))
            while self.cut % self.h:
                self.h -= 1
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)
        self.bytes = self.w * self.h * self.samples * self.kind.itemsize

    def _value(self, entry: tuple, k: int) -> int:
        place, code, _ = entry
        size = struct.calcsize("=" + code)
        return struct.unpack(self.order + code, self.get(place + size * k, size))[0]

    def _raw(self, band: int, i: int) -> bytes:
        if self.cut is None:
            k = band * self.across * self.down + i
            return self.unpack(self.get(self._value(self.places, k), self._value(self.sizes, k)))
        row = self.width * self.per * self.kind.itemsize
        strip, within = i * self.h // self.cut, i * self.h % self.cut
        k = band * -(-self.height // self.cut) + strip
        return self.get(self._value(self.places, k) + within * row, min(self.h, self.height - i * self.h) * row)

    def read(self, i: int, j: int, bands: list[int]) -> np.ndarray:
        """Values (bands, rows, columns) of the block in block row i and block column j."""

        def part(band: int) -> np.ndarray:
            a = np.frombuffer(self._raw(band, i * self.across + j), self.kind)
            a = a[: len(a) // (self.w * self.per) * self.w * self.per].reshape(-1, self.w, self.per)
            return np.cumsum(a, 1, dtype=self.kind.newbyteorder("=")) if self.predictor == 2 else a

        a = np.concatenate([part(b) for b in bands], 2) if self.apart else part(0)[:, :, bands]
        return np.moveaxis(a[: self.height - i * self.h, : self.width - j * self.w], 2, 0)


def name_of(uri: str) -> str:
    """An image is named by its file."""
    return re.sub(r"\.[^.]*$", "", uri.rsplit("/", 1)[1])


@dataclass
class Part(InputPartition):
    """Some of the wanted blocks of a file: those numbered from `first` to before `last`, row by row."""

    uri: str
    first: int
    last: int


class Reader(DataSourceReader):
    """Pixels of files, planned as partitions of about `target` unpacked bytes. Only blocks that the window meets are read, of files that
    keep bands apart only the bands asked for."""

    def __init__(self, uris: list[str], bands: list[int], nodata: float | None, window: tuple[int, int, int, int] | None, decimate: int, target: int = 32 << 20):
        self.uris, self.bands, self.nodata, self.decimate, self.target = uris, bands, nodata, decimate, target
        self.rows, self.cols = ([0, 1 << 62], [0, 1 << 62]) if window is None else ([window[0], window[1]], [window[2], window[3]])

    def _sampled(self, size: int, span: list[int]) -> np.ndarray:
        """Rows or columns of the file that are wanted: the middle one of each `decimate`, within the span."""
        k = self.decimate
        at = np.minimum(np.arange(-(-size // k)) * k + k // 2, size - 1)
        return at[(at >= span[0]) & (at < span[1])]

    def _wanted(self, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self._sampled(b.height, self.rows) // b.h), np.unique(self._sampled(b.width, self.cols) // b.w)

    def partitions(self) -> list[Part]:
        with ThreadPoolExecutor(32) as pool:
            found = list(pool.map(self._parts, self.uris))
        return [p for parts in found for p in parts] or [Part("", 0, 0)]  # Spark wants one

    def _parts(self, uri: str) -> list[Part]:
        b = Blocks(Ranges(uri))
        rows, cols = self._wanted(b)
        n, per = len(rows) * len(cols), max(1, self.target // b.bytes)
        return [Part(uri, k, min(n, k + per)) for k in range(0, n, per)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.batches(partition, Ranges(partition.uri)) if partition.last else iter(())

    def batches(self, part: Part, get: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
        b, image, k = Blocks(get), name_of(part.uri), self.decimate
        nodata = self.nodata if self.nodata is not None else header(image, 0, tags(get)[1])["nodata"]
        rows, cols = self._wanted(b)
        at_rows, at_cols = self._sampled(b.height, self.rows), self._sampled(b.width, self.cols)
        names = ["image", "prow", "pcol", *(f"b{i + 1}" for i in self.bands)]
        for n in range(part.first, part.last):
            i, j = int(rows[n // len(cols)]), int(cols[n % len(cols)])
            own_rows, own_cols = at_rows[at_rows // b.h == i], at_cols[at_cols // b.w == j]
            a = b.read(i, j, self.bands)[:, own_rows - i * b.h][:, :, own_cols - j * b.w].astype(np.float64)
            valid = ~np.isnan(a) if nodata is None else ~np.isnan(a) & (a != nodata)
            r, c = np.nonzero(valid.any(0))
            values = [pa.array(a[x][r, c], mask=~valid[x][r, c]) for x in range(len(self.bands))]
            yield pa.RecordBatch.from_arrays([pa.array([image]).take(pa.array(np.zeros(len(r), np.int32))), pa.array((own_rows[r] // k).astype(np.int32)), pa.array((own_cols[c] // k).astype(np.int32)), *values], names)


class FilteredReader(Reader):
    """A reader that filters on image, prow and pcol narrow. Spark takes it only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "image" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.uris = [u for u in self.uris if name_of(u) in wanted]
            elif name in ("prow", "pcol") and self.decimate == 1:
                side = self.rows if name == "prow" else self.cols
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    side[0] = max(side[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    side[1] = min(side[1], f.value + (not isinstance(f, LessThan)))
            yield f  # Spark still looks at each row


class Source(DataSource):
    """`spark.read.format("pixelloom_geotiff").option("files", json list of URIs)`, with the options bands (all, or names by commas), nodata,
    window (first row, end row, first column, end column), decimate, and filters (true where the session lets filters reach Python sources)."""

    @classmethod
    def name(cls) -> str:
        return "pixelloom_geotiff"

    def _files(self) -> list[str]:
        return json.loads(self.options["files"])

    def _bands(self) -> list[int]:
        if "bands" in self.options:
            return [int(b.strip().lstrip("b")) - 1 for b in self.options["bands"].split(",")]
        return list(range(tags(Ranges(self._files()[0]))[1].get(SAMPLES, (1,))[0]))

    def schema(self) -> str:
        return "image string, prow int, pcol int, " + ", ".join(f"b{i + 1} double" for i in self._bands())

    def reader(self, schema) -> Reader:
        o = self.options
        window = tuple(int(x) for x in o["window"].split(",")) if "window" in o else None
        kind = FilteredReader if o.get("filters") == "true" else Reader
        return kind(self._files(), self._bands(), float(o["nodata"]) if "nodata" in o else None, window, int(o.get("decimate", "1")), int(o.get("target", str(32 << 20))))


def catalogue(spark: SparkSession, path: str, pattern: str = "*.tif*") -> list[dict]:
    """One entry a file of a folder (or a path with wildcards), by name: its scene, its number of bands and its URI. Headers are read in tasks,
    by ranges."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    schema = pa.schema([("path", pa.string()), *((f.name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()]) for f in SCENE_SCHEMA), ("bands", pa.int32())])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"path": p, **header(name_of(p), 0, tags(Ranges(p))[1])} for p in batch.column(0).to_pylist()], schema)

    found = files.mapInArrow(heads, "path string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCENE_SCHEMA) + ", bands int").collect()
    if not found:
        raise ValueError(f"no file at {path}")
    if len({r["bands"] for r in found}) > 1:
        raise ValueError("the images have different numbers of bands")
    return [{**r.asDict(), "ord": i} for i, r in enumerate(sorted(found, key=lambda r: r["path"]))]


def read(spark: SparkSession, path: str, nodata: float | None = None, pattern: str = "*.tif*", bands: tuple[str, ...] | None = None, images: tuple[str, ...] | None = None, window: tuple[int, int, int, int] | None = None, decimate: int = 1) -> Rasters:
    """All files of a folder (or a path with wildcards), in the order of their names; an image is named by its file.

    Of the files only what is asked for is read: these images, these bands (where a file keeps bands apart), the blocks that meet a
    window (first row, end row, first column, end column), every decimate-th row and column. Positions stay those of the whole image; with
    decimate the pixels are that much larger, each with the value at its middle. Where spark.sql.python.filterPushdown.enabled is set,
    filters on image, prow and pcol prune files and blocks too."""
    if decimate < 1:
        raise ValueError("decimate is 1 or more")
    found = [h for h in catalogue(spark, path, pattern) if images is None or h["image"] in images]
    if not found:
        raise ValueError("none of these images is there")
    names = bands or tuple(f"b{i + 1}" for i in range(found[0]["bands"]))
    if not {*names} <= {f"b{i + 1}" for i in range(found[0]["bands"])}:
        raise ValueError(f"the images have no such bands: {', '.join(names)}")
    k = decimate
    scaled = [{**h, "res_x": h["res_x"] * k, "res_y": h["res_y"] * k, "width": -(-h["width"] // k), "height": -(-h["height"] // k)} for h in found]
    scenes = spark.createDataFrame([tuple(h[f] for f in SCENE_SCHEMA.fieldNames()) for h in scaled], SCENE_SCHEMA)
    spark.dataSource.register(Source)
    source = spark.read.format(Source.name()).option("files", json.dumps([h["path"] for h in found])).option("bands", ",".join(names)).option("decimate", str(k))
    source = source.option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    source = source if nodata is None else source.option("nodata", str(nodata))
    source = source if window is None else source.option("window", ",".join(map(str, window)))
    return Rasters(source.load(), scenes, names)


def _fields(s: dict, kind: np.dtype, bands: int, tile: int, nodata: float | None, places: list[int], sizes: list[int], at: int) -> bytes:
    """The directory of a file, to be put at byte `at`."""
    code = int(s["crs"].split(":")[1]) if s["crs"] and s["crs"].startswith("EPSG:") else None
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if code == 4326 else 1, 1025, 0, 1, 1, 2048 if code == 4326 else 3072, 0, 1, code) if code else ()
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields = [(WIDTH, "I", (s["width"],)), (HEIGHT, "I", (s["height"],)), (BITS, "H", (8 * kind.itemsize,) * bands), (COMPRESSION, "H", (8,)), (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (bands,)), (PLANAR, "H", (1,)), (TILE_WIDTH, "I", (tile,)), (TILE_HEIGHT, "I", (tile,)), (TILE_OFFSETS, "Q", places), (TILE_BYTES, "Q", sizes), (FORMAT, "H", (sample,) * bands), (SCALE, "d", (s["res_x"], s["res_y"], 0.0)), (TIE, "d", (0.0, 0.0, 0.0, s["x0"], s["y0"], 0.0))]
    fields += [(KEYS, "H", keys)] if keys else []
    fields += [(NODATA, "s", f"{nodata:g}".encode() + b"\0")] if nodata is not None else []
    number = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
    raw = [(t, c, v if c == "s" else struct.pack(f"<{len(v)}{c}", *v), len(v)) for t, c, v in fields]
    entries, extra, later = b"", b"", at + 8 + 20 * len(raw) + 8
    for t, c, v, n in raw:
        if len(v) <= 8:
            place = v.ljust(8, b"\0")
        else:
            place = struct.pack("<Q", later + len(extra))
            extra += v + b"\0" * (-len(v) % 8)
        entries += struct.pack("<HHQ", t, number[c], n) + place
    return struct.pack("<Q", len(raw)) + entries + struct.pack("<Q", 0) + extra


def _packed(r: Rasters, kind: np.dtype, fill: float, tile: int) -> DataFrame:
    """image, number (of the tile, row by row), data: the deflated tiles that have a pixel. A task holds a tile."""
    bands = r.bands
    tr, tc = grid.tile_ids(tile)
    p = null_to_nodata(r.pixels, bands, fill, kind.name if kind.name in DTYPES else None)

    def pack(part):
        import pandas as pd

        a = np.full((tile, tile, len(bands)), fill, kind)
        for k, b in enumerate(bands):
            a[part.prow % tile, part.pcol % tile, k] = part[b]
        return pd.DataFrame({"image": [part.image.iloc[0]], "tile_row": [int(part.prow.iloc[0]) // tile], "tile_col": [int(part.pcol.iloc[0]) // tile], "data": [zlib.compress(a.tobytes(), 6)]})

    return p.groupBy("image", tr.alias("_r"), tc.alias("_c")).applyInPandas(pack, "image string, tile_row int, tile_col int, data binary")


def write(r: Rasters, folder: str, dtype: str = "float32", nodata: float | None = None, tile: int = 256) -> list[str]:
    """One tiled, deflated file per image under a folder given as a URI or path that all executors share.

    Tiles are sorted by ranges of (image, number), so one image is written by as many tasks as its tiles ask for: each writes what it
    has of an image as a part, under a name of its own, and reports its tiles' sizes. Only parts that were reported count.
    Then every part's place in its file is known by prefix sums, and parts are copied there by a task each, where the file system
    writes at any place (file:); elsewhere, as in object stores, a task an image strings its parts together. The directory of
    the file comes last, then its name: a write that fails leaves no file behind."""
    if tile % 16:
        raise ValueError("tiles are multiples of 16")
    kind, fill = np.dtype(dtype), 0 if nodata is None else nodata
    uri = folder if "://" in folder else "file://" + os.path.abspath(folder)
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    work = f"{base}/.parts-{uuid.uuid4().hex}"
    fs.create_dir(work)
    try:
        return _written(r, uri, base, work, kind, fill, nodata, tile)
    finally:
        fs.delete_dir(work)


def _written(r: Rasters, uri: str, base: str, work: str, kind: np.dtype, fill: float, nodata: float | None, tile: int) -> list[str]:
    columns = F.ceil(F.col("width") / tile).cast("long")
    every = grid.tile_table(r.scenes, tile).join(r.scenes.select("image", columns.alias("across")), "image").select("image", "tile_row", "tile_col", (F.col("tile_row") * F.col("across") + F.col("tile_col")).alias("number"))
    rows = every.join(_packed(r, kind, fill, tile), ["image", "tile_row", "tile_col"], "left").select("image", "number", "data")
    blank = zlib.compress(np.full((tile, tile, len(r.bands)), fill, kind).tobytes(), 6)
    bands = len(r.bands)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        image, stream, first, sizes, path = None, None, 0, [], ""

        def reported() -> list[tuple]:
            if stream is None:
                return []
            stream.close()
            return [(image, first, path, sum(sizes), sizes)]

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if image != row["image"]:
                    done += reported()
                    image, first, sizes, path = row["image"], row["number"], [], f"{work}/{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(path, compression=None)
                data = row["data"] or blank
                stream.write(data)
                sizes.append(len(data))
            yield _part_rows(done)
        yield _part_rows(reported())

    by = [F.col("image"), F.col("number")]
    done = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(parts, "image string, first long, path string, size long, sizes array<long>"))
    # a row a part: as many as tasks and images
    order = Window.partitionBy("image").orderBy("first")
    placed = done.withColumn("at", F.lit(16) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                # the same bytes go to the same place however often a task is tried
                target = os.open(f"{work}/{row['image']}.tif", os.O_CREAT | os.O_WRONLY)
                try:
                    with fs.open_input_stream(row["path"]) as source:
                        at = row["at"]
                        while chunk := source.read(1 << 22):
                            at += os.pwrite(target, chunk, at)
                finally:
                    os.close(target)
            yield batch.select(["image"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                own = sorted(s["parts"], key=lambda p: p["first"])
                sizes = [n for p in own for n in p["sizes"]]
                places = np.cumsum([16, *sizes])
                end = int(places[-1])
                start = b"II" + struct.pack("<HHHQ", 43, 8, 0, end)
                last = _fields(s, kind, bands, tile, nodata, places[:-1].tolist(), sizes, end)
                target = f"{work}/{s['image']}.tif"
                if uri.startswith("file:"):
                    with open(target, "r+b") as f:
                        f.write(start)
                        f.seek(end)
                        f.write(last)
                else:
                    with fs.open_output_stream(target, compression=None) as sink:
                        sink.write(start)
                        for p in own:
                            with fs.open_input_stream(p["path"]) as source:
                                while chunk := source.read(1 << 22):
                                    sink.write(chunk)
                        sink.write(last)
                out.append(s["image"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["image"])

    if uri.startswith("file:"):
        placed.select("image", "path", "at").repartition(F.col("path")).mapInArrow(copy, "image string").write.format("noop").mode("overwrite").save()
    ready = done.groupBy("image").agg(F.collect_list(F.struct("first", "path", "sizes")).alias("parts")).join(r.scenes, "image").mapInArrow(close, "image string").collect()
    fs, _ = pafs.FileSystem.from_uri(uri)
    for x in ready:  # names are given when all files are whole
        fs.move(f"{work}/{x['image']}.tif", f"{base}/{x['image']}.tif")
    return sorted(f"{base}/{x['image']}.tif" for x in ready)


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"image": pa.string(), "first": pa.int64(), "path": pa.string(), "size": pa.int64(), "sizes": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of the files alone."""
    return spark.createDataFrame([tuple(h[f] for f in SCENE_SCHEMA.fieldNames()) for h in catalogue(spark, path)], SCENE_SCHEMA)
