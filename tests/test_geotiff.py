import math
import struct
import zlib

import numpy as np
import pytest
from test_operators import array, raster

from pixelloom.sources import geotiff


def plain_tiff(a, order="<", compression=1, predictor=1, apart=False):
    """A small strip file made by hand: bands x rows x columns."""
    n, h, w = a.shape
    kind = a.dtype.newbyteorder(order)
    if apart:
        strips = [a[k].astype(kind) for k in range(n)]
    else:
        strips = [np.moveaxis(a, 0, 2).astype(kind)]
    if predictor == 2:
        strips = [np.diff(s, axis=1, prepend=np.zeros_like(s[:, :1])).astype(kind) for s in strips]
    raw = [zlib.compress(s.tobytes()) if compression == 8 else s.tobytes() for s in strips]
    at, places, body = 8, [], b""
    for s in raw:
        places.append(at + len(body))
        body += s
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (8 * a.itemsize,)), (259, 3, (compression,)), (273, 4, tuple(places)), (277, 3, (n,)), (278, 4, (h,)), (279, 4, tuple(map(len, raw))), (284, 3, (2 if apart else 1,)), (317, 3, (predictor,)), (339, 3, ({"u": 1, "i": 2, "f": 3}[a.dtype.kind],)), (33550, 12, (2.0, 2.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 100.0, 50.0, 0.0))]
    ifd = at + len(body)
    later, extra, out = ifd + 2 + 12 * len(fields) + 4, b"", b""
    for tag, code, v in fields:
        packed = struct.pack(order + {3: "H", 4: "I", 12: "d"}[code] * len(v), *v)
        if len(packed) > 4:
            place = struct.pack(order + "I", later + len(extra))
            extra += packed
        else:
            place = packed.ljust(4, b"\0")
        out += struct.pack(order + "HHI", tag, code, len(v)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, ifd) + body + struct.pack(order + "H", len(fields)) + out + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "predictor", "apart"), [(1, 1, False), (8, 2, False), (8, 1, True)])
def test_read_strips(spark, tmp_path, order, compression, predictor, apart):
    a = np.arange(60, dtype=np.uint16).reshape(2, 5, 6) * 7
    (tmp_path / "scene.one.tif").write_bytes(plain_tiff(a, order, compression, predictor, apart))
    r = geotiff.read(spark, str(tmp_path), nodata=0)
    s = r.scenes.first()
    assert (s["image"], s["x0"], s["y0"], s["res_x"], s["width"], s["height"], s["dtype"]) == ("scene.one", 100.0, 50.0, 2.0, 6, 5, "uint16")
    want = a.astype(float)
    want[a == 0] = math.nan
    for k, b in enumerate(("b1", "b2")):
        assert np.allclose(array(r.pixels, "scene.one", (5, 6), b), want[k], equal_nan=True)


def test_write_and_read_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = np.round(rng.uniform(1, 200, (2, 40, 50)))
    a[:, :3, :3] = math.nan
    r = raster(spark, {"p": (a, 10, 90, 0.5), "q": (a + 1, 0, 40, 1)}, nodata=255.0)
    assert [p.rsplit("/", 1)[1] for p in geotiff.write(r, str(tmp_path / "out"), "uint8", 255.0, tile=16)] == ["p.tif", "q.tif"]
    back = geotiff.read(spark, str(tmp_path / "out"))
    assert np.allclose(array(back.pixels, "q", (40, 50), "b2"), a[1] + 1, equal_nan=True)
    s = {x["image"]: x for x in back.scenes.collect()}["p"]
    assert (s["x0"], s["y0"], s["res_x"], s["nodata"], s["dtype"], s["crs"]) == (10.0, 90.0, 0.5, 255.0, "uint8", "EPSG:3857")


def test_lzw_and_packbits():
    assert geotiff.unlzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert geotiff.unpackbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])


def test_no_files(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"nothing")
    with pytest.raises(Exception):
        geotiff.read(spark, str(tmp_path)).scenes.count()


def counted(path, reader, parts=None):
    """Pixels and bytes read of a file, by the reader in this process."""
    out, n = [], 0
    for part in parts or reader.partitions():
        get = geotiff.Ranges(part.uri)
        for batch in reader.batches(part, get):
            out += batch.to_pylist()
        n += get.count
    return out, n


def large(spark, tmp_path, side=512, tile=64):
    rng = np.random.default_rng(2)
    a = rng.integers(1, 60_000, (2, side, side)).astype(float)
    files = geotiff.write(raster(spark, {"big": (a, 0, side, 1)}), str(tmp_path / "big"), "uint16", 0.0, tile=tile)
    return a, files[0]


def test_window_reads_its_tiles_alone(spark, tmp_path):
    a, path = large(spark, tmp_path)
    size = (tmp_path / "big" / "big.tif").stat().st_size
    reader = geotiff.Reader([f"file://{path}"], [0, 1], None, (70, 120, 200, 250), 1)
    pixels, n = counted(path, reader)
    # block row 1, block columns 3 (192-255): one tile of 64
    assert len(pixels) == 50 * 50 and all(p["b2"] == a[1, p["prow"], p["pcol"]] for p in pixels)
    assert n < size / 20
    r = geotiff.read(spark, str(tmp_path / "big"), window=(70, 120, 200, 250), bands=("b2",))
    assert r.bands == ("b2",) and r.pixels.count() == 2500 and r.scenes.first()["width"] == 512
    assert r.pixels.agg({"b2": "sum"}).first()[0] == a[1, 70:120, 200:250].sum()


def test_filters_prune_files_and_blocks(spark, tmp_path):
    a, path = large(spark, tmp_path)
    reader = geotiff.FilteredReader([f"file://{path}", "file:///x/other.tif"], [0], None, None, 1)
    kept = list(reader.pushFilters([geotiff.EqualTo(("image",), "big"), geotiff.GreaterThanOrEqual(("prow",), 100), geotiff.LessThan(("prow",), 110), geotiff.EqualTo(("pcol",), 7)]))
    assert len(kept) == 4 and reader.uris == [f"file://{path}"] and reader.rows == [100, 110] and reader.cols == [7, 8]
    assert [p["b1"] for p in counted(path, reader)[0]] == a[0, 100:110, 7].tolist()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        r = geotiff.read(spark, str(tmp_path / "big"))
        assert r.pixels.where("image = 'big' and prow = 5 and pcol > 500").count() == 11
        assert r.pixels.where("image = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_decimated_read(spark, tmp_path):
    a, path = large(spark, tmp_path, 500)
    r = geotiff.read(spark, str(tmp_path / "big"), decimate=7)
    s = r.scenes.first()
    assert (s["width"], s["height"], s["res_x"]) == (72, 72, 7.0)
    at = np.minimum(np.arange(72) * 7 + 3, 499)
    assert np.array_equal(array(r.pixels, "big", (72, 72)), a[0][np.ix_(at, at)])
    # tiles that no wanted row or column meets are not read
    reader = geotiff.Reader([f"file://{path}"], [0], None, None, 250)
    assert len(counted(path, reader)[0]) == 4 and counted(path, reader)[1] < (tmp_path / "big" / "big.tif").stat().st_size / 4


def test_plain_strips_are_read_by_rows(tmp_path):
    a = np.arange(2000 * 1000, dtype=np.uint32).reshape(1, 2000, 1000)
    (tmp_path / "one.tif").write_bytes(plain_tiff(a))
    pixels, n = counted("", geotiff.Reader([f"file://{tmp_path}/one.tif"], [0], None, (1000, 1002, 5, 9), 1))
    assert [p["b1"] for p in pixels] == [float(a[0, r, c]) for r in (1000, 1001) for c in range(5, 9)]
    assert n < 1_200_000 and len(geotiff.Reader([f"file://{tmp_path}/one.tif"], [0], None, None, 1, 1 << 20).partitions()) >= 8


def test_one_image_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    kept = geotiff.saved
    monkeypatch.setattr(geotiff, "saved", lambda df: seen.append(kept(df)) or seen[-1])
    try:
        a, path = large(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0].where("image = 'big'").count() > 1  # a row a part
    assert np.array_equal(array(geotiff.read(spark, str(tmp_path / "big")).pixels, "big", (512, 512)), a[0])
    assert [p.name for p in (tmp_path / "big").iterdir()] == ["big.tif"]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    r = raster(spark, {"p": (np.ones((20, 20)), 0, 20, 1), "q": (np.ones((20, 20)), 0, 20, 1)})
    broken = r.with_pixels(r.pixels.selectExpr("image", "prow", "pcol", "if(image = 'q' and prow = 19, raise_error('lost'), b1) as b1"))
    with pytest.raises(Exception, match="lost"):
        geotiff.write(broken, str(tmp_path / "out"), "uint8", 0.0, tile=16)
    assert list((tmp_path / "out").iterdir()) == []
