"""Cases computed by hand or with numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import expressions
from pixelloom.model import Rasters, dense, nodata_to_null, null_to_nodata, resolve_dtype, resolve_nodata, scenes_of, wrap_cast
from pixelloom.operators import blocks, clouds, grid, regression, restructure, stats, vector
from pixelloom.sources import paths, tables


def raster(spark, images, nodata=None):
    """images: name -> (array of rows x cols or bands x rows x cols, x0, y0, res)."""
    rows, scenes, bands = [], [], 1
    for k, (name, (a, x0, y0, res)) in enumerate(images.items()):
        a = np.asarray(a, float)
        a = a[None] if a.ndim == 2 else a
        bands = len(a)
        scenes.append({"image": name, "ord": k, "x0": x0, "y0": y0, "res_x": res, "res_y": res, "width": a.shape[2], "height": a.shape[1], "nodata": nodata})
        for r in range(a.shape[1]):
            for c in range(a.shape[2]):
                v = [None if math.isnan(x) else float(x) for x in a[:, r, c]]
                if any(x is not None for x in v):
                    rows.append((name, r, c, *v))
    names = tuple(f"b{i + 1}" for i in range(bands))
    return Rasters(spark.createDataFrame(rows, "image string, prow int, pcol int, " + ", ".join(f"{b} double" for b in names)), scenes_of(spark, scenes), names)


def array(pixels, name, shape, band="b1"):
    out = np.full(shape, np.nan)
    for r in pixels.where(F.col("image") == name).collect():
        if r[band] is not None:
            out[r.prow, r.pcol] = r[band]
    return out


def test_wrap_cast(spark):
    df = spark.createDataFrame([(300.9,), (-1.0,), (255.0,), (-129.0,)], "v double")
    assert [r[0] for r in df.select(wrap_cast(F.col("v"), "uint8")).collect()] == [44, 255, 255, 127]
    assert [r[0] for r in df.select(wrap_cast(F.col("v"), "int8")).collect()] == [44, -1, -1, 127]


def test_nodata(spark):
    r = raster(spark, {"a": ([[1, 0], [2, 3]], 0, 2, 1)}, nodata=0.0)
    valid = nodata_to_null(r.pixels, r.bands, 0.0)
    assert valid.count() == 3
    assert sorted(x.b1 for x in null_to_nodata(dense(r.with_pixels(valid)), r.bands, 99.0, "uint8").collect()) == [1, 2, 3, 99]
    assert resolve_nodata(r.scenes) == 0.0 and resolve_nodata(r.scenes, 7.0) == 7.0 and resolve_dtype(r.scenes) == "float64"


def test_windows():
    assert grid.windows(5, 3, 2, 2) == [(0, 0, 2, 2), (2, 0, 2, 2), (4, 0, 1, 2), (0, 2, 2, 1), (2, 2, 2, 1), (4, 2, 1, 1)]
    assert grid.tile_shape(None, 5, 3) == (5, 3) and grid.tile_shape((2, 3), 0, 0) == (2, 3)


@pytest.mark.parametrize(("number", "images", "w", "h"), [(100, 1, 10, 10), (100, 2, 30, 10), (7, 3, 5, 20), ((2, 3), 9, 1, 1), (1, 1, 100, 1)])
def test_block_grid_stays_within_the_total(number, images, w, h):
    rows, cols = grid.block_grid(number, images, w, h)
    assert (rows, cols) == (2, 3) if isinstance(number, tuple) else 1 <= rows * cols <= number * images or rows * cols == 1


def test_overlaps_need_area(spark):
    s = scenes_of(spark, [{"image": n, "x0": x, "y0": 10, "width": 10, "height": 10} for n, x in (("a", 0), ("b", 10), ("c", 9))])
    assert [(r.image_i, r.image_j) for r in grid.overlaps(s).orderBy("image_i", "image_j").collect()] == [("a", "c"), ("b", "c")]


def test_requirements(spark):
    s = scenes_of(spark, [{"image": "a", "x0": 0, "y0": 1, "width": 1, "height": 1}, {"image": "b", "x0": 0, "y0": 1, "width": 1, "height": 1, "crs": "EPSG:4326"}])
    with pytest.raises(ValueError, match="coordinate systems"):
        grid.require(s)
    grid.require(s, crs=False)


def test_single_pixel_statistics(spark):
    r = raster(spark, {"a": ([[5.0]], 0, 1, 1), "b": ([[math.nan]], 0, 1, 1)})
    assert {x.image: (x.mean, x.std, x.size) for x in stats.whole(r).collect()} == {"a": (5.0, 0.0, 1), "b": (0.0, 0.0, 0)}
    assert {(x.mean, x.std, x.size) for x in stats.overlap(r).collect()} == {(0.0, 0.0, 0)}


def test_overlap_of_different_resolutions(spark):
    """The coarse image is resampled to the fine one's grid; pairs of one resolution keep the plain join."""
    fine = np.arange(64.0).reshape(8, 8)
    r = raster(spark, {"a": (fine, 0, 8, 1), "b": (np.full((4, 4), 3.0), 0, 8, 2), "c": (fine + 1, 0, 8, 1)})
    o = {(x.image, x.other): (x["mean"], x["std"], x["size"]) for x in stats.overlap(r).collect()}
    assert o["b", "a"] == pytest.approx((3.0, 0.0, 64)) and o["a", "b"] == pytest.approx((fine.mean(), fine.std(), 64))
    assert o["a", "c"] == pytest.approx((fine.mean(), fine.std(), 64)) and o["c", "a"][0] == pytest.approx(fine.mean() + 1)
    # b is the first of its pair with c by name, so c is resampled to b's grid
    means = (fine + 1).reshape(4, 2, 4, 2).mean((1, 3))
    assert o["c", "b"][2] == 16 and o["c", "b"][0] == pytest.approx(means.mean())


def brute_solve(names, anchors, ov, whole, fm, fs):
    """Minimum-change least squares from the plain constraint matrix."""
    n, rows, goal, total = len(names), [], [], 0.0
    for i in range(n):
        for j in range(i + 1, n):
            if (names[i], names[j]) in ov and (names[i] in anchors or names[j] in anchors):
                (m1, v1, s), (m2, v2, _) = ov[names[i], names[j]], ov[names[j], names[i]]
                a, b = np.zeros(2 * n), np.zeros(2 * n)
                a[2 * i], a[2 * i + 1], a[2 * j], a[2 * j + 1] = m1, 1, -m2, -1
                b[2 * i], b[2 * j] = v1, -v2
                rows += [a * s * fm, b * s * fs]
                goal += [0, 0]
                total += s
    p = total / (2 * n) if total else 1.0
    for i, name in enumerate(names):
        if name in anchors:
            m, v = whole[name]
            a, b = np.zeros(2 * n), np.zeros(2 * n)
            a[2 * i], a[2 * i + 1], b[2 * i] = m, 1, v
            rows += [a * p, b * p]
            goal += [m * p, v * p]
    x0 = np.tile([1.0, 0.0], n)
    a = np.array(rows)
    return (x0 + np.linalg.pinv(a, rcond=1e-13) @ (np.array(goal) - a @ x0)).reshape(n, 2)


def stat_tables(spark, ov, whole, bands=("b1",)):
    between = spark.createDataFrame([(a, b, band, *map(float, v[:2]), v[2]) for (a, b), v in ov.items() for band in bands], "image string, other string, band string, mean double, std double, size long")
    return spark.createDataFrame([(n, band, float(m), float(s), 10) for n, (m, s) in whole.items() for band in bands], "image string, band string, mean double, std double, size long"), between


def solved(spark, names, anchors, ov, whole, **options):
    named = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "image string, ord long")
    rows = regression.constraints(named, regression.Anchors("include", tuple(anchors)), *stat_tables(spark, ov, whole), 3.0, 1.0)
    found = {x.image: (x.scale, x.offset) for x in regression.solved(rows, **options).collect()}
    return np.array([found.get(n, (1.0, 0.0)) for n in names])


def overlaps_of(r, pairs, flat=False):
    ov = {}
    for a, b in pairs:
        size = int(r.integers(50, 500))
        ov[a, b] = (r.uniform(50, 150), 0.0 if flat else r.uniform(5, 20), size)
        ov[b, a] = (r.uniform(50, 150), 0.0 if flat else r.uniform(5, 20), size)
    return ov


@pytest.mark.parametrize("anchors", [("A", "B", "C"), ("B",), ()])
@pytest.mark.parametrize("flat", [False, True])
def test_solver(spark, anchors, flat):
    r = np.random.default_rng(1)
    names = ["A", "B", "C", "D"]
    ov = overlaps_of(r, [("A", "B"), ("B", "C"), ("A", "C")], flat)
    whole = {n: (r.uniform(50, 150), 0.0 if flat else r.uniform(5, 20)) for n in names}
    got = solved(spark, names, anchors, ov, whole)
    want = brute_solve(names, anchors, ov, whole, 3.0, 1.0) if anchors else np.tile([1.0, 0.0], (4, 1))
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)
    assert tuple(got[3]) == pytest.approx((1.0, 0.0))


@pytest.mark.parametrize("options", [{"most_dense": 0}, {"most_dense": 0, "most_edges": 0}, {"most_dense": 3}])
def test_sparse_solvers_equal_the_dense_one(spark, options):
    """Three parts: a triangle, a chain with one constant image, a pair; means far larger than deviations."""
    r = np.random.default_rng(3)
    names = [f"i{k}" for k in range(9)]
    ov = overlaps_of(r, [("i0", "i1"), ("i1", "i2"), ("i0", "i2"), ("i3", "i4"), ("i4", "i5"), ("i5", "i6"), ("i7", "i8")])
    ov = {k: (m + 10_000, s, n) for k, (m, s, n) in ov.items()}
    whole = {n: (r.uniform(10_000, 10_100), r.uniform(5, 20)) for n in names}
    ov["i6", "i5"] = (500.0, 0.0, ov["i6", "i5"][2])
    whole["i6"] = (500.0, 0.0)
    for anchors in (names, ["i0", "i4", "i7"]):
        got, want = solved(spark, names, anchors, ov, whole, **options), brute_solve(names, anchors, ov, whole, 3.0, 1.0)
        assert np.allclose(got[:, 0], want[:, 0], rtol=1e-5) and np.allclose(got[:, 1], want[:, 1], rtol=1e-4, atol=0.05)


@pytest.mark.parametrize("every", [True, False])
def test_chain_of_two_thousand_images(spark, every):
    """All anchors, or every second one."""
    r = np.random.default_rng(5)
    n = 2_000 if every else 400
    names = [f"c{k:04d}" for k in range(n)]
    anchors = names[:: 1 if every else 2]
    ov = overlaps_of(r, [(names[k], names[k + 1]) for k in range(n - 1)])
    whole = {x: (r.uniform(50, 150), r.uniform(5, 20)) for x in names}
    got = solved(spark, names, anchors, ov, whole)
    # the gradient of the least squares vanishes, measured against its terms
    pull = sum(ov[names[k], names[k + 1]][2] for k in range(n - 1)) / (2 * n)
    rows = [({k: (whole[x][0] * pull, pull)}, whole[x][0] * pull) for k, x in enumerate(names) if x in anchors]
    rows += [({k: (whole[x][1] * pull, 0)}, whole[x][1] * pull) for k, x in enumerate(names) if x in anchors]
    for k in range(n - 1):
        (m1, s1, w), (m2, s2, _) = ov[names[k], names[k + 1]], ov[names[k + 1], names[k]]
        rows += [({k: (m1 * w * 3, w * 3), k + 1: (-m2 * w * 3, -w * 3)}, 0), ({k: (s1 * w, 0), k + 1: (-s2 * w, 0)}, 0)]
    total, size = np.zeros((n, 2)), np.zeros((n, 2))
    for terms, goal in rows:
        rest = sum(np.dot(c, got[k]) for k, c in terms.items()) - goal
        for k, c in terms.items():
            total[k] += np.multiply(c, rest)
            size[k] += np.abs(c) * (abs(goal) + sum(np.abs(np.multiply(d, got[j])).sum() for j, d in terms.items()))
    assert (np.abs(total) <= 1e-8 * size).all()


def test_global_regression_makes_images_agree(spark):
    g = np.add.outer(np.arange(12) * 3.0, np.arange(12) ** 1.5)
    r = raster(spark, {"a": (g, 0, 12, 1), "b": (2 * g + 10, 6, 12, 1)})
    r = r.with_pixels(r.pixels.where("image = 'a'").union(r.pixels.where("image = 'b'").join(r.pixels.where("image = 'a'").select((F.col("pcol") - 6).alias("pcol"), "prow", (2 * F.col("b1") + 10).alias("v")), ["prow", "pcol"]).select("image", "prow", "pcol", F.col("v").alias("b1"))))
    found, whole, between = regression.parameters(r, regression.Anchors("include", ("a",)))
    p = {x.image: (x.scale, x.offset) for x in found.collect()}
    assert p["a"] == pytest.approx((1, 0), abs=1e-6) and p["b"] == pytest.approx((0.5, -5), abs=1e-6)
    out = regression.apply(r, found, "uint8")
    assert dict(out.pixels.dtypes)["b1"] == "smallint"
    text = tables.model_json(found, whole, between)
    model = tables.model_tables(spark, text)
    again = {x.image: (x.scale, x.offset) for x in regression.parameters(r, regression.Anchors("include", ("a",)), model=model)[0].collect()}
    assert again["b"] == pytest.approx(p["b"], abs=1e-6)
    broken = json.loads(text)
    del broken["b"]["whole_stats"]
    with pytest.raises(ValueError, match="whole_stats"):
        tables.check_model(json.dumps(broken))


def brute_local(a, loc, ref, canvas, x0, y0, method, alpha):
    rows, cols = a.shape
    out = np.full(a.shape, np.nan)
    for r in range(rows):
        for c in range(cols):
            y = min(max((canvas.y_max - (y0 - r)) / (canvas.y_max - canvas.y_min) * canvas.rows - 0.5, 0), canvas.rows - 1)
            x = min(max((x0 + c - canvas.x_min) / (canvas.x_max - canvas.x_min) * canvas.cols - 0.5, 0), canvas.cols - 1)
            v = []
            for m in (loc, ref):
                s = w = 0.0
                for i in range(canvas.rows):
                    for j in range(canvas.cols):
                        k = max(0, 1 - abs(y - i)) * max(0, 1 - abs(x - j))
                        if k and not math.isnan(m[i, j]):
                            s, w = s + k * m[i, j], w + k
                v.append(s / w if w else math.nan)
            if not math.isnan(a[r, c]) and not any(map(math.isnan, v)):
                out[r, c] = a[r, c] * v[1] / v[0] if method == "linear" else alpha * a[r, c] ** (math.log(v[1]) / math.log(v[0]))
    return out


@pytest.mark.parametrize("method", ["linear", "gamma"])
def test_local_adjustment(spark, method):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(20, 60, (8, 8)), rng.uniform(60, 90, (8, 8))
    a[0:4, 0:4] = math.nan
    r = raster(spark, {"a": (a, 0, 8, 1), "b": (b, 0, 8, 1)})
    canvas = blocks.Canvas.over(r.scenes, (2, 2))
    local = blocks.means(r, canvas, 0.1)
    loc, ref = np.full((2, 2), math.nan), np.full((2, 2), math.nan)
    for i in range(2):
        for j in range(2):
            cells = a[4 * i : 4 * i + 4, 4 * j : 4 * j + 4]
            loc[i, j] = np.nanmean(cells) if not np.isnan(cells).all() else math.nan
            ref[i, j] = np.nanmean([loc[i, j], b[4 * i : 4 * i + 4, 4 * j : 4 * j + 4].mean()])
    got = array(blocks.adjust(r, local, canvas, method, alpha=0.75).pixels, "a", a.shape)
    assert np.allclose(got, brute_local(a, loc, ref, canvas, 0, 8, method, 0.75), equal_nan=True)


def test_block_threshold_and_loaded_maps(spark, tmp_path):
    a = np.full((4, 4), math.nan)
    a[0, 0], a[2:, 2:] = 5, 7
    r = raster(spark, {"a": (a, 0, 4, 1)})
    canvas = blocks.Canvas.over(r.scenes, (2, 2))
    local = blocks.means(r, canvas, 0.5)
    assert [(x.brow, x.bcol, x["mean"]) for x in local.collect()] == [(1, 1, 7.0)]
    tables.write_blocks(local, f"{tmp_path}/m0")
    tables.write_blocks(local.withColumn("image", F.lit("a_later")).withColumn("mean", F.lit(9.0)), f"{tmp_path}/m1")
    loaded = tables.read_blocks(spark, [f"{tmp_path}/m0", f"{tmp_path}/m1"], [(2, 2), (2, 2)])
    assert {(x.image, x["mean"]) for x in blocks.match_loaded(loaded, ["a"]).collect()} >= {("a", 9.0)}
    with pytest.raises(ValueError):
        tables.read_blocks(spark, [f"{tmp_path}/m0"], [(2, 2), (3, 2)])
    assert blocks.smoothed(local).collect()[0]["mean"] == pytest.approx(7.0)


def test_expressions_are_checked(spark):
    df = spark.createDataFrame([("a", 0, 0, 10.0, 10.0), ("a", 0, 1, 1.0, None)], "image string, prow int, pcol int, b1 double, b2 double")
    assert [r.value for r in expressions.band_math(df, "b1 + b2", ("b1", "b2")).collect()] == [20.0]
    assert expressions.band_math(df, "np.where(b2 > 3, b1, 0)", ("b1", "b2")).count() == 1
    assert [r.value for r in expressions.band_math(df, "-b1 ** 2 // 3 + b1 % -3", ("b1",)).orderBy("pcol").collect()] == [-100 // 3 + 10 % -3, -1 // 3 + 1 % -3]
    for bad in ("__import__('os')", "b1.real", "b9 + 1", "b1 +", "[b1]", "open(b1)", "np.linalg.inv(b1)", "lambda: b1"):
        with pytest.raises(ValueError):
            expressions.to_column(bad, ("b1", "b2"))


def test_percentile_threshold(spark):
    r = raster(spark, {"a": (np.tile(np.arange(16.0), (16, 1)), 0, 16, 1)})
    out = array(expressions.threshold(r.pixels, "b1 >= 95%b1", r.bands).withColumnRenamed("value", "b1"), "a", (16, 16))
    edges = np.linspace(0, 15, 1001)
    cut = edges[np.flatnonzero(np.cumsum(np.histogram(np.tile(np.arange(16.0), 16), edges)[0]) >= 0.95 * 256)[0]]
    assert np.array_equal(out[0], (np.arange(16) >= cut).astype(float))
    flat = raster(spark, {"a": (np.ones((3, 3)), 0, 3, 1)})
    with pytest.raises(Exception, match="no range of values"):
        expressions.threshold(flat.pixels, "b1 > 50%b1", flat.bands).collect()


def square_raster(spark):
    a = np.zeros((16, 16))
    a[2:6, 2:6], a[10:14, 10:14] = 1, 2
    return raster(spark, {"a": (a, 0, 16, 1)})


def test_polygons_from_values(spark):
    r = square_raster(spark)
    cells = vector.true_cells(r, "b1 > 0")
    assert vector.areas(r, cells).collect()[0].area == 32
    assert vector.connected(cells, tile=4).select("crow", "ccol").distinct().count() == 2
    assert vector.outline(cells, ["image"]).count() == 32
    assert vector.size_filter(vector.areas(r, cells), ">4").count() == 1 and vector.size_filter(vector.areas(r, cells), "<50%").count() == 0
    with pytest.raises(ValueError):
        vector.size_filter(vector.areas(r, cells), "about 4")
    assert vector.true_cells(r, "b1 == 2", {0: 1, 1: 2, 2: None}).count() == 0
    assert vector.buffered(r, cells, 1.0).count() == 2 * (16 + 4 * 4 + 4)


def test_polygon_features_mask_their_own_cells(spark):
    """Cells -> polygons -> mask gives the cells back: with holes, diagonal neighbours and several regions."""
    rng = np.random.default_rng(8)
    a = (rng.uniform(0, 1, (14, 14)) < 0.55).astype(float)
    a[3:9, 3:9] = 1
    a[5:7, 5:7] = 0
    r = raster(spark, {"a": (a, 5, 40, 2), "b": (np.ones((3, 3)), 0, 3, 1)})
    cells = vector.true_cells(r, "b1 > 0")
    f = vector.polygons(r, cells, tile=5)
    assert f.count() == 2
    got = vector.mask(r, f.where("props['image'] = 'a'"), "include", field="image").pixels.where("image = 'a'")
    assert {(x.prow, x.pcol) for x in got.collect()} == {(i, j) for i, j in zip(*np.nonzero(a), strict=True)}
    regions = vector.polygons(r, cells, dissolve=False, tile=5)
    assert regions.count() == vector.connected(cells, 5).select("image", "crow", "ccol").distinct().count()
    assert {(p.x, p.y) for p in regions.where("props['image'] = 'b'").first().rings[0]} == {(0, 0), (3, 0), (3, 3), (0, 3)}


def test_snake_across_tiles(spark):
    a = np.full((9, 9), math.nan)
    for i in range(0, 9, 2):
        a[i] = 1
    for i in range(1, 9, 2):
        a[i, 8 if i % 4 == 1 else 0] = 1
    cells = raster(spark, {"a": (a, 0, 9, 1)}).pixels.select("image", "prow", "pcol")
    assert {(r.crow, r.ccol) for r in vector.connected(cells, tile=3).collect()} == {(0, 0)}


def test_mask_with_a_hole(spark):
    r = raster(spark, {"a": (np.ones((10, 10)), 0, 10, 1)})
    ring = vector.box(1, 1, 9, 9) + vector.box(3, 3, 7, 7)
    f = vector.feature_table(spark, [("m", 0, {"name": "x"}, ring)])
    assert vector.mask(r, f).pixels.count() == 64 - 16
    assert vector.mask(r, f, "exclude").pixels.count() == 100 - 48
    assert vector.mask(r, f, "include", field="name").pixels.count() == 100
    with pytest.raises(ValueError):
        vector.mask(r, f, "other")


def test_merge_vectors(spark):
    layers = {"u": vector.feature_table(spark, [("u", 0, {"id": "1"}, vector.box(0, 0, 5, 5))]), "v": vector.feature_table(spark, [("v", 0, {"id": "2"}, vector.box(1, 1, 6, 6))])}
    assert vector.merge(layers, "keep").count() == 2 and vector.merge(layers, "union", "n").collect()[0].props["n"] == "u, v"
    shared = vector.merge(layers, "intersection").collect()
    assert len(shared) == 1 and {(p.x, p.y) for p in shared[0].rings[0]} == {(1, 1), (5, 1), (5, 5), (1, 5)}
    with pytest.raises(ValueError):
        vector.merge(layers, "other")
    # rings of unlike lengths in one feature
    ring = vector.box(0, 0, 9, 9) + [[(1, 1), (3, 1), (1, 3), (1, 1)]]
    holed = vector.merge({"u": vector.feature_table(spark, [("u", 0, {}, ring)]), "v": layers["v"]}, "intersection").collect()
    assert sum(abs(sum(p.x * q.y - q.x * p.y for p, q in zip(x.rings[0], x.rings[0][1:], strict=False))) / 2 for x in holed) == pytest.approx(25 - 2)


def test_align(spark):
    r = raster(spark, {"a": (np.arange(256.0).reshape(16, 16), 0, 16, 1), "b": (np.full((8, 8), 3.0), 0, 16, 2)})
    out = restructure.align(r, "bilinear", tap=True, resolution="lowest")
    assert np.allclose(array(out.pixels, "a", (8, 8))[1:3, 1:3], [[r0 * 16 + c0 + 8.5 for c0 in (2, 4)] for r0 in (2, 4)])
    assert {(s.width, s.res_x) for s in out.scenes.collect()} == {(8, 2.0)}
    assert np.allclose(array(restructure.align(r, "nearest", tap=True).pixels, "b", (16, 16)), 3.0)
    assert np.allclose(array(restructure.align(r, "cubic", tap=True).pixels, "b", (16, 16)), 3.0)
    assert restructure.align(r).scenes is r.scenes
    with pytest.raises(ValueError):
        restructure.resample(r, r.scenes, "other")


def test_mosaic_takes_the_last_valid(spark):
    r = raster(spark, {"z": ([[1, 2], [3, 4]], 0, 2, 1), "a": ([[math.nan, 9], [9, 9]], 1, 2, 1)})
    m = {(x.prow, x.pcol): x.b1 for x in restructure.mosaic(r).collect()}
    assert m == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 9, (0, 2): 9, (1, 2): 9}


def test_cloud_mask_needs_a_predictor(spark):
    r = raster(spark, {"a": (np.full((3, 4, 4), 5.0), 0, 4, 1)})
    with pytest.raises(ValueError):
        clouds.cloud_mask(r, "b1", "b2", "b3")
    clouds.register("ones", lambda stack: np.ones(stack.shape[1:]))
    assert clouds.cloud_mask(r, "b1", "b2", "b3", "ones", down_sample=2.0).count() == 4


def test_tiles_see_their_neighbours(spark):
    """A predictor that sums a square of 7 x 7 pixels gives the same for every tile size, as on the whole image."""
    a = np.random.default_rng(3).integers(1, 9, (3, 50, 70)).astype(float)
    a[:, 10:14, 20:60] = math.nan
    r = raster(spark, {"a": (a, 0, 50, 1)})

    def near(stack):
        padded = np.pad(np.nan_to_num(stack[0]), 3)
        return sum(padded[i : i + stack.shape[1], j : j + stack.shape[2]] for i in range(7) for j in range(7))

    want = near(np.nan_to_num(a))
    for tile in (8, 17, 100):
        out = clouds.cloud_mask(r, "b1", "b2", "b3", near, tile=tile, halo=3).collect()
        assert len(out) == 50 * 70 - 160 and all(x.value == want[x.prow, x.pcol] for x in out)


def test_comparisons(spark):
    r = raster(spark, {"a": ([[1, 2], [3, 4]], 0, 2, 1), "b": ([[2, 2], [0, math.nan]], 0, 2, 1), "c": ([[1]], 0, 2, 1)})
    assert {(x.prow, x.pcol): x["diff"] for x in stats.difference(r, "a", "b").collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 3}
    with pytest.raises(ValueError):
        stats.difference(r, "a", "c")
    with pytest.raises(ValueError):
        stats.profile_pairs({"x": [r]})
    q = {x.image: (x.q25, x["median"], x.q75) for x in stats.profile(r).collect()}
    assert q["a"] == (1.75, 2.5, 3.25)


def test_tables_round_trip(spark, tmp_path):
    r = raster(spark, {"a": ([[1, math.nan], [3, 4]], 0, 2, 1)})
    tables.write(r, str(tmp_path / "t"), nodata=0.0)
    back = tables.read(spark, str(tmp_path / "t"), nodata=0.0)
    assert back.bands == ("b1",) and sorted(x.b1 for x in back.pixels.collect()) == [1, 3, 4]
    f = vector.feature_table(spark, [("m", 0, {"k": "v"}, vector.box(0, 0, 2, 2))])
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": "v"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}))
    got = tables.read_geojson(spark, str(tmp_path / "x.geojson"), "m").orderBy("feature_id").collect()
    assert got[0].rings == f.collect()[0].rings and len(got[1].rings) == 2
    tables.write_geojson(f, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["properties"] == {"k": "v"}
    w = tables.from_wkt(spark.createDataFrame([(0, {"k": "v"}, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")], "feature_id int, props map<string,string>, wkt string"), "wkt", "m")
    assert w.collect()[0].rings == f.collect()[0].rings


def test_paths(tmp_path):
    for n in ("A_GlobalMatch.tif", "B_GlobalMatch.tif", "C_Other.tif"):
        (tmp_path / n).write_text("")
    assert [p.rsplit("/", 1)[1] for p in paths.search(str(tmp_path), "*_GlobalMatch.tif")] == ["A_GlobalMatch.tif", "B_GlobalMatch.tif"]
    assert paths.create(str(tmp_path / "o"), "$_x.tif", ["/a/b.c.tif", "d.e"]) == [f"{tmp_path}/o/b.c_x.tif", f"{tmp_path}/o/d_x.tif"] and (tmp_path / "o").is_dir()
    assert paths.match(["/x/A_LocalMatch.gpkg", "/y/A_LocalMatch.gpkg", "/x/zz.gpkg"], ["/r/img_A_1.tif", "/r/B.tif"], r"(.*)_LocalMatch\.gpkg$") == ["/y/A_LocalMatch.gpkg", None]
    assert paths.resolve("name", ["/a/b.tif"]) == ["/a/b.tif"] and paths.resolve("name", "/a/b.tif") == ["b"]
    with pytest.raises(ValueError):
        paths.resolve("other", "x")


def rectangles(spark, n, name, seed, spread=300.0):
    r = np.random.default_rng(seed)
    size = 2.0 ** r.uniform(-3, 7, (n, 2))
    low = r.uniform(-spread, spread, (n, 2))
    low[: n // 4], size[: n // 4] = np.round(low[: n // 4]), np.round(size[: n // 4])  # touching ones, and points
    rows = [(i, *map(float, (*low[i], *(low[i] + size[i])))) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} int, left double, bottom double, right double, top double")


@pytest.mark.parametrize("touch", [False, True])
def test_meeting_boxes(spark, touch):
    from pixelloom.operators import boxes

    (a, one), (b, two) = rectangles(spark, 200, "a", 1), rectangles(spark, 300, "b", 2)
    less = (lambda x, y: x <= y) if touch else (lambda x, y: x < y)
    want = sorted((i, j, max(p[0], q[0]), min(p[2], q[2])) for i, *p in a for j, *q in b if less(max(p[0], q[0]), min(p[2], q[2])) and less(max(p[1], q[1]), min(p[3], q[3])))
    found = boxes.meeting(one, two, touch)
    assert sorted(map(tuple, found.select("a", "b", "x_min", "x_max").collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_that_contain_others(spark):
    from pixelloom.operators import boxes

    keys = ["", "a", "ab", "scene_0001", "scene_0002", "scene_00", "Z" * 30, "ü🙂", "scene_0001"]
    texts = ["scene_0001.tif", "x scene_0002 and scene_0001", "aab", None, "", "Z" * 29, "Z" * 31, "eü🙂e", "scene_"]
    found = boxes.containing(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(k,) for k in [*keys, None]], "k string"), "k")
    assert sorted(map(tuple, found.collect())) == sorted({(t, k) for t in texts if t is not None for k in keys if k in t})


def test_many_features_mask_as_brute_force(spark):
    r = np.random.default_rng(4)
    image = raster(spark, {"a": (np.ones((90, 150)), 0, 90, 1), "b": (np.ones((40, 70)), 100, 60, 1)})
    rings = []
    for _ in range(150):
        x, y = r.uniform(-10, 160), r.uniform(-10, 100)
        corners = [(x + r.uniform(-9, 9), y + r.uniform(-9, 9)) for _ in range(r.integers(3, 8))]  # they may cross themselves
        rings.append([*corners, corners[0]])
    rings += [[(0.5, 0.5), (10.5, 0.5), (10.5, 9.5), (0.5, 9.5), (0.5, 0.5)]]
    f = vector.feature_table(spark, [("m", i, {"name": "a" if i % 2 else "all of a, b"}, [ring]) for i, ring in enumerate(rings)])

    def hit(ring, cx, cy):
        return sum((y1 <= cy < y2 or y2 <= cy < y1) and x1 + (cy - y1) / (y2 - y1) * (x2 - x1) > cx for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) % 2

    want = {("a", 89 - y, x) for y in range(90) for x in range(150) if any(hit(g, x + 0.5, y + 0.5) for g in rings)}
    want |= {("b", 59 - y, x - 100) for y in range(20, 60) for x in range(100, 170) if any(hit(g, x + 0.5, y + 0.5) for g in rings)}
    assert {tuple(x) for x in vector.inside(image, f).collect()} == want
    named = {tuple(x) for x in vector.inside(image, f, "name").collect() if x.image == "b"}
    assert named == {("b", 59 - y, x - 100) for y in range(20, 60) for x in range(100, 170) if any(hit(g, x + 0.5, y + 0.5) for i, g in enumerate(rings) if i % 2 == 0)}


def test_wide_buffer_equals_brute_force(spark):
    r = np.random.default_rng(6)
    image = raster(spark, {"a": (np.ones((2, 2)), 0, 2, 1)})
    image = Rasters(image.pixels, scenes_of(spark, [{"image": "a", "x0": 0.0, "y0": 200.0, "width": 230, "height": 200}]), ("b1",))
    at = np.unique(np.stack([r.integers(0, 200, 400), r.integers(0, 230, 400)], 1), axis=0)
    cells = spark.createDataFrame([("a", int(y), int(x)) for y, x in at], "image string, prow int, pcol int")
    for distance in (0.4, 1.0, 7.3, 60.0):
        rows, cols = np.mgrid[0:200, 0:230]
        near = np.zeros((200, 230), bool)
        for y, x in at:
            near |= np.maximum(abs(rows - y) - 0.5, 0) ** 2 + np.maximum(abs(cols - x) - 0.5, 0) ** 2 <= distance**2
        assert {(p.prow, p.pcol) for p in vector.buffered(image, cells, distance).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_clipped_areas_equal_those_of_a_geometry_library(spark):
    from pixelloom.operators import clipping
    from jts import Jts

    j, r = Jts(spark), np.random.default_rng(8)

    def star(n, x, y, size):
        turn = np.sort(r.uniform(0, 2 * np.pi, n))
        far = r.uniform(0.3, 1, n) * size
        points = [(float(x + d * np.cos(t)), float(y + d * np.sin(t))) for t, d in zip(turn, far, strict=True)]
        return [*points, points[0]]

    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2
    for k in range(60):
        a, b = [star(r.integers(3, 14), 0, 0, 10)], [star(r.integers(3, 14), r.uniform(-8, 8), r.uniform(-8, 8), 8)]
        if k % 3 == 0:
            a.append([(x * 0.2, y * 0.2) for x, y in a[0]])  # a hole
        if k % 4 == 0:
            a, b = ([[(float(round(x)), float(round(y))) for x, y in ring] for ring in p] for p in (a, b))
        try:
            want = j.polygon(a).intersection(j.polygon(b)).getArea()
        except Exception:
            continue  # rounded corners may cross
        pieces = clipping.shared(a, b)
        assert sum(map(area, pieces)) == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert all(ring[0] == ring[-1] and len(ring) > 3 for ring in pieces)
    box = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]
    assert clipping.shared(box(0, 0, 5), box(5, 0, 5)) == [] and clipping.shared(box(0, 0, 5), [[]]) == []
    assert len(clipping.shared(box(0, 0, 5), box(1, 1, 9))) == 1 and sorted(set(clipping.shared(box(0, 0, 5), box(1, 1, 9))[0])) == [(1, 1), (1, 5), (5, 1), (5, 5)]
    # a comb of three teeth comes in three pieces
    comb = [[(0, 0), (5, 0), (5, 4), (4, 4), (4, 1), (3, 1), (3, 4), (2, 4), (2, 1), (1, 1), (1, 4), (0, 4), (0, 0)]]
    assert len(clipping.shared(comb, box(0, 2, 5))) == 3 and sum(map(area, clipping.shared(comb, box(-1, -1, 9)))) == area(comb[0])


def test_constant_bands_stay_or_are_undetermined(spark):
    """A constant band has no ratio of deviations: NaN where that is asked for, for images that the anchor reaches alone."""
    rng = np.random.default_rng(5)
    flat, free = np.full((4, 8), 0.1), rng.random((3, 4, 8))
    r = raster(spark, {name: (np.stack([flat, free[k]]), x, 4, 1) for k, (name, x) in enumerate({"A": 0, "N": 4, "R": 50}.items())})
    closed = lambda **how: {(x.image, x.band): (x.scale, x.offset) for x in regression.anchored(stats.overlap(r), r.scenes, "A", **how).collect()}
    solved = lambda anchors, **how: {(x.image, x.band): (x.scale, x.offset) for x in regression.parameters(r, anchors, **how)[0].collect()}
    for keep in (True, False):
        for found in (closed(keep_undetermined=keep), solved(regression.Anchors("include", ("A",)), keep_undetermined=keep), solved(regression.Anchors("exclude", ("N", "R")), keep_undetermined=keep)):
            assert found["A", "b1"] == pytest.approx((1, 0)) and found["R", "b1"] == (1, 0)
            assert found["N", "b1"] == pytest.approx((1, 0)) if keep else all(map(math.isnan, found["N", "b1"]))
            assert all(map(math.isfinite, found["N", "b2"]))


def test_constant_anchors_that_overlap_are_undetermined(spark):
    """Where all are anchors, a constant band leaves them all open; one constant image leaves the others determined."""
    rng = np.random.default_rng(6)
    flat, free = np.full((4, 8), 0.1), rng.random((4, 4, 8))
    r = raster(spark, {name: (np.stack([flat, free[k], flat if name == "N" else free[3]]), x, 4, 1) for k, (name, x) in enumerate({"A": 0, "N": 4, "R": 8}.items())})
    for keep in (True, False):
        found = {(x.image, x.band): (x.scale, x.offset) for x in regression.parameters(r, keep_undetermined=keep)[0].collect()}
        for (image, band), x in found.items():
            assert all(map(math.isnan, x)) if not keep and (band == "b1" or (image, band) == ("N", "b3")) else all(map(math.isfinite, x))
            assert x == pytest.approx((1, 0)) or band != "b1" or not keep


def test_small_groups_share_a_python_call_and_stay_whole(spark):
    """Groups over several Arrow batches come whole, and many small ones in one call."""
    import pandas as pd

    from pixelloom.operators.components import by_groups

    def run(rows, bounds):
        first = rows.iloc[bounds[:-1]]
        return pd.DataFrame({"image": first.image.to_numpy(), "k": first.k.to_numpy(), "n": np.diff(bounds), "total": np.add.reduceat(rows.v.to_numpy(), bounds[:-1]), "calls": len(bounds) - 1})

    rows = spark.range(3000).selectExpr("if(id < 1000, 'large', concat('i', id % 400)) as image", "cast(if(id < 1000, 0, id % 3) as int) as k", "id as v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")
    try:
        found = by_groups(rows, ["image", "k"], run, "image string, k int, n long, total long, calls long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.image, r.k): (r.n, r.total) for r in rows.groupBy("image", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()}
    assert len(found) == len(want) and {(r.image, r.k): (r.n, r.total) for r in found} == want
    assert max(r.calls for r in found) > 10


def test_boxes_are_dealt_by_their_counted_rows(spark, monkeypatch):
    from pixelloom.operators import boxes

    rows = [(k, float(k % 20), float(k // 20), k % 20 + 1.5 + k % 3, k // 20 + 1.5) for k in range(200)]
    a, b = (spark.createDataFrame(rows, f"{n} long, left double, bottom double, right double, top double") for n in ("i", "j"))
    plain = sorted(map(tuple, boxes.meeting(a, b).collect()))
    monkeypatch.setattr(boxes, "ROWS", 100)
    dealt = boxes.meeting(a, b)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == plain
    assert {x[:2] for x in plain} == {(p[0], q[0]) for p in rows for q in rows if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}
