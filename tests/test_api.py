import math

import numpy as np
import pytest
from test_operators import array, raster

from pixelloom import api
from pixelloom.functions import expressions
from pixelloom.model import Rasters, scenes_of
from pixelloom.operators import stats, vector
from pixelloom.plans import validate
from pixelloom.sources.scenes import scenes
from pixelloom.streaming import increments


def pair(spark):
    rng = np.random.default_rng(3)
    return raster(spark, {"X": (rng.uniform(50, 100, (16, 16)), 0, 16, 1), "Y": (rng.uniform(80, 160, (16, 16)), 8, 16, 1)})


def test_global_model_file(spark, tmp_path):
    r = pair(spark)
    f = str(tmp_path / "model.json")
    one = api.global_regression(r, model_images=("include", ["X"]), save_adjustments=f, custom_nodata=0)
    two = api.global_regression(r, model_images=("include", ["X"]), load_adjustments=f)
    assert np.allclose(array(one.pixels, "Y", (16, 16)), array(two.pixels, "Y", (16, 16)))
    o = {(x.image, x.other): x["mean"] for x in stats.overlap(one).collect()}
    assert o["X", "Y"] == pytest.approx(o["Y", "X"], rel=1e-6)
    masked = api.global_regression(r, model_images=("include", ["X"]), vector_mask=("exclude", vector.feature_table(spark, [("m", 0, {}, vector.box(8, 0, 12, 16))])))
    assert not np.allclose(array(masked.pixels, "Y", (16, 16)), array(one.pixels, "Y", (16, 16)))


def test_local_block_map_folder(spark, tmp_path):
    r = pair(spark)
    folder = str(tmp_path / "maps")
    options = {"number_of_blocks": (2, 2), "correction_method": "linear", "override_bounds": (0, 0, 24, 16)}
    one = api.local_block_adjustment(r, save_block_maps=folder, **options)
    two = api.local_block_adjustment(r, load_block_maps=[folder], correction_method="linear")
    assert np.allclose(array(one.pixels, "X", (16, 16)), array(two.pixels, "X", (16, 16)))
    with pytest.raises(ValueError):
        api.local_block_adjustment(r, load_block_maps=[folder], override_bounds=(0, 0, 1, 1))
    assert api.local_block_adjustment(r, number_of_blocks="coefficient_of_variation").pixels.count() == 512


def test_chain(spark, tmp_path):
    r = pair(spark)
    assert api.band_math(r, "b1 * 2").bands == ("b1",) and api.threshold_raster(r, "b1 > 70").pixels.count() == 512
    cells = api.values_to_polygons(r, "b1 > 90", filter_by_polygon_size=">1", polygon_buffer=1.0)
    assert {f.props["image"] for f in cells.collect()} == {"X", "Y"}
    merged = api.merge_rasters(api.align_rasters(r))
    assert merged.scenes.first()["width"] == 24 and merged.pixels.count() == 24 * 16
    api.write(merged, str(tmp_path / "m"), nodata=0.0, dtype="uint16")
    assert api.read(spark, str(tmp_path / "m"), 0.0).pixels.count() == 24 * 16
    assert api.mask_rasters(r) is r
    api.write_geotiff(merged, str(tmp_path / "g"), "uint16", 0.0)
    assert api.read_geotiff(spark, str(tmp_path / "g")).pixels.count() == 24 * 16
    assert set(api.__all__) <= set(dir(api))


@pytest.mark.parametrize(
    "call",
    [
        lambda: validate.window_size(0), lambda: validate.window_size((16, 32), cog=True), lambda: validate.window_size(20, cog=True), lambda: validate.dtype("complex"), lambda: validate.nodata("x"), lambda: validate.vector_mask(("inside", None)), lambda: validate.factors(-1, 1),
        lambda: validate.model_images(("include", "x")), lambda: validate.blocks(0, 1, "gamma", 0.1, None), lambda: validate.blocks(5, "x", "gamma", 0.1, None), lambda: validate.blocks(5, 1, "cubic", 0.1, None), lambda: validate.blocks(5, 1, "gamma", 2, None), lambda: validate.blocks(5, 1, "gamma", 0.1, (1, 1, 0, 2)),
    ],
)
def test_validation(call):
    with pytest.raises(ValueError):
        call()


def test_streamed_statistics(spark, tmp_path):
    a = np.arange(16.0).reshape(4, 4)
    a[0, 0] = math.nan
    r = raster(spark, {"a": (a, 0, 4, 1)})
    for k in (0, 1):
        r.pixels.where(f"prow % 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(r.pixels.schema).parquet(str(tmp_path / "in"))
        increments.follow(stream, r.bands, str(tmp_path / "sums"), str(tmp_path / "check")).awaitTermination(120)
    got, want = increments.current(spark, str(tmp_path / "sums")).first(), stats.whole(r).first()
    assert (got["mean"], got["std"], got["size"]) == pytest.approx((want["mean"], want["std"], want["size"]))


def test_merged_image_has_the_first_type_and_crs(spark):
    cat = scenes_of(spark, [{"image": n, "x0": x, "y0": 2.0, "width": 2, "height": 2, "dtype": "uint8", "nodata": 0.0, "crs": "EPSG:4326"} for n, x in (("a", 0.0), ("b", 1.0))])
    r = Rasters(spark.createDataFrame([("a", 0, 0, 5.0), ("b", 1, 1, 7.0)], "image string, prow int, pcol int, b1 double"), cat, ("b1",))
    out = api.merge_rasters(r)
    s = out.scenes.first()
    assert (s["dtype"], s["crs"], s["nodata"], s["width"], s["height"]) == ("uint8", "EPSG:4326", 0.0, 3, 2)
    assert sorted((p.prow, p.pcol, p.b1) for p in out.pixels.collect()) == [(0, 0, 5.0), (1, 2, 7.0)]


def test_empty_layer_masks_nothing(spark):
    cat = scenes_of(spark, [{"image": "a", "x0": 0.0, "y0": 2.0, "width": 2, "height": 2}])
    r = Rasters(spark.createDataFrame([("a", 0, 0, 5.0), ("a", 1, 1, 7.0)], "image string, prow int, pcol int, b1 double"), cat, ("b1",))
    nothing = vector.feature_table(spark, [("mask", 0, {}, vector.box(0, 0, 1, 1))]).where("false")
    assert vector.mask(r, nothing).pixels.count() == vector.mask(r, nothing, "exclude").pixels.count() == 2


def test_percentile_of_a_constant_image_is_an_error(spark):
    flat = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 0, 1, 5.0)], "image string, prow int, pcol int, b1 double")
    with pytest.raises(Exception, match="no range of values"):
        expressions.threshold(flat, "b1 >= 90%b1", ("b1",)).collect()


def test_profile_equals_numpy(spark):
    r = np.random.default_rng(4)
    values = {"a": r.normal(1e6, 3, 5_000), "b": r.integers(0, 9, 4_001).astype(float), "c": np.array([2.5]), "d": np.full(30, 7.0), "e": np.array([1.0, 4.0])}
    rows = [(k, 0, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "image string, prow int, pcol int, b1 double")
    out = stats.profile(Rasters(df, scenes_of(spark, [{"image": k, "x0": 0.0, "y0": 1.0, "width": len(v), "height": 1} for k, v in values.items()]), ("b1",)), bins=64)
    got = {x.image: (x.q25, x.median, x.q75) for x in out.collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert np.allclose(got[k], np.percentile(v, [25, 50, 75]), rtol=1e-12)


def test_known_pairs_are_not_read_again(spark, sf):
    r = scenes(spark, sf)
    every = stats.overlap(r)
    known = every.where("image in ('A', 'N') and other in ('A', 'N')").select("image", "other")
    left = sorted((x.image, x.other, x.band, round(x.mean, 9), x.size) for x in stats.overlap(r, known).collect())
    assert left == sorted((x.image, x.other, x.band, round(x.mean, 9), x.size) for x in every.collect() if {x.image, x.other} != {"A", "N"})


def test_streamed_deviation_keeps_its_digits(spark, tmp_path):
    """Large values with a small spread, in batches of different means."""
    parts = [[1e9 + k + x / 100 for x in range(50)] for k in range(3)]
    for i, v in enumerate(parts):
        increments.partials(spark.createDataFrame([("a", x) for x in v], "image string, b1 double"), ("b1",)).write.parquet(f"{tmp_path}/batch={i}")
    got, whole = increments.current(spark, str(tmp_path)).first(), np.concatenate(parts)
    assert got["size"] == 150 and np.isclose(got["std"], whole.std(ddof=1), rtol=1e-6) and np.isclose(got["mean"], whole.mean())


def test_local_correction_takes_a_type(spark, sf):
    out = api.local_block_adjustment(scenes(spark, sf), number_of_blocks=(3, 3), correction_method="linear", output_dtype="uint8")
    assert all(0 <= x.b2 <= 255 and x.b2 == int(x.b2) for x in out.pixels.where("b2 is not null").limit(200).collect())
