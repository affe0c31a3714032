"""Seamlines: the geometry of the tasks against a geometry library, then whole images."""

import itertools
import math
import random

import numpy as np
import pytest
from jts import Jts
from pyspark.sql import functions as F
from test_operators import raster

from pixelloom.operators import overlay, regions, seamline, vector, voronoi


def mask(r, height, width, holes):
    """A connected ragged region with holes."""
    a = np.zeros((height, width), bool)
    a[2:-2, 2:-2] = True
    for k in range(2, width - 2):
        a[: 2 + int(r.integers(0, 3)), k] = False
        a[height - 2 - int(r.integers(0, 3)) :, k] = False
    for _ in range(holes):
        y, x = int(r.integers(4, height - 8)), int(r.integers(4, width - 8))
        a[y : y + int(r.integers(1, 4)), x : x + int(r.integers(1, 4))] = False
    return a


def region(a):
    """The largest region by sides."""
    todo, best = set(zip(*map(np.ndarray.tolist, np.nonzero(a)), strict=True)), set()
    while todo:
        found, stack = set(), [min(todo)]
        while stack:
            p = stack.pop()
            if p in todo:
                todo.discard(p)
                found.add(p)
                stack += [(p[0] + d, p[1] + e) for d, e in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        best = max(best, found, key=len)
    return best


def outlined(cells, x0=0.0, y0=0.0, res=1.0):
    edges = []
    for r, c in cells:
        for (d, e), edge in (((-1, 0), (r, c, r, c + 1)), ((0, 1), (r, c + 1, r + 1, c + 1)), ((1, 0), (r + 1, c + 1, r + 1, c)), ((0, -1), (r + 1, c, r, c))):
            if (r + d, c + e) not in cells:
                edges.append(edge)
    return [[(x0 + c * res, y0 - r * res) for r, c in x] for ring in overlay.traced(edges) for x in overlay.loops(ring)]


def pair(k):
    r = np.random.default_rng(k)
    res = (1.0, 0.3, 2.0)[k % 3]
    a = outlined(region(mask(r, 24, 30, int(r.integers(0, 9)))), 500000.0, 4000000.0)
    b = outlined(region(mask(r, 26, 28, int(r.integers(0, 9)))), 500000.0 + int(r.integers(-12, 16)), 4000000.0 + int(r.integers(-12, 12)), res)
    return a, b


def sized(rings):
    return sum(map(overlay.area, rings))


def test_outlines_overlaps_and_anchors_equal_those_of_a_geometry_library(spark):
    j = Jts(spark)
    met = 0
    for k in range(40):
        a, b = pair(k)
        one, two = j.polygon(a), j.polygon(b)
        assert sized(overlay.oriented(a)) == pytest.approx(one.getArea(), rel=1e-9)
        parts = [p for p in j.parts(one.intersection(two)) if p.getGeometryType() == "Polygon" and not p.isEmpty()]
        shell = overlay.overlap(a, b)
        assert (shell is None) == (not parts)
        if shell is None:
            continue
        met += 1
        want = max(parts, key=lambda p: p.getArea())
        near = [p for p in parts if p.getArea() > want.getArea() - 1e-6]
        assert any(abs(overlay.area(shell)) == pytest.approx(j.factory.createPolygon(p.getExteriorRing().getCoordinates()).getArea(), rel=1e-7) for p in near)
        found = one.getBoundary().intersection(two.getBoundary())
        points = sorted((p.getX(), p.getY()) for p in j.parts(found) if p.getGeometryType() == "Point" and not p.isEmpty())
        lines = sorted(p.getLength() for p in j.parts(found) if p.getGeometryType() == "LineString" and not p.isEmpty())
        ends = overlay.anchors(a, b)
        assert len(ends) == len(points) + len(lines)
        assert np.allclose(ends[len(lines) :], points, atol=1e-6) if points else True
    assert met > 30


@pytest.mark.parametrize("kind", ["free", "grid", "circle", "outline"])
def test_voronoi_edges_equal_those_of_a_geometry_library(spark, kind):
    r = random.Random(4)
    if kind == "free":
        points = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(300)]
    elif kind == "grid":
        points = [(float(x), float(y)) for x in range(12) for y in range(9)] * 2
    elif kind == "circle":
        points = [(3 + 5 * math.cos(k), 4 + 5 * math.sin(k)) for k in range(40)] + [(3.0, 4.0)]
    else:
        points = seamline.spaced([(0.0, 0.0), (20.0, 0.0), (20.0, 9.0), (0.0, 9.0), (0.0, 0.0)], 1)
    edges = voronoi.graph(points)
    # a node is as far from its nearest points as from its circle's, and no point is nearer
    for node in edges:
        d = sorted(math.dist(node, p) for p in set(points))
        assert d[2] - d[0] < 1e-5
    j = Jts(spark)
    builder = j.top.triangulate.VoronoiDiagramBuilder()
    builder.setSites(j.factory.createMultiPointFromCoords(j._filled(points)))
    inner = lambda p: -1 < p[0] < 21 and -1 < p[1] < 21
    want = {}
    for cell in j.parts(builder.getDiagram(j.factory)):
        ring = j.points(cell.getExteriorRing())
        for p, q in itertools.pairwise(ring):
            if math.dist(p, q) > 1e-3 and all(sorted(math.dist(x, s) for s in set(points))[2] - min(math.dist(x, s) for s in set(points)) < 1e-5 for x in (p, q)) and inner(p) and inner(q):
                want[frozenset((tuple(np.round(p, 3)), tuple(np.round(q, 3))))] = math.dist(p, q)
    found = {frozenset((p, q)): d for p, near in edges.items() for q, d in near.items() if d > 1e-3 and inner(p) and inner(q)}
    assert len(found) == len(want) and sum(found.values()) == pytest.approx(sum(want.values()), rel=1e-4)
    assert voronoi.graph([(float(k), 2.0 * k) for k in range(9)]) == {}


def test_pieces_equal_those_of_a_geometry_library(spark):
    j, split = Jts(spark), 0
    for k in range(60):
        r = np.random.default_rng(100 + k)
        rings = outlined(region(mask(r, 24, 30, int(r.integers(0, 12)))))
        way = [(float(x), float(-r.integers(2, 23)) - (0.37 if k % 2 else 0)) for x in sorted(r.integers(-2, 34, 4))]
        way = [p for i, p in enumerate(way) if not i or p[0] > way[i - 1][0]]
        if len(way) < 2:
            continue
        if k % 3 == 0:
            way = way[:-1] + [(15.5, -12.0)]  # an end within, perhaps in a hole
            if any(p[0] >= 15.5 for p in way[:-1]):
                continue
        lattice = voronoi.Lattice([p for ring in rings for p in ring] + way)
        polygon = [[lattice.put(p) for p in ring] for ring in overlay.oriented(rings)]
        found = overlay.pieces(polygon, [lattice.put(p) for p in way])
        want = j.split(j.polygon(rings), j.line(way))
        assert np.allclose(sorted(sized(x) / lattice.scale**2 for x in found), sorted(p.getArea() for p in want), atol=1e-4), k
        assert sorted(sum(len(overlay.loops(ring)) for ring in x) - 1 for x in found) == sorted(p.getNumInteriorRing() for p in want) or k % 2 == 0  # parts that touch at nodes may join
        split += len(found) > 1
        middle = j.polygon(rings).getCentroid()
        mine = next((p for p in want if p.contains(middle)), None) or max(want, key=lambda p: p.getArea())
        assert sized(overlay.kept(rings, [way])) == pytest.approx(mine.getArea(), rel=1e-6)
    assert split > 20


def test_farthest_points():
    r = np.random.default_rng(2)
    for _ in range(30):
        points = [(float(x), float(y)) for x, y in r.integers(0, 9, (int(r.integers(2, 40)), 2))]
        u, v = seamline.farthest([*points, (20.0, 3.0)])
        assert math.dist(u, v) == max(math.dist(p, q) for p, q in itertools.combinations([*points, (20.0, 3.0)], 2))


def test_seamlines_split_the_overlap(spark):
    r = raster(spark, {"l": (np.ones((20, 20)), 0, 20, 1), "r": (np.ones((20, 20)), 10, 20, 1)})
    found, cuts = seamline.seamlines(r, min_point_spacing=1)
    j = Jts(spark)
    a, b = (j.polygon([[(p[0], p[1]) for p in ring] for ring in x.rings]) for x in found.orderBy("feature_id").collect())
    assert a.intersection(b).getArea() < 1e-6 and a.union(b).getArea() == pytest.approx(600) and cuts.count() > 5
    with pytest.raises(ValueError):
        seamline.footprints(raster(spark, {"l": ([[1.0]], 0, 1, 1), "r": ([[math.nan]], 0, 1, 1)}))
    with pytest.raises(Exception, match="long enough"):
        seamline.seamlines(r, min_point_spacing=1, min_cut_length=100)


def test_three_images_share_their_union(spark):
    """Cuts of other pairs that run through a footprint act on it, in the order of pairs."""
    r = raster(spark, {"a": (np.ones((30, 30)), 0, 30, 1), "b": (np.ones((30, 30)), 20, 30, 1), "c": (np.ones((30, 30)), 40, 30, 1), "far": (np.ones((5, 5)), 400, 30, 1)})
    found, cuts = seamline.seamlines(r, "name", min_point_spacing=1)
    rows = {x.props["name"]: [[(p[0], p[1]) for p in ring] for ring in x.rings] for x in found.collect()}
    sizes = {k: sized(v) for k, v in rows.items()}
    assert sum(sizes.values()) == pytest.approx(2100 + 25) and sizes["far"] == 25
    assert sizes == pytest.approx({"a": 750, "b": 600, "c": 750, "far": 25}, abs=30)  # the seam's ends lean to one side
    assert sorted(x.pair for x in cuts.select("pair").distinct().collect()) == ["a-b", "b-c"]
    assert cuts.groupBy("pair").agg(F.max("pos") + 1 == F.count("*")).collect()[0][1]


def shuffled(spark):
    """Records written by all shuffles so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_footprints_shuffle_outlines_and_not_cells(spark):
    r = raster(spark, {f"i{k}": (np.ones((40, 50)), 100.0 * k, 40, 1) for k in range(20)})
    cells = r.pixels.count()
    before = shuffled(spark)
    assert seamline.footprints(r).count() == 20
    assert shuffled(spark) - before < cells / 20


@pytest.mark.parametrize("tile", [5, 64])
def test_largest_regions_equal_those_of_cells(spark, tile):
    g = np.random.default_rng(7)
    images = {f"i{k}": (np.where(g.random((int(g.integers(3, 23)), int(g.integers(3, 23)))) < 0.35 + 0.07 * (k % 9), 1.0, math.nan), 0.0, 30.0, 1) for k in range(36)}
    images["whole"] = np.ones((13, 17)), 0.0, 30.0, 1
    images["tie"] = [[1.0, math.nan, 1.0], [1.0, math.nan, 1.0]], 0.0, 30.0, 1
    images["on lines"] = np.ones((10, 5)), 0.0, 30.0, 1
    r = raster(spark, images)
    cells = r.pixels.select("image", "prow", "pcol").orderBy(F.rand(5))
    every = vector.connected(cells, 256)
    found = {x.image: x for x in regions.largest_outlines(cells, tile).collect()}
    assert len(found) == len(images)
    sizes = {(x.image, x.crow, x.ccol): x["count"] for x in every.groupBy("image", "crow", "ccol").count().collect()}
    outlines = {(x.image, x.crow, x.ccol): x.corners for x in vector.outlines(every).collect()}
    for name, x in found.items():
        best = max((k for k in sizes if k[0] == name), key=lambda k: (sizes[k], -k[1], -k[2]))
        assert (name, x.crow, x.ccol) == best and sorted(x.corners) == sorted(outlines[best])


def test_like_geometries_are_triangulated_and_cut_once(monkeypatch):
    """Pairs that differ in their place alone share the work on the lattice, with the results of each by itself."""
    calls = []
    triangles, pieces = voronoi.Triangles, overlay.pieces
    monkeypatch.setattr(voronoi, "Triangles", lambda points: calls.append("triangles") or triangles(points))
    monkeypatch.setattr(overlay, "pieces", lambda *how: calls.append("pieces") or pieces(*how))
    boxed = lambda x: [[(x, 0.0), (x + 12.0, 0.0), (x + 12.0, -19.0), (x, -19.0), (x, 0.0)]]
    seams = []
    for k in range(20):
        a, b = boxed(64.0 * k), boxed(64.0 * k + 9)
        line = seamline.center_line(a, b, 1, 0)
        seams.append([[(x - 64.0 * k, y) for x, y in ring] for ring in (line, *overlay.kept(a, [line]), *overlay.kept(b, [line]))])
    assert all(np.allclose(np.array(p), np.array(q)) for s in seams for p, q in zip(s, seams[0], strict=True))
    assert calls.count("triangles") <= 1 and calls.count("pieces") <= 2
