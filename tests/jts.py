"""Planar geometry by the JTS library that Spark's JVM brings, to compare with."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Jts:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.top = self.jvm.org.locationtech.jts
        self.factory = self.top.geom.GeometryFactory()

    def _array(self, n: int):
        from pyspark import SparkContext

        return SparkContext._active_spark_context._gateway.new_array(self.top.geom.Coordinate, n)

    def line(self, points: list[tuple[float, float]]):
        return self.factory.createLineString(self._filled(points))

    def _filled(self, points: list[tuple[float, float]]):
        out = self._array(len(points))
        for i, (x, y) in enumerate(points):
            out[i] = self.top.geom.Coordinate(float(x), float(y))
        return out

    def polygon(self, rings: list[list[tuple[float, float]]]):
        """By the even-odd rule over rings."""
        out = None
        for ring in rings:
            one = self.factory.createPolygon(self._filled(ring))
            out = one if out is None else out.symDifference(one)
        return out

    @staticmethod
    def parts(geometry) -> list:
        return [geometry.getGeometryN(i) for i in range(geometry.getNumGeometries())]

    @staticmethod
    def points(geometry) -> list[tuple[float, float]]:
        return [(c.getX(), c.getY()) for c in geometry.getCoordinates()]

    def rings(self, polygon) -> list[list[tuple[float, float]]]:
        return [self.points(polygon.getExteriorRing()), *(self.points(polygon.getInteriorRingN(i)) for i in range(polygon.getNumInteriorRing()))]

    def polygonized(self, lines: list) -> list:
        p = self.top.operation.polygonize.Polygonizer()
        for x in lines:
            p.add(x)
        return list(p.getPolygons())

    def split(self, polygon, cut) -> list:
        """The pieces of a polygon along a line."""
        noded = polygon.getBoundary().union(cut)
        inner = lambda piece: polygon.contains(piece.getInteriorPoint())
        return [p for p in self.polygonized([noded]) if inner(p)]
