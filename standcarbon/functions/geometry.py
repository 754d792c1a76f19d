"""Polygon expressions over array<polygon<ring<point>>> columns; no UDFs."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ("minx", "miny", "maxx", "maxy")

# EPSG:3301 (Lambert conformal conic, two standard parallels, GRS80).
_SEMI_MAJOR = 6378137.0
_INVERSE_FLATTENING = 298.257222101
_PARALLEL_1 = math.radians(59 + 20 / 60)
_PARALLEL_2 = math.radians(58.0)
_ORIGIN_LATITUDE = math.radians(57 + 31 / 60 + 3.19415 / 3600)
_ORIGIN_LONGITUDE = math.radians(24.0)
_FALSE_EASTING = 500000.0
_FALSE_NORTHING = 6375000.0

_FLATTENING = 1 / _INVERSE_FLATTENING
_ECCENTRICITY = math.sqrt(_FLATTENING * (2 - _FLATTENING))


def _conic_m(latitude: float) -> float:
    return math.cos(latitude) / math.sqrt(1 - (_ECCENTRICITY * math.sin(latitude)) ** 2)


def _conic_t(latitude: float) -> float:
    swing = _ECCENTRICITY * math.sin(latitude)
    return math.tan(math.pi / 4 - latitude / 2) / ((1 - swing) / (1 + swing)) ** (
        _ECCENTRICITY / 2
    )


_CONE = (math.log(_conic_m(_PARALLEL_1)) - math.log(_conic_m(_PARALLEL_2))) / (
    math.log(_conic_t(_PARALLEL_1)) - math.log(_conic_t(_PARALLEL_2))
)
_SCALE = _SEMI_MAJOR * _conic_m(_PARALLEL_1) / (_CONE * _conic_t(_PARALLEL_1) ** _CONE)
_ORIGIN_RADIUS = _SCALE * _conic_t(_ORIGIN_LATITUDE) ** _CONE


def _project_point(point: Column) -> Column:
    latitude = F.radians(point["y"])
    swing = F.sin(latitude) * _ECCENTRICITY
    t = F.tan(F.lit(math.pi / 4) - latitude / 2) / F.pow(
        (1 - swing) / (1 + swing), F.lit(_ECCENTRICITY / 2)
    )
    radius = F.pow(t, F.lit(_CONE)) * _SCALE
    angle = (F.radians(point["x"]) - _ORIGIN_LONGITUDE) * _CONE
    return F.struct(
        (radius * F.sin(angle) + _FALSE_EASTING).alias("x"),
        (F.lit(_FALSE_NORTHING + _ORIGIN_RADIUS) - radius * F.cos(angle)).alias("y"),
    )


def to_metric(geometry: Column) -> Column:
    """Longitude/latitude to metres in the national grid."""
    return F.transform(
        geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, _project_point))
    )


# Each round leaves less than a hundredth of the error of the latitude before it.
_LATITUDE_ROUNDS = 7


def _unproject_point(point: Column) -> Column:
    east, south = point["x"] - _FALSE_EASTING, F.lit(_FALSE_NORTHING + _ORIGIN_RADIUS) - point["y"]
    t = F.pow(F.sqrt(east * east + south * south) / _SCALE, F.lit(1 / _CONE))
    longitude = F.atan2(east, south) / _CONE + _ORIGIN_LONGITUDE

    def nearer(latitude: Column, _: Column) -> Column:
        swing = F.sin(latitude) * _ECCENTRICITY
        flat = F.pow((1 - swing) / (1 + swing), F.lit(_ECCENTRICITY / 2))
        return F.lit(math.pi / 2) - F.atan(t * flat) * 2

    rounds = F.sequence(F.lit(1), F.lit(_LATITUDE_ROUNDS))
    latitude = F.aggregate(rounds, F.lit(math.pi / 2) - F.atan(t) * 2, nearer)
    return F.struct(F.degrees(longitude).alias("x"), F.degrees(latitude).alias("y"))


def to_geographic(geometry: Column) -> Column:
    """Metres in the national grid to longitude/latitude; the inverse of `to_metric`."""
    return F.transform(
        geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, _unproject_point))
    )


def points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def with_bounds(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    all_points = points(F.col(geometry))
    return df.withColumns(
        {
            "minx": F.array_min(all_points["x"]),
            "miny": F.array_min(all_points["y"]),
            "maxx": F.array_max(all_points["x"]),
            "maxy": F.array_max(all_points["y"]),
        }
    )


def pad_bounds(df: DataFrame, pad: float) -> DataFrame:
    return df.withColumns(
        {
            "minx": F.col("minx") - pad,
            "miny": F.col("miny") - pad,
            "maxx": F.col("maxx") + pad,
            "maxy": F.col("maxy") + pad,
        }
    )


def total_bounds(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """One counter-clockwise closed ring."""
    corners = ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def _twice_ring_area(ring: Column) -> Column:
    # Relative to the first vertex, so large coordinates do not cancel.
    origin = ring[0]
    count = F.size(ring)
    crosses = F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(count - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(count - 1, F.lit(0))),
        lambda p, q: (p["x"] - origin["x"]) * (q["y"] - origin["y"])
        - (q["x"] - origin["x"]) * (p["y"] - origin["y"]),
    )
    return F.aggregate(crosses, F.lit(0.0), lambda total, cross: total + cross)


def _closed(ring: Column) -> Column:
    last = F.element_at(ring, -1)
    return F.when(F.size(ring) < 3, F.slice(ring, 1, 0)).when(
        (ring[0]["x"] == last["x"]) & (ring[0]["y"] == last["y"]), ring
    ).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def closed(geometry: Column) -> Column:
    """Every ring ends where it began; rings of fewer than three points are empty."""
    return F.transform(geometry, lambda polygon: F.transform(polygon, _closed))


def oriented(geometry: Column) -> Column:
    """Close every ring; shells run counter-clockwise, holes clockwise."""

    def orient(ring: Column, position: Column) -> Column:
        closed = _closed(ring)
        counter_clockwise = _twice_ring_area(closed) > 0
        return F.when(counter_clockwise == (position == 0), closed).otherwise(F.reverse(closed))

    return F.transform(geometry, lambda polygon: F.transform(polygon, orient))


def area_m2(oriented_geometry: Column) -> Column:
    """Planar area of an oriented metric geometry; holes count negative."""
    ring_areas = F.transform(F.flatten(oriented_geometry), _twice_ring_area)
    return F.aggregate(ring_areas, F.lit(0.0), lambda total, area: total + area) / 2


def _ring_edges(ring: Column, made) -> Column:
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), count), F.slice(ring, F.lit(2), count), made)


def meets_box(geometry: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a shape and a box have a place in common, borders included.

    They have if an edge, cut at the sides of the box, leaves a rest, or if the box lies inside:
    then an odd number of edges is east of its corner.
    """

    def cut(p: Column, q: Column, axis: str, low: Column, high: Column) -> tuple[Column, Column, Column]:
        way = F.nullif(q[axis] - p[axis], F.lit(0.0))
        one, two = (low - p[axis]) / way, (high - p[axis]) / way
        # Edges along the other axis lie between the sides or are outside.
        return F.least(one, two), F.greatest(one, two), way.isNotNull() | p[axis].between(low, high)

    def touches(p: Column, q: Column) -> Column:
        x, y = cut(p, q, "x", minx, maxx), cut(p, q, "y", miny, maxy)
        enters, leaves = F.greatest(F.lit(0.0), x[0], y[0]), F.least(F.lit(1.0), x[1], y[1])
        return x[2] & y[2] & (enters <= leaves)

    def east(p: Column, q: Column) -> Column:
        at = p["x"] + (q["x"] - p["x"]) * (miny - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        crosses = ((p["y"] > miny) != (q["y"] > miny)) & (minx < at)
        return F.coalesce(crosses, F.lit(False)).cast("int")

    rings = F.flatten(closed(geometry))
    met = F.exists(F.flatten(F.transform(rings, lambda ring: _ring_edges(ring, touches))), lambda x: x)
    crossed = F.flatten(F.transform(rings, lambda ring: _ring_edges(ring, east)))
    inside = F.aggregate(crossed, F.lit(0), lambda total, one: total + one) % 2 == 1
    return F.coalesce(met, F.lit(False)) | F.coalesce(inside, F.lit(False))


def edge_list(closed_geometry: Column) -> Column:
    """Flat [x1, y1, x2, y2, …] of all non-vertical edges, for the area kernel."""

    def ring_edges(ring: Column) -> Column:
        count = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(
            F.slice(ring, F.lit(1), count),
            F.slice(ring, F.lit(2), count),
            lambda p, q: F.array(p["x"], p["y"], q["x"], q["y"]),
        )

    edges = F.flatten(F.transform(F.flatten(closed_geometry), ring_edges))
    return F.flatten(F.filter(edges, lambda edge: edge[0] != edge[2]))
