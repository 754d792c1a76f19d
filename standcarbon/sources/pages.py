"""A folder of stored feature pages as a data source: filters and the cap meet the pages, not the rows.

A layer is fetched page by page and every page kept as a GeoJSON document. Each page is read by one
task, small ones several at a time; a feature that the pushed filters refuse is never handed on.
"""

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import isfinite, isnan
from os.path import abspath
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from standcarbon.functions.geometry import BOUNDS
from standcarbon.operators.ordering import row_numbers
from standcarbon.session import discard_path
from standcarbon.sources.files import parse_geometry

PAGE_FEATURES = 2_000
# Pages that one task reads one after the other.
TASK_BYTES = 64 << 20
_GEOMETRY = "geometry"


class _Number(str):
    """A number as the page has it."""


def _text(value: object) -> str | None:
    """A property as text: strings and numbers as they are, what is nested as JSON."""
    return None if value is None else str(value) if isinstance(value, str) else _json(value)


def _json(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _points(geometry: object) -> Iterator[list]:
    """The points of the polygons of a geometry."""
    waiting = [geometry]
    while waiting:
        shape = waiting.pop()
        if not isinstance(shape, dict):
            continue
        kind = shape.get("type")
        if kind == "GeometryCollection":
            waiting += shape.get("geometries") or []
        elif kind in ("Polygon", "MultiPolygon"):
            rings = shape.get("coordinates") or []
            for polygon in [rings] if kind == "Polygon" else rings:
                for ring in polygon:
                    yield from ring


def _bounds(geometry: object) -> list[float | None]:
    points = [(float(p[0]), float(p[1])) for p in _points(geometry)]
    if not points or not all(isfinite(v) for p in points for v in p):
        return [None] * 4
    xs, ys = zip(*points, strict=True)
    return [min(xs), min(ys), max(xs), max(ys)]


_COMPARED: dict[type, Callable] = {
    D.EqualTo: lambda x, y: x == y,
    D.GreaterThan: lambda x, y: x > y,
    D.GreaterThanOrEqual: lambda x, y: x >= y,
    D.LessThan: lambda x, y: x < y,
    D.LessThanOrEqual: lambda x, y: x <= y,
    D.In: lambda x, y: x in y,
    D.StringStartsWith: lambda x, y: x.startswith(y),
}


@dataclass(frozen=True)
class _Condition:
    """A pushed filter: a column, and how it compares. A missing value meets none."""

    column: str
    kind: type
    value: object = None

    def holds(self, row: dict) -> bool:
        found = row[self.column]
        if found is None:
            return False
        return self.kind is D.IsNotNull or _COMPARED[self.kind](found, self.value)


@dataclass
class _Pages(D.InputPartition):
    """Pages of one task: path, most features that may be taken, and how many it has to have."""

    pages: list[tuple[str, int | None, int | None]]


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    path = uri.removeprefix("file:")
    # A local path may be written with one slash after the scheme, or with three.
    return fs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("/") else abspath(path)


class _Reader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.uri = options["path"]
        self.limit = int(options["limit"]) if "limit" in options else None
        self.size = int(options.get("pagefeatures", PAGE_FEATURES))
        self.conditions: list[_Condition] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            kind, column = type(f), getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            known = (kind in _COMPARED or kind is D.IsNotNull) and len(column) == 1
            # Spark orders NaN after all numbers, Python nowhere.
            odd = any(isinstance(v, float) and isnan(v) for v in (value if kind is D.In else [value]))
            if known and column[0] in self.names and not odd:
                self.conditions.append(_Condition(column[0], kind, value))
            else:
                yield f

    def partitions(self) -> Sequence[D.InputPartition]:
        store, folder = _files(self.uri)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        hidden = lambda path: any(p[:1] in "._" for p in path[len(folder) :].split("/") if p)
        pages = sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path))
        if self.limit is not None:
            pages = pages[: -(-self.limit // self.size)]
        made: list[_Pages] = []
        held = TASK_BYTES
        for i, (path, size) in enumerate(pages):
            if held + size > TASK_BYTES:
                made.append(_Pages([]))
                held = 0
            held += size
            most = exactly = None
            if self.limit is not None:
                most = min(self.size, self.limit - i * self.size)
                exactly = self.size if i + 1 < len(pages) else None
            made[-1].pages.append((path, most, exactly))
        return made or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        store, _ = _files(self.uri)
        for path, most, exactly in partition.pages:
            with store.open_input_stream(path) as stream:
                data = stream.read()
            try:
                page = json.loads(data, parse_float=_Number, parse_int=_Number, parse_constant=_Number)
            except ValueError as error:
                raise ValueError(f"page {path} is broken: {error}") from error
            features = (page or {}).get("features") or []
            if most is not None and len(features) > self.size:
                raise ValueError(f"page {path} has {len(features)} features, over {self.size}")
            if exactly is not None and len(features) < exactly:
                raise ValueError(f"page {path} has {len(features)} features and is not the last")
            rows = [row for f in features[:most] if self._met(row := self._row(f))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[n] for r in rows], pa.float64() if n in BOUNDS else pa.string())
                    for n in self.names
                ],
                names=self.names,
            )

    def _met(self, row: dict) -> bool:
        return all(condition.holds(row) for condition in self.conditions)

    def _row(self, feature: dict) -> dict:
        properties, geometry = feature.get("properties") or {}, feature.get("geometry")
        row = {name: _text(properties.get(name)) for name in self.names}
        row[_GEOMETRY] = None if geometry is None else _json(geometry)
        return row | dict(zip(BOUNDS, _bounds(geometry), strict=True))


@dataclass
class _Written(D.WriterCommitMessage):
    """Pages of one task."""

    pages: int


class _Writer(D.DataSourceArrowWriter):
    """Rows (page, feature), all of a page in one task and next to each other; a file a page.

    A page gets its name when it is whole, so a task that fails or is repeated leaves no torn one.
    """

    def __init__(self, options: dict):
        self.uri = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> D.WriterCommitMessage:
        store, folder = _files(self.uri)
        store.create_dir(folder, recursive=True)
        number, held, count = None, [], 0
        for batch in iterator:
            for page, feature in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if page != number:
                    count += self._put(store, folder, number, held)
                    number, held = page, []
                if feature is not None:
                    held.append(feature)
        return _Written(count + self._put(store, folder, number, held))

    @staticmethod
    def _put(store: fs.FileSystem, folder: str, number: int | None, features: list[str]) -> int:
        if number is None:
            return 0
        torn = f"{folder}/.{uuid4()}"
        with store.open_output_stream(torn) as stream:
            stream.write(('{"type":"FeatureCollection","features":[' + ",".join(features) + "]}").encode())
        store.move(torn, f"{folder}/page-{number:012d}.json")
        return 1

    def commit(self, messages: list[D.WriterCommitMessage | None]) -> None:
        """Pages are in place already."""

    def abort(self, messages: list[D.WriterCommitMessage | None]) -> None:
        """Whole pages stay; the job fails."""


class FeaturePages(D.DataSource):
    """Options: path; to read, properties (a JSON list), and, for a cap, limit and pageFeatures."""

    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> StructType:
        properties = json.loads(self.options["properties"])
        taken = {_GEOMETRY, *BOUNDS}
        if clash := [p for p in properties if p.lower() in taken]:
            raise ValueError(f"properties named like a column of the source: {clash}")
        texts = [StructField(name, StringType()) for name in (*properties, _GEOMETRY)]
        return StructType([*texts, *[StructField(b, DoubleType()) for b in BOUNDS]])

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()})


def read_pages(
    spark: SparkSession,
    path: str,
    properties: Sequence[str],
    limit: int | None = None,
    page_features: int = PAGE_FEATURES,
) -> DataFrame:
    """Features of a folder of pages, one page a file: properties as text, polygons, their bounds.

    Nested properties become compact JSON.

    Comparisons of a property with a text, or of a bound with a number, are pushed to the pages.
    `limit` takes the first features in the order of the files' paths, before any filter, and
    later pages are not opened. It relies on every page but the last having `page_features`, as
    paging gives them, and fails where a page has not. A broken page fails the job, a feature
    without a polygon has no bounds; an empty folder gives no row.
    """
    if limit is not None and limit < 0 or page_features < 1:
        raise ValueError("limit and page_features count features")
    spark.dataSource.register(FeaturePages)
    options = {"properties": json.dumps(list(properties)), "pageFeatures": str(page_features)}
    if limit is not None:
        options["limit"] = str(limit)
    pages = spark.read.format(FeaturePages.name()).options(**options).load(path)
    return pages.withColumn(_GEOMETRY, parse_geometry(F.col(_GEOMETRY)))


def write_pages(
    features: DataFrame, path: str, key: str, feature: str, page_features: int = PAGE_FEATURES
) -> None:
    """GeoJSON pages of `page_features` features each, in the order of a unique `key`.

    `feature` is the column with a feature's JSON. A page is gathered in one task, and holds no more
    than a page may. What is at `path` goes first. Tasks write their pages themselves: a committer
    moves files one after the other, and there is one for each page.
    """
    numbered = row_numbers(features.select(F.col(key).alias("_key"), F.col(feature).alias("_json")), "_key", "_n")
    page = F.floor((F.col("_n") - 1) / page_features).alias("page")
    dealt = numbered.select(page, "_n", "_json").repartition("page").sortWithinPartitions("page", "_n")
    spark = features.sparkSession
    spark.dataSource.register(FeaturePages)
    discard_path(spark, path)
    written = dealt.select("page", F.col("_json").alias("feature"))
    written.write.format(FeaturePages.name()).mode("append").option("path", path).save()
