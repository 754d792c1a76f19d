"""Feature pages, detail documents, CSV export."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from standcarbon import schemas as S
from standcarbon.functions import parsing as P
from standcarbon.operators.elements import latest_details

_NUMBERS = "array<double>"
# Collections inside collections; the format advises against any. Deeper ones are an error.
COLLECTION_DEPTH = 6


def parse_geometry(geometry: Column) -> Column:
    """GeoJSON polygon, multipolygon or collection of them; other shapes have no area.

    A collection nested deeper than COLLECTION_DEPTH fails the job, as its area would be unknown.
    """

    def rings(depth: str, json: Column, field: str = "coordinates") -> Column:
        return F.from_json(json, f"{field} {depth}")[field]

    def typed(polygons: Column) -> Column:
        return F.transform(
            polygons,
            lambda polygon: F.transform(
                polygon,
                lambda ring: F.transform(
                    ring, lambda point: F.struct(point[0].alias("x"), point[1].alias("y"))
                ),
            ),
        )

    def simple(json: Column) -> Column:
        kind = F.get_json_object(json, "$.type")
        return F.when(
            kind == "Polygon", F.array(rings(f"array<array<{_NUMBERS}>>", json))
        ).when(kind == "MultiPolygon", rings(f"array<array<array<{_NUMBERS}>>>", json))

    def opened(members: Column) -> Column:
        """Collections among the members replaced by what they hold."""

        def held(json: Column) -> Column:
            inner = F.from_json(json, "geometries array<string>")["geometries"]
            is_collection = F.get_json_object(json, "$.type") == "GeometryCollection"
            return F.when(is_collection, F.coalesce(inner, F.array().cast("array<string>"))).otherwise(
                F.array(json)
            )

        return F.flatten(F.transform(members, held))

    members = F.array(geometry)
    for _ in range(COLLECTION_DEPTH):
        members = opened(members)
    deeper = F.exists(members, lambda json: F.get_json_object(json, "$.type") == "GeometryCollection")
    message = F.lit(f"geometry collections nested more than {COLLECTION_DEPTH} deep")
    members = F.when(F.coalesce(deeper, F.lit(False)), F.raise_error(message).cast("array<string>")).otherwise(members)
    parts = F.filter(F.transform(members, simple), lambda part: part.isNotNull())
    # Most features are no collections and are parsed once.
    nested = geometry.contains("GeometryCollection")
    return typed(F.when(nested, F.flatten(parts)).otherwise(simple(geometry)))


_BROKEN = "_broken"


def _counted(
    spark: SparkSession, path: str, schema: StructType, lines: bool, seen: Observation, **more: Column
) -> DataFrame:
    """Documents of a folder, `_broken` where one cannot be parsed, counted while they are read."""
    read = spark.read.schema(StructType([*schema.fields, StructField(_BROKEN, StringType())]))
    read = read.option("columnNameOfCorruptRecord", _BROKEN).option("multiLine", not lines)
    counts = {"documents": F.lit(True), "broken": F.col(_BROKEN).isNotNull(), **more}
    return read.json(path).observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()])


def read_features(
    spark: SparkSession,
    path: str,
    properties: Sequence[str] | None = None,
    lines: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """All features of all pages: properties as text columns, geometry as polygons.

    Without `properties` the names in use are looked up first. `lines`: one page per line. `seen`
    gets the numbers of documents and of broken ones when the table is first used; what can be read
    of a broken page stays.
    """
    if seen is None:
        pages = spark.read.schema(S.FEATURE_PAGE).option("multiLine", not lines).json(path)
    else:
        pages = _counted(spark, path, S.FEATURE_PAGE, lines, seen).drop(_BROKEN)
    features = pages.select(F.explode("features").alias("feature")).select("feature.*")
    if properties is None:
        names = features.select(F.explode(F.map_keys("properties")).alias("name")).distinct()
        # Bounded by the layer's schema, not by its rows.
        properties = sorted(row["name"] for row in names.collect())
    return features.select(
        *[F.col("properties")[name].alias(name) for name in properties],
        parse_geometry(F.col("geometry")).alias("geometry"),
    )


def snapshot_features(snapshots: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Features of the pages kept as snapshots: (namespace, key) and as from `read_features`."""
    page = F.from_json("payload", S.FEATURE_PAGE)
    features = snapshots.select(
        "namespace", "key", F.explode(page["features"]).alias("feature")
    ).select("namespace", "key", "feature.*")
    return features.select(
        "namespace",
        "key",
        *[F.col("properties")[name].alias(name) for name in properties],
        parse_geometry(F.col("geometry")).alias("geometry"),
    )


def snapshot_details(snapshots: DataFrame) -> DataFrame:
    """Details of the documents kept as snapshots, as from `read_details`; a broken one gives none."""
    parsed = snapshots.select("cached_at", F.from_json("payload", S.DETAIL_DOCUMENT).alias("d"))
    stored = F.col("cached_at").cast("string").alias("cached_at")
    fields = [f"d.{name}" for name in S.DETAIL_DOCUMENT.names if name != "cached_at"]
    return _details(parsed.select(*fields, stored))


def read_details(
    spark: SparkSession, path: str, lines: bool = False, seen: Observation | None = None
) -> DataFrame:
    """(stand_id, elements, …) per stand; broken documents give no row, the latest one counts.

    `seen` gets the numbers of documents, of broken ones and of others without a stand id when the
    table is first used.
    """
    if seen is not None:
        stand = P.stand_join_id(F.col("_stand_id"))
        nameless = F.col(_BROKEN).isNull() & stand.isNull()
        read = _counted(spark, path, S.DETAIL_DOCUMENT, lines, seen, without_id=nameless)
        return _details(read.filter(F.col(_BROKEN).isNull()).drop(_BROKEN))
    documents = (
        spark.read.schema(S.DETAIL_DOCUMENT)
        .option("multiLine", not lines)
        .option("mode", "DROPMALFORMED")
        .json(path)
    )
    return _details(documents)


def _details(documents: DataFrame) -> DataFrame:
    known = documents.select(
        P.stand_join_id(F.col("_stand_id")).alias("stand_id"),
        F.coalesce("elemendid", F.array().cast("array<string>")).alias("elements"),
        F.col("boniteediKood").alias("site_class"),
        F.col("kasvukohaKood").alias("site_type"),
        P.boolean(F.col("kuivendatud")).alias("drained"),
        F.coalesce(F.col("cached_at").try_cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
        .alias("cached_at"),
    ).filter("stand_id is not null")
    return latest_details(known, "cached_at").drop("cached_at")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)
