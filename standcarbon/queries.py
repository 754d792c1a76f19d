"""The registered queries: each operator over the whole driver tables, next to its SQL twin."""

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standcarbon import fixtures as X
from standcarbon import schemas as S
from standcarbon.functions import geometry as G
from standcarbon.operators import allocate as A
from standcarbon.operators import elements as E
from standcarbon.operators import lookup as J
from standcarbon.operators.overlay import overlay, prepare_geometry
from standcarbon.oracles import (
    DENSITY,
    INVALID_POLYGONS,
    L_SHAPES,
    POLYGONS,
    RESULT_LABELS,
    RESULT_NUMBERS,
    age_sql,
    name_sql,
    rounded,
    sql,
    steady_rounding,
    tco2e_sql,
)
from standcarbon.plans import analysis as N
from standcarbon.plans import reports as R
from standcarbon.session import scratch_path, staged
from standcarbon.sources import files, layers, pages, snapshots, stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to four digits, where sums in another order agree; see `steady_rounding`."""

    def steady(name: str) -> Column:
        value = F.col(name)
        rounded_ = F.floor(value * 10000 + 0.4998765432) / 10000
        # floor() counts in whole numbers; NaN, infinities and numbers with no digits to drop stay.
        return F.when(F.abs(value) < 1e11, rounded_).otherwise(value).alias(name)

    kinds = dict(df.dtypes)
    return df.select(*[steady(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, folder: tidy(function(spark, folder))
        if oracle is not None:
            ORACLES[function.__name__] = steady_rounding(oracle)
        return function

    return register


def run(spark: SparkSession, folder: str) -> N.Analysis:
    return N.Analysis(
        X.notices(spark, folder), X.stands(spark, folder), X.elements(spark, folder), X.as_of()
    )


# --- sources, filters, layers ---


@query(
    sql(
        """select notice_id, source_layer, submitted_date from notices_raw
where submitted_date >= date '1997-01-01' and submitted_date < date '1998-01-01'""",
        "notices_raw",
    )
)
def period_filter(spark, folder):
    raw = layers.filter_period(
        X.notices_raw(spark, folder), date(1997, 1, 1), date(1997, 12, 31)
    )
    return raw.select("notice_id", "source_layer", "submitted_date")


@query(
    sql(
        """select notice_id, source_layer from (select *, row_number() over
(partition by source_layer order by notice_id) as rn from notices_raw) where rn <= 100""",
        "notices_raw",
    )
)
def layer_cap(spark, folder):
    raw = X.notices_raw(spark, folder)
    capped = layers.limit_per_layer(raw, ["archive", "current"], 100, ["notice_id"])
    return capped.select("notice_id", "source_layer")


@query(
    """select namespace, key, cached_at, payload from (select event_type as namespace,
cast(user_id as varchar) as key, ts as cached_at, props as payload, row_number() over
(partition by event_type, user_id order by ts desc, props desc) as rn from events) where rn = 1
and cached_at >= timestamp '2024-01-20 00:00:00'"""
)
def snapshot_freshness(spark, folder):
    stored = X.table(spark, folder, "events").select(
        F.col("event_type").alias("namespace"),
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").alias("cached_at"),
        F.col("props").alias("payload"),
    )
    as_of = F.lit("2024-01-30 00:00:00").cast(stored.schema["cached_at"].dataType)
    return snapshots.fresh_snapshots(stored, as_of, timedelta(days=10))


@query(
    """select namespace, key, cached_at, payload from (select event_type as namespace,
cast(user_id as varchar) as key, ts as cached_at, props as payload, row_number() over
(partition by event_type, user_id order by ts desc, props desc) as rn from events) where rn = 1"""
)
def snapshot_store(spark, folder):
    """A store after a write that is cleared and two that stay."""
    entries = X.table(spark, folder, "events").select(
        F.col("event_type").alias("namespace"),
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").alias("cached_at"),
        F.col("props").alias("payload"),
    )
    path, even = scratch_path(spark, "store"), F.crc32(F.col("payload").cast("binary")) % 2 == 0
    snapshots.replace_snapshots(entries.withColumn("payload", F.lit("gone")), path, 8)
    snapshots.clear_store(spark, path, entries.schema)
    for part in (even, ~even):
        snapshots.replace_snapshots(entries.filter(F.coalesce(part, F.lit(True))), path, 8)
    return snapshots.read_store(spark, path, entries.schema)


def _registry_notices(raw: DataFrame) -> DataFrame:
    """The raw layer under registry names, everything as text."""
    return raw.select(
        F.col("notice_id").alias("teatise_id"),
        F.concat(F.col("submitted_date").cast("string"), F.lit("T23:30:00+03:00")).alias(
            "Esitamise_Kuupaev"
        ),
        F.col("planned_volume_m3").cast("string").alias("raiutav_maht"),
        F.col("harvest_type").alias("raie_liik"),
        F.col("cadastral_ref").alias("katastri_nr"),
        F.concat(F.col("stand_number").cast("string"), F.lit(".0")).alias("eraldise_nr"),
        "source_layer",
        "source_rank",
        *G.BOUNDS,
    )


@query(
    sql(
        f"""select notice_id, submitted_date, harvest_type, cadastral_ref, stand_number,
{rounded("planned_volume_m3")}, source_layer from notices_raw""",
        "notices_raw",
    )
)
def canonical_notices(spark, folder):
    canonical = layers.canonical_notices(_registry_notices(X.notices_raw(spark, folder)))
    return canonical.drop("source_rank", *G.BOUNDS)


_PROFILE = """select {place} as position, '{name}' as column_name, avg(case when
regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9:.]*)?$') and
try_cast(v[:10] as date) is not null then 1e0 else 0e0 end) as parse_rate
from (select cast({name} as varchar) as v from orders where {name} is not null
order by o_orderkey, v limit 20)"""
_ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)


@query(
    " union all ".join(
        f"({_PROFILE.format(place=place, name=name)})" for place, name in enumerate(_ORDER_COLUMNS)
    )
)
def date_profile(spark, folder):
    orders = X.table(spark, folder, "orders").select(*_ORDER_COLUMNS)
    return layers.profile_dates(orders, "o_orderkey")


@query(
    sql(
        f"""select notice_id, source_layer, case when source_layer = 'current' then harvest_type end
as harvest_type, {rounded("planned_volume_m3")} from (select *, row_number() over
(partition by notice_id order by source_rank desc, submitted_date desc) as rn from notices_raw)
where rn = 1""",
        "notices_raw",
    )
)
def union_layers_latest(spark, folder):
    raw = X.notices_raw(spark, folder).drop("source_rank")
    archive = raw.filter("source_layer = 'archive'").drop("harvest_type")
    current = raw.filter("source_layer = 'current'")
    united = layers.union_layers({"archive": archive, "current": current})
    latest = layers.dedupe_latest(united, ["notice_id"], ["source_rank", "submitted_date"])
    return latest.select("notice_id", "source_layer", "harvest_type", "planned_volume_m3")


@query(
    sql(
        f"""select notice_id, source_layer, submitted_date, {rounded("planned_volume_m3")} from (
select *, row_number() over (partition by notice_id order by source_rank desc, submitted_date desc) as rn
from (select *, row_number() over (partition by source_layer order by notice_id) as place
  from (select * replace (case when source_layer = 'current' and cast(notice_id as bigint) % 5 = 0
      then submitted_date + 400 else submitted_date end as submitted_date) from notices_raw)
  where submitted_date >= date '1995-01-01' and submitted_date < date '1998-01-01')
where place <= 5000) where rn = 1""",
        "notices_raw",
    )
)
def load_notices(spark, folder):
    """Period and limit per layer come before the newer copy of a notice wins."""
    raw = X.notices_raw(spark, folder)
    moved = (F.col("source_layer") == "current") & (F.col("notice_id").cast("bigint") % 5 == 0)
    day = F.when(moved, F.date_add("submitted_date", 400)).otherwise(F.col("submitted_date"))
    registry = _registry_notices(raw.withColumn("submitted_date", day))
    parts = {
        name: registry.filter(F.col("source_layer") == name).drop("source_layer", "source_rank")
        for name in ("archive", "current")
    }
    loaded = layers.load_notices(parts, date(1995, 1, 1), date(1997, 12, 31), 5000, "teatise_id")
    return loaded.select("notice_id", "source_layer", "submitted_date", "planned_volume_m3")


def _feature() -> Column:
    """A notice as a GeoJSON feature."""
    ring = F.array(
        F.array("minx", "miny"), F.array("maxx", "miny"), F.array("maxx", "maxy"),
        F.array("minx", "maxy"), F.array("minx", "miny"),
    )
    multi = F.col("source_layer") == "archive"
    shape = F.when(
        multi,
        F.to_json(
            F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
        ),
    ).otherwise(
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    )
    properties = F.to_json(
        F.struct(
            F.col("notice_id").alias("teatis_id"),
            F.col("submitted_date").alias("kuupaev"),
            F.col("planned_volume_m3").alias("raiutav_maht"),
        )
    )
    return F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), shape, F.lit("}")
    )


def _feature_page() -> Column:
    """A notice as a GeoJSON page of one feature."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), _feature(), F.lit("]}"))


@query(
    sql(
        f"""select notice_id, submitted_date, {rounded("planned_volume_m3", "minx", "miny", "maxx",
"maxy")} from notices_raw""",
        "notices_raw",
    )
)
def read_features(spark, folder):
    """Written as GeoJSON pages, one feature each, and read back."""
    raw = X.notices_raw(spark, folder)
    path = scratch_path(spark, "features")
    raw.select(_feature_page().alias("value")).write.mode("overwrite").text(path)
    features = files.read_features(
        spark, path, ["teatis_id", "kuupaev", "raiutav_maht"], lines=True
    )
    return layers.canonical_notices(features).select(
        "notice_id", "submitted_date", "planned_volume_m3", *G.BOUNDS
    )


_PAGED = ("teatis_id", "kuupaev", "raiutav_maht")
_PAGED_CAP = 1_250


def _paged(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Both layers as pages of 200 features, in the order of layer and id, read back as a source."""
    raw = X.notices_raw(spark, folder)
    path = scratch_path(spark, "pages")
    key = F.concat_ws("/", "source_layer", "notice_id").alias("key")
    pages.write_pages(raw.select(key, _feature().alias("feature")), path, "key", "feature", 200)
    return pages.read_pages(spark, path, _PAGED, limit, 200)


@query(
    sql(
        f"""select notice_id, submitted_date, {rounded("planned_volume_m3", "minx", "miny", "maxx",
"maxy")} from notices_raw where submitted_date >= date '1995-01-01' and submitted_date < date
'1997-07-01' and minx <= 8000 and maxy >= 1000""",
        "notices_raw",
    )
)
def paged_features(spark, folder):
    """Period and box are filters of the page source, so other features never leave the pages."""
    features = _paged(spark, folder).filter(
        "kuupaev >= '1995-01-01' and kuupaev < '1997-07-01' and minx <= 8000.0 and maxy >= 1000.0"
    )
    return layers.canonical_notices(features.drop(*G.BOUNDS)).select(
        "notice_id", "submitted_date", "planned_volume_m3", *G.BOUNDS
    )


@query(
    sql(
        f"""select notice_id, {rounded("minx", "miny", "maxx", "maxy")} from (select *, row_number()
over (order by source_layer, notice_id) as rn from notices_raw) where rn <= {_PAGED_CAP}""",
        "notices_raw",
    )
)
def paged_cap(spark, folder):
    """The first features of a layer: only the pages that hold them are opened."""
    return _paged(spark, folder, _PAGED_CAP).select(F.col("teatis_id").alias("notice_id"), *G.BOUNDS)


@query(
    sql(
        """select source_layer, count(*) as n_features, count(*) + case source_layer when 'archive'
then count(*) filter (where cast(notice_id as bigint) % 5 = 0) else 0 end as n_pages, case source_layer
when 'archive' then count(*) filter (where cast(notice_id as bigint) % 5 = 0) else 0 end as n_broken
from notices_raw group by source_layer""",
        "notices_raw",
    )
)
def guarded_layers(spark, folder):
    """Two layers load, one with broken pages that are counted; a third one fails while read."""
    raw = X.notices_raw(spark, folder)
    readers = {}
    for name in ("archive", "current", "closed"):
        page = _feature_page()
        if name == "closed":
            deep = '"geometry":' + '{"type":"GeometryCollection","geometries":[' * 9
            page = F.replace(page, F.lit('"geometry":{'), F.lit(deep + "{"))
            page = F.replace(page, F.lit("}}]}"), F.lit("}" + "]}" * 9 + "}]}"))
        rows = raw.filter(F.col("source_layer") == ("current" if name == "closed" else name))
        torn = F.when((F.col("notice_id") % 5 == 0) & (F.lit(name) == "archive"), F.substr(page, F.lit(1), F.lit(30)))
        path = scratch_path(spark, name)
        rows.select(F.explode(F.array_compact(F.array(page, torn))).alias("value")).write.text(path)
        readers[name] = lambda seen, path=path: files.read_features(
            spark, path, ["teatis_id"], lines=True, seen=seen
        )
    loaded, counts = layers.load_layers(readers)
    # One row per layer.
    kept = [(name, c["documents"], c["broken"]) for name, c in counts.items()]
    report = spark.createDataFrame(kept, "source_layer string, n_pages long, n_broken long")
    rows = layers.union_layers(loaded).groupBy("source_layer").agg(F.count(F.lit(1)).alias("n_features"))
    return rows.join(F.broadcast(report), "source_layer", "left")


@query(
    sql(
        f"""select notice_id, {rounded("planned_volume_m3", "minx", "miny", "maxx", "maxy")} from (
select *, row_number() over (partition by notice_id order by source_rank desc) as rn from notices_raw)
where rn = 1""",
        "notices_raw",
    )
)
def snapshot_notices(spark, folder):
    """Pages kept as snapshots, two of some notices: the fresh and latest one is parsed."""
    kept_at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("source_rank") * 3600)
    stored = X.notices_raw(spark, folder).select(
        F.lit("wfs").alias("namespace"),
        F.col("notice_id").alias("key"),
        kept_at.alias("cached_at"),
        _feature_page().alias("payload"),
    )
    as_of = F.timestamp_seconds(F.lit(1_700_000_000 + 86_400))
    fresh = snapshots.fresh_snapshots(stored, as_of, snapshots.LAYER_MAX_AGE)
    features = files.snapshot_features(fresh, ["teatis_id", "kuupaev", "raiutav_maht"])
    canonical = layers.canonical_notices(features.drop("namespace", "key"))
    return canonical.select("notice_id", "planned_volume_m3", *G.BOUNDS)


@query(
    """select cast(p_partkey as varchar) as stand_id, 2 as n_elements,
concat('{"puuliigiKood":"KS","tagavara":', p_size, '}') as first_element from part"""
)
def read_details(spark, folder):
    """Two documents per stand; the later one counts, a broken line and a missing id do not."""
    parts = X.table(spark, folder, "part")
    versions = F.explode(F.array(F.lit(1), F.lit(2)))
    element = F.concat(
        F.lit('{"puuliigiKood":"KS","tagavara":'),
        F.when(F.col("version") == 2, F.col("p_size")).otherwise(-1),
        F.lit("}"),
    )
    document = F.concat(
        F.lit('{"_stand_id":"'),
        F.col("p_partkey"),
        F.when(F.col("version") == 2, ".0").otherwise(""),
        F.lit('","cached_at":"2026-08-0'),
        F.col("version"),
        F.lit('T00:00:00Z","elemendid":['),
        element,
        F.lit(',"x"]}'),
    )
    broken = F.when(F.col("version") == 1, F.lit('{"_stand_id": "'))
    lines = parts.select("*", versions.alias("version")).select(
        F.explode(F.array_compact(F.array(document, broken))).alias("value")
    )
    path = scratch_path(spark, "details")
    lines.write.mode("overwrite").text(path)
    read = files.read_details(spark, path, lines=True)
    return read.select(
        "stand_id",
        F.size("elements").alias("n_elements"),
        F.col("elements")[0].alias("first_element"),
    )


# --- stand lookup and overlay ---


@query(sql("select stand_id from matched_stands", "matched_stands"))
def exact_stand_semi(spark, folder):
    return J.exact_stands(X.stands(spark, folder), X.notices(spark, folder)).select("stand_id")


@query(sql("select notice_id from unmatched", "unmatched"))
def unmatched_notice_anti(spark, folder):
    notices = X.notices(spark, folder)
    exact = J.exact_stands(X.stands(spark, folder), notices)
    return J.unmatched_notices(notices, exact).select("notice_id")


@query(sql("select notice_id, stand_id from near", "near"))
def bbox_fallback(spark, folder):
    notices, stands = X.notices(spark, folder), X.stands(spark, folder)
    unmatched = J.unmatched_notices(notices, J.exact_stands(stands, notices))
    return J.bbox_stands(unmatched, stands, X.BBOX_PAD, geographic=False)


@query(sql("select notice_id, stand_id from near", "near", changed=L_SHAPES))
def bbox_fallback_shapes(spark, folder):
    """Stands of which only the box, but not the shape, meets the notice's are left out."""
    notices, stands = X.notices(spark, folder), X.stands(spark, folder)
    unmatched = J.unmatched_notices(notices, J.exact_stands(stands, notices))
    shapes = X.stand_corner_polygons(stands.select("stand_id", *G.BOUNDS))
    return J.bbox_stands(unmatched, shapes, X.BBOX_PAD, geographic=False)


@query(sql("select notice_id, stand_id from near", "near"))
def bbox_fallback_store(spark, folder):
    """From a layer store, of which only files near an unmatched notice are opened."""
    notices, stands = X.notices(spark, folder), X.stands(spark, folder)
    unmatched = J.unmatched_notices(notices, J.exact_stands(stands, notices))
    path = scratch_path(spark, "layer")
    stores.write_layer(stands.select("stand_id", *G.BOUNDS), path, "stand_id", file_rows=2000)
    unmatched = staged(unmatched.select("notice_id", *G.BOUNDS))
    near = stores.read_near(spark, path, unmatched, "notice_id", X.BBOX_PAD)
    return J.bbox_stands(unmatched, near, X.BBOX_PAD, geographic=False)


@query(
    sql(
        f"""select stand_id, {", ".join(map(rounded, G.BOUNDS))} from stands, (select min(minx) as x,
min(miny) as y, max(maxy) as top from notices) where minx <= x + 20000 and maxx >= x
and miny <= y + (top - y) / 4 and maxy >= y""",
        "stands",
        "notices",
    )
)
def layer_region(spark, folder):
    """The stands of the south-western quarter, from a layer store."""
    ends = G.total_bounds(X.notices(spark, folder)).first()
    region = (ends.minx, ends.miny, ends.minx + 20000, ends.miny + (ends.maxy - ends.miny) / 4)
    path = scratch_path(spark, "layer")
    stands = X.stands(spark, folder).select("stand_id", *G.BOUNDS)
    stores.write_layer(stands, path, "stand_id", file_rows=2000)
    return stores.read_region(spark, path, region)


@query(
    sql(
        """select stand_id, min(frame_rank) as frame_rank from (select stand_id, 0 as frame_rank
from matched_stands union all select stand_id, 1 from near) group by stand_id""",
        "matched_stands",
        "near",
    )
)
def stands_for_notices(spark, folder):
    notices, stands = X.notices(spark, folder), X.stands(spark, folder)
    needed = J.stands_for_notices(notices, stands, X.BBOX_PAD, geographic=False)
    return needed.select("stand_id", "frame_rank")


@query(sql(f"select notice_id, stand_id, {rounded('overlap_ha')} from overlap_rows", "overlap_rows"))
def overlay_overlap(spark, folder):
    return overlay(X.notices(spark, folder), X.stands(spark, folder))


@query(
    sql(
        f"select notice_id, stand_id, {rounded('overlap_ha')} from overlap_rows",
        "overlap_rows",
        changed=POLYGONS,
    )
)
def overlay_polygons(spark, folder):
    notices = X.notice_polygons(X.notices(spark, folder).select("notice_id", *G.BOUNDS))
    stands = X.stand_polygons(X.stands(spark, folder).select("stand_id", *G.BOUNDS))
    return overlay(prepare_geometry(notices, False), prepare_geometry(stands, False))


@query(
    sql(
        f"select notice_id, stand_id, {rounded('overlap_ha')} from overlap_rows",
        "overlap_rows",
        changed=INVALID_POLYGONS,
    )
)
def overlay_invalid_polygons(spark, folder):
    """Shapes with a hole across the shell, and of parts that overlap."""
    notices = X.notice_invalid_polygons(X.notices(spark, folder).select("notice_id", *G.BOUNDS))
    stands = X.stand_invalid_polygons(X.stands(spark, folder).select("stand_id", *G.BOUNDS))
    return overlay(prepare_geometry(notices, False), prepare_geometry(stands, False))


@query(
    sql(
        """select 'notice' as kind, notice_id as id, round((maxx - minx) * (maxy - miny) * 0.75 / 10000, 4)
as area_ha from notices union all select 'stand', stand_id,
round((maxx - minx) * (maxy - miny) * 0.8125 / 10000, 4) from stands""",
        "notices",
        "stands",
    )
)
def polygon_area(spark, folder):
    """Area of shapes with a hole and of shapes of two parts."""
    notices = X.notice_polygons(X.notices(spark, folder).select("notice_id", *G.BOUNDS))
    stands = X.stand_polygons(X.stands(spark, folder).select("stand_id", *G.BOUNDS))
    sides = [
        prepare_geometry(df, False).select(
            F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), "area_ha"
        )
        for kind, df in (("notice", notices), ("stand", stands))
    ]
    return sides[0].unionByName(sides[1])


@query(
    sql(
        """select notice_id, round(500000 + rho * sin(theta), 2) as east,
round(6375000 + rho0 - rho * cos(theta), 2) as north from (
select notice_id, n * (radians(lon) - radians(24)) as theta, n,
  6378137 * f * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat)))
    / (1 + e * sin(radians(lat))), e / 2), n) as rho, 6378137 * f * pow(t0, n) as rho0
from (select *, m1 / (n * pow(t1, n)) as f from (
select *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) as n from (
select *, cos(p1) / sqrt(1 - e * e * sin(p1) * sin(p1)) as m1,
  cos(p2) / sqrt(1 - e * e * sin(p2) * sin(p2)) as m2,
  tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) as t1,
  tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) as t2,
  tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) as t0
from (select notice_id, 22 + (o % 6000) / 1000 as lon, 57.5 + (o % 2000) / 1000 as lat,
  sqrt(2 / 298.257222101 - pow(1 / 298.257222101, 2)) as e, radians(59 + 20 / 60) as p1,
  radians(58) as p2, radians(57 + 31 / 60 + 3.19415 / 3600) as p0
  from (select notice_id, cast(notice_id as bigint) as o from notices))))))""",
        "notices",
    )
)
def project_points(spark, folder):
    o = F.col("notice_id").cast("bigint")
    corner = F.struct(
        (F.lit(22.0) + o % 6000 / 1000).alias("x"), (F.lit(57.5) + o % 2000 / 1000).alias("y")
    )
    placed = X.notices(spark, folder).select(
        "notice_id", G.to_metric(F.array(F.array(F.array(corner)))).alias("g")
    )
    point = F.col("g")[0][0][0]
    return placed.select(
        "notice_id", F.round(point["x"], 2).alias("east"), F.round(point["y"], 2).alias("north")
    )


@query(
    sql(
        """select notice_id, round(22 + (o % 6000) / 1000, 6) as lon, round(57.5 + (o % 2000) / 1000, 6) as lat
from (select notice_id, cast(notice_id as bigint) as o from notices)""",
        "notices",
    )
)
def unproject_points(spark, folder):
    """There and back: the grid's points as longitude and latitude again."""
    o = F.col("notice_id").cast("bigint")
    corner = F.struct(
        (F.lit(22.0) + o % 6000 / 1000).alias("x"), (F.lit(57.5) + o % 2000 / 1000).alias("y")
    )
    metric = G.to_metric(F.array(F.array(F.array(corner))))
    back = G.to_geographic(F.col("metric"))[0][0][0]
    points = X.notices(spark, folder).select("notice_id", metric.alias("metric"))
    return points.select("notice_id", F.round(back["x"], 6).alias("lon"), F.round(back["y"], 6).alias("lat"))


@query(
    sql(
        "select min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy "
        "from notices",
        "notices",
    )
)
def total_bounds(spark, folder):
    return G.total_bounds(X.notices(spark, folder))


# --- elements and stands ---


@query(
    sql(
        """select stand_id, record_id from elements e
where exists (select 1 from overlap_rows o where o.stand_id = e.stand_id)""",
        "elements",
        "overlap_rows",
    )
)
def detail_pruning(spark, folder):
    a = run(spark, folder)
    pruned = E.prune_details(a.elements, a.overlaps.rows)
    return pruned.select("stand_id", "record_id")


@query(
    sql(
        """select stand_id, record_id from elements e
where exists (select 1 from overlap_rows o where o.stand_id = e.stand_id)""",
        "elements",
        "overlap_rows",
    )
)
def detail_store(spark, folder):
    """Details read from a store, of which only the parts with overlapping stands are opened."""
    a = run(spark, folder)
    path = scratch_path(spark, "details")
    records = a.elements.select("stand_id", "record_id")
    stores.write_details(records, path, 64)
    return stores.details_of(spark, path, records.schema, a.overlaps.rows, 64)


@query(
    """select cast(p as varchar) as stand_id, 0 as pos, cast(o * 10 + n as varchar) as record_id,
'Y' as stratum_code, 'MA' as species_code, 'Mänd' as species, round(l_quantity, 4) as share_pct,
round(l_quantity * 2, 4) as stock_m3_ha, case when n <> 1 then 45e0 end as inventory_age,
cast(null as double) as current_age
from (select *, l_partkey as p, l_orderkey as o, l_linenumber as n from lineitem)
union all select cast(l_partkey as varchar), 1, concat(l_partkey, ':1'), null, 'QQ', 'Muu (QQ)',
null, round(l_tax * 100, 4), null, 50e0 from lineitem where l_discount <= 0.05
union all select cast(l_partkey as varchar), 2, case l_linenumber when 1 then '0' when 2 then 'abc'
else 'unknown:2' end, null, null, 'Muu', 12.5e0, null, null, null from lineitem"""
)
def normalize_elements(spark, folder):
    """Every line item as a detail document of three objects and a stray entry."""
    n, quantity = F.col("l_linenumber"), F.col("l_quantity")
    rejected = F.col("l_discount") > 0.05
    first = F.struct(
        (F.col("l_orderkey") * 10 + n).cast("double").alias("id"),
        F.col("l_partkey").alias("eraldisId"),
        F.lit(" y ").alias("rindeKood"),
        F.lit("\tma ").alias("puuliigiKood"),
        quantity.cast("string").alias("osakaal"),
        (quantity * 2).alias("tagavara"),
        F.when(n == 1, "nan").otherwise("45").alias("vanus"),
        F.lit(True).alias("jooksevVanus"),
    )
    second = F.struct(
        F.col("l_partkey").alias("eraldisId"),
        F.lit("qq").alias("puuliigiKood"),
        F.when(rejected, -1.0).otherwise(F.col("l_tax") * 100).alias("tagavara"),
        F.lit("5e1").alias("jooksevVanus"),
        F.lit("1d").alias("vanus"),
    )
    third = F.struct(
        F.when(n == 1, "0").when(n == 2, " abc ").alias("id"),
        F.lit(" ").alias("puuliigiKood"),
        F.lit("+12.5").alias("osakaal"),
        F.lit("inf").alias("tagavara"),
    )
    details = X.table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("stand_id"),
        F.array(
            F.to_json(first), F.lit('"stray {"'), F.to_json(second), F.to_json(third)
        ).alias("elements"),
    )
    return E.normalize_elements(details).drop("raw_json")


@query(
    f"""select *, round(coalesce(stock_layer_1, 0) + coalesce(stock_layer_2, 0)
+ coalesce(stock_young, 0), 4) as stock_m3_ha
from (select cast(p as varchar) as stand_id, concat('K', p % 50) as cadastral_ref,
p // 50 as stand_number, case when p % 11 <> 0 then d end as inventory_date,
case when p % 11 <> 0 then round({age_sql("d")}, 4) end as inventory_age_years,
round(p_retailprice / 1000, 4) as area_ha, case when p % 5 <> 0 then p_size * 1.5e0 end
as stock_layer_1, case when p % 3 <> 0 then p_size * 1e0 end as stock_layer_2,
p % 7 * 1e0 as stock_young, p_size / 10 as current_increment_m3_ha_y,
case when p_type <> 'SMALL' then p_type end as site_class,
case p % 4 when 0 then true when 1 then false when 2 then true end as drained
from (select *, p_partkey as p, date '2008-01-01' + cast(p_partkey * 37 % 6500 as int) as d
from part))"""
)
def build_stands(spark, folder):
    """Parts as registry rows: all text, with blanks, signs, zones and junk."""
    p = F.col("p_partkey")
    day = F.date_add(F.lit("2008-01-01").cast("date"), (p * 37 % 6500).cast("int"))
    raw = X.table(spark, folder, "part").select(
        F.concat(p, F.lit(".0")).alias("id"),
        F.concat(F.lit("  K"), p % 50, F.lit("\t")).alias("katastri_nr"),
        F.floor(p / 50).cast("string").alias("eraldise_nr"),
        F.when(p % 11 == 0, "2008-02-30")
        .when(p % 3 == 0, F.concat(day, F.lit("Z")))
        .when(p % 3 == 1, F.concat(day, F.lit("T23:59:59.5+03:00")))
        .otherwise(F.date_format(day, "yyyyMMdd"))
        .alias("invent_kp"),
        (F.col("p_retailprice") / 1000).cast("string").alias("pindala"),
        F.when(p % 5 == 0, "nan").otherwise(F.col("p_size") * 1.5).alias("tagavara_1_ha"),
        F.when(p % 3 == 0, "-2").otherwise(F.concat(F.lit("+"), "p_size")).alias("tagavara_2_ha"),
        (p % 7).cast("string").alias("tagavara_y_ha"),
        (F.col("p_size") / 10).cast("string").alias("juurdekasv"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).otherwise(" ").alias("boniteedi_kood"),
        F.when(p % 4 == 0, "TRUE").when(p % 4 == 1, "f").when(p % 4 == 2, "1.0").otherwise(
            "perhaps"
        ).alias("kuivendatud"),
    )
    built = E.build_stands(raw, X.as_of())
    return built.select(
        "stand_id", "cadastral_ref", "stand_number", "inventory_date", "inventory_age_years",
        "area_ha", "stock_layer_1", "stock_layer_2", "stock_young", "stock_m3_ha",
        "current_increment_m3_ha_y", "site_class", "drained",
    )


_SUMMARY = f"""select stand_id, count(*) as n_species_rows,
round(coalesce(sum(stock_m3_ha), 0), 4) as volume_m3_ha,
case when sum(stock_m3_ha) > 0 then round(sum({tco2e_sql("stock_m3_ha")})
  / (1.3 * 0.5 * 44.0 / 12.0) / sum(stock_m3_ha), 4) else 0.42 end as weighted_density,
case when sum(stock_m3_ha) > 0 then round(sum(stock_m3_ha * coalesce(inventory_age, 0))
  / sum(stock_m3_ha), 4) end as weighted_age, max(name) as main_species
from (select *, first_value({name_sql()}) over (partition by stand_id
    order by stock_m3_ha desc nulls last, case when stock_m3_ha is null then share_pct end
    desc nulls last, pos rows between unbounded preceding and unbounded following) as name
  from elements where stock_m3_ha >= 0 or (stock_m3_ha is null and share_pct > 0))
group by stand_id"""


@query(sql(_SUMMARY, "elements"))
def stand_detail_summary(spark, folder):
    return E.stand_detail_summary(X.elements(spark, folder))


@query(
    sql(
        f"""select stand_id, record_id, species_code, round({DENSITY}, 4) as wood_density
from elements where stock_m3_ha >= 0 or (stock_m3_ha is null and share_pct > 0)""",
        "elements",
    )
)
def detail_species_rows(spark, folder):
    """The rows a detail summary rests on."""
    rows = E.usable_species(X.elements(spark, folder))
    return rows.select("stand_id", "record_id", "species_code", "wood_density")


# --- allocation ---


@query(
    sql(
        "select stand_id, detail_complete, allocatable as stock_allocatable, standing_basis, "
        "harvest_rule from rules",
        "rules",
    )
)
def detail_complete(spark, folder):
    return (
        run(spark, folder)
        .allocation.groupBy("stand_id", "standing_basis", "harvest_rule")
        .agg(
            F.bool_and("detail_complete").alias("detail_complete"),
            F.bool_and("stock_allocatable").alias("stock_allocatable"),
        )
    )


@query(
    sql(
        f"""select stand_id, record_id, stratum_code, species_code, {rounded("inventory_age",
"current_age")}, round(volume, 4) as volume_m3_per_ha from inventory_rows""",
        "inventory_rows",
    )
)
def inventory_allocation(spark, folder):
    a = run(spark, folder)
    return A.inventory_records(a.elements, a.allocation)


@query(
    sql(
        f"""select stand_id, record_id, stratum_code, species_code, {rounded("inventory_age",
"current_age")}, round(weight * 1000, 4) as volume_m3 from detail_rows""",
        "detail_rows",
    )
)
def detail_strata_allocation(spark, folder):
    """1000 m3 over the records of every complete detail."""
    a = run(spark, folder)
    rows = A.detail_records(a.elements, a.allocation)
    return rows.withColumn("volume_m3", F.col("weight") * 1000).drop("weight")


@query(
    sql(
        """select p.notice_id, p.stand_id, p.standing_basis, round(s.volume * p.overlap_ha, 4) as standing_volume_m3,
p.standing_basis <> 'andmed puuduvad' as is_complete
from parts p left join (select stand_id, sum(volume) as volume from standing_rows
group by stand_id) s on s.stand_id = p.stand_id""",
        "parts",
        "standing_rows",
    )
)
def standing_volume(spark, folder):
    a = run(spark, folder)
    return a.given(a.overlaps.with_stands(a.stand_rates())).select(
        "notice_id",
        "stand_id",
        "standing_basis",
        (F.col("standing_m3_per_ha") * F.col("overlap_ha")).alias("standing_volume_m3"),
        (F.col("standing_basis") != S.UNKNOWN).alias("is_complete"),
    )


@query(
    sql(
        """select p.notice_id, p.stand_id, p.planned_basis as basis, p.planned_complete
as is_complete, round(p.planned_part, 4) as planned_volume_m3, round(case when p.planned_part = 0
then 0 else p.planned_part * h.weight end, 4) as allocated_m3
from parts p left join (select stand_id, sum(weight) as weight from harvest_rows group by stand_id)
h on h.stand_id = p.stand_id""",
        "parts",
        "harvest_rows",
    )
)
def planned_harvest_volume(spark, folder):
    a = run(spark, folder)
    weights = a.species_rates.groupBy("stand_id", "harvest_rule").agg(
        F.sum("harvest_weight").alias("_weight")
    )
    part = F.col("planned_part_m3")
    rows = a.given(a.overlaps.with_stands(weights, a.overlaps.with_planned_part(a.notices)))
    complete = part.isNotNull() & ((part == 0) | (F.col("harvest_rule") != "none"))
    return rows.select(
        "notice_id",
        "stand_id",
        F.when(part.isNull(), S.UNKNOWN).otherwise(S.HARVEST_VOLUME).alias("basis"),
        complete.alias("is_complete"),
        part.alias("planned_volume_m3"),
        F.when(part == 0, F.lit(0.0)).otherwise(part * F.col("_weight")).alias("allocated_m3"),
    )


def _part_volumes(spark, folder, name: str) -> DataFrame:
    """A volume per part; zero for every 29th, unusable for every 23rd."""
    p = F.col("p_partkey")
    volume = F.when(p % 23 == 0, -1.0).when(p % 29 == 0, 0.0).otherwise(F.col("p_retailprice"))
    return X.table(spark, folder, "part").select(
        p.cast("string").alias("stand_id"), volume.alias(name)
    )


_PART_VOLUMES = """(select cast(p_partkey as varchar) as stand_id, case when p_partkey % 23 = 0
then -1e0 when p_partkey % 29 = 0 then 0e0 else p_retailprice end as volume from part)"""


@query(
    sql(
        f"""select l.stand_id, l.record_id, l.stratum_code, l.species_code,
{rounded("inventory_age", "current_age")}, round(v.volume * case
when s.by_share then l.share_pct / s.share when t.bad = 0 and t.share > 0
then t.stock / s.stock * l.share_pct / t.share else l.stock_m3_ha / s.stock end, 4) as volume_m3
from living l join {_PART_VOLUMES} v on v.stand_id = l.stand_id and v.volume > 0
join (select stand_id, sum(stock) as stock, sum(share) as share, sum(n) = sum(n_stock)
    and sum(stock) > 0 as stocked,
    count(distinct stratum_code) <= 1 and sum(bad) = 0 and sum(share) > 0 as by_share
  from strata group by stand_id) s on s.stand_id = l.stand_id and (s.by_share or s.stocked)
join strata t on t.stand_id = l.stand_id and t.stratum_code is not distinct from l.stratum_code
where case when s.by_share or (t.bad = 0 and t.share > 0) then l.share_pct > 0
  and (s.by_share or t.stock > 0) else l.stock_m3_ha > 0 end
union all select stand_id, null, null, null, null, null, 0 from {_PART_VOLUMES} where volume = 0""",
        "living",
        "strata",
    )
)
def planned_from_species(spark, folder):
    elements = X.elements(spark, folder)
    volumes = _part_volumes(spark, folder, "volume_m3")
    return A.planned_records(elements, volumes)


@query(
    sql(
        f"""select stand_id, record_id, species_code, round(volume_m3, 4) as volume_m3,
round({tco2e_sql("volume_m3")}, 4) as carbon_co2e_t
from (select e.*, v.volume * e.share_pct / sum(e.share_pct) over (partition by e.stand_id)
as volume_m3 from elements e join {_PART_VOLUMES} v on v.stand_id = e.stand_id and v.volume > 0
where e.share_pct > 0)""",
        "elements",
    )
)
def allocate_by_share(spark, folder):
    elements = X.elements(spark, folder)
    volumes = _part_volumes(spark, folder, "total_volume_m3")
    rows = A.allocate_by_share(elements, volumes)
    return rows.select("stand_id", "record_id", "species_code", "volume_m3", "carbon_co2e_t")


@query(
    sql(
        f"""select notice_id, stand_id, record_id, species_code, round(volume, 4) as volume_m3,
round({tco2e_sql("volume")}, 4) as carbon_co2e_t
from (select p.notice_id, e.stand_id, e.record_id, e.species_code, p.planned_part * e.share_pct
    / sum(e.share_pct) over (partition by p.notice_id, e.stand_id) as volume
  from parts p join elements e on e.stand_id = p.stand_id
  where p.planned_part > 0 and e.share_pct > 0)""",
        "parts",
        "elements",
    )
)
def prorate_notice_volume(spark, folder):
    """Planned volume by overlap and share, per species record."""
    a = run(spark, folder)
    return a.given(A.prorate_by_share(a.elements, a.overlaps.with_planned_part(a.notices)))


@query(
    sql(
        f"""select stand_id, round(sum({tco2e_sql("volume")}), 4) as tco2e from standing_rows
group by stand_id""",
        "standing_rows",
    )
)
def carbon_totals(spark, folder):
    """tCO2e per hectare of every stand with a known standing volume."""
    a = run(spark, folder)
    standing = a.records().filter("standing_m3_per_ha is not null")
    return A.carbon_totals(standing, ["stand_id"], "standing_m3_per_ha")


# --- analysis ---


@query(
    sql(
        """select notice_id, stand_id, source_record_id, stratum_code, estimate_scope,
species_code, species, round(overlap_ha, 4) as overlap_ha, round(volume_m3, 4) as volume_m3,
round(biomass_tco2, 4) as biomass_tco2, round(age, 4) as age, round(current_age, 4) as current_age,
site_class, site_type, drained from breakdown""",
        "breakdown",
    )
)
def species_breakdown(spark, folder):
    # Notices are shuffled and staged with no more than the report reads of them.
    read = X.notices(spark, folder).select("notice_id", *G.BOUNDS, "planned_volume_m3")
    job = N.Analysis(read, X.stands(spark, folder), X.elements(spark, folder), X.as_of())
    return job.species_breakdown()


@query(
    sql(
        f"""select notice_id, stand_id, {rounded("overlap_ha")}, round(standing, 4)
as standing_live_biomass_tco2, round(planned, 4) as planned_harvest_biomass_tco2,
standing_basis as standing_volume_basis, planned_basis as planned_harvest_volume_basis,
standing_complete as standing_biomass_is_complete,
planned_complete as planned_harvest_biomass_is_complete, round(age_num, 4) as weighted_age_num,
round(age_den, 4) as weighted_age_den, round(current_num, 4) as weighted_current_age_num,
round(current_den, 4) as weighted_current_age_den from crossings""",
        "crossings",
    )
)
def intersections(spark, folder):
    a = run(spark, folder)
    return a.given(a.intersections())


@query(
    sql(
        f"""select notice_id, {rounded("standing_live_biomass_tco2",
"planned_harvest_biomass_tco2", "covered_by_inventory_ha", "mean_age", "mean_current_age_years")},
round(age_num, 4) as weighted_age_num, round(age_den, 4) as weighted_age_den,
standing_volume_basis, planned_harvest_volume_basis, standing_biomass_is_complete,
planned_harvest_biomass_is_complete from combined""",
        "combined",
    )
)
def aggregate_intersections(spark, folder):
    a = run(spark, folder)
    return a.given(N.aggregate_intersections(a.intersections(), own_labels=True))


@query(
    sql(
        f"select notice_id, {rounded('mean_age', 'mean_current_age_years')} from combined",
        "combined",
    )
)
def weighted_ages(spark, folder):
    a = run(spark, folder)
    return a.given(N.weighted_ages(a.intersections()))


@query(
    sql(
        "select notice_id, round(sum(overlap_ha), 4) as total_overlap_ha from overlap_rows "
        "group by notice_id",
        "overlap_rows",
    )
)
def overlap_totals(spark, folder):
    a = run(spark, folder)
    return a.given(a.overlaps.totals())


@query(
    sql(
        f"""select notice_id, inventory_date, {rounded("inventory_age_years")},
case when inventory_age_years is null then 'teadmata' when inventory_age_years < 3 then 'väga hea'
when inventory_age_years < 6 then 'hea' when inventory_age_years < 9 then 'vananev' else 'nõrk' end
as inventory_recency from inventory""",
        "inventory",
    )
)
def oldest_inventory(spark, folder):
    a = run(spark, folder)
    rows = a.overlaps.with_stands(a.stands.select("stand_id", "inventory_date"))
    return a.given(N.oldest_inventory(rows, a.as_of))


_INCREMENT = (
    "current_increment_m3_ha_y",
    "current_increment_on_overlap_m3_y",
    "current_increment_covered_area_ha",
    "current_increment_coverage_pct",
)


@query(
    sql(
        f"""select notice_id, {rounded(*_INCREMENT)}, current_increment_is_complete
from increment""",
        "increment",
    )
)
def increment_aggregate(spark, folder):
    a = run(spark, folder)
    rates = a.stands.select("stand_id", "current_increment_m3_ha_y")
    return a.given(N.aggregate_increment(a.overlaps.with_stands(rates)))


@query(
    sql(
        """select o.notice_id, d.dominant_species from (select distinct notice_id from overlap_rows) o
left join dominant d on d.notice_id = o.notice_id""",
        "overlap_rows",
        "dominant",
    )
)
def dominant_species(spark, folder):
    a = run(spark, folder)
    return a.given(a.dominant_species())


_RESULT_LIST = ", ".join(RESULT_LABELS) + ", " + rounded(*RESULT_NUMBERS)


@query(sql(f"select {_RESULT_LIST} from results", "results"))
def notice_results(spark, folder):
    return run(spark, folder).results().select(*RESULT_LABELS, *RESULT_NUMBERS)


# Some shapes are covered by exactly half, where the last digit of a sum decides the class; the
# percentage itself is compared.
_POLYGON_LABELS = [c for c in RESULT_LABELS if c != "spatial_coverage_quality"]


@query(
    sql(
        f"select {', '.join(_POLYGON_LABELS)}, {rounded(*RESULT_NUMBERS)} from results",
        "results",
        changed=POLYGONS,
    )
)
def notice_results_polygons(spark, folder):
    """End to end on shapes: notices with a hole, stands of two parts."""
    # The job reads edges, bounds and areas; the shapes themselves need not be staged with them.
    job = N.Analysis(
        prepare_geometry(X.notice_polygons(X.notices(spark, folder)), False).drop("geometry"),
        prepare_geometry(X.stand_polygons(X.stands(spark, folder)), False).drop("geometry"),
        X.elements(spark, folder),
        X.as_of(),
    )
    return job.results().select(*_POLYGON_LABELS, *RESULT_NUMBERS)


# --- reports ---


@query(
    sql(
        """select notice_id, round(standing_live_biomass_tco2, 4) as standing_live_biomass_tco2
from results where standing_live_biomass_tco2 is not null""",
        "results",
    )
)
def known_estimates(spark, folder):
    known = R.known_estimates(run(spark, folder).results(dominant=False), "standing_live_biomass_tco2")
    return known.select("notice_id", "standing_live_biomass_tco2")


@query(
    sql(
        """select count(*) as n_notices, round(sum(area_ha), 4) as total_area_ha,
round(sum(standing_live_biomass_tco2), 4) as standing_tco2,
round(sum(planned_harvest_biomass_tco2), 4) as planned_tco2,
round(max(inventory_age_years), 4) as max_inventory_age_years, count(*) filter
(contains(planned_harvest_volume_basis, 'raiemahu põhine hinnang')) as n_harvest_estimates
from results""",
        "results",
    )
)
def kpi_rollup(spark, folder):
    return R.kpi_rollup(run(spark, folder).results(dominant=False))


@query(
    sql(
        """select string_agg(distinct standing_volume_basis, ' + ' order by standing_volume_basis)
as standing_sources, string_agg(distinct planned_harvest_volume_basis, ' + '
order by planned_harvest_volume_basis) as planned_sources, string_agg(distinct inventory_recency,
', ' order by inventory_recency) as recency_labels, string_agg(distinct
cast(inventory_date as varchar), ', ' order by cast(inventory_date as varchar)) as inventory_dates
from results""",
        "results",
    )
)
def label_sets(spark, folder):
    return R.label_sets(run(spark, folder).results(dominant=False))


@query(
    sql(
        """select round(sum(current_increment_on_overlap_m3_y), 4) as increment_m3_y,
round(sum(current_increment_covered_area_ha), 4) as increment_area_ha,
round(sum(current_increment_on_overlap_m3_y) / sum(current_increment_covered_area_ha), 4)
as increment_m3_ha_y from results where current_increment_is_complete""",
        "results",
    )
)
def increment_rollup(spark, folder):
    """From overlaps and increments alone: a notice without overlap has no complete increment."""
    a = run(spark, folder)
    rates = a.stands.select("stand_id", "current_increment_m3_ha_y")
    return R.increment_rollup(N.aggregate_increment(a.overlaps.with_stands(rates)))


@query(
    sql(
        "select spatial_coverage_quality, count(*) as n_notices from results "
        "group by spatial_coverage_quality",
        "results",
    )
)
def coverage_counts(spark, folder):
    return R.value_counts(run(spark, folder).results(dominant=False), "spatial_coverage_quality")


@query(
    sql(
        "select inventory_recency, count(*) as n_notices from results group by inventory_recency",
        "results",
    )
)
def recency_counts(spark, folder):
    return R.value_counts(run(spark, folder).results(dominant=False), "inventory_recency")


@query(
    sql(
        """select notice_id, estimate_scope, species, round(sum(volume_m3), 4) as volume_m3
from breakdown group by notice_id, estimate_scope, species""",
        "breakdown",
    )
)
def species_volumes(spark, folder):
    return run(spark, folder).species_volumes()


@query(
    sql(
        """select species, estimate_scope, round(sum(volume_m3), 4) as volume_m3,
round(sum(biomass_tco2), 4) as biomass_tco2 from breakdown group by species, estimate_scope""",
        "breakdown",
    )
)
def species_rollup(spark, folder):
    return R.species_rollup(run(spark, folder).species_totals())


@query(
    sql(
        """select species, round(sum(biomass_tco2) filter (estimate_scope = 'standing'), 4)
as standing, round(sum(biomass_tco2) filter (estimate_scope = 'planned_harvest'), 4)
as planned_harvest from breakdown group by species""",
        "breakdown",
    )
)
def species_pivot(spark, folder):
    return R.species_pivot(run(spark, folder).species_totals())


@query(
    sql(
        f"""select {_RESULT_LIST} from results
order by results.standing_live_biomass_tco2 desc nulls last, notice_id limit 20""",
        "results",
    )
)
def top20_notices(spark, folder):
    return run(spark, folder).chosen_results(R.top_notices).select(*RESULT_LABELS, *RESULT_NUMBERS)


_QUANTILES = """select coalesce(quantile_cont(standing_live_biomass_tco2, 0.33), 0) as q1,
coalesce(quantile_cont(standing_live_biomass_tco2, 0.66), 0) as q2 from results"""


@query(sql(f"select round(q1, 4) as q1, round(q2, 4) as q2 from ({_QUANTILES})", "results"))
def quantile_thresholds(spark, folder):
    return R.quantile_thresholds(run(spark, folder).stored_estimates(R.BIOMASS[0]))


@query(
    sql(
        f"""select notice_id, map_class, case map_class when 'unknown' then '#777777' when 'low'
then '#2ca25f' when 'middle' then '#fec44f' else '#de2d26' end as map_color
from (select notice_id, case when v is null then 'unknown' when v <= q1 then 'low'
when v <= q2 then 'middle' else 'high' end as map_class from (select notice_id,
standing_live_biomass_tco2 as v, q1, q2 from results, ({_QUANTILES}) q))""",
        "results",
    )
)
def map_layer(spark, folder):
    a = run(spark, folder)
    return R.map_layer(a.stored_estimates("notice_id", R.BIOMASS[0])).select("notice_id", "map_class", "map_color")


_EXPORT_LABELS = [c for c in RESULT_LABELS if c not in ("source_layer", "submitted_date")]
_EXPORT_NUMBERS = [c for c in RESULT_NUMBERS if c not in ("planned_volume_m3", "mean_age")]


@query(
    sql(
        f"""select {", ".join(_EXPORT_LABELS)}, {rounded(*_EXPORT_NUMBERS)},
round(planned_volume_m3, 4) as raiutav_maht, round(mean_age, 4) as mean_inventory_age_years
from results""",
        "results",
    )
)
def export_table(spark, folder):
    return R.export_table(run(spark, folder).results())


@query(
    sql(
        f"""select notice_id, source_layer, submitted_date, harvest_type, cadastral_ref,
{rounded("planned_volume_m3", "minx", "maxy")} from notices_raw""",
        "notices_raw",
    )
)
def csv_round_trip(spark, folder):
    """Notices written as CSV and read back: text, dates, numbers and unknown values stay."""
    chosen = X.notices_raw(spark, folder).select(
        "notice_id", "source_layer", "submitted_date", "harvest_type", "cadastral_ref",
        "planned_volume_m3", "minx", "maxy",
    )
    path = scratch_path(spark, "csv")
    files.write_csv(chosen, path)
    return spark.read.schema(chosen.schema).option("header", True).csv(path)


@query(
    sql(
        """select row_number() over (order by notice_id) as sequence, notice_id,
round(standing_live_biomass_tco2, 4) as standing_live_biomass_tco2,
round(planned_harvest_biomass_tco2, 4) as planned_harvest_biomass_tco2 from results
where standing_live_biomass_tco2 is not null or planned_harvest_biomass_tco2 is not null""",
        "results",
    )
)
def chart_rows(spark, folder):
    return R.chart_rows(run(spark, folder).results(dominant=False))
