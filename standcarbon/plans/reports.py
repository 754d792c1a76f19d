"""Roll-ups, rankings and the export table over NOTICE_RESULT and SPECIES_BREAKDOWN."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon import schemas as S
from standcarbon.functions import measures as M
from standcarbon.functions import parsing as P
from standcarbon.operators.ordering import exact_quantiles, row_numbers
from standcarbon.sources.layers import resolve_column

BIOMASS = ("standing_live_biomass_tco2", "planned_harvest_biomass_tco2")


def known_estimates(results: DataFrame, column: str) -> DataFrame:
    return results.filter(F.col(column).isNotNull())


def kpi_rollup(results: DataFrame) -> DataFrame:
    """Headline numbers; sums are over known estimates and NULL where none is known."""
    harvest_based = F.col("planned_harvest_volume_basis").contains(S.HARVEST_VOLUME)
    return results.agg(
        F.count(F.lit(1)).alias("n_notices"),
        F.sum("area_ha").alias("total_area_ha"),
        F.sum("standing_live_biomass_tco2").alias("standing_tco2"),
        F.sum("planned_harvest_biomass_tco2").alias("planned_tco2"),
        F.max("inventory_age_years").alias("max_inventory_age_years"),
        F.count_if(harvest_based).alias("n_harvest_estimates"),
    )


def label_sets(results: DataFrame) -> DataFrame:
    """Distinct labels and inventory dates present; bounded by labels and by calendar days."""

    def labels(column: str, separator: str, missing: str):
        joined = M.joined_labels(F.col(column), separator)
        return F.coalesce(F.nullif(joined, F.lit("")), F.lit(missing))

    return results.agg(
        labels("standing_volume_basis", " + ", S.UNKNOWN).alias("standing_sources"),
        labels("planned_harvest_volume_basis", " + ", S.UNKNOWN).alias("planned_sources"),
        labels("inventory_recency", ", ", S.UNKNOWN_CLASS).alias("recency_labels"),
        M.joined_labels(F.col("inventory_date"), ", ").alias("inventory_dates"),
    )


def increment_rollup(results: DataFrame) -> DataFrame:
    """Total over complete notices and its area-weighted rate, never a mean of rates."""
    total = P.finite(F.col("current_increment_on_overlap_m3_y"))
    area = P.finite(F.col("current_increment_covered_area_ha"))
    usable = results.filter(
        F.col("current_increment_is_complete") & total.isNotNull() & (area > 0)
    )
    return usable.agg(
        F.sum("current_increment_on_overlap_m3_y").alias("increment_m3_y"),
        F.sum("current_increment_covered_area_ha").alias("increment_area_ha"),
        (
            F.sum("current_increment_on_overlap_m3_y")
            / F.nullif(F.sum("current_increment_covered_area_ha"), F.lit(0.0))
        ).alias("increment_m3_ha_y"),
    )


def value_counts(results: DataFrame, column: str) -> DataFrame:
    return (
        results.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_notices"))
        .orderBy(F.desc("n_notices"), column)
    )


def species_volumes(breakdown: DataFrame) -> DataFrame:
    """Volume per notice, scope and species."""
    return breakdown.groupBy("notice_id", "estimate_scope", "species").agg(
        F.sum("volume_m3").alias("volume_m3")
    )


def species_rollup(breakdown: DataFrame) -> DataFrame:
    return (
        breakdown.groupBy("species", "estimate_scope")
        .agg(
            F.sum("volume_m3").alias("volume_m3"),
            F.sum("biomass_tco2").alias("biomass_tco2"),
        )
        .orderBy(F.desc("biomass_tco2"), "species", "estimate_scope")
    )


def species_pivot(breakdown: DataFrame) -> DataFrame:
    """Species rows, one tCO2e column per scope."""
    return (
        breakdown.groupBy("species")
        .pivot("estimate_scope", ["standing", "planned_harvest"])
        .agg(F.sum("biomass_tco2"))
    )


def chart_rows(results: DataFrame) -> DataFrame:
    """Notices with any known estimate, numbered in order of their id."""
    known = results.select("notice_id", *BIOMASS).na.drop(how="all", subset=list(BIOMASS))
    return row_numbers(known, "notice_id", "sequence")


def top_notices(results: DataFrame, rows: int = 20) -> DataFrame:
    return results.orderBy(F.desc_nulls_last(BIOMASS[0]), "notice_id").limit(rows)


def quantile_thresholds(results: DataFrame) -> DataFrame:
    """Bounds between the map classes; zero where nothing is known."""
    bounds = exact_quantiles(results, BIOMASS[0], S.MAP_QUANTILES)
    return bounds.select(*[F.coalesce(q, F.lit(0.0)).alias(q) for q in ("q1", "q2")])


def map_layer(results: DataFrame) -> DataFrame:
    """Map class and colour per notice."""
    bounds = quantile_thresholds(results).select(F.struct("q1", "q2")).scalar()
    value = F.col(BIOMASS[0])
    map_class = (
        F.when(value.isNull(), "unknown")
        .when(value <= bounds["q1"], "low")
        .when(value <= bounds["q2"], "middle")
        .otherwise("high")
    )
    colors = F.create_map(*[F.lit(item) for pair in S.MAP_COLORS.items() for item in pair])
    return results.withColumn("map_class", map_class).withColumn(
        "map_color", colors[F.col("map_class")]
    )


def export_table(results: DataFrame) -> DataFrame:
    """The stable user-facing columns, in order, those that exist."""
    volume = "planned_volume_m3"
    if volume in results.columns and "raiutav_maht" not in results.columns:
        results = results.withColumnRenamed(volume, "raiutav_maht")
    identity = resolve_column(results.columns, S.EXPORT_ID_NAMES)
    if "notice_id" in results.columns:
        identity = "notice_id"
    harvest = resolve_column(results.columns, S.HARVEST_TYPE_NAMES)
    wanted = [identity, "raiutav_maht", harvest, *S.EXPORT_COLUMNS]
    present = [name for name in dict.fromkeys(wanted) if name in results.columns]
    return results.select(*present).withColumnsRenamed({"mean_age": "mean_inventory_age_years"})
