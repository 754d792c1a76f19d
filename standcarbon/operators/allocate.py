"""Allocation of stand stock and of planned harvest volume to species.

Every rule is linear: the volume of a record is its stock or its share times one coefficient of
its (stand, stratum), per hectare of overlap or per cubic metre of harvest. So elements are first
summed to (stand, stratum, species), where a stand has no more rows than the code lists have
entries; the rules then run on those sums, and records only look their coefficient up.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standcarbon import schemas as S
from standcarbon.functions import measures as M
from standcarbon.operators.skew import many_to_many

STRATUM = ["stand_id", "stratum_key"]
GROUP = [*STRATUM, "species_code"]
_AGES = ("inventory_age", "current_age")
COEFFICIENTS = (
    "inventory_per_share",
    "detail_per_stock",
    "detail_per_share",
    "standing_per_stock",
    "standing_per_share",
    "harvest_per_stock",
    "harvest_per_share",
)


def _over_stand(aggregate: Column) -> Column:
    return aggregate.over(Window.partitionBy("stand_id"))


def _over_stratum(aggregate: Column) -> Column:
    return aggregate.over(Window.partitionBy("stand_id", "stratum_key"))


def is_living(stratum: Column) -> Column:
    """A record without stratum is living."""
    return F.coalesce(stratum != S.NON_LIVING_STRATUM, F.lit(True))


def reconciles(detail: Column, inventory: Column) -> Column:
    tolerance = F.greatest(
        F.greatest(F.abs(detail), F.abs(inventory)) * S.RECONCILE_RELATIVE,
        F.lit(S.RECONCILE_ABSOLUTE),
    )
    return F.abs(detail - inventory) <= tolerance


def _stratum_key() -> Column:
    # Blank strata are NULL already, so '' can stand for "no stratum" as a join key.
    return F.coalesce("stratum_code", F.lit(""))


def living_elements(elements: DataFrame) -> DataFrame:
    living = elements.filter(is_living(F.col("stratum_code")))
    return living.withColumn("stratum_key", _stratum_key())


def group_elements(elements: DataFrame, by_species: bool = True) -> DataFrame:
    """Sums of living elements per stand, stratum and species code; combined before the shuffle.

    The coefficients of records rest on strata alone: without `by_species` neither the code nor the
    sums of ages, which only rates by species need, are carried along.
    """
    stock, share = F.col("stock_m3_ha"), F.col("share_pct")
    positive_share = F.when(share > 0, share)
    sums = [
        F.count(F.lit(1)).alias("records"),
        F.count(stock).alias("records_with_stock"),
        F.count_if(F.coalesce(share < 0, F.lit(True))).alias("bad_shares"),
        F.coalesce(F.sum(stock), F.lit(0.0)).alias("stock"),
        F.coalesce(F.sum(positive_share), F.lit(0.0)).alias("share"),
        F.count(positive_share).alias("shared_records"),
        F.count(F.when(stock > 0, 1)).alias("stocked_records"),
    ]
    for weight, column in (("stock", stock), ("share", positive_share)):
        for age in _AGES if by_species else ():
            known = F.when(F.col(age).isNotNull(), column)
            sums += [
                F.coalesce(F.sum(known), F.lit(0.0)).alias(f"{weight}_with_{age}"),
                F.coalesce(F.sum(known * F.col(age)), F.lit(0.0)).alias(f"{weight}_times_{age}"),
            ]
    keys = GROUP if by_species else STRATUM
    return living_elements(elements).groupBy(*keys).agg(*sums)


def _stratum_sums(groups: DataFrame) -> DataFrame:
    return groups.withColumns(
        {
            "t_stock": _over_stratum(F.sum("stock")),
            "t_share": _over_stratum(F.sum("share")),
            "t_bad": _over_stratum(F.sum("bad_shares")),
            "stratum_code": F.nullif(F.col("stratum_key"), F.lit("")),
        }
    )


def _stand_sums(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "s_records": F.coalesce(_over_stand(F.sum("records")), F.lit(0)),
            "s_with_stock": F.coalesce(_over_stand(F.sum("records_with_stock")), F.lit(0)),
            "s_stock": _over_stand(F.sum("stock")),
            "s_share": _over_stand(F.sum("share")),
            "s_bad": _over_stand(F.sum("bad_shares")),
            "has_strata": _over_stand(F.max("stratum_code")).isNotNull(),
            "one_stratum": F.coalesce(
                _over_stand(F.min("stratum_code")) == _over_stand(F.max("stratum_code")),
                F.lit(True),
            ),
        }
    )


def _all(condition: Column) -> Column:
    return _over_stand(F.min(condition))


def _no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def stand_allocation(stands: DataFrame, groups: DataFrame) -> DataFrame:
    """Rules and coefficients on (stand, stratum, species) rows; a stand without any has one row.

    Adds standing_basis, detail_complete, stock_allocatable, harvest_rule and the coefficients.
    """
    inventory = stands.select("stand_id", *S.STRATUM_COMPONENT.values(), "stock_m3_ha")
    # The join leaves rows partitioned by stand: neither window below shuffles again.
    rows = _stand_sums(_stratum_sums(inventory.join(groups, "stand_id", "left")))

    stock = F.col("stock_m3_ha")
    values = {code: F.col(name) for code, name in S.STRATUM_COMPONENT.items()}
    own = F.coalesce(*[F.when(F.col("stratum_code") == c, v) for c, v in values.items()])
    has_components = F.coalesce(*values.values()).isNotNull()
    # A positive component none of whose records is listed.
    unlisted = _any(
        [
            F.coalesce(value > 0, F.lit(False))
            & _no(_over_stand(F.max(F.col("stratum_code") == code)))
            for code, value in values.items()
        ]
    )
    rows = rows.withColumns(
        {
            "component": own,
            "has_components": has_components,
            "components_reconcile": ~unlisted
            & F.coalesce(_all(reconciles(F.col("t_stock"), own)), F.lit(True)),
            "components_shared": ~unlisted
            & F.coalesce(
                _all(F.when(own > 0, (F.col("t_bad") == 0) & (F.col("t_share") > 0))),
                F.lit(True),
            ),
        }
    )

    living = F.col("s_records") > 0
    by_strata = F.col("has_strata") & F.col("has_components")
    shares_usable = living & (F.col("s_bad") == 0) & (F.col("s_share") > 0)
    checked = (
        F.when(~F.col("has_components"), True)
        .when(F.col("has_strata"), F.col("components_reconcile"))
        .otherwise(F.coalesce(reconciles(F.col("s_stock"), stock), F.lit(True)))
    )
    detail_complete = living & (F.col("s_records") == F.col("s_with_stock")) & checked
    allocatable = (
        F.when(stock.isNull(), False)
        .when(stock == 0, True)
        .when(by_strata, F.col("components_shared"))
        .otherwise(F.coalesce(shares_usable, F.lit(False)))
    )
    rows = rows.withColumns(
        {
            "by_strata": F.coalesce(by_strata, F.lit(False)),
            "detail_complete": F.coalesce(detail_complete, F.lit(False)),
            "stock_allocatable": F.coalesce(allocatable, F.lit(False)),
            "shares_usable": F.coalesce(shares_usable, F.lit(False)),
        }
    )
    rows = rows.withColumns(
        {
            "standing_basis": F.when(F.col("detail_complete"), S.DETAIL_STOCK)
            .when(F.col("stock_allocatable"), S.ALLOCATED_STOCK)
            .otherwise(S.UNKNOWN),
            "harvest_rule": F.when(
                F.col("stock_allocatable"), F.when(stock > 0, "components").otherwise("none")
            )
            .when(F.col("detail_complete") & (F.col("s_stock") > 0), "strata")
            .when(
                stock.isNull() & F.col("one_stratum") & F.col("shares_usable"), "shares"
            )
            .otherwise("none"),
        }
    )
    return _with_coefficients(rows).drop(
        "components_reconcile", "components_shared", "shares_usable", "one_stratum"
    )


def strata_coefficients() -> dict[str, Column]:
    """Strata weigh by stock; inside one, shares decide, or stocks where shares are unusable."""
    weighs = F.col("t_stock") > 0
    by_share = (F.col("t_bad") == 0) & (F.col("t_share") > 0)
    return {
        "share": F.when(weighs & by_share, F.col("t_stock") / F.col("s_stock") / F.col("t_share")),
        "stock": F.when(weighs & ~by_share, 1 / F.col("s_stock")),
    }


def _with_coefficients(rows: DataFrame) -> DataFrame:
    stock = F.col("stock_m3_ha")
    per_share = F.when(
        F.col("by_strata"), F.when(F.col("component") > 0, F.col("component") / F.col("t_share"))
    ).otherwise(stock / F.col("s_share"))
    standing, rule = F.col("standing_basis"), F.col("harvest_rule")
    local = strata_coefficients()
    weighable = F.col("detail_complete") & (F.col("s_stock") > 0)
    return rows.withColumns(
        {
            "inventory_per_share": F.when(F.col("stock_allocatable") & (stock > 0), per_share),
            "detail_per_share": F.when(weighable, local["share"]),
            "detail_per_stock": F.when(weighable, local["stock"]),
        }
    ).withColumns(
        {
            "standing_per_stock": F.when(standing == S.DETAIL_STOCK, F.lit(1.0)),
            "standing_per_share": F.when(
                standing == S.ALLOCATED_STOCK, F.col("inventory_per_share")
            ),
            "harvest_per_share": F.when(rule == "components", F.col("inventory_per_share") / stock)
            .when(rule == "strata", F.col("detail_per_share"))
            .when(rule == "shares", 1 / F.col("s_share")),
            "harvest_per_stock": F.when(rule == "strata", F.col("detail_per_stock")),
        }
    )


def bare_allocation(groups: DataFrame) -> DataFrame:
    """Harvest coefficients from species rows alone, no stand record.

    Shares decide in at most one stratum; else, or where they fail, complete stocks do.
    """
    rows = _stand_sums(_stratum_sums(groups.repartition("stand_id")))
    shares = F.col("one_stratum") & (F.col("s_bad") == 0) & (F.col("s_share") > 0)
    stocks = (F.col("s_records") == F.col("s_with_stock")) & (F.col("s_stock") > 0)
    local = strata_coefficients()
    return rows.withColumn(
        "harvest_rule", F.when(shares, "shares").when(stocks, "strata").otherwise("none")
    ).withColumns(
        {
            "harvest_per_share": F.when(F.col("harvest_rule") == "shares", 1 / F.col("s_share"))
            .when(F.col("harvest_rule") == "strata", local["share"]),
            "harvest_per_stock": F.when(F.col("harvest_rule") == "strata", local["stock"]),
        }
    )


def is_zero_stock() -> Column:
    """Known to hold nothing: the estimate is one row of 0 m3 without species."""
    return (F.col("standing_basis") == S.ALLOCATED_STOCK) & (F.col("stock_m3_ha") == 0)


def _weighted(stock: str, share: str) -> Column:
    return F.coalesce(
        F.col("standing_per_stock") * F.col(stock), F.col("standing_per_share") * F.col(share)
    )


def species_rates(allocation: DataFrame) -> DataFrame:
    """Per (stand, species code): m3 per hectare standing, m3 per m3 harvested, and age sums.

    A rate is NULL where the estimate lists no row: zero-stock details count, zero shares do not.
    """
    stocked, shared = F.col("stocked_records") > 0, F.col("shared_records") > 0
    rows = allocation.withColumns(
        {
            "species_code": F.when(~is_zero_stock(), F.col("species_code")),
            "standing_m3_per_ha": F.when(is_zero_stock(), F.lit(0.0))
            .when(F.col("standing_per_stock").isNotNull(), _weighted("stock", "share"))
            .when(shared, _weighted("stock", "share")),
            "harvest_weight": F.coalesce(
                F.when(stocked, F.col("harvest_per_stock") * F.col("stock")),
                F.when(shared, F.col("harvest_per_share") * F.col("share")),
            ),
        }
    )
    ages = [
        F.sum(_weighted(f"stock_{kind}_{age}", f"share_{kind}_{age}")).alias(f"{kind}_{age}")
        for age in _AGES
        for kind in ("with", "times")
    ]
    # Basis and rule are constants of the stand.
    return rows.groupBy("stand_id", "standing_basis", "harvest_rule", "species_code").agg(
        F.sum("standing_m3_per_ha").alias("standing_m3_per_ha"),
        F.sum("harvest_weight").alias("harvest_weight"),
        *ages,
    )


def stand_rates(rates: DataFrame, listed: bool = False) -> DataFrame:
    """One row per stand: tCO2e per hectare and per harvested m3, and age sums per hectare.

    With `listed` also its species with both volumes; the list is as long as the code list at most.
    """
    code, columns = F.col("species_code"), []
    if listed:
        volumes = [F.col("standing_m3_per_ha").alias("standing"), F.col("harvest_weight").alias("planned")]
        entry = F.struct(M.species_name(code).alias("species"), *volumes)
        known = F.col("standing_m3_per_ha").isNotNull() | F.col("harvest_weight").isNotNull()
        columns = [F.collect_list(F.when(known, entry)).alias("listed")]
    harvest_ok = (F.col("harvest_rule") != "none").alias("harvest_ok")
    return rates.groupBy("stand_id", "standing_basis", harvest_ok).agg(
        F.sum("standing_m3_per_ha").alias("standing_m3_per_ha"),
        F.sum(M.tco2e(F.col("standing_m3_per_ha"), code)).alias("standing_tco2_per_ha"),
        F.sum(M.tco2e(F.col("harvest_weight"), code)).alias("harvest_tco2_per_m3"),
        *[
            F.coalesce(F.sum(f"{kind}_{age}"), F.lit(0.0)).alias(f"{kind}_{age}")
            for age in _AGES
            for kind in ("with", "times")
        ],
        *columns,
    )


def strata_lookup(stands: DataFrame, elements: DataFrame) -> DataFrame:
    """What records look up, by an allocation without species: a row per (stand, stratum), or one
    without stratum of a stand without records. `records` is how many there are, `zero_stock` says
    that the stand is known to hold nothing."""
    rows = stand_allocation(stands, group_elements(elements, by_species=False))
    numbers = [name for name in COEFFICIENTS if name.startswith(("standing_", "harvest_"))]
    return rows.groupBy(*STRATUM, "standing_basis", "harvest_rule").agg(
        F.coalesce(F.max("records"), F.lit(0)).alias("records"),
        F.bool_or(is_zero_stock()).alias("zero_stock"),
        *[F.max(name).alias(name) for name in numbers],
    )


def record_coefficients(allocation: DataFrame) -> DataFrame:
    """One row per (stand, stratum)."""
    constants = [c for c in ("standing_basis", "harvest_rule") if c in allocation.columns]
    numbers = [c for c in COEFFICIENTS if c in allocation.columns]
    return (
        allocation.filter("stratum_key is not null")
        .groupBy("stand_id", "stratum_key", *constants)
        .agg(*[F.max(name).alias(name) for name in numbers])
    )


def match_records(elements: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Living records next to the coefficients of their stratum."""
    return living_elements(elements).join(coefficients, STRATUM)


def match_by_stand(elements: DataFrame, coefficients: DataFrame) -> DataFrame:
    """The same rows, shuffled by stand alone, so that a join by stand follows without another
    shuffle of the records. The few strata of a stand are compared in place."""
    strata = coefficients.withColumnsRenamed({"stand_id": "_stand", "stratum_key": "_stratum"})
    living = elements.filter(is_living(F.col("stratum_code")))
    key, other = _stratum_key(), F.col("_stratum")
    # An equation would become a key of the join and of its shuffle.
    same = (key >= other) & (key <= other)
    met = living.join(strata, (F.col("stand_id") == F.col("_stand")) & same)
    return met.withColumnRenamed("_stratum", "stratum_key").drop("_stand")


def record_volume(scope: str) -> Column:
    """Volume or weight of a matched record; NULL where the scope lists no row for it."""
    stock, share = F.col("stock_m3_ha"), F.col("share_pct")
    per_stock, per_share = F.col(f"{scope}_per_stock"), F.col(f"{scope}_per_share")
    listed = stock.isNotNull() if scope == "standing" else stock > 0
    return F.coalesce(
        F.when(listed, per_stock * stock), F.when(share > 0, per_share * share)
    )


RECORD = (
    "stand_id", "record_id", "stratum_code", "species_code", "inventory_age", "current_age",
)


def listed_records(matched: DataFrame, *facts: str) -> DataFrame:
    """Matched records that either scope lists, with both volumes and other `facts` beside them."""
    return matched.select(
        *RECORD,
        "standing_basis",
        record_volume("standing").alias("standing_m3_per_ha"),
        (F.col("harvest_rule") != "none").alias("harvest_ok"),
        record_volume("harvest").alias("harvest_weight"),
        *facts,
    ).filter("standing_m3_per_ha is not null or harvest_weight is not null")


def stand_records(elements: DataFrame, allocation: DataFrame) -> DataFrame:
    """STAND_ALLOC: standing m3 per hectare and harvest weight (sums to 1) of each record."""
    listed = listed_records(match_records(elements, record_coefficients(allocation)))
    zero = (
        allocation.filter(is_zero_stock())
        .select("stand_id", "standing_basis")
        .distinct()
        .withColumns({"standing_m3_per_ha": F.lit(0.0), "harvest_ok": F.lit(False)})
    )
    return listed.unionByName(zero, allowMissingColumns=True)


def inventory_records(elements: DataFrame, allocation: DataFrame) -> DataFrame:
    """Stand stock per hectare shared out by declared shares, wherever that is possible."""
    coefficients = record_coefficients(
        allocation.select("stand_id", "stratum_key", "inventory_per_share")
    )
    matched = match_records(elements, coefficients)
    shared = matched.filter("share_pct > 0").withColumn(
        "volume_m3_per_ha", F.col("inventory_per_share") * F.col("share_pct")
    )
    zero = (
        allocation.filter(F.col("stock_m3_ha") == 0)
        .select("stand_id")
        .distinct()
        .withColumn("volume_m3_per_ha", F.lit(0.0))
    )
    listed = shared.filter("volume_m3_per_ha is not null").select(*RECORD, "volume_m3_per_ha")
    return listed.unionByName(zero, allowMissingColumns=True)


def detail_records(elements: DataFrame, allocation: DataFrame) -> DataFrame:
    """Weights of the records of complete details: strata by stock, species by local share."""
    coefficients = record_coefficients(
        allocation.select("stand_id", "stratum_key", "detail_per_share", "detail_per_stock")
    )
    matched = match_records(elements, coefficients)
    return (
        matched.withColumn("weight", record_volume("detail"))
        .filter("weight is not null")
        .select(*RECORD, "weight")
    )


def planned_records(elements: DataFrame, volumes: DataFrame) -> DataFrame:
    """Planned volume (stand_id, volume_m3) spread over bare species rows.

    Zero volume is one known row of 0 m3; a volume that cannot be spread lists nothing.
    """
    coefficients = record_coefficients(bare_allocation(group_elements(elements)))
    matched = match_records(elements, coefficients)
    weights = matched.withColumn("weight", record_volume("harvest")).filter("weight is not null")
    spread = weights.join(volumes.filter("volume_m3 > 0"), "stand_id").withColumn(
        "volume_m3", F.col("volume_m3") * F.col("weight")
    )
    zero = volumes.filter("volume_m3 = 0").select("stand_id", "volume_m3")
    return spread.select(*RECORD, "volume_m3").unionByName(zero, allowMissingColumns=True)


def allocate_by_share(elements: DataFrame, volumes: DataFrame) -> DataFrame:
    """Known total (stand_id, total_volume_m3) over the rows with a positive share.

    Unlike the inventory rule, rows without share are passed over.
    """
    shared = elements.filter("share_pct > 0")
    totals = shared.groupBy("stand_id").agg(F.sum("share_pct").alias("_total_share"))
    known = volumes.filter("total_volume_m3 > 0").join(totals, "stand_id")
    volume = F.col("total_volume_m3") * F.col("share_pct") / F.col("_total_share")
    return (
        shared.join(known, "stand_id")
        .withColumn("volume_m3", volume)
        .withColumn("carbon_co2e_t", M.tco2e(volume, F.col("species_code")))
        .drop("_total_share", "total_volume_m3")
    )


def carbon_totals(records: DataFrame, keys: list[str], volume: str) -> DataFrame:
    """tCO2e per key; one unusable volume makes the total unknown, never smaller."""
    usable = (F.col(volume) >= 0) & (F.col(volume) < float("inf"))
    return records.groupBy(*keys).agg(
        F.when(
            F.bool_and(F.coalesce(usable, F.lit(False))),
            F.sum(M.tco2e(F.col(volume), F.col("species_code"))),
        ).alias("tco2e")
    )


def prorate_by_share(elements: DataFrame, parts: DataFrame) -> DataFrame:
    """Planned parts (notice_id, stand_id, planned_part_m3) over the species records of the stand.

    One row per overlap and record with a positive share, by that share; a part that is not positive
    lists nothing.
    """
    shared = elements.filter("share_pct > 0")
    totals = shared.groupBy("stand_id").agg(F.sum("share_pct").alias("_total_share"))
    # The density is looked up once a record, not once a row.
    known = shared.join(totals, "stand_id").withColumn("_density", M.wood_density(F.col("species_code")))
    positive = parts.filter("planned_part_m3 > 0")
    rows = many_to_many(positive, known, ["stand_id"], ["notice_id"], ["record_id", "pos"])
    volume = F.col("planned_part_m3") * F.col("share_pct") / F.col("_total_share")
    return rows.select(
        "notice_id", "stand_id", "record_id", "species_code",
        volume.alias("volume_m3"), M.tco2e_of(volume, F.col("_density")).alias("carbon_co2e_t"),
    )
