"""Stand records, their species elements, and the per-stand detail summary."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standcarbon.functions import measures as M
from standcarbon.functions import parsing as P
from standcarbon.schemas import DEFAULT_DENSITY, STRATUM_COMPONENT

REGISTRY_COLUMNS = (
    "id", "katastri_nr", "eraldise_nr", "invent_kp", "pindala", "korgus", "tagavara_1_ha",
    "tagavara_2_ha", "tagavara_y_ha", "juurdekasv", "rpindala_1", "taius_1", "kasvukoht_kood",
    "boniteedi_kood", "kuivendatud", "arengukl_kood",
)


# What build_stands produces; a feed's columns of these names are not passed through.
STAND_COLUMNS = (
    "stand_id", "cadastral_ref", "stand_number", "inventory_date", "area_ha", "height_m",
    "stock_layer_1", "stock_layer_2", "stock_young", "raw_stock_inputs",
    "current_increment_m3_ha_y", "basal_area_m2_ha", "stocking_pct", "site_type", "site_class",
    "drained", "development_class", "stock_m3_ha", "inventory_age_years",
)
_ELEMENT_FIELDS = (
    "id", "eraldisId", "rindeKood", "puuliigiKood", "osakaal", "tagavara", "vanus", "jooksevVanus",
)
_TEXT_FIELDS = ("id", "eraldisId", "rindeKood", "puuliigiKood")
_NUMBER_FIELDS = ("id", "osakaal", "tagavara", "vanus", "jooksevVanus")
_ELEMENT = ", ".join(f"{name} string" for name in _ELEMENT_FIELDS)


def normalize_elements(details: DataFrame) -> DataFrame:
    """(stand_id, elements array<json>) -> one typed row per usable species element.

    Entries that are no objects do not count; the position counts all objects, also those dropped
    afterwards for a negative stock.
    """
    objects = F.filter("elements", lambda item: F.ltrim(item).startswith("{"))
    parsed = F.transform(objects, lambda j: F.struct(j.alias("raw_json"), F.from_json(j, _ELEMENT).alias("e")))

    def typed_fields(p: Column) -> Column:
        numbers = F.array(*[p["e"][name] for name in _NUMBER_FIELDS])
        texts = [p["e"][name].alias(name) for name in _TEXT_FIELDS]
        return F.struct(p["raw_json"].alias("raw_json"), *texts, F.transform(numbers, P.double).alias("n"))

    # Inside the generator an object is parsed once. As columns of their own the fields would be
    # computed again by each operator that the filter below is pushed through.
    rows = details.select("stand_id", F.posexplode(F.transform(parsed, typed_fields)).alias("pos", "_e"))
    number_of = {name: P.finite(F.col("_e.n")[i]) for i, name in enumerate(_NUMBER_FIELDS)}
    typed = rows.select(
        "stand_id",
        "pos",
        "_e.raw_json",
        P.text(F.col("_e.id")).alias("_id"),
        number_of["id"].alias("_number"),
        F.coalesce(P.text(F.col("_e.eraldisId")), F.lit("unknown")).alias("_owner"),
        F.upper(P.text(F.col("_e.rindeKood"))).alias("stratum_code"),
        F.upper(P.text(F.col("_e.puuliigiKood"))).alias("species_code"),
        number_of["osakaal"].alias("share_pct"),
        number_of["tagavara"].alias("stock_m3_ha"),
        number_of["vanus"].alias("inventory_age"),
        number_of["jooksevVanus"].alias("current_age"),
    )
    number = F.when(F.col("_number") != 0, P.integral(F.col("_number"))).cast("string")
    return typed.filter(F.coalesce(F.col("stock_m3_ha") >= 0, F.lit(True))).select(
        "stand_id",
        "pos",
        F.coalesce(number, "_id", F.concat_ws(":", "_owner", "pos")).alias("record_id"),
        "stratum_code",
        "species_code",
        M.species_name(F.col("species_code")).alias("species"),
        "share_pct",
        "stock_m3_ha",
        "inventory_age",
        "current_age",
        "raw_json",
    )


def build_stands(stands: DataFrame, as_of: Column) -> DataFrame:
    """STAND from registry text columns; other columns pass through.

    A registry column a feed does not carry is unknown. `stand_id` of `canonical_stands` is kept:
    it is the form in which details are matched.
    """

    def raw(name: str) -> Column:
        return F.col(name) if name in stands.columns else F.lit(None).cast("string")

    def component(name: str) -> Column:
        value = P.finite_double(raw(name))
        return F.when(value >= 0, value)

    raw_inputs = [
        item
        for part in ("1", "2", "y")
        for item in (F.lit(f"tagavara_{part}_ha"), raw(f"tagavara_{part}_ha").cast("string"))
    ]
    typed = stands.select(
        (
            F.col("stand_id") if "stand_id" in stands.columns else P.stand_record_id(raw("id"))
        ).alias("stand_id"),
        P.text(raw("katastri_nr")).alias("cadastral_ref"),
        P.integer(raw("eraldise_nr")).alias("stand_number"),
        P.iso_date(raw("invent_kp")).alias("inventory_date"),
        P.finite_double(raw("pindala")).alias("area_ha"),
        P.finite_double(raw("korgus")).alias("height_m"),
        component("tagavara_1_ha").alias("stock_layer_1"),
        component("tagavara_2_ha").alias("stock_layer_2"),
        component("tagavara_y_ha").alias("stock_young"),
        F.create_map(*raw_inputs).alias("raw_stock_inputs"),
        P.finite_double(raw("juurdekasv")).alias("current_increment_m3_ha_y"),
        P.finite_double(raw("rpindala_1")).alias("basal_area_m2_ha"),
        P.finite_double(raw("taius_1")).alias("stocking_pct"),
        P.text(raw("kasvukoht_kood")).alias("site_type"),
        P.text(raw("boniteedi_kood")).alias("site_class"),
        P.boolean(raw("kuivendatud")).alias("drained"),
        P.text(raw("arengukl_kood")).alias("development_class"),
        *[name for name in stands.columns if name not in (*REGISTRY_COLUMNS, *STAND_COLUMNS)],
    )
    components = [F.col(name) for name in STRATUM_COMPONENT.values()]
    known_sum = sum((F.coalesce(part, F.lit(0.0)) for part in components), F.lit(0.0))
    return typed.withColumns(
        {
            "stock_m3_ha": F.when(F.coalesce(*components).isNotNull(), known_sum),
            "inventory_age_years": M.calendar_age_years(F.col("inventory_date"), as_of),
        }
    )


def stand_detail_summary(elements: DataFrame) -> DataFrame:
    """Stock, stock-weighted density and age, and main species of each stand."""
    stock, share = F.col("stock_m3_ha"), F.col("share_pct")
    usable = usable_species(elements)
    total = F.coalesce(F.sum(stock), F.lit(0.0))
    density = F.sum(stock * F.col("wood_density")) / total
    age = F.sum(stock * F.coalesce("inventory_age", F.lit(0.0))) / total
    name = M.species_name(F.col("species_code"))
    by_stock = F.max_by(
        F.when(stock.isNotNull(), name), F.when(stock.isNotNull(), F.struct(stock, -F.col("pos")))
    )
    by_share = F.max_by(name, F.struct(F.coalesce(share, F.lit(0.0)), -F.col("pos")))
    return (
        usable.groupBy("stand_id")
        .agg(
            F.count(F.lit(1)).alias("n_species_rows"),
            total.alias("volume_m3_ha"),
            F.when(total > 0, density).otherwise(DEFAULT_DENSITY).alias("weighted_density"),
            F.when(total > 0, age).alias("weighted_age"),
            by_stock.alias("_by_stock"),
            by_share.alias("_by_share"),
        )
        .withColumn("main_species", F.coalesce("_by_stock", "_by_share"))
        .drop("_by_stock", "_by_share")
    )


def latest_details(documents: DataFrame, order: str) -> DataFrame:
    """Later document of the same stand wins; of equally late ones the greatest by content, so that
    a retried task decides alike."""
    content = sorted(set(documents.columns) - {"stand_id", order})
    latest = Window.partitionBy("stand_id").orderBy(F.desc(order), *map(F.desc, content))
    return (
        documents.withColumn("_rank", F.row_number().over(latest))
        .filter("_rank = 1")
        .drop("_rank")
    )


def prune_details(details: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Only details of stands that really overlap a notice."""
    return details.join(overlaps.select("stand_id").distinct(), "stand_id", "left_semi")


def usable_species(elements: DataFrame) -> DataFrame:
    """The species rows a detail summary rests on, with the density of their wood."""
    stock, share = F.col("stock_m3_ha"), F.col("share_pct")
    usable = elements.filter(
        F.when(stock.isNotNull(), stock >= 0).otherwise(F.coalesce(share > 0, F.lit(False)))
    )
    return usable.withColumn("wood_density", M.wood_density(F.col("species_code")))


def detail_site(details: DataFrame) -> DataFrame:
    """Site fields of the detail documents, one row per stand."""
    return details.select("stand_id", "site_class", "site_type", "drained")
