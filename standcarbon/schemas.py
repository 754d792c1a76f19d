"""Fixed values and table schemas."""

from pyspark.sql import types as T

# --- fixed values: must equal the published method and registry code lists ---

DETAIL_STOCK = "detail-liigiline tagavara"
ALLOCATED_STOCK = "eraldise tagavara + liigiosakaal"
HARVEST_VOLUME = "raiemahu põhine hinnang"
UNKNOWN = "andmed puuduvad"

UNKNOWN_CLASS = "teadmata"
RECENCY_BANDS = ((3.0, "väga hea"), (6.0, "hea"), (9.0, "vananev"))
RECENCY_OLDEST = "nõrk"
COVERAGE_BANDS = ((90.0, "hea"), (50.0, "osaline"))
COVERAGE_LOWEST = "nõrk"

WOOD_DENSITY = {
    "MA": 0.42,
    "KU": 0.40,
    "KS": 0.51,
    "HB": 0.35,
    "LM": 0.45,
    "LV": 0.45,
    "SA": 0.57,
    "TA": 0.58,
}
DEFAULT_DENSITY = 0.42
BIOMASS_EXPANSION = 1.30
CARBON_FRACTION = 0.50
CO2_PER_CARBON = 44.0 / 12.0

OTHER_SPECIES = "Muu"
SPECIES_NAMES = {
    "0": "Määramata",
    "HB": "Haab",
    "JA": "Jalakas",
    "KD": "Kadakas",
    "KP": "Künnapuu",
    "KS": "Kask",
    "KU": "Kuusk",
    "LH": "Lehis",
    "LM": "Sanglepp",
    "LV": "Hall lepp",
    "MA": "Mänd",
    "NU": "Nulg",
    "PA": "Paju",
    "PI": "Pihlakas",
    "PK": "Paakspuu",
    "PN": "Pärn",
    "PP": "Pappel",
    "RE": "Remmelgas",
    "SA": "Saar",
    "SD": "Seedermänd",
    "SP": "Sarapuu",
    "TA": "Tamm",
    "TL": "Teised lehtpuud",
    "TM": "Toomingas",
    "TO": "Teised okaspuud",
    "TP": "Teised põõsaliigid",
    "TS": "Ebatsuuga",
    "TY": "Türnpuu",
    "VA": "Vaher",
}

NON_LIVING_STRATUM = "A"
# Stratum code -> stand stock column it is reported in.
STRATUM_COMPONENT = {"1": "stock_layer_1", "2": "stock_layer_2", "Y": "stock_young"}
RECONCILE_RELATIVE = 0.02
RECONCILE_ABSOLUTE = 1.0

MIN_OVERLAP_M2 = 1e-6
BBOX_PAD_DEGREES = 0.002
MAP_COLORS = {"unknown": "#777777", "low": "#2ca25f", "middle": "#fec44f", "high": "#de2d26"}
MAP_QUANTILES = (0.33, 0.66)

NOTICE_ID_NAMES = ("teatis_id", "teatise_id", "id", "dokumendi_id", "number", "teatise_nr")
EXPORT_ID_NAMES = ("teatis_id", "teatise_id", "id", "teatise_nr", "number")
NOTICE_DATE_NAMES = (
    "kuupaev",
    "kuupäev",
    "esitamise_kuupaev",
    "esitatud",
    "esitamise_aeg",
    "registreerimise_kuupaev",
    "registreeritud",
    "otsuse_kuupaev",
    "kehtiv_alates",
    "alguskuupaev",
    "created",
    "date",
)
HARVEST_VOLUME_NAMES = ("raiutav_maht", "raie_maht", "harvest_volume")
HARVEST_TYPE_NAMES = ("raie_liik", "raieliik", "raie_kood", "tegevus", "harvest_type")
STAND_ID_NAMES = ("eraldis_id", "eraldisid", "id", "stand_id")

EXPORT_COLUMNS = (
    "area_ha",
    "dominant_species",
    "mean_age",
    "mean_current_age_years",
    "standing_live_biomass_tco2",
    "standing_live_biomass_tco2_ha",
    "planned_harvest_biomass_tco2",
    "standing_volume_basis",
    "planned_harvest_volume_basis",
    "standing_biomass_is_complete",
    "planned_harvest_biomass_is_complete",
    "inventory_date",
    "inventory_age_years",
    "inventory_recency",
    "spatial_coverage_pct",
    "spatial_coverage_quality",
    "volume_source_quality",
    "current_increment_m3_ha_y",
    "current_increment_on_overlap_m3_y",
    "current_increment_covered_area_ha",
    "current_increment_coverage_pct",
    "current_increment_is_complete",
)

# --- schemas ---

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
# polygons -> rings (first is the shell, the others are holes) -> points
GEOMETRY = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))

FEATURE_PAGE = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "properties", T.MapType(T.StringType(), T.StringType())
                        ),
                        T.StructField("geometry", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

DETAIL_DOCUMENT = T.StructType(
    [
        T.StructField("_stand_id", T.StringType()),
        T.StructField("cached_at", T.StringType()),
        T.StructField("elemendid", T.ArrayType(T.StringType())),
        T.StructField("boniteediKood", T.StringType()),
        T.StructField("kasvukohaKood", T.StringType()),
        T.StructField("kuivendatud", T.StringType()),
    ]
)
