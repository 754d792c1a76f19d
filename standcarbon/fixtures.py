"""Forest tables derived from the order and part tables, so every operator runs on shared data.

Terrain grows with the data: lots of 400 m lie in rows of 100, part p on lot p and order o on lot
2 o / 15, so a notice meets a few stands at any scale. Coordinates are metres.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standcarbon.functions.geometry import rectangle
from standcarbon.schemas import WOOD_DENSITY

AS_OF = "2026-08-09"
BBOX_PAD = 20.0
LOT = 400.0
ISLAND = 10_000_000.0


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lot_x(lot: Column) -> Column:
    return F.pmod(lot, F.lit(100)) * LOT


def _lot_y(lot: Column) -> Column:
    return F.floor(lot / 100) * LOT


def notices_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Both layers: even orders are archived, all but every fourth are current too."""
    o = F.col("o_orderkey")
    lot = F.floor(o * 2 / 15)
    archived = F.struct(F.lit("archive").alias("source_layer"), F.lit(1).alias("source_rank"))
    current = F.struct(F.lit("current").alias("source_layer"), F.lit(2).alias("source_rank"))
    layers = (
        F.when(o % 4 == 0, F.array(archived))
        .when(o % 2 == 0, F.array(archived, current))
        .otherwise(F.array(current))
    )
    # Every 19th notice lies on an island without stands.
    west = _lot_x(lot) + o % 8 * 50.0 + F.when(o % 19 == 0, ISLAND).otherwise(0.0)
    south = _lot_y(lot) + o % 6 * 60.0
    referenced = F.floor(lot / 2) * 2
    return (
        table(spark, folder, "orders")
        .select("*", F.explode(layers).alias("layer"))
        .select(
            o.cast("string").alias("notice_id"),
            "layer.source_layer",
            "layer.source_rank",
            F.col("o_orderdate").cast("date").alias("submitted_date"),
            F.col("o_orderpriority").alias("harvest_type"),
            F.when(
                o % 7 != 0,
                F.concat(
                    F.when(o % 11 == 3, "Q").otherwise("K"), (referenced % 50).cast("string")
                ),
            ).alias("cadastral_ref"),
            F.floor(referenced / 50).alias("stand_number"),
            F.when(o % 23 == 0, None)
            .when(o % 29 == 0, 0.0)
            .otherwise(F.col("o_totalprice") / 1000 * F.col("layer.source_rank"))
            .alias("planned_volume_m3"),
            (west + 20.0).alias("minx"),
            south.alias("miny"),
            (west + 120.0 + o % 9 * 20.0).alias("maxx"),
            (south + 100.0 + o % 11 * 20.0).alias("maxy"),
        )
    )


def notices(spark: SparkSession, folder: str) -> DataFrame:
    from standcarbon.sources.layers import dedupe_latest

    return dedupe_latest(
        notices_raw(spark, folder),
        ["notice_id"],
        ["source_rank", "submitted_date", "planned_volume_m3"],
    )


def elements(spark: SparkSession, folder: str) -> DataFrame:
    """Each line item is one species element of the stand of its part."""
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    quantity = F.col("l_quantity")
    stratum = (
        F.when(p % 4 == 0, F.when(o % 3 == 0, "2").otherwise("1"))
        .when(p % 4 == 1, "1")
        .when(
            p % 4 == 2, F.when(o % 7 == 0, "A").when(o % 3 == 0, "Y").otherwise("1")
        )
    )
    listed = (*WOOD_DENSITY, "XX")
    codes = F.array(*[F.lit(c) for c in listed])
    record = o * 10 + n
    return table(spark, folder, "lineitem").select(
        p.cast("string").alias("stand_id"),
        record.alias("pos"),
        record.cast("string").alias("record_id"),
        stratum.alias("stratum_code"),
        codes[((o + n) % len(listed)).cast("int")].alias("species_code"),
        F.when((p % 17 == 0) & (n == 1), None).otherwise(quantity).alias("share_pct"),
        F.when((p % 5 == 0) & (n % 2 == 0), None)
        .when(o % 31 == 0, 0.0)
        .otherwise(quantity * 2)
        .alias("stock_m3_ha"),
        F.when(o % 13 != 0, 10.0 + o % 120).alias("inventory_age"),
        F.when(o % 13 != 0, 15.0 + o % 120).alias("current_age"),
    )


def stands(spark: SparkSession, folder: str) -> DataFrame:
    """One stand per part; its reported stocks follow its elements, overstated for every third."""
    p = F.col("p_partkey")
    stratum, stock = F.col("stratum_code"), F.col("stock_m3_ha")
    reported = elements(spark, folder).groupBy("stand_id").agg(
        F.sum(F.when(stratum.isNull() | (stratum == "1"), stock)).alias("s1"),
        F.sum(F.when(stratum == "2", stock)).alias("s2"),
        F.sum(F.when(stratum == "Y", stock)).alias("sy"),
    )

    def component(value: Column) -> Column:
        return F.when(p % 13 == 0, None).when(p % 19 == 0, 0.0).otherwise(value)

    # Every 16th stand lies where no notice is.
    west = _lot_x(p) - F.when(p % 16 == 5, ISLAND).otherwise(0.0)
    first = F.when(p % 3 == 1, F.col("s1") * 1.5).otherwise(F.col("s1"))
    parts = table(spark, folder, "part").withColumn("stand_id", p.cast("string"))
    placed = (
        parts.join(reported, "stand_id", "left")
        .select(
            "stand_id",
            F.concat(F.lit("K"), (p % 50).cast("string")).alias("cadastral_ref"),
            F.floor(p / 50).alias("stand_number"),
            F.when(
                p % 11 != 0,
                F.date_add(F.lit("2008-01-01").cast("date"), (p * 37 % 6500).cast("int")),
            ).alias("inventory_date"),
            component(first).alias("stock_layer_1"),
            component(F.col("s2")).alias("stock_layer_2"),
            component(F.col("sy")).alias("stock_young"),
            F.when(p % 10 != 0, F.col("p_size") / 10).alias("current_increment_m3_ha_y"),
            F.col("p_brand").alias("site_type"),
            F.col("p_type").alias("site_class"),
            (p % 2 == 0).alias("drained"),
            west.alias("minx"),
            (_lot_y(p) + 40.0).alias("miny"),
            (west + 250.0 + p % 7 * 20.0).alias("maxx"),
            (_lot_y(p) + 300.0 + p % 5 * 25.0).alias("maxy"),
        )
    )
    components = [F.col(c) for c in ("stock_layer_1", "stock_layer_2", "stock_young")]
    known = sum((F.coalesce(c, F.lit(0.0)) for c in components), F.lit(0.0))
    return placed.withColumn(
        "stock_m3_ha", F.when(F.coalesce(*components).isNotNull(), known)
    )


def notice_polygons(df: DataFrame) -> DataFrame:
    """The rectangle with a hole: the middle half of each side is cut out."""
    w, h = (F.col("maxx") - F.col("minx")) / 4, (F.col("maxy") - F.col("miny")) / 4
    shell = rectangle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    hole = rectangle(
        F.col("minx") + w, F.col("miny") + h, F.col("maxx") - w, F.col("maxy") - h
    )
    return df.withColumn("geometry", F.array(F.array(shell, hole)))


def _part(x0: float, y0: float, x1: float, y1: float):
    """Corners of a rectangle given in shares of the bounds."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    x, y = F.col("minx"), F.col("miny")
    return rectangle(x + w * x0, y + h * y0, x + w * x1, y + h * y1)


def notice_invalid_polygons(df: DataFrame) -> DataFrame:
    """The rectangle with a hole that sticks out of it in the east."""
    rings = F.array(_part(0, 0, 1, 1), _part(0.5, 0.25, 1.25, 0.75))
    return df.withColumn("geometry", F.array(rings))


def stand_invalid_polygons(df: DataFrame) -> DataFrame:
    """Two parts that overlap in a quarter of the width."""
    parts = F.array(F.array(_part(0, 0, 0.75, 1)), F.array(_part(0.5, 0, 1, 1)))
    return df.withColumn("geometry", parts)


def stand_corner_polygons(df: DataFrame) -> DataFrame:
    """A thin L along the south and the west of the bounds."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    xa, ya = x0 + (x1 - x0) * 0.05, y0 + (y1 - y0) * 0.05
    corners = ((x0, y0), (x1, y0), (x1, ya), (xa, ya), (xa, y1), (x0, y1))
    shape = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    return df.withColumn("geometry", F.array(F.array(shape)))


def stand_polygons(df: DataFrame) -> DataFrame:
    """An L (north-east quarter missing) and a separate square in that quarter."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    corners = ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1))
    shape_l = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    square = rectangle((xm + x1) / 2, (ym + y1) / 2, x1, y1)
    return df.withColumn("geometry", F.array(F.array(shape_l), F.array(square)))
