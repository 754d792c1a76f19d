"""Parsers, ages, classes and the carbon factor, value by value."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from standcarbon.functions import measures as M
from standcarbon.functions import parsing as P


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def test_unusable_numbers_are_unknown(spark):
    texts = ["1.5", " +2 ", "1e3", ".5", "5.", "", " ", None, "nan", "inf", "-inf", "1d", "1_0",
             "true", "0x10", "1e999", "abc", "1 2"]
    assert column(spark, texts, P.finite_double) == [1.5, 2.0, 1000.0, 0.5, 5.0] + [None] * 13


def test_only_integral_numbers_are_integers(spark):
    assert column(spark, ["2.0", "2.5", "7", "x", None], P.integer) == [2, None, 7, None, None]


def test_record_and_join_forms_of_stand_ids(spark):
    ids = ["12.0", "12.9", "A-1", None, "inf"]
    assert column(spark, ids, P.stand_record_id) == ["12", "12.9", "A-1", "", "inf"]
    assert column(spark, ids, P.stand_join_id) == ["12", "12", "A-1", None, "inf"]


def test_text_is_trimmed_of_all_blanks(spark):
    assert column(spark, ["\t a b \n", "　", "", None], P.text) == ["a b", None, None, None]


def test_dates_are_taken_as_written(spark):
    good = ["2021-07-29", "2021-07-29Z", "2021-07-29T23:30:00-05:00", "2021-07-29 10:00",
            "20210729", " 2021-07-29T10:00:00.123456Z ", "2021-07-29+02:00"]
    bad = ["2021-02-30", "2021-7-9", "29.07.2021", "2021", "junk", "2021-07-29T25:00", "", None]
    assert column(spark, good + bad, P.iso_date) == [date(2021, 7, 29)] * 7 + [None] * 8


def test_booleans(spark):
    yes, no = ["true", "T", "yes", "Y", "1", "1.0"], ["false", "f", "No", "n", "0", "0.0"]
    other = ["2", "perhaps", "", None]
    assert column(spark, yes + no + other, P.boolean) == [True] * 6 + [False] * 6 + [None] * 4


@pytest.mark.parametrize(
    ("since", "as_of", "years"),
    [
        (date(2017, 4, 3), date(2021, 4, 3), 4.0),
        (date(2016, 2, 29), date(2018, 2, 28), 2.0),
        (date(2012, 2, 29), date(2019, 2, 28), 7.0),
        (date(2017, 2, 28), date(2020, 2, 29), 3 + 1 / 366),
        (date(2019, 5, 14), date(2026, 8, 9), 7 + 87 / 365),
        (date(2020, 1, 31), date(2019, 12, 31), -31 / 366),
        (date(2022, 6, 7), date(2022, 6, 7), 0.0),
    ],
)
def test_age_counts_anniversaries(spark, since, as_of, years):
    row = spark.range(1).select(M.calendar_age_years(F.lit(since), F.lit(as_of)).alias("a")).first()
    assert row["a"] == pytest.approx(years, abs=1e-12)


def test_recency_bands(spark):
    ages = [0.0, 2.999, 3.0, 5.999, 6.0, 8.999, 9.0, -0.1, None, float("nan")]
    labels = ["väga hea"] * 2 + ["hea"] * 2 + ["vananev"] * 2 + ["nõrk"] + ["teadmata"] * 3
    assert column(spark, ages, M.recency_class, "double") == labels


def test_coverage_bands(spark):
    shares = [250.0, 90.0, 89.9, 50.0, 49.9, 0.0, None, float("nan")]
    labels = ["hea"] * 2 + ["osaline"] * 2 + ["nõrk"] * 2 + ["teadmata"] * 2
    assert column(spark, shares, M.coverage_class, "double") == labels


def test_species_lookups(spark):
    codes = [" ma ", "KU", "xx", None, " ", "0"]
    names = ["Mänd", "Kuusk", "Muu (XX)", "Muu", "Muu", "Määramata"]
    assert column(spark, codes, M.species_name) == names
    assert column(spark, codes, M.wood_density) == [0.42, 0.40, 0.42, 0.42, 0.42, 0.42]


def test_carbon_factor(spark):
    [value] = column(spark, ["KS"], lambda c: M.tco2e(F.lit(10.0), c))
    assert value == pytest.approx(10 * 0.51 * 1.3 * 0.5 * 44 / 12)
