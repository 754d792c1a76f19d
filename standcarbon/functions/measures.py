"""Ages, quality classes, species lookups and the carbon factor."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from standcarbon import schemas as S


def _lookup(values: dict, key: Column, default: object) -> Column:
    """Value of `key`, or the default. By position in a constant array: the optimizer turns a map
    lookup into one comparison per entry, each computing the key again."""
    position = F.coalesce(F.array_position(F.lit(list(values)), key), F.lit(0))
    return F.lit([default, *values.values()])[position.cast("int")]


def calendar_age_years(since: Column, as_of: Column) -> Column:
    """Completed anniversaries plus the fraction of the running year; negative if reversed."""
    early, late = F.least(since, as_of), F.greatest(since, as_of)
    # Whole months are counted to the clamped anniversary: 29 February ends on the 28th.
    years = F.floor(F.months_between(late, early) / 12).cast("int")
    last, following = F.add_months(early, years * 12), F.add_months(early, years * 12 + 12)
    age = years + F.datediff(late, last) / F.datediff(following, last)
    known = since.isNotNull() & as_of.isNotNull()
    return F.when(known, age * F.when(as_of < since, -1.0).otherwise(1.0))


def recency_class(age: Column) -> Column:
    classes = F.when(age.isNull() | F.isnan(age) | (age < 0), S.UNKNOWN_CLASS)
    for limit, label in S.RECENCY_BANDS:
        classes = classes.when(age < limit, label)
    return classes.when(age < float("inf"), S.RECENCY_OLDEST).otherwise(S.UNKNOWN_CLASS)


def coverage_class(pct: Column) -> Column:
    infinite = F.abs(pct) == float("inf")
    classes = F.when(pct.isNull() | F.isnan(pct) | infinite, S.UNKNOWN_CLASS)
    for limit, label in S.COVERAGE_BANDS:
        classes = classes.when(pct >= limit, label)
    return classes.otherwise(S.COVERAGE_LOWEST)


def species_key(code: Column) -> Column:
    return F.nullif(F.upper(F.trim(code)), F.lit(""))


def wood_density(code: Column) -> Column:
    return _lookup(S.WOOD_DENSITY, species_key(code), S.DEFAULT_DENSITY)


def species_name(code: Column) -> Column:
    key = species_key(code)
    return F.coalesce(
        F.nullif(_lookup(S.SPECIES_NAMES, key, ""), F.lit("")),
        F.concat(F.lit(f"{S.OTHER_SPECIES} ("), key, F.lit(")")),
        F.lit(S.OTHER_SPECIES),
    )


def tco2e(volume_m3: Column, code: Column) -> Column:
    return tco2e_of(volume_m3, wood_density(code))


def tco2e_of(volume_m3: Column, density: Column) -> Column:
    factor = S.BIOMASS_EXPANSION * S.CARBON_FRACTION * S.CO2_PER_CARBON
    return volume_m3 * density * F.lit(factor)


def joined_labels(c: Column, separator: str = " + ") -> Column:
    """Aggregate: sorted distinct known labels in one string."""
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def steady_sum(value: Column) -> Column:
    """Aggregate: the sum of doubles, the same in any order of the rows.

    Whole parts, and the two halves of the 60 binary digits after the point, are added as integers
    and rounded at the end. Where a value is 2⁴⁰ or more, or no number, the plain sum is taken.
    """
    half = float(1 << 30)
    small = F.when(F.abs(value) < float(1 << 40), value)
    whole = F.floor(small)
    scaled = (small - whole) * half
    upper = F.floor(scaled)
    lower = F.floor((scaled - upper) * half)
    a, b, c = (F.sum(part).cast("decimal(20,0)") for part in (whole, upper, lower))
    total = a * F.lit(1 << 60) + b * F.lit(1 << 30) + c
    all_small = F.count(small) == F.count(value)
    return F.when(all_small, total.cast("double") / float(1 << 60)).otherwise(F.sum(value))
