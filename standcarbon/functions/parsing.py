"""Tolerant parsers for registry values that arrive as text. Anything unusable is NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = r"(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?"
_OFFSET = r"(?:[+-][0-9]{2}(?::?[0-5][0-9](?::?[0-5][0-9])?)?)?"
# Groups 1, 2 and 4, 3 and 5 hold year, month and day; anything else matches with empty groups.
_ISO = (
    r"^(?:([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2}))(?:Z|[\s\S]"
    + _TIME
    + _OFFSET
    + r"Z?)?|[\s\S]*)$"
)


def text(c: Column) -> Column:
    """Trimmed text; blank is NULL."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(_WHITESPACE)), F.lit(""))


def double(c: Column) -> Column:
    """Number as written, infinite if too large, else NULL. Spark alone would also take forms such
    as '1d'."""
    trimmed = F.btrim(c.cast("string"), F.lit(_WHITESPACE))
    # Text that is no number is NULL before the cast, which raises and catches an error for it.
    return F.when(trimmed.rlike(_NUMBER), trimmed).try_cast("double")


def finite_double(c: Column) -> Column:
    """Finite number, else NULL."""
    return finite(double(c))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities of a numeric column."""
    return F.when(F.abs(c) < float("inf"), c)


def integral(number: Column) -> Column:
    """Whole value of a numeric column, NULL for any other."""
    return F.when(number == F.floor(number), number).try_cast("bigint")


def integer(c: Column) -> Column:
    return integral(finite_double(c))


def whole_number_part(c: Column) -> Column:
    """Number truncated towards zero."""
    return finite_double(c).try_cast("bigint")


def stand_record_id(c: Column) -> Column:
    """Identity as kept on a record: the integer, else the text, else empty."""
    return F.coalesce(integer(c).cast("string"), c.cast("string"), F.lit(""))


def stand_join_id(c: Column) -> Column:
    """Identity used to match stands with details: truncated number, else text."""
    return F.coalesce(whole_number_part(c).cast("string"), c.cast("string"))


def iso_date(c: Column) -> Column:
    """Calendar date as written: offsets and Z never shift it."""
    trimmed = F.btrim(c.cast("string"), F.lit(_WHITESPACE))
    return F.regexp_replace(trimmed, _ISO, "$1-$2$4-$3$5").try_cast("date")


def boolean(c: Column) -> Column:
    """Registry spellings of yes and no; numbers count when they are 1 or 0."""
    word = F.lower(F.btrim(c.cast("string"), F.lit(_WHITESPACE)))
    return (
        F.when(word.rlike("^(true|t|yes|y|[+]?0*1([.]0*)?)$"), True)
        .when(word.rlike("^(false|f|no|n|[+-]?0+([.]0*)?)$"), False)
    )
