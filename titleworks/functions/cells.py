"""Column expressions that turn messy text cells into clean single values.

Everything here is a built-in expression, so it runs inside the scan's generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Durations, season names, legal suffixes.
UNIT_SECONDS = {"hr": 3600, "min": 60, "sec": 1}
SEASONS = ("winter", "spring", "summer", "fall")
COMPANY_SUFFIXES = ("Inc.", "Inc", "Ltd.", "Ltd", "LLC", "LLC.")

# Every character that counts as white space in a text cell.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_COMMA = f"[{WHITE_SPACE}]*,[{WHITE_SPACE}]*"
_BETWEEN = "\x01"
_DURATION = r"(?U)([0-9]+)\s*(hr|min|sec)"
# ISO 8601 date, extended or basic, with an optional clock time and offset.
_HOUR, _SIXTY = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_CLOCK = rf"{_HOUR}(?::?{_SIXTY}(?::?{_SIXTY}(?:[.,]\d+)?)?)?"
_OFFSET = rf"(?:Z|[+-]{_HOUR}(?::?{_SIXTY}(?::?{_SIXTY}(?:[.,]\d+)?)?)?)?"
# The whole text is replaced, so a text that is no date leaves "--", which is no date either.
_ISO = rf"(?s)^(?:(\d{{4}})(-?)(\d{{2}})\2(\d{{2}})(?:.{_CLOCK}{_OFFSET})?|.*)$"


def trim_all(cell: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.trim(cell, F.lit(WHITE_SPACE))


def clean_text(cell: Column) -> Column:
    """The trimmed text, or null for an empty cell."""
    return F.nullif(trim_all(cell.cast("string")), F.lit(""))


def clean_float(cell: Column) -> Column:
    """A number, or null for an empty, unreadable or not-a-number cell."""
    return F.nanvl(clean_text(cell).try_cast("double"), F.lit(None).cast("double"))


def clean_int(cell: Column) -> Column:
    """A whole number (truncated, so "28.0" is 28), or null."""
    return clean_float(cell).try_cast("bigint")


def clean_score(cell: Column) -> Column:
    return clean_float(cell).try_cast("decimal(4,2)")


def unreadable_number(cell: Column) -> Column:
    """True where a cell holds text that is not a number: such cells become null, so count them."""
    return clean_text(cell).isNotNull() & clean_text(cell).try_cast("double").isNull()


def duration_minutes(cell: Column) -> Column:
    """Minutes in texts such as "1 hr 55 min"; at least 1, null when there is no time in them."""
    text = clean_text(cell)
    amounts = F.regexp_extract_all(text, F.lit(_DURATION), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_DURATION), F.lit(2))
    per_unit = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    parts = F.zip_with(amounts, units, lambda n, u: n.try_cast("bigint") * per_unit[u])
    seconds = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total + part)
    one = F.lit(1).cast("bigint")
    # A one-element list names the sum, which is used twice but should be computed once.
    minutes = lambda s: F.when(s > 0, F.greatest(one, F.bround(s / F.lit(60)).cast("bigint")))
    return F.transform(F.array(seconds), minutes)[0]


def air_date(cell: Column) -> Column:
    """The day written in an ISO date text, as local to that text (no time zone shift)."""
    return F.regexp_replace(clean_text(cell), _ISO, "$1-$3-$4").try_cast("date")


def air_year(cell: Column) -> Column:
    return F.year(air_date(cell)).cast("bigint")


def release_year(year: Column, aired: Column) -> Column:
    return F.coalesce(clean_int(year), air_year(aired))


def release_season(season: Column, aired: Column) -> Column:
    """The listed season when it is a known one, else the quarter the title started in."""
    known = F.lower(clean_text(season))
    # get(), because element_at() takes a null position of a constant array as the last one.
    by_month = F.get(F.array(*[F.lit(s) for s in SEASONS]), F.quarter(air_date(aired)) - 1)
    return F.when(known.isin(*SEASONS), known).otherwise(by_month)


def split_list(cell: Column) -> Column:
    """Comma-separated names as an array; empty and "Unknown" cells give an empty array."""
    return listed_names(clean_text(cell))


def listed_names(text: Column) -> Column:
    """The names of a trimmed text or null. It is used several times, so it should be a column and not an expression."""
    # Cut at plain commas: a pattern to split by would be compiled for every cell, one to replace by is kept.
    pieces = F.array_remove(F.split(F.regexp_replace(text, _COMMA, ","), ","), "")
    no_names = F.array().cast("array<string>")
    return F.when(text.isNull() | (F.lower(text) == "unknown"), no_names).otherwise(pieces)


def split_companies(cell: Column) -> Column:
    """Like split_list, but a piece that is only a legal suffix joins the name before it."""
    return listed_companies(clean_text(cell))


def listed_companies(text: Column) -> Column:
    """Like listed_names, with legal suffixes joined to the names before them."""
    suffixes = "|".join(s.replace(".", r"\.") for s in sorted(COMPANY_SUFFIXES, reverse=True))
    joined = F.array_join(listed_names(text), _BETWEEN)
    glued = F.regexp_replace(joined, f"{_BETWEEN}({suffixes})(?={_BETWEEN}|$)", ", $1")
    return F.array_remove(F.split(glued, _BETWEEN), "")


def is_excluded(rating: Column) -> Column:
    """Adult titles. A title without a rating is kept."""
    return F.coalesce(rating, F.lit("")).startswith("Rx")


def effect_label(effect: Column) -> Column:
    return (
        F.when(effect < 0.01, "negligible")
        .when(effect < 0.06, "small")
        .when(effect < 0.14, "medium")
        .otherwise("large")
    )


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The mapped text for a key, or the key itself."""
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), mapping.items(), F.when(key.isNull(), key)).otherwise(key)
