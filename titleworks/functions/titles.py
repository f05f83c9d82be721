"""Title words, series keys and display labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Small words that start many unrelated titles.
FILLER_WORDS = ("no", "wa", "ga", "wo", "ni", "de", "to", "the", "a", "an", "of")
KEY_WORDS = 2


def title_words(title: Column) -> Column:
    """Lower-case words, punctuation removed (letters and digits of any script stay)."""
    spaced = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: (w != "") & ~w.isin(*FILLER_WORDS))


def series_key(title: Column) -> Column:
    """The first two meaningful words; null for a title without any."""
    key = F.array_join(F.slice(title_words(title), 1, KEY_WORDS), " ")
    return F.when(key != "", key)


def first_word(title: Column) -> Column:
    return F.try_element_at(title_words(title), F.lit(1))


def two_words(title: Column) -> Column:
    """The two-word key; null when the title has fewer words."""
    words = title_words(title)
    return F.when(F.size(words) >= KEY_WORDS, F.array_join(F.slice(words, 1, KEY_WORDS), " "))


def key_size(title: Column) -> Column:
    return F.least(F.size(title_words(title)), F.lit(KEY_WORDS))


def slot_key(title: Column, title_id: Column) -> Column:
    """The key under which a list holds one title. Titles without words never share one."""
    return F.coalesce(series_key(title), F.concat(F.lit("#"), title_id.cast("string")))


def series_rule(title: Column) -> Column:
    """What a title asks of its series: how many of the first words must agree, and the words; null without words."""
    return F.concat(key_size(title).cast("string"), F.lit(":"), series_key(title))


def series_codes(title: Column) -> Column:
    """The rules a title fulfils: by its first word, and by its first two."""
    return F.array_compact(F.array(F.concat(F.lit("1:"), first_word(title)), F.concat(F.lit("2:"), two_words(title))))


def same_series(title: Column, other: Column) -> Column:
    """True when the other title starts with this title's key words."""
    return F.coalesce(F.array_contains(series_codes(other), series_rule(title)), F.lit(False))


def title_label(title: Column, kind: Column, year: Column) -> Column:
    """A title with its type and year, unless the title already carries that year."""
    year_text = year.cast("bigint").cast("string")
    year_text = F.when(~F.contains(title, F.concat(F.lit("("), year_text, F.lit(")"))), year_text)
    details = F.concat_ws(", ", F.when(kind != "", kind), year_text)
    return F.when(details != "", F.concat(title, F.lit(" ("), details, F.lit(")"))).otherwise(title)


def title_contains(query: str, *titles: Column) -> Column:
    """Case-insensitive plain-text match in any of the titles."""
    found = F.lit(False)
    for title in titles:
        found = found | F.coalesce(F.contains(F.lower(title), F.lower(F.lit(query))), F.lit(False))
    return found
