"""Source rows to clean records: one shape for both sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.functions import cells as C
from titleworks.schemas import COMPANY_ROLES, INTEGER_COLUMNS, TAG_FAMILIES

COMPANY = "struct<name: string, role: string, mal_id: bigint>"


def _record(df: DataFrame, tags: Column, companies: Column, source: str, *extra: str) -> DataFrame:
    text = lambda name: C.clean_text(F.col(name)).alias(name)
    types = dict(df.dtypes)
    whole = lambda name: (F.col(name) if types[name] == "bigint" else C.clean_int(F.col(name))).alias(name)
    return df.select(
        whole("mal_id"),
        *[text(name) for name in ("title", "title_english", "type", "source")],
        whole("episodes"),
        C.duration_minutes(F.col("duration")).alias("duration_min"),
        text("rating"),
        text("synopsis"),
        C.release_season(F.col("season"), F.col("aired_from")).alias("season"),
        C.release_year(F.col("year"), F.col("aired_from")).alias("year"),
        *[text(name) for name in ("broadcast_day", "broadcast_time", "status")],
        C.clean_score(F.col("score")).alias("score"),
        *[whole(name) for name in ("scored_by", "members", "favorites")],
        F.lit(source).alias("data_source"),
        tags.alias("tags"),
        companies.cast(f"array<{COMPANY}>").alias("companies"),
        *extra,
    )


def clean_snapshot(rows: DataFrame, source: str = "kaggle", *extra: str) -> DataFrame:
    """Snapshot rows (text cells) to clean records; `extra` columns pass through."""
    # A column for each step, because an expression that is used several times would be computed as often.
    texts = rows.withColumns({field: C.clean_text(F.col(field)) for field in (*TAG_FAMILIES, *COMPANY_ROLES)})
    lists = texts.withColumns({field: C.listed_companies(F.col(field)) for field in COMPANY_ROLES})
    tags = F.concat(*[C.listed_names(F.col(field)) for field in TAG_FAMILIES])

    def credits(field: str, role: str) -> Column:
        each = lambda value: F.array_repeat(value, F.size(field))
        # Zipped and not transformed: what is inside a lambda runs outside generated code.
        return F.arrays_zip(F.col(field).alias("name"), each(F.lit(role)).alias("role"), each(F.lit(None).cast("bigint")).alias("mal_id"))

    companies = F.concat(*[credits(field, role) for field, role in COMPANY_ROLES.items()])
    return _record(lists, tags, companies, source, *extra)


def clean_items(items: DataFrame, source: str = "api", *extra: str) -> DataFrame:
    """Service items (a struct column named item) to the same clean records."""
    flat = items.select(
        "item.*",
        F.col("item.aired.from").alias("aired_from"),
        F.col("item.broadcast.day").alias("broadcast_day"),
        F.col("item.broadcast.time").alias("broadcast_time"),
        *extra,
    )

    def entries(field: str, entry) -> Column:  # noqa: ANN001
        made = F.transform(F.col(field), entry)
        return F.coalesce(made, F.filter(made, lambda _: F.lit(False)), F.array())

    def credit(role: str):  # noqa: ANN202
        return lambda x: F.struct(
            x["name"].alias("name"), F.lit(role).alias("role"), x["mal_id"].alias("mal_id")
        )

    tags = F.concat(*[entries(field, lambda x: x["name"]) for field in TAG_FAMILIES])
    companies = F.concat(*[entries(field, credit(role)) for field, role in COMPANY_ROLES.items()])
    return _record(flat, tags, companies, source, *extra)


def drop_excluded(records: DataFrame) -> DataFrame:
    return records.where(~C.is_excluded(F.col("rating")))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    return df.groupBy(key).agg(best).select(key, "last.*").select(*df.columns)


def prepare_counted(records: DataFrame, key: str = "mal_id", order: str = "_seq") -> DataFrame:
    """Per id: its raw rows, how many are excluded, and the last record that is not (or null).

    One pass gives both the prepared records and the numbers of what was dropped.
    """
    out = C.is_excluded(F.col("rating"))
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(
        F.count("*").alias("_rows"),
        F.count_if(out).alias("_out"),
        F.max_by(F.struct(*rest), F.when(~out, F.col(order))).alias("last"),
    )


def prepare(records: DataFrame, key: str = "mal_id", order: str = "_seq") -> DataFrame:
    """Drop excluded titles, then keep the last record of every id."""
    return prepared_rows(prepare_counted(records, key, order), key)


def prepared_rows(counted: DataFrame, key: str = "mal_id") -> DataFrame:
    return counted.where("_rows > _out").select(key, "last.*")


def dropped_counts(counted: DataFrame) -> DataFrame:
    """Raw rows, and how many the exclusion and the de-duplication drop; one row."""
    zero, kept = F.lit(0).cast("bigint"), F.count_if(F.col("_rows") > F.col("_out"))
    return counted.agg(
        F.coalesce(F.sum("_rows"), zero).alias("raw_rows"),
        F.coalesce(F.sum("_out"), zero).alias("rx_dropped"),
        (F.coalesce(F.sum(F.col("_rows") - F.col("_out")), zero) - kept).alias("duplicates_dropped"),
        kept.alias("kept"),
    )


def prepare_counts(records: DataFrame, key: str = "mal_id") -> DataFrame:
    """The dropped counts alone, reading only the id and the rating."""
    out = C.is_excluded(F.col("rating"))
    return dropped_counts(records.groupBy(key).agg(F.count("*").alias("_rows"), F.count_if(out).alias("_out")))


def unreadable_counts(rows: DataFrame) -> DataFrame:
    """Per whole-number column, cells holding text that is no number (they become null)."""
    counts = [F.count_if(C.unreadable_number(F.col(c))).alias(c) for c in INTEGER_COLUMNS if c in rows.columns]
    return rows.agg(*counts)
