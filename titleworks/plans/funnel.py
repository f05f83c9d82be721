"""The data funnel: every row from the raw snapshot down to the analysis population."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleworks.functions.cells import is_excluded

# The steps in order, and whether a step that changes nothing is shown.
STEPS = (
    ("Rows in the raw CSV", True),
    ("Rx (adult) titles removed", True),
    ("Duplicate rows removed", True),
    ("CSV titles missing from the database", False),
    ("Titles added by the live API", True),
    ("Database titles from an earlier load", False),
    ("No score", True),
    ("Fewer than 1,000 members", True),
    ("Not yet aired", True),
)


def snapshot_ids(records: DataFrame) -> DataFrame:
    """Per id: raw rows, and rows that survive the exclusion (one shuffle, combined first)."""
    out = is_excluded(F.col("rating"))
    return records.groupBy("mal_id").agg(F.count("*").alias("rows"), F.count_if(~out).alias("kept"))


def snapshot_counts(records: DataFrame) -> DataFrame:
    return snapshot_ids(records).agg(*_snapshot_totals())


def _snapshot_totals() -> list:
    zero = F.lit(0).cast("bigint")
    kept_ids = F.count_if(F.col("kept") > 0)
    return [
        F.coalesce(F.sum("rows"), zero).alias("raw_rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("kept")), zero).alias("rx_removed"),
        (F.coalesce(F.sum("kept"), zero) - kept_ids).alias("duplicates_removed"),
        kept_ids.alias("kept_ids"),
    ]


def source_counts(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshot and stored ids compared both ways, with the later source's share of each."""
    ids = snapshot_ids(records).select("mal_id", "rows", "kept")
    both = ids.join(stored.select("mal_id", "data_source"), "mal_id", "full_outer")
    kept, known = F.coalesce(F.col("kept"), F.lit(0)) > 0, F.col("data_source").isNotNull()
    api = F.col("data_source") == "api"
    return both.agg(
        *_snapshot_totals(),
        F.count_if(kept & ~known).alias("missing"),
        F.count_if(known & ~kept & api).alias("added"),
        F.count_if(known & ~kept & ~api).alias("earlier"),
        F.count_if(kept & known & api).alias("refreshed_by_api"),
    )


def build_funnel(sources: DataFrame, filters: DataFrame) -> tuple[DataFrame, int]:
    """The steps (step, label, change, rows) and the refreshed titles, which change no row count.

    Both inputs are one row of totals, so reading them costs one number each. Raises when the
    steps do not lead to the stored row count.
    """
    s, f = sources.first(), filters.first()
    reached = s.raw_rows - s.rx_removed - s.duplicates_removed - s.missing + s.added + s.earlier
    if reached != f.in_database:
        raise ValueError(f"Funnel reaches {reached} rows but the database has {f.in_database}")
    changes = (
        s.raw_rows, -s.rx_removed, -s.duplicates_removed, -s.missing, s.added, s.earlier,
        f.has_score - f.in_database, f.enough_members - f.has_score, f.has_aired - f.enough_members,
    )
    rows = [
        (i, label, change)
        for i, ((label, always), change) in enumerate(zip(STEPS, changes, strict=True))
        if always or change
    ]
    steps = filters.sparkSession.createDataFrame(rows, "step int, label string, change bigint")
    # Nine rows at most.
    running = F.sum("change").over(Window.orderBy("step"))
    steps = steps.withColumn("rows", running)
    first = F.col("step") == 0
    return steps.withColumn("change", F.when(~first, F.col("change"))), s.refreshed_by_api
