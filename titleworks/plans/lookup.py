"""Lookups over the result tables: point reads, search, filters, picks and overview numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleworks.functions.titles import title_contains, title_label
from titleworks.operators.substrings import NAMES_AT_ONCE, Texts
from titleworks.plans.marts import watched
from titleworks.session import settle

SUMMARY = ["mal_id", "title", "title_english", "type", "year", "score", "members"]


# Rows in a pack: titles of which a query's first ones are kept, and queries that are looked for at once.
TITLES_PACKED, QUERIES_PACKED = 100_000, 200_000


class UnknownTitle(LookupError):
    """The id is not in the catalog (a known title may still have no picks)."""


def find(catalog: DataFrame, title_id: int) -> DataFrame:
    return catalog.where(F.col("mal_id") == title_id)


def search(catalog: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Titles containing the text, most watched first."""
    if not query or not 1 <= limit <= 50:
        raise ValueError("a query needs text and a limit from 1 to 50")
    hits = catalog.where(title_contains(query, F.col("title"), F.col("title_english")))
    return hits.select(*SUMMARY).orderBy(F.desc_nulls_last("members"), "mal_id").limit(limit)


def _in_bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in packs of `size` or a little more, as bytes."""
    held, n = [], 0

    def pack() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for rows in held:
                out.write_batch(rows)
        return pa.RecordBatch.from_pydict({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= size:
            yield pack()
            held, n = [], 0
    if n:
        yield pack()


def _first_hits(asked: Texts, titles: pa.Table, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, title) by number: of each query the first `limit` of these titles (or all) that hold it, in the order of `search`."""
    hits = [np.empty((2, 0), np.int64)]
    for at in range(0, len(titles), NAMES_AT_ONCE):
        part = titles.slice(at, NAMES_AT_ONCE)
        for name in ("title", "title_english"):
            hits += [np.array([query, row + at]) for query, row in asked.found(part[name].combine_chunks())]
    query, row = np.concatenate(hits, axis=1)
    members = titles["members"].combine_chunks()
    none, members, ids = members.is_null().to_numpy(zero_copy_only=False), members.fill_null(0).to_numpy(), titles["mal_id"].combine_chunks().to_numpy()
    order = np.lexsort((row, ids[row], -members[row], none[row], query))
    query, row = query[order], row[order]
    once = np.flatnonzero(np.r_[True, (np.diff(query) != 0) | (np.diff(row) != 0)][: len(query)])  # a title may hold a query at several places
    query, row = query[once], row[once]
    if limit is None:
        return query, row
    first = np.r_[True, np.diff(query) != 0][: len(query)]
    place = np.arange(len(query))
    keep = place - np.maximum.accumulate(np.where(first, place, 0)) < limit
    return query[keep], row[keep]


def _hits(names: DataFrame, packs: DataFrame, limit: int | None) -> DataFrame:
    """(query, mal_id, members): of each query the titles that hold it, or the first ones of each pack of titles.

    The titles are not shuffled: each pack of them meets all packs of queries, which every task reads.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = texts = None
        for batch in batches:
            for own, packed in zip(*batch.columns, strict=True):
                wanted = packed.as_buffer()
                if last is None or not wanted.equals(last):
                    last = pa.py_buffer(wanted.to_pybytes())
                    queries = pa.ipc.open_stream(last).read_all()["query"].combine_chunks()
                    texts = Texts(queries)
                rows = pa.ipc.open_stream(own.as_buffer()).read_all()
                query, row = (pa.array(x) for x in _first_hits(texts, rows, limit))
                found = rows.take(row)
                yield pa.RecordBatch.from_arrays([queries.take(query), *(found[name].combine_chunks() for name in ("mal_id", "members"))], names=["query", "mal_id", "members"])

    left = names.mapInArrow(lambda batches: _in_bytes(batches, TITLES_PACKED), "packed binary")
    right = packs.withColumnRenamed("packed", "wanted").coalesce(1).hint("shuffle_replicate_nl")
    return left.crossJoin(right).select("packed", "wanted").mapInArrow(look, "query string, mal_id bigint, members bigint")


def search_many(catalog: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """`search` for a table of queries (query_id, query): (query_id, rank, ...), up to `limit` titles each.

    A title's runs of letters of the queries' lengths are looked up among the queries, so a query meets only the titles
    that hold it, and of these only the first ones leave a task. Queries that are null or empty find nothing; equal
    queries under several ids are answered for each; ids should be unique. A title's id too: one under which several
    rows hold the query is not found (as ever).
    """
    if not 1 <= limit <= 50:
        raise ValueError("a limit is from 1 to 50")
    folded = F.lower("query")
    asked = settle(queries.where(F.length("query") > 0).select("query_id", folded.alias("query")), "asked")
    order = [F.desc_nulls_last("members"), F.col("mal_id")]
    packs = settle(asked.select("query").distinct().coalesce(1).mapInArrow(lambda batches: _in_bytes(batches, QUERIES_PACKED), "packed binary"), "queries")
    names = settle(catalog.where("mal_id is not null").select(
        F.col("mal_id").cast("bigint"), F.col("members").cast("bigint"), F.lower("title").alias("title"), F.lower("title_english").alias("title_english")
    ), "names")
    repeated = settle(names.groupBy("mal_id").agg(F.count("*").alias("n")).where("n > 1").select("mal_id"), "repeated")
    if repeated.isEmpty():
        hits = _hits(names, packs, limit)
    else:
        several = _hits(names.join(repeated, "mal_id", "left_semi"), packs, None)
        once = several.groupBy("query", "mal_id").agg(F.count("*").alias("n"), F.max("members").alias("members")).where("n = 1").drop("n")
        hits = _hits(names.join(repeated, "mal_id", "left_anti"), packs, limit).unionByName(once)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    likely = settle(hits.where(F.col("rank") <= limit).select("query", "mal_id"), "hits")
    rows = asked.join(likely, "query").join(catalog.select(*SUMMARY), "mal_id")
    holds = [F.coalesce(F.contains(F.lower(name), F.col("query")), F.lit(False)) for name in ("title", "title_english")]
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.where(holds[0] | holds[1]).withColumn("rank", best).where(F.col("rank") <= limit).select("query_id", "rank", *SUMMARY)


def recommend(catalog: DataFrame, recs: DataFrame, title_id: int, k: int = 10) -> DataFrame:
    """Up to k picks for a title, best first."""
    if not 1 <= k <= 10:
        raise ValueError("k is from 1 to 10")
    if find(catalog, title_id).isEmpty():
        raise UnknownTitle(f"no title with id {title_id}")
    return picks_with_titles(catalog, recs.where((F.col("anime_id") == title_id) & (F.col("rank") <= k))).orderBy("rank")


def picks_with_titles(catalog: DataFrame, recs: DataFrame) -> DataFrame:
    """Picks of any number of titles with the picked titles' facts; the rank is within a list."""
    score = F.round(F.col("similarity").cast("double"), 4).alias("match_score")
    facts = catalog.select(F.col("mal_id").alias("similar_id"), *SUMMARY)
    return recs.join(facts, "similar_id").select("anime_id", "rank", score, *SUMMARY)


def picks_table(catalog: DataFrame, recs: DataFrame) -> DataFrame:
    """Picks with a display label and the tags both titles have."""
    own = catalog.select(F.col("mal_id").alias("anime_id"), F.col("genres").alias("own"))
    other = catalog.select(F.col("mal_id").alias("similar_id"), "title", "type", "year", "score", "genres")
    label = title_label(F.col("title"), F.col("type"), F.col("year"))
    return (
        recs.join(own, "anime_id")
        .join(other, "similar_id")
        .select(
            "anime_id", "rank", "similar_id", label.alias("label"),
            F.round(F.col("similarity").cast("double"), 4).alias("match_score"),
            F.sort_array(F.array_intersect("own", "genres")).alias("shared"), "score",
        )
    )


def filter_catalog(
    catalog: DataFrame,
    types: list[str] | None = None,
    years: tuple[int, int] | None = None,
    genre: str | None = None,
    studio: str | None = None,
    min_members: int = 0,
) -> DataFrame:
    """Titles passing every given filter; undated titles stay only when no years are given."""
    kept = catalog
    if types:
        kept = kept.where(F.col("type").isin(*types))
    if years is not None:
        kept = kept.where(F.col("year").between(*years))
    if genre:
        kept = kept.where(F.array_contains("genres", genre))
    if studio:
        kept = kept.where(F.array_contains("studios", studio))
    if min_members > 0:
        kept = kept.where(F.col("members") >= min_members)
    return kept


def explore(matches: DataFrame) -> DataFrame:
    """The table to show: lists as text, most watched first."""
    joined = {c: F.concat_ws(", ", c) for c in ("genres", "studios")}
    return matches.withColumns(joined).orderBy(F.desc_nulls_last("members"), "mal_id").drop("mal_id")


def list_options(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.select(F.explode(column).alias("option")).distinct().orderBy("option")


def score_histogram(scores: DataFrame, width: float = 0.25) -> DataFrame:
    """Titles per score bin; bins start on a multiple of the width and empty ones are kept."""
    step = F.lit(width)
    bins = scores.where("score is not null").select((F.col("score").cast("double") / step).alias("s"))
    counts = bins.groupBy(F.floor("s").alias("bin")).agg(F.count("*").alias("count"), F.max("s").alias("top"))
    # One row per bin from here on.
    ends = counts.agg(F.min("bin").alias("low"), F.ceil(F.max("top")).alias("high"))
    every = ends.where("low is not null").select(F.explode(F.sequence("low", "high")).alias("bin"))
    start = F.round(F.col("bin") * step, 2)
    label = F.format_string("%.2f-%.2f", start, F.round((F.col("bin") + 1) * step, 2))
    return (
        every.join(counts.select("bin", "count"), "bin", "left")
        .select(start.alias("bin_start"), label.alias("label"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
        .orderBy("bin_start")
    )


def bin_label_for(histogram: DataFrame, value: float) -> DataFrame:
    """The label of the bin that holds a value (the first bin for one below all)."""
    fits = F.max_by("label", F.when(F.col("bin_start") <= value, F.col("bin_start")))
    return histogram.agg(F.coalesce(fits, F.min_by("label", "bin_start")).alias("label"))


def overview(catalog: DataFrame, recs: DataFrame) -> DataFrame:
    """Numbers for the first page. Scores have two decimals, so exact quartiles stay small."""
    scores = catalog.where(watched()).groupBy(F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n"))
    quartiles = scores.agg(
        F.sum("n").alias("scored_titles"),
        *[F.percentile("score", p, F.col("n")).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
    )
    lists = recs.agg(F.count_distinct("anime_id").alias("titles_with_recommendations"))
    total = catalog.agg(F.count("*").alias("titles"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(total).join(one(quartiles), "_one").join(one(lists), "_one").drop("_one")


def as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text; empty values are written as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
