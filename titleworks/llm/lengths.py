"""Exact token counts: a histogram of encoded lengths answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleworks.llm.encoder import encoder
from titleworks.llm.text import flat
from titleworks.session import settle

SPAN = 1024  # lengths whose sums are added up together before the sums of spans are


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) of every row: ids of the whole text, none for null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            data, at = flat(batch.column(1))
            whole = memoryview(data)
            counts = [own.count(bytes(whole[low:high])) for low, high in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def length_table(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs: n_tokens, docs, docs_longer, tokens_longer, docs_at_most,
    tokens_at_most and tokens_cut (what is left if every document is cut to that length).

    Only the counts by length are shuffled, and their sums by span of lengths are all that one task
    adds up. An empty table gives no rows; repeated rows count again; null lengths are left out.
    """
    by_length = settle(lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths")
    by_length = by_length.withColumns({"span": F.floor(F.col("n_tokens") / SPAN), "tokens": F.col("n_tokens") * F.col("docs")})
    sums = by_length.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    rest = {f"{name}_{side}": F.coalesce(F.sum(c).over(w), none) for name, c in (("d", "d"), ("t", "t")) for side, w in (("after", later), ("before", earlier))}
    spans = sums.select("span", *[v.alias(k) for k, v in rest.items()])
    above = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("span").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    table = by_length.join(spans, "span").select(
        "n_tokens",
        "docs",
        (F.col("d_after") + F.coalesce(F.sum("docs").over(above), none)).alias("docs_longer"),
        (F.col("t_after") + F.coalesce(F.sum("tokens").over(above), none)).alias("tokens_longer"),
        (F.col("d_before") + F.sum("docs").over(below)).alias("docs_at_most"),
        (F.col("t_before") + F.sum("tokens").over(below)).alias("tokens_at_most"),
    )
    return table.withColumn("tokens_cut", F.col("tokens_at_most") + F.col("n_tokens") * F.col("docs_longer"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs, docs_longer, tokens, tokens_cut, docs_empty) for each given limit, from a length table."""
    limit = F.explode(F.array([F.lit(x).cast("bigint") for x in limits])).alias("context_limit")
    longer = F.col("n_tokens") > F.col("context_limit")
    cut = F.col("docs") * F.least("n_tokens", "context_limit")
    return table.select("n_tokens", "docs", limit).groupBy("context_limit").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.when(longer, F.col("docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens"),
        F.sum(cut).alias("tokens_cut"),
        F.sum(F.when(F.col("n_tokens") == 0, F.col("docs")).otherwise(0)).alias("docs_empty"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    share = F.explode(F.array([F.lit(float(x)) for x in shares])).alias("share")
    total = F.col("docs_at_most") + F.col("docs_longer")
    rows = table.select("n_tokens", "docs_at_most", total.alias("total"), share)
    return rows.where("docs_at_most >= share * total").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
