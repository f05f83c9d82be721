"""What filters of a chain remove in every order: failure ids are united, and combinations of failures are counted.

Four filters read one text alone. The fifth is an existential self-join: a left-semi join on text hash, exact
text and smaller doc_id marks every row whose text an earlier document has. The ids of its rows and of the other
filters' failures are united, each row's failures become the bits of a number, and only counts of (part, bits,
labels) remain; all orders and steps are sums of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import flat
from titleworks.session import settle

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 3  # percent of the code points
SYMBOLS = b"#$%&*|"
BROADCAST_HASHES = 500_000  # 20 MB; more repeated hashes are joined by a shuffle
COPIES_A_TASK = 4096  # rows of one text that meet its earliest document in one task

_CAPITALS = bytes(range(65, 91))
_KEY = ["doc_id", "lang", "hash", "check"]


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at 20 and 09-0D hex, nothing else
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    bits = BIT["A"] if len(words) < LEAST_WORDS else 0
    bits |= BIT["B"] if 100 * len(set(words)) < LEAST_DISTINCT * len(words) else 0
    bits |= BIT["C"] if 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * points else 0
    return bits | (BIT["D"] if len(text.translate(None, SYMBOLS)) < len(text) else 0)


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, hash, check, bits) of every row; texts end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(4))
            whole = memoryview(data)
            bits = [failures(bytes(whole[low:high])) for low, high in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(np.array(bits, np.int32))], names=[*_KEY, "bits"])

    return docs.select(*_KEY, "text").mapInArrow(run, "doc_id bigint, lang string, hash bigint, check bigint, bits int")


def _later_copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The keys of rows whose whole text a row with a smaller doc_id has.

    Only rows whose hash occurs again take part, so other texts are never shuffled. Of each text in a task one row,
    its smallest id, goes to meet the others; a text with very many rows is dealt to several tasks.
    """
    again = rows.groupBy("hash").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")).where("rows > 1")
    again = settle(again.select("hash", "first", F.ceil(F.col("rows") / COPIES_A_TASK).cast("int").alias("parts")), "hashes")
    found = docs.join(F.broadcast(again) if again.count() <= BROADCAST_HASHES else again, "hash")
    earliest = found.where("doc_id is not null").groupBy("hash", "text", "parts").agg(F.min("doc_id").alias("earlier"))
    earliest = earliest.select("hash", F.col("text").alias("same"), "earlier", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    later = found.where("doc_id > first").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    meets = (later["hash"] == earliest["hash"]) & (later["part"] == earliest["part"]) & (later["text"] == earliest["same"]) & (earliest["earlier"] < later["doc_id"])
    return later.join(earliest, meets, "left_semi").select(*_KEY)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): how many rows of a language fail exactly the filters of bits, by their labels."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    docs = docs.withColumns({"hash": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), F.col("text"))})
    rows = settle(_judged(docs), "judged")
    alone = [rows.where(F.col("bits").bitwiseAND(BIT[f]) != 0).select(*_KEY, F.lit(BIT[f]).alias("bits"), F.lit(0).alias("n")) for f in "ABCD"]
    copies = _later_copies(docs, rows).select(*_KEY, F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("n"))
    failed = rows.select(*_KEY, F.lit(0).alias("bits"), F.lit(1).alias("n"))
    for other in [*alone, copies]:
        failed = failed.union(other)
    each = failed.groupBy(*_KEY).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    each = each.groupBy("doc_id", "lang", "bits").agg(F.sum("n").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    known = each.join(marks, "doc_id", "left").groupBy(F.col("lang").alias("part"), "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return known.agg(F.sum("n").alias("n"))


def _steps(spark) -> DataFrame:  # noqa: ANN001
    """(filter_order, step, bit, before) for every order of the filters and each of its steps; before: bits of the earlier filters."""
    rows = [("".join(p), k + 1, BIT[p[k]], sum(BIT[f] for f in p[:k])) for p in permutations(FILTERS) for k in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per language, order of the five filters and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley), counts of rows of docs (doc_id, text, lang, ...).

    Null texts count as empty and fail A; null languages are the empty string. A row with a null doc_id is judged by A to
    D, but fails E never and is nobody's earlier document: null is not smaller than any id. Rows that repeat a doc_id
    and a text are equal, so neither is the other's later copy. A document is good or toxic if any row of labels
    (doc_id, quality, toxic) says so. An empty table gives no rows; other columns are ignored.
    """
    cells = settle(combinations(docs, labels), "combinations")
    steps = _steps(docs.sparkSession)
    pairs = [(bit, before) for bit in BIT.values() for before in range(1 << len(FILTERS)) if not before & bit]
    pair = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in pairs])
    asked = cells.withColumn("x", F.explode(pair)).select("part", "bits", "good", "toxic", "n", "x.bit", "x.before")
    fails, earlier = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    count = lambda which, n=F.col("n"): F.sum(F.when(which, n).otherwise(0)).cast("bigint")
    orders = F.lit(len(list(permutations(FILTERS))))
    sums = asked.groupBy("part", "bit", "before").agg(
        count(~fails & ~earlier).alias("kept"),
        count(fails & ~earlier).alias("removed"),
        count(fails & earlier).alias("redundant"),
        count(F.col("bits") == F.col("bit")).alias("unique_fails"),
        count(fails & ~earlier & F.col("good")).alias("good_lost"),
        count(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
        # of the filters a row fails, each is the first in equally many of the orders
        count(fails, F.col("n") * (orders / F.greatest(F.bit_count("bits"), F.lit(1))).cast("bigint")).alias("shapley"),
    )
    return sums.join(F.broadcast(steps), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
