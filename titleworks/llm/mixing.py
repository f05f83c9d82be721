"""Mixing sources by a time-varying curriculum, in DataFrame operations only.

Every source has a schedule: its weight as a piecewise linear function of training time, 0 to 1. The
schedule's integral is the source's share of all words; its inverse says when a source's x-th word
is due. Documents get their place in their source's stream from a hash, each take its training
position from the inverted schedule, and positions are range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titleworks.llm.text import word_count
from titleworks.session import settle

SEED = 17


def _none() -> Column:
    return F.lit(0).cast("bigint")


def _segments(knots: str) -> str:
    """SQL: the stretches between knots, each with the integral before it."""
    pairs = f"zip_with(slice({knots}, 1, size({knots}) - 1), slice({knots}, 2, size({knots}) - 1), (a, b) -> named_struct('at', a.at, 'to', b.at, 'w0', a.weight, 'w1', b.weight))"
    return f"""aggregate({pairs}, cast(array() as array<struct<at:double,to:double,w0:double,w1:double,before:double>>), (done, s) -> concat(done, array(named_struct(
        'at', s.at, 'to', s.to, 'w0', s.w0, 'w1', s.w1, 'before', if(size(done) = 0, 0D,
        element_at(done, -1).before + (element_at(done, -1).to - element_at(done, -1).at) * (element_at(done, -1).w0 + element_at(done, -1).w1) / 2)))))"""


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, knots, ...) with segments, area and target.

    The targets add up to `share` of all words, in proportion to the schedules' integrals, but none is
    above `most` times its source's size: what is too much is shared again among the others, until
    none is above. Each round is one sum over the sources; only two numbers reach the driver.
    """
    if share > most:
        raise ValueError("more words are asked for than sources may give")
    last = "element_at(segments, -1)"
    area = F.expr(f"{last}.before + ({last}.to - {last}.at) * ({last}.w0 + {last}.w1) / 2")
    settled = settle(sources.withColumn("segments", F.expr(_segments("knots"))).withColumn("area", area).drop("knots"), "schedules")
    total = settled.agg(F.sum("source_size")).first()[0] or 0
    limit, level = F.col("source_size") * F.lit(float(most)), -1.0
    while True:
        full = limit <= F.col("area") * F.lit(level)
        given, weight = settled.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("area")))).first()
        new = (total * share - given) / weight if weight else level
        if new <= level:
            break
        level = new
    return settled.withColumn("target", F.least(limit, F.col("area") * F.lit(max(level, 0.0))))


def _when_due(x: Column) -> Column:
    """The time at which a share x of the source's schedule has passed."""
    part = F.element_at(F.filter("segments", lambda s: s["before"] <= x * F.col("area")), -1)
    rest = x * F.col("area") - part["before"]
    slope = (part["w1"] - part["w0"]) / (part["to"] - part["at"])
    step = F.when(rest <= 0, 0.0).otherwise(2 * rest / (part["w0"] + F.sqrt(F.greatest(part["w0"] * part["w0"] + 2 * slope * rest, F.lit(0.0)))))
    return F.least(part["to"], part["at"] + step)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): the documents, rows that agree in all three counted together."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    return settle(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")


def sources_of(entries: DataFrame) -> DataFrame:
    """(source, source_size, entries) of the rows of sizes(); null is a source of its own."""
    return entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("entries"))


def _earlier_words(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (source, interval, words, ...) with `earlier`: the words of the source's rows before, by interval and then `order`."""
    sums = rows.groupBy("source", "interval").agg(F.sum("words").alias("sum"))
    before = W.partitionBy("source").orderBy("interval").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("interval").alias("i"), F.coalesce(F.sum("sum").over(before), _none()).alias("before"))
    inside = W.partitionBy("source", "interval").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("interval") == F.col("i"))).drop("s", "i")
    return rows.withColumn("earlier", F.col("before") + F.coalesce(F.sum("words").over(inside), _none())).drop("before")


def _fill(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, at, begin) of the documents behind the prefix that fit, by source and `start`, and (s, filled) of every source.

    A round takes, of the documents no larger than a source's gap, again the prefix in hash order, until none
    fits anywhere. What is too large stays too large, so rounds shrink, and about halve the gap.
    """
    filled = rows.groupBy(F.col("source").alias("s")).agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("start") + F.col("words"))), _none()).alias("filled"))
    left = rows.where(~F.col("fits") & (F.col("words") > 0)).select("source", "start", "words", "rest", "source_size", "entries")
    more = None
    while True:
        able = left.join(filled, F.col("source").eqNullSafe(F.col("s"))).drop("s").where(F.col("words") <= F.col("rest") - F.col("filled"))
        able = able.withColumn("interval", F.floor(F.col("start") / F.col("source_size") * F.ceil(F.sqrt("entries"))))
        able = _earlier_words(able, ["start"]).withColumn("begin", F.col("filled") + F.col("earlier"))
        able = settle(able.withColumn("fits", F.col("begin") + F.col("words") <= F.col("rest")).drop("filled", "interval", "earlier"), "gaps")
        got = able.where("fits").select(F.col("source").alias("s"), F.col("start").alias("at"), "begin", (F.col("begin") + F.col("words")).alias("end"))
        more = got.drop("end") if more is None else more.union(got.drop("end"))
        if got.isEmpty():
            return more, filled
        ends = got.groupBy(F.col("s").alias("t")).agg(F.max("end").alias("end"))
        filled = settle(filled.join(ends, F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.coalesce("end", "filled").alias("filled")), "filled")
        left = able.where(~F.col("fits")).drop("begin", "fits")


def mix(entries: DataFrame, targeted: DataFrame) -> DataFrame:
    """One row for each of sizes(): doc_id, source, size, copies, source_size, target, takes and positions.

    `targeted` comes from targets() over sources_of(). A source is taken whole as often as its target
    allows; of the last round come documents in hash order, each that still fits, then the one document
    whose size is closest to what is still missing, if it brings the sum nearer. So taken words miss the target
    by no more than half of the smallest document left over; nothing is cut. `positions` has one training time, 0 to 1,
    for each take. A source's stream is summed up by about the square root of its documents at a time, in
    hash intervals, so a source with a third of all rows is many small groups. Documents without words
    take no words; rows equal in doc_id, source and size are taken together; reruns give the same rows.
    """
    of_source = targeted.select("source", "source_size", "entries", "target", "segments", "area")
    same = entries["source"].eqNullSafe(of_source["source"])
    rows = entries.join(of_source, same).drop(of_source["source"])
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "size"), 11) * F.lit(2.0**-53)
    groups = F.ceil(F.sqrt("entries"))
    rows = rows.withColumns({"words": F.col("size") * F.col("copies"), "place": place, "interval": F.least(F.floor(place * groups), groups - 1)})
    rows = _earlier_words(rows, ["place", "doc_id", "size"]).withColumnRenamed("earlier", "start")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(_none())
    rows = rows.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    rows = settle(rows.withColumn("fits", F.col("start") + F.col("words") <= F.col("rest")).drop("interval", "place"), "streams")
    more, filled = _fill(rows)
    rows = rows.join(filled, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.join(more, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("words") > 0), "left").drop("s", "at")
    gap = F.col("rest") - F.col("filled")
    off = F.abs(F.col("words") - gap)
    able = ~F.col("fits") & F.col("begin").isNull() & (F.col("words") > 0) & (off < gap)
    last = rows.where(able).groupBy(F.col("source").alias("s")).agg(F.min(F.struct(off.alias("off"), "start")).alias("best")).select("s", F.col("best.start").alias("last"))
    rows = rows.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    extra = able & (F.col("start") == F.coalesce("last", F.lit(-1)))
    rows = rows.withColumns({"extra": extra, "takes": F.col("rounds") + F.when(F.col("fits") | F.col("begin").isNotNull() | extra, 1).otherwise(0)})
    begin = F.when(F.col("extra"), F.col("filled")).otherwise(F.coalesce("begin", "start")) + F.col("words") / 2
    due = lambda k: _when_due(F.least(F.lit(1.0), F.coalesce((k * F.col("source_size") + F.when(k < F.col("rounds"), F.col("start") + F.col("words") / 2).otherwise(begin)) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))))
    positions = F.when(F.col("takes") > 0, F.transform(F.sequence(_none(), F.col("takes") - 1), due)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "copies", "source_size", "target", "takes", positions.alias("positions"))


def in_training_order(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the plan takes it, range-sorted by training position.

    Columns of docs named _words, _id, _source, _size or _position are not supported: rename them first.
    """
    takes = plan.where("takes > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.explode("positions").alias("_position"))
    sized = docs.withColumn("_words", word_count(F.col("text")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    return sized.join(takes, same).orderBy("_position", "_id").select(*docs.columns)
