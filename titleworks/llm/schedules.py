"""The schedules that the queries mix sources by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.operators.ranks import row_numbers


def _knots(*weights: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(at).alias("at"), F.lit(weight).alias("weight")) for at, weight in weights])


def weighed(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, with schedules whose integrals are 3, 1, 2, repeating: falling, level, rising."""
    numbered = row_numbers(sources, [F.col("source").isNull(), F.col("source")], "number")
    kind = F.pmod(F.col("number") - 1, F.lit(3))
    knots = F.when(kind == 0, _knots((0.0, 4.0), (1.0, 2.0))).when(kind == 1, _knots((0.0, 1.0), (1.0, 1.0))).otherwise(_knots((0.0, 1.0), (1.0, 3.0)))
    return numbered.withColumn("knots", knots).drop("number")
