"""One interpretable regression: least squares, robust (HC3) errors, cross-validation.

Executors turn their rows into small cross-product matrices (terms x terms). Only the sums of
those reach the driver, so the rows are read twice and never move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.functions.probability import normal_two_sided

# Fields measured after release, which must never explain the score.
OUTCOMES = ("score", "scored_by", "members", "favorites", "rank", "popularity")
MOST_TERMS = 500  # default of design(): the driver solves a matrix of terms x terms
SUMS = "fold int, i int, j int, v double"


def known_before(df: DataFrame, values: dict[str, Column]) -> None:
    """Fail if a term reads what is only known after release, under whatever name.

    The terms are analysed over the rows without those fields: an expression that needs one is refused.
    """
    early = df.drop(*OUTCOMES)
    for term, value in values.items():
        try:
            early.select(value).schema  # noqa: B018 - analysis alone, no job
        except AnalysisException as error:
            raise ValueError(f"term {term!r} cannot be computed from fields known before release") from error


def level_counts(df: DataFrame, categorical: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in categorical])
    return df.select(F.inline(pairs)).where("level is not null").groupBy("factor", "level").agg(F.count("*").alias("n"))


def reference_levels(levels: DataFrame) -> DataFrame:
    """The most common level of every category (ties: first by name)."""
    place = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("n"), "level"))
    return levels.withColumn("place", place).where("place = 1").select("factor", F.col("level").alias("reference"))


@dataclass
class Design:
    """Terms in order (without the constant), each with its expression, and the references."""

    terms: list[str]
    values: list[Column]
    references: dict[str, str]


def design(
    df: DataFrame, numeric: dict[str, Column], categorical: list[str], indicators: dict[str, Column], most_terms: int = MOST_TERMS
) -> Design:
    """Numbers as they are, indicators as 0/1, one 0/1 term per level but the most common one.

    More than `most_terms` terms are refused: sums of terms x terms numbers per fold reach the driver.
    """
    known_before(df, numeric | {c: F.col(c) for c in categorical} | indicators)
    counts = level_counts(df, categorical).cache() if categorical else None
    references: dict[str, str] = {}
    terms, values = list(numeric), [c.cast("double") for c in numeric.values()]
    terms += list(indicators)
    values += [c.cast("double") for c in indicators.values()]
    if counts is not None:
        references = {r.factor: r.reference for r in reference_levels(counts).collect()}
        # The matrix has one column per level, so their number is checked before it is read.
        levels = counts.select("factor", "level").limit(most_terms + 1).collect()
        counts.unpersist()
        if len(levels) + len(terms) > most_terms:
            raise ValueError(f"more than {most_terms} terms: group rare levels first")
        for factor in categorical:
            for level in sorted(r.level for r in levels if r.factor == factor):
                if level != references[factor]:
                    terms.append(f"{factor}={level}")
                    values.append((F.col(factor) == level).cast("double"))
    return Design(terms, values, references)


def nonzero_entries(df: DataFrame, key: str, made: Design) -> DataFrame:
    """The design matrix in long form: one row per non-zero entry."""
    entries = F.array(*[F.struct(F.lit(t).alias("term"), v.alias("value")) for t, v in zip(made.terms, made.values, strict=True)])
    return df.select(key, F.inline(F.filter(entries, lambda e: e["value"] != 0)))


def fold_of(key: Column, folds: int) -> Column:
    """A fold from the id alone, so it does not depend on how the rows are laid out."""
    low = F.pmod(key, F.lit(1 << 31))  # the product then stays below 2 ** 63 for any id
    return F.pmod(low * F.lit(2654435761) % F.lit(4294967296), F.lit(folds)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield z, batch.column(1).to_numpy(zero_copy_only=False)


def _sums(matrices: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for fold, m in matrices.items():
        i, j = np.triu_indices(m.shape[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), fold, "int32")), pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(m[i, j])],
            names=["fold", "i", "j", "v"],
        )


def _collect(rows: DataFrame, work: Callable, size: int) -> dict[int, np.ndarray]:
    """Sum the executors' matrices on the cluster; the driver gets terms x terms numbers per fold."""
    sums = rows.mapInArrow(work, SUMS).groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    result = {}
    for fold, part in sums.groupby("fold"):
        m = np.zeros((size, size))
        m[part.i, part.j] = part.v
        result[int(fold)] = m + np.triu(m, 1).T
    return result


def cross_products(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for z, fold in _blocks(batches):
            for f in np.unique(fold):
                part = z[fold == f]
                found[int(f)] = found.get(int(f), 0.0) + part.T @ part
        yield from _sums(found)

    return _collect(rows, work, size)


def robust_sums(rows: DataFrame, inverse: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum of x x' (e / (1 - h))^2 and of e^2, with leverage h and residual e of every row."""
    p = len(beta)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for z, _ in _blocks(batches):
            x, e = z[:, :p], z[:, p] - z[:, :p] @ beta
            room = 1.0 - np.einsum("ij,jk,ik->i", x, inverse, x, optimize=True)
            # A row that alone decides a coefficient fits exactly and has no error to add.
            w = np.divide(e, room, out=np.zeros_like(e), where=room > 1e-10)
            total[:p, :p] += (x * (w * w)[:, None]).T @ x
            total[p, p] += e @ e
        yield from _sums({0: total})

    m = _collect(rows, work, p + 1).get(0, np.zeros((p + 1, p + 1)))
    return m[:p, :p], float(m[p, p])


def _solve(gram: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Least-squares solution, (pseudo) inverse and rank; repeated terms share their effect."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    scaled = gram / np.outer(scale, scale)
    inverse = np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) / np.outer(scale, scale)
    return inverse @ xy, inverse, int(np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True))


def fit(df: DataFrame, key: str, target: str, made: Design, folds: int = 5) -> tuple[pd.DataFrame, dict]:
    """Coefficients (one row per term) and fit facts, from two passes over the rows."""
    x = [F.coalesce(v, F.lit(0.0)) for v in made.values]
    size = len(x) + 1
    base = df.select(F.array(*x).alias("x"), F.col(target).cast("double").alias("y"), fold_of(F.col(key), folds).alias("fold"))
    # Means first: centred columns keep years (about 2000) from swamping the 0/1 terms.
    means = base.agg(F.avg("y"), *[F.avg(F.col("x")[i]) for i in range(len(x))]).first()
    if means[0] is None:
        raise ValueError("no rows to fit")
    centre = np.array([0.0, *means[1:], means[0]])
    centred = F.zip_with("x", F.lit([float(m) for m in means[1:]]), lambda a, m: a - m)
    z = F.concat(F.array(F.lit(1.0)), centred, F.array(F.col("y") - F.lit(float(means[0]))))
    rows = base.select(z.alias("z"), "fold")

    by_fold = cross_products(rows, size + 1)
    total = sum(by_fold.values())
    beta, inverse, rank = _solve(total[:size, :size], total[:size, size])
    meat, sse = robust_sums(rows, inverse, beta)
    cov = inverse @ meat @ inverse
    n, sst = total[0, 0], total[size, size] - total[0, size] ** 2 / total[0, 0]

    # Back from centred columns: only the constant changes.
    back = np.eye(size)
    back[0, 1:] = -centre[1:size]
    coef = back @ beta
    coef[0] += centre[size]
    std_err = np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0.0))
    half = 1.959963984540054 * std_err
    with np.errstate(divide="ignore", invalid="ignore"):
        z_values = coef / std_err
    coefficients = pd.DataFrame(
        {
            "term": ["const", *made.terms],
            "coef": coef,
            "std_err": std_err,
            "ci_low": coef - half,
            "ci_high": coef + half,
            "p_value": [normal_two_sided(v) for v in z_values],
        }
    )
    r2 = 1.0 - sse / sst if sst > 0 else math.nan
    facts = {
        "n": int(n),
        "r2": r2,
        "adj_r2": 1.0 - (1.0 - r2) * (n - 1) / (n - rank),
        **cross_validate(by_fold, total, size),
    }
    return coefficients, facts


def cross_validate(by_fold: dict[int, np.ndarray], total: np.ndarray, size: int) -> dict[str, float]:
    """R squared on each fold of a model fitted to the others, from the folds' sums alone."""
    model, baseline = [], []
    for part in by_fold.values():
        rest = total - part
        if rest[0, 0] == 0 or part[0, 0] < 2:
            continue
        b, _, _ = _solve(rest[:size, :size], rest[:size, size])
        yy, y, n = part[size, size], part[0, size], part[0, 0]
        sst = yy - y * y / n
        if sst <= 0:
            continue
        sse = yy - 2 * b @ part[:size, size] + b @ part[:size, :size] @ b
        mean = rest[0, size] / rest[0, 0]
        model.append(1 - sse / sst)
        baseline.append(1 - (yy - 2 * mean * y + n * mean * mean) / sst)
    return {
        "model_r2": float(np.mean(model)) if model else math.nan,
        "model_r2_std": float(np.std(model)) if model else math.nan,
        "baseline_r2": float(np.mean(baseline)) if baseline else math.nan,
    }
