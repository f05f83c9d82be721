"""Statistics give known answers and agree with brute force."""

from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from titleworks.functions import probability as B
from titleworks.operators import rank_tests as R
from titleworks.operators import regression as L


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_spearman_by_hand(spark):
    # Ranks 3 1.5 4 1.5 5 and 2 4 1 5 3: products of deviations -6.5, squares 9.5 and 10.
    rows = [(3.0, 2.0), (1.0, 7.0), (4.0, 1.0), (1.0, 8.0), (5.0, 3.0), (9.0, None), (None, 9.0)]
    df = spark.createDataFrame(rows, "x double, score double").withColumn("falling", -F.col("score"))
    found = {r.factor: r for r in R.spearman(R.pair_cells(df, ["x", "falling"])).collect()}
    assert found["x"].n == 5 and found["x"].statistic == pytest.approx(-6.5 / 95**0.5)
    assert found["x"].effect_size == pytest.approx(6.5**2 / 95)
    assert (found["falling"].n, found["falling"].statistic, found["falling"].effect_size) == (6, -1.0, 1.0)


def test_spearman_matches_ranked_correlation(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.integers(0, 40, 3000).astype(float), "b": rng.normal(size=3000), "score": np.round(rng.normal(7, 1, 3000), 1)})
    pdf["a"] += pdf.score * 5
    found = {r.factor: r.statistic for r in R.spearman(R.pair_cells(spark.createDataFrame(pdf), ["a", "b"])).collect()}
    for c in "ab":
        assert found[c] == pytest.approx(pdf[c].rank().corr(pdf.score.rank()), abs=1e-12)


def test_kruskal_sees_only_the_order_of_scores(spark):
    rng = np.random.default_rng(31)
    pdf = pd.DataFrame({"g": rng.choice(list("pqrs"), 250, p=[0.5, 0.3, 0.15, 0.05])})
    pdf["score"] = np.round(rng.gamma(3.0, 1.0, 250) + (pdf.g == "r") * 1.5, 1)
    ranks = pdf.score.rank()
    ties = pdf.score.value_counts()
    sums = ranks.groupby(pdf.g).agg(["sum", "size"])
    h = (12 / (250 * 251) * (sums["sum"] ** 2 / sums["size"]).sum() - 3 * 251) / (1 - (ties**3 - ties).sum() / (250**3 - 250))
    for scores in (pdf.score, pdf.score**3 + 1):
        row = R.kruskal(R.category_cells(spark.createDataFrame(pdf.assign(score=scores)), ["g"])).first()
        assert (row.n, row.groups) == (250, 4) and row.statistic == pytest.approx(h) and row.effect_size == pytest.approx(h / 249)


def test_kruskal_of_a_tied_sample(spark):
    # By hand: ranks 1.5 1.5 3 | 4.5 4.5 6, corrected for two pairs of ties.
    df = frame(spark, g=["a", "a", "a", "b", "b", "b"], score=[1.0, 1.0, 2.0, 3.0, 3.0, 4.0])
    h = 12 / 42 * (36 / 3 + 225 / 3) - 21
    assert R.kruskal(R.category_cells(df, ["g"])).first().statistic == pytest.approx(h / (1 - 12 / 210))


def test_kruskal_without_variation_has_no_statistic(spark):
    df = frame(spark, g=["a", "b"], score=[1.0, 1.0])
    assert R.kruskal(R.category_cells(df, ["g"])).first().statistic is None


def test_p_values_match_the_statistics_library_on_the_class_path(spark):
    math = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 2, 5, 40, 300):
        for x in (0.01, 0.5, 3.84, 30.0, 250.0, 700.0):
            exact = math.ChiSquaredDistribution(float(df)).cumulativeProbability(x)
            assert B.chi2_tail(x, df) == pytest.approx(1 - exact, abs=1e-10)
    for df in (1, 3, 30, 5000):
        for t in (0.0, 0.2, 1.96, 8.0):
            exact = 2 * math.TDistribution(float(df)).cumulativeProbability(-t)
            assert B.t_two_sided(t, df) == pytest.approx(exact, rel=1e-8)
    assert B.chi2_tail(5.99, 2) == pytest.approx(0.05004, abs=1e-5)


@pytest.mark.parametrize("n", [1, 2, 5, 50, 101, 400])
def test_median_interval_matches_resampling(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(7.0, 0.5, n), 2)
    row = R.group_medians(R.category_cells(frame(spark, g=["a"] * n, score=values), ["g"])).first()
    medians = np.median(rng.choice(values, (20_000, n)), axis=1)
    low, high = np.percentile(medians, [2.5, 97.5])
    assert row.n == n and row.median == pytest.approx(np.median(values))
    assert row.ci_low <= row.median <= row.ci_high
    # Even sizes average two neighbouring answers; tiny samples have wide gaps between values.
    room = 0.03 if n > 5 else 0.5
    assert abs(row.ci_low - low) <= room and abs(row.ci_high - high) <= room


@pytest.mark.parametrize("n", [19_999, 20_001, 120_000])
def test_median_ranks_are_exact_at_every_size(spark, n):
    """The rank is the first whose binomial tail, from another library, reaches the share."""
    binomial = spark._jvm.org.apache.commons.math3.distribution.BinomialDistribution
    for share in (0.025, 0.975):
        middle = (n + 1) // 2
        reached = lambda k: 1 - binomial(n, k / n).cumulativeProbability(middle - 1)  # noqa: B023, E731
        rank = B.median_rank(n, middle, share)
        assert reached(rank) >= share - 1e-9 and reached(rank - 1) < share + 1e-9


def test_tails_do_not_change_method_with_size(spark):
    math = spark._jvm.org.apache.commons.math3.distribution
    for df in (19_999.0, 20_001.0, 3_000_000.0):
        exact = 2 * math.TDistribution(df).cumulativeProbability(-2.5)
        assert B.t_two_sided(2.5, df) == pytest.approx(exact, rel=1e-6)
        tail = 1 - math.ChiSquaredDistribution(df).cumulativeProbability(df * 1.001)
        assert B.chi2_tail(df * 1.001, df) == pytest.approx(tail, rel=1e-6)


def test_adjusted_p_values_step_up(spark):
    # Five tests: 0.9, 0.3 * 5/4, 0.021 * 5/3, then 0.02 * 5/2 is held down to that, 0.005 * 5.
    given = {"m": 0.02, "n": 0.005, "o": 0.3, "p": 0.021, "q": 0.9, "r": None}
    df = spark.createDataFrame(list(given.items()), "factor string, p_value double")
    found = {r.factor: r.p_adjusted for r in R.adjust_p_values(df).collect()}
    assert found.pop("r") is None
    assert found == pytest.approx({"m": 0.035, "n": 0.025, "o": 0.375, "p": 0.035, "q": 0.9})


def test_terms_may_not_read_what_is_measured_later(spark):
    df = spark.createDataFrame([(7.5, 900, 3, "x")], "score double, members long, length int, kind string")
    L.known_before(df, {"length": F.col("length"), "score": F.log1p("length")})  # a name alone is no leak
    for late in (F.col("members"), F.sqrt(F.col("members") + F.col("length")), F.when(F.col("score") > 7, 1)):
        with pytest.raises(ValueError, match="known before release"):
            L.design(df, {"harmless": late}, [], {})
    with pytest.raises(ValueError, match="known before release"):
        L.design(df, {}, ["members"], {})


def test_design_of_two_categories(spark):
    rows = [("b", "x", 1), ("b", "y", 2), ("a", "y", 3), ("a", "x", 4), (None, "z", 5)]
    df = spark.createDataFrame(rows, "left string, right string, n int")
    made = L.design(df, {"n": F.col("n"), "n2": F.col("n") ** 2}, ["left", "right"], {"odd": F.col("n") % 2 == 1})
    assert made.references == {"left": "a", "right": "x"}  # as common as the next, and first by name
    assert made.terms == ["n", "n2", "odd", "left=b", "right=y", "right=z"]
    entries = {(r.n, r.term): r.value for r in L.nonzero_entries(df, "n", made).collect()}
    assert entries[5, "right=z"] == 1.0 and (5, "left=b") not in entries and entries[4, "n2"] == 16.0
    with pytest.raises(ValueError, match="more than 3 terms"):
        L.design(df, {"n": F.col("n")}, ["left", "right"], {}, most_terms=3)


def test_folds_of_very_large_ids(spark):
    ids = [0, 7, 4_000_000_000, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert [r[0] for r in df.select(L.fold_of(F.col("id"), 5)).collect()] == [i % 2**31 * 2654435761 % 2**32 % 5 for i in ids]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({"id": np.arange(n), "year": rng.integers(1990, 2025, n), "kind": rng.choice(["a", "b", "c"], n), "tv": rng.random(n) < 0.4})
    pdf["same"] = pdf.tv
    pdf["score"] = 6 + 0.8 * pdf.tv + 0.01 * (pdf.year - 2000) + 0.3 * (pdf.kind == "c") + rng.normal(0, 0.1 + 0.3 * pdf.tv, n)
    return pdf


def test_regression_equals_the_matrix_formulas(spark, sample):
    df = spark.createDataFrame(sample).repartition(5)
    made = L.design(df, {"year": F.col("year")}, ["kind"], {"tv": F.col("tv")})
    table, facts = L.fit(df, "id", "score", made)
    first = sample.kind.value_counts().sort_index().idxmax()
    assert made.references == {"kind": first}
    levels = [v for v in "abc" if v != first]
    x = np.column_stack([np.ones(len(sample)), sample.year, sample.tv, *[sample.kind == v for v in levels]]).astype(float)
    y = sample.score.to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    cov = inverse @ (x.T * (e / (1 - h)) ** 2 @ x) @ inverse
    assert table.term.tolist() == ["const", "year", "tv", *[f"kind={v}" for v in levels]]
    np.testing.assert_allclose(table.coef, beta, rtol=1e-6)
    np.testing.assert_allclose(table.std_err, np.sqrt(np.diag(cov)), rtol=1e-6)
    r2 = 1 - (e @ e) / ((y - y.mean()) ** 2).sum()
    assert facts["n"] == 900 and facts["r2"] == pytest.approx(r2)
    assert facts["adj_r2"] == pytest.approx(1 - (1 - r2) * 899 / (900 - x.shape[1]))
    # Cross-validation from sums equals refitting on each fold.
    fold = sample.id.to_numpy() * 2654435761 % 4294967296 % 5
    scores = []
    for f in range(5):
        b = np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]
        held = y[fold == f]
        scores.append(1 - ((held - x[fold == f] @ b) ** 2).sum() / ((held - held.mean()) ** 2).sum())
    assert facts["model_r2"] == pytest.approx(np.mean(scores))
    assert facts["model_r2_std"] == pytest.approx(np.std(scores))
    assert facts["baseline_r2"] < 0.01


def test_regression_survives_a_repeated_term(spark, sample):
    df = spark.createDataFrame(sample)
    once, facts = L.fit(df, "id", "score", L.design(df, {}, [], {"tv": F.col("tv")}))
    twice, same = L.fit(df, "id", "score", L.design(df, {}, [], {"tv": F.col("tv"), "same": F.col("same")}))
    assert same["r2"] == pytest.approx(facts["r2"]) and same["adj_r2"] == pytest.approx(facts["adj_r2"])
    assert twice.coef[1:].sum() == pytest.approx(once.coef[1])


def test_regression_recovers_a_plane(spark):
    rng = np.random.default_rng(41)
    pdf = pd.DataFrame({"id": np.arange(1500) * 10**15, "w": rng.uniform(-3, 3, 1500), "v": rng.uniform(0, 1, 1500)})
    pdf["score"] = 2.0 - 0.4 * pdf.w + 1.5 * pdf.v + rng.uniform(-0.5, 0.5, 1500)
    table, facts = L.fit(spark.createDataFrame(pdf), "id", "score", L.design(spark.createDataFrame(pdf), {"w": F.col("w"), "v": F.col("v")}, [], {}))
    for term, value in (("const", 2.0), ("w", -0.4), ("v", 1.5)):
        row = table.set_index("term").loc[term]
        assert abs(row.coef - value) < 4 * row.std_err < 0.2
    assert facts["n"] == 1500 and facts["model_r2"] == pytest.approx(facts["r2"], abs=0.02)


def _log_gamma(z):
    z = Decimal(z)
    rest = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - Decimal("0.5")) * z.ln() - z + Decimal("6.283185307179586476925286766559005768394").ln() / 2 + rest


@pytest.mark.parametrize("n", [1_000, 1_000_000, 1_000_000_000])
def test_tails_keep_their_digits_at_every_size(n):
    with localcontext() as digits:
        digits.prec = 60
        for a, step in ((n // 2, 1), (n // 2, -2), (n // 5 * 2, 0)):
            b, k = n - a + 1, a + step * int(n**0.5)
            x = Decimal(k) / n
            true = (_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * x.ln() + b * (1 - x).ln()).exp()
            assert B.beta_front(k / n, (n - k) / n, a, b) == pytest.approx(float(true), rel=1e-11)
        h = n + 3 * int(n**0.5)
        true = (n * Decimal(h).ln() - h - _log_gamma(n)).exp()
        assert B.gamma_front(h, n) == pytest.approx(float(true), rel=1e-11)


@pytest.mark.parametrize("n", [301, 400])
def test_resampled_medians_are_near_the_exact_limits_and_repeat(spark, n):
    random = np.random.default_rng(n)
    scores = np.round(random.normal(7, 1, n), 2)
    values, counts = np.unique(scores, return_counts=True)
    cells = spark.createDataFrame([("a", "x", float(v), int(c)) for v, c in zip(values, counts, strict=True)], "factor string, group string, score double, n long")
    first = R.resampled_medians(cells.repartition(1)).collect()
    assert first == R.resampled_medians(cells.repartition(5, "score")).collect()
    assert first != R.resampled_medians(cells, seed=1, resamples=999).collect()
    exact = R.group_medians(cells).first()
    for share, limit, found in ((0.025, exact.ci_low, first[0].ci_low), (0.975, exact.ci_high, first[0].ci_high)):
        medians = np.sort([np.median(random.choice(scores, n)) for _ in range(4000)])
        low, high = np.quantile(medians, [max(0, share - 0.02), min(1, share + 0.02)])
        assert low <= found <= high and low <= limit <= high
    assert first[0].n == n
