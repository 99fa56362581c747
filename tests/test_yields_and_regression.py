import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agriclime.functions import solver
from agriclime.operators import quantiles, regression as rg, yields as yl

YIELD = "wide string, region string, year int, prod_10a_kg double"


def test_province_names(spark):
    names = ["충청남도", "경기도", "강원도", "제주도", "서울특별시", "부산광역시", None]
    df = spark.createDataFrame([(n, "r", 2000 + i, 500.0 + i) for i, n in enumerate(names)], YIELD)
    out = yl.normalized_yields([df, df.limit(0)], trend=(-100.0, 0.25)).collect()
    assert [r.wide for r in out] == ["충남", "경기", "강원", "제주", None]
    for r in out:
        assert r.prod_trend == pytest.approx(-100.0 + 0.25 * r.year)
        assert r.prod_norm == pytest.approx(r.prod_10a_kg - r.prod_trend)


def test_trend_is_fitted_before_rows_are_dropped(spark):
    rows = [("서울특별시", "소계", 2000 + i, 900.0 - 40 * i) for i in range(5)]
    rows += [("경기도", "a", 2000 + i, 500.0 + 3 * i) for i in range(5)] + [("경기도", "b", 2003, None)]
    df = spark.createDataFrame(rows, YIELD)
    x = np.array([r[2] for r in rows[:10]], float)
    y = np.array([r[3] for r in rows[:10]])
    slope, intercept = np.polyfit(x, y, 1)
    line = yl.yield_trend(df).first()
    assert (line.slope, line.intercept, line.n) == (
        pytest.approx(slope), pytest.approx(intercept), 10)
    out = yl.normalized_yields([df]).where(F.col("year") == 2003).collect()
    assert {r.region for r in out} == {"a", "b"}
    assert all(r.prod_trend == pytest.approx(intercept + slope * 2003) for r in out)


def test_union_keeps_all_rows(spark):
    a = spark.createDataFrame([("w", "r", 2000, 1.0)], YIELD)
    b = a.select("year", "prod_10a_kg", "region", "wide")
    assert yl.yield_union(a, b, a).count() == 3


def random_rows(n=80, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(20, 4, (n, 3))
    x[:, 2] += 0.6 * x[:, 0]
    y = 3 + x @ [0.5, -1.2, 0.0] + rng.normal(0, 2, n)
    return x, y


def frame(spark, x, y):
    rows = [(f"g{i % 2}", 2000 + i, float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, year int, y double, a double, b double, c double")


MODEL = rg.Model("m", ("a", "b", "c"), y="y")


def by_term(df, *cols):
    return {r.term: tuple(r[c] for c in cols) for r in df.collect()}


def reference_fit(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    resid = y - design @ beta
    df = len(y) - design.shape[1]
    sigma2 = resid @ resid / df
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma2)
    return beta, se, resid, df, sigma2


def test_coefficients_and_errors(spark):
    x, y = random_rows()
    beta, se, resid, df, sigma2 = reference_fit(np.column_stack([np.ones(len(y)), x]), y)
    got = by_term(rg.ols(frame(spark, x, y), [MODEL]), "estimate", "std_error", "t_value")
    for term, b, s in zip(("(Intercept)", "a", "b", "c"), beta, se):
        assert got[term] == pytest.approx((b, s, b / s))
    row = rg.ols_summary(frame(spark, x, y), [MODEL]).first()
    r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
    assert (row.n, row.df, row.f_df) == (80, df, 3)
    assert (row.r2, row.sigma) == pytest.approx((r2, math.sqrt(sigma2)))
    assert row.adj_r2 == pytest.approx(1 - (1 - r2) * 79 / df)
    assert row.f_value == pytest.approx(r2 / 3 / ((1 - r2) / df))
    want = np.quantile(resid, [0, 0.25, 0.5, 0.75, 1])
    assert [row[c] for c in rg.RESIDUAL_QUANTILES] == pytest.approx(list(want))


def test_p_values_match_the_ml_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x, y = random_rows(40, 8)
    df = frame(spark, x, y)
    fit = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    )
    want = list(fit.summary.pValues)
    got = by_term(rg.ols(df, [MODEL]), "p_value")
    assert [got[t][0] for t in ("a", "b", "c", "(Intercept)")] == pytest.approx(want, abs=1e-10)


def test_known_tail_probabilities():
    # Standard two-sided 5 % and upper 5 % table points.
    assert solver.t_p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert solver.t_p_value(-1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert solver.f_p_value(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert solver.t_p_value(0.0, 7) == 1.0


def test_degenerate_moments():
    one = solver.solve(1, np.array([4.0, 2.0]), np.zeros(3))
    assert one["coefficients"] == [4.0, None] and one["df"] == 0 and one["r2"] is None
    flat = solver.solve(9, np.array([4.0, 2.0]), np.array([0.0, 0.0, 1.5]))
    assert flat["coefficients"] == [4.0, 0.0] and flat["sigma"] == 0.0 and flat["r2"] is None
    exact = solver.solve(9, np.array([4.0, 2.0]), np.array([6.0, 3.0, 1.5]))
    assert exact["coefficients"] == pytest.approx([0.0, 2.0]) and exact["r2"] == pytest.approx(1)
    assert solver.solve(9, np.array([4.0]), np.array([2.0]))["f_df"] == 0


def test_squared_terms_replace_the_linear_ones(spark):
    x, y = random_rows()
    model = rg.Model("m", ("a", "b", "c"), frozenset({"b"}), "y")
    design = np.column_stack([np.ones(len(y)), x[:, 0], x[:, 1] ** 2, x[:, 2]])
    beta, *_ = reference_fit(design, y)
    got = by_term(rg.ols(frame(spark, x, y), [model]), "estimate")
    assert set(got) == {"(Intercept)", "a", "b^2", "c"}
    assert [got[t][0] for t in ("(Intercept)", "a", "b^2", "c")] == pytest.approx(list(beta))


def test_duplicate_and_constant_predictors_have_no_coefficient(spark):
    x, y = random_rows()
    x[:, 1], x[:, 2] = 2 * x[:, 0], 7.25
    beta, *_ = reference_fit(np.column_stack([np.ones(len(y)), x[:, 0]]), y)
    df = frame(spark, x, y)
    got = by_term(rg.ols(df, [MODEL]), "estimate", "std_error", "p_value")
    assert got["b"] == got["c"] == (None, None, None)
    assert (got["(Intercept)"][0], got["a"][0]) == pytest.approx(tuple(beta))
    assert rg.ols_summary(df, [MODEL]).first().f_df == 1


def test_vif(spark):
    x, y = random_rows()
    got = by_term(rg.vif(frame(spark, x, y), [MODEL]), "vif")
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [got[t][0] for t in ("a", "b", "c")] == pytest.approx(list(want))


def test_incomplete_rows_are_left_out(spark):
    x, y = random_rows()
    x[3, 1], y[7] = np.nan, np.nan
    keep = [i for i in range(80) if i not in (3, 7)]
    beta, *_ = reference_fit(np.column_stack([np.ones(78), x[keep]]), y[keep])
    got = by_term(rg.ols(frame(spark, x, y), [MODEL]), "estimate")
    assert [got[t][0] for t in ("(Intercept)", "a", "b", "c")] == pytest.approx(list(beta))


def test_groups_are_fitted_separately(spark):
    x, y = random_rows()
    df = frame(spark, x, y)
    both = rg.ols(df, [MODEL], ["g"])
    for g in ("g0", "g1"):
        alone = by_term(rg.ols(df.where(F.col("g") == g), [MODEL]), "estimate")
        part = by_term(both.where(F.col("g") == g), "estimate")
        assert {t: v[0] for t, v in part.items()} == pytest.approx(
            {t: v[0] for t, v in alone.items()})


def test_too_few_rows_give_no_tests(spark):
    x, y = random_rows(4)
    got = by_term(rg.ols(frame(spark, x, y), [MODEL]), "estimate", "std_error", "p_value")
    assert all(v[0] is not None and v[1] is None and v[2] is None for v in got.values())


def test_sixteen_models_are_configured():
    assert len(rg.LINEAR_MODELS) == len(rg.SQUARED_MODELS) == 8
    assert rg.squared_model("pr_day").terms() == [
        "pr_day_P1^2", "pr_day_P2^2", "pr_day_P3", "pr_day_P4^2", "pr_day_P5"]
    assert rg.linear_model("ws_max").xs[0] == "ws_avg_P1"


def test_trend_points(spark):
    x, y = random_rows()
    out = rg.trend_points(frame(spark, x, y), "a", "y", "g").collect()
    for g in ("g0", "g1"):
        rows = [r for r in out if r.g == g]
        slope, intercept = np.polyfit([r.x for r in rows], [r.y for r in rows], 1)
        assert [r.fitted for r in rows] == pytest.approx([intercept + slope * r.x for r in rows])
        assert sum(r.residual for r in rows) == pytest.approx(0, abs=1e-8)


@pytest.mark.parametrize("n", [1, 2, 9, 501, 60_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = {
        "normal": rng.normal(0, 1, n),
        "ties": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 20, n)),
        "tail": np.exp(rng.normal(0, 6, n)),
    }
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    names = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0, "q99": 0.99}
    for r in quantiles.exact_quantiles(df, ["g"], "v", names).collect():
        want = np.quantile(values[r.g], list(names.values()))
        assert [r[c] for c in names] == pytest.approx(list(want), rel=1e-12, abs=1e-12)
