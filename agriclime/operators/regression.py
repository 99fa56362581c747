"""Linear models: one aggregation of moments on Spark, one small solve per model.

Executors reduce the rows to a count, means and covariances per model (and group).
Only those few numbers reach the solver, which runs inside a task, one row per
model, so any number of groups is fitted in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null
from ..functions.solver import moment_solver
from ..sources.tables import materialize
from .phenology import PERIODS
from .quantiles import exact_quantiles

RESPONSE = "prod_10a_kg"
INTERCEPT = "(Intercept)"
RESIDUAL_QUANTILES = {
    "resid_min": 0.0,
    "resid_q1": 0.25,
    "resid_median": 0.5,
    "resid_q3": 0.75,
    "resid_max": 1.0,
}


@dataclass(frozen=True)
class Model:
    """Response ``y`` on predictors ``xs`` plus intercept; ``squares`` enter as their square."""

    name: str
    xs: tuple[str, ...]
    squares: frozenset[str] = field(default_factory=frozenset)
    y: str = RESPONSE

    def terms(self) -> list[str]:
        return [f"{x}^2" if x in self.squares else x for x in self.xs]

    def columns(self) -> list[Column]:
        out = []
        for x in self.xs:
            value = nan_to_null(F.col(x).cast("double"))
            out.append(value * value if x in self.squares else value)
        return out


# Predictor groups, and the periods whose squared term replaces the
# linear one. The wind group is named after its model; its columns hold the maximum
# of the mean wind.
MODEL_VARIABLES = {
    "tm_avg": "tm_avg",
    "tm_min": "tm_min",
    "tm_max": "tm_max",
    "hm_avg": "hm_avg",
    "pr_day": "pr_day",
    "ss_dura_sum": "ss_dura_sum",
    "ws_max": "ws_avg",
    "gdd10c": "gdd10c",
}
SQUARED_PERIODS = {
    "tm_avg": ("P4",),
    "tm_min": ("P3",),
    "tm_max": ("P3", "P5"),
    "hm_avg": ("P4",),
    "pr_day": ("P1", "P2", "P4"),
    "ss_dura_sum": ("P2",),
    "ws_max": ("P2",),
    "gdd10c": ("P3",),
}


def linear_model(name: str) -> Model:
    var = MODEL_VARIABLES[name]
    return Model(name, tuple(f"{var}_{p}" for p in PERIODS))


def squared_model(name: str) -> Model:
    var = MODEL_VARIABLES[name]
    squares = frozenset(f"{var}_{p}" for p in SQUARED_PERIODS[name])
    return Model(f"{name}_sq", linear_model(name).xs, squares)


LINEAR_MODELS = tuple(linear_model(n) for n in MODEL_VARIABLES)
SQUARED_MODELS = tuple(squared_model(n) for n in MODEL_VARIABLES)


def _complete_cases(df: DataFrame, models: Sequence[Model], groups: Sequence[str]) -> DataFrame:
    """(groups, model, y, x0..) rows of every model, without rows missing a used value.

    Models may differ in width; a narrower one has null in the columns that it lacks.
    """
    size = max(len(m.xs) for m in models)
    cases = []
    for m in models:
        y, xs = nan_to_null(F.col(m.y).cast("double")), m.columns()
        complete = y.isNotNull()
        for x in xs:
            complete = complete & x.isNotNull()
        padded = [*xs, *[F.lit(None).cast("double")] * (size - len(xs))]
        cases.append(
            F.struct(
                F.lit(m.name).alias("model"),
                complete.alias("complete"),
                y.alias("y"),
                *[x.alias(f"x{i}") for i, x in enumerate(padded)],
            )
        )
    return (
        df.select(*groups, F.explode(F.array(*cases)).alias("case"))
        .select(*groups, "case.*")
        .where("complete")
        .drop("complete")
    )


def _moments(cases: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Count, means and co-moments (upper triangle) of (y, x0..) per group and model.

    Columns that a narrower model lacks have no moments; without these nulls its arrays
    are those of its own width.
    """
    values = [c for c in cases.columns if c not in groups and c != "model"]
    means = F.array_compact(F.array(*[F.avg(v) for v in values]))
    pairs = F.array_compact(F.array(*[F.covar_pop(a, b) for a, b in combinations_with_replacement(values, 2)]))
    return cases.groupBy(*groups, "model").agg(
        F.count(F.lit(1)).alias("n"), means.alias("means"), pairs.alias("covariances")
    )


_FITTED = (
    "n bigint, df bigint, coefficients array<double>, std_errors array<double>, "
    "t_values array<double>, p_values array<double>, vifs array<double>, r2 double, "
    "adj_r2 double, sigma double, f_value double, f_df bigint, f_p_value double"
)


def fit_models(df: DataFrame, models: Sequence[Model], groups: Sequence[str] = ()) -> DataFrame:
    """One row per model and group with everything a least-squares fit reports.

    All models share one scan and one aggregation. A predictor that is a linear
    combination of earlier ones gets no coefficient (null), like a constant one.
    """
    return fit_states(moment_states(df, models, groups), models, groups)


def moment_states(df: DataFrame, models: Sequence[Model], groups: Sequence[str] = ()) -> DataFrame:
    """What all fits of these models need: ``n``, ``means`` and ``covariances`` of the response
    and predictors per group and model.

    A state is a few numbers, however many rows it stands for. Stored, states of new years,
    other tables or finer groups are united by :func:`merge_states` without the rows.
    """
    groups = list(groups)
    return _moments(_complete_cases(df, models, groups), groups)


def merge_states(states: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One state per model and ``groups`` from any number of states (union them first).

    ``groups`` may be fewer columns than the states have: provinces unite to the country.
    Co-moments are shifted from each state's means to the common ones, so nothing is lost to
    cancellation. Both steps are aggregates that combine on the map side.
    """
    groups, keys = list(groups), [*groups, "model"]
    stored = materialize(states.select(*keys, "n", "means", "covariances"), "moment-states")
    at = stored.select(*keys, "n", F.posexplode("means").alias("i", "mean"))
    common = at.groupBy(*keys, "i").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")
    )
    # A model's width bounds these lists.
    common = common.groupBy(*keys).agg(
        F.max("n").alias("all_n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("all_means"),
    )
    common = common.select(*[F.col(k).alias(f"of_{k}") for k in keys], "all_n", "all_means")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    joined = stored.join(materialize(common, "moment-means"), same)
    joined = joined.withColumn("off", F.zip_with("means", "all_means", lambda a, b: a - b))
    width = F.size("means")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.transform(F.sequence(i, width - 1), lambda j: F.get("off", i) * F.get("off", j)),
        )
    )
    part = F.zip_with("covariances", pairs, lambda c, shift: F.col("n") * (c + shift))
    summed = joined.select(*keys, "all_n", "all_means", F.posexplode(part).alias("i", "part"))
    summed = summed.groupBy(*keys, "all_n", "all_means", "i").agg(F.sum("part").alias("total"))
    return summed.groupBy(*keys, F.col("all_n").alias("n"), F.col("all_means").alias("means")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda x: x["total"] / F.col("all_n")).alias(
            "covariances"
        )
    )


def fit_states(states: DataFrame, models: Sequence[Model], groups: Sequence[str] = ()) -> DataFrame:
    """The fits of :func:`fit_models` from moment states."""
    groups = list(groups)
    keys = ", ".join(f"`{g}` {states.schema[g].dataType.simpleString()}" for g in groups)
    schema = (keys + ", " if keys else "") + "model string, " + _FITTED
    fitted = states.mapInPandas(moment_solver([*groups, "model"]), schema)
    terms = F.create_map(
        *[
            part
            for m in models
            for part in (F.lit(m.name), F.array(*[F.lit(t) for t in [INTERCEPT, *m.terms()]]))
        ]
    )
    return fitted.withColumn("terms", F.element_at(terms, F.col("model")))


def ols(df: DataFrame, models: Sequence[Model], groups: Sequence[str] = ()) -> DataFrame:
    """Coefficient table: one row per model, group and term, the intercept included."""
    return coefficients(fit_models(df, models, groups), groups)


def coefficients(fitted: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The coefficient table of fits."""
    zipped = F.arrays_zip("terms", "coefficients", "std_errors", "t_values", "p_values")
    return fitted.select(*groups, "model", F.explode(zipped).alias("row")).select(
        *groups,
        "model",
        F.col("row.terms").alias("term"),
        F.col("row.coefficients").alias("estimate"),
        F.col("row.std_errors").alias("std_error"),
        F.col("row.t_values").alias("t_value"),
        F.col("row.p_values").alias("p_value"),
    )


def vif(df: DataFrame, models: Sequence[Model], groups: Sequence[str] = ()) -> DataFrame:
    """Variance inflation factor per predictor, on the model's complete cases."""
    return inflation(fit_models(df, models, groups), groups)


def inflation(fitted: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The variance inflation factors of fits."""
    predictors = F.slice("terms", 2, F.size("vifs"))
    zipped = F.arrays_zip(predictors.alias("terms"), F.col("vifs"))
    return fitted.select(*groups, "model", F.explode(zipped).alias("row")).select(
        *groups, "model", F.col("row.terms").alias("term"), F.col("row.vifs").alias("vif")
    )


def ols_summary(df: DataFrame, models: Sequence[Model], groups: Sequence[str] = ()) -> DataFrame:
    """Per model and group: fit quality, F test and the quantiles of the residuals.

    The fits, one row per model and group, become a stage table.
    """
    groups = list(groups)
    keys = [*groups, "model"]
    fitted = materialize(fit_models(df, models, groups), "fits")
    cases = _complete_cases(df, models, groups)
    values = [f"x{i}" for i in range(max(len(m.xs) for m in models))]
    lines = fitted.select(
        *[F.col(k).alias(f"fit_{k}") for k in keys], F.col("coefficients").alias("b")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"fit_{k}"))
    predicted = F.get("b", F.lit(0))
    for i, v in enumerate(values):
        # A predictor without coefficient, or that the model lacks, takes no part.
        predicted = predicted + F.coalesce(F.get("b", F.lit(i + 1)) * F.col(v), F.lit(0.0))
    residuals = cases.join(lines, same).select(*keys, (F.col("y") - predicted).alias("residual"))
    quantiles = exact_quantiles(residuals, keys, "residual", RESIDUAL_QUANTILES)
    return fitted.join(quantiles, keys, "left").select(
        *keys, "n", "df", "r2", "adj_r2", "sigma", "f_value", "f_df", "f_p_value",
        *RESIDUAL_QUANTILES,
    )


def trend_points(df: DataFrame, x: str, y: str = RESPONSE, group: str = "region") -> DataFrame:
    """Points of a scatter plot with the straight line of their group.

    The line is an aggregate joined back, one row per group (a stage table), instead
    of a window that would hold a whole group.
    """
    yv, xv = nan_to_null(F.col(y).cast("double")), nan_to_null(F.col(x).cast("double"))
    points = df.select(group, "year", xv.alias("x"), yv.alias("y")).dropna(subset=["x", "y"])
    lines = points.groupBy(F.col(group).alias("line_of")).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    return (
        points.join(materialize(lines, "trend-lines"), F.col(group).eqNullSafe(F.col("line_of")))
        .select(group, "year", "x", "y", fitted.alias("fitted"))
        .withColumn("residual", F.col("y") - F.col("fitted"))
    )
