"""Feature table to the tables of all regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.regression import LINEAR_MODELS, SQUARED_MODELS, Model, ols, ols_summary, vif
from ..sources.tables import materialize

ALL_MODELS = (*LINEAR_MODELS, *SQUARED_MODELS)


def regression_tables(
    features: DataFrame, models: Sequence[Model] = ALL_MODELS, groups: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Coefficients, fit summaries and inflation factors of every model (and group).

    The feature table, small by then, is stored once for the passes over it.
    """
    stored = materialize(features, "features")
    return {
        "coefficients": ols(stored, models, groups),
        "summary": ols_summary(stored, models, groups),
        "vif": vif(stored, models, groups),
    }
