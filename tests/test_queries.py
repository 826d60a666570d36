"""Every query of the catalog with SQL gives the SQL's rows; those that take long only with TEST_ALL set."""

import os

import pytest

from seasonloom.plans import catalog
from tests.oracle import SF, assert_same

#: Queries over whole forecasts or several fits.
LONG = {"backtest_scores", "baseline_ladder", "bootstrap_delta_rmse", "bucket_summary", "coefficient_delta", "coefficient_summary", "coverage_counts", "effect_size_table", "fit_failure_summary", "fit_failures", "forecast_zoned", "incomplete_doys", "lead_curve", "model_row_counts", "monthly_bias", "monthly_export", "one_step_prediction", "patch_coefficients", "patch_summary", "per_id_error_stats", "pooled_rmse", "raw_model_fit", "tidy_coefficients", "win_fraction_cohens_d", "wls_fit_gaussian"}


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if os.environ.get("TEST_ALL") or n not in LONG])
def test_query(spark, name):
    assert_same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name])
