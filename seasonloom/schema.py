"""Schemas of the engine's tables, and the check that a frame has what an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame

RAW = "ID long, FECHA timestamp_ntz, Value double"
PREPARED = "ID long, FECHA date, TD double, TMIN double, doy int"
CLIMATOLOGY = "ID long, doy int, TD_clim double, TMIN_clim double"
COEFFICIENTS = "const_anom double, TMIN_anom_coeff double, TD_anom_lag1 double, TD_anom_lag2 double, TMIN_anom_lag1 double, doy int, r_squared_anom double, ID long"
TIDY = "ID long, zone_id int, doy int, feature_name string, coeff double, r_squared_anom double, h int"
FAILURE = "phase string, bucket_id int, ID long, doy int, exception_type string, message string"
PREDICTION = "FECHA date, ID long, TD_predicted double"
ZONES = "ID long, zone_id int, zone_label string, lon double, lat double"
MANIFEST = "zone_id int, zone_label string, doy int, h int, feature_list string, n_features int, skill double, skill_baseline double, skill_uplift double"
SCALING = "dataset string, mode string, hw string, p int, n_ids int, B int, phase string, trial int, wall_s double, timestamp string"


def require_columns(df: DataFrame, columns, label: str = "frame") -> DataFrame:
    """df, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{label} lacks {missing}; it has {df.columns}")
    return df
