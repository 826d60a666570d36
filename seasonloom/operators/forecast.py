"""Autoregressive forecasts driven by a known exogenous series.

Time runs in sequence within a location and locations run in parallel: the standard recipe folds over one row per
location that holds its days as a sorted array; recipes by zone walk through matrices of many locations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.config import Feature
from seasonloom.operators.series import last_rows
from seasonloom.schema import PREDICTION

#: Days that the recursion walks through at a time.
PART = 32
#: Locations that a zoned forecast walks through together, and the rows of its inputs that it holds for them at most.
TOGETHER, ROWS = 512, 1_000_000
STANDARD_COLUMNS = ("const_anom", "TMIN_anom_coeff", "TD_anom_lag1", "TD_anom_lag2", "TMIN_anom_lag1")


def horizon(future: DataFrame, span: tuple[int, int]) -> DataFrame:
    """ID, FECHA, TMIN, doy of the exogenous days within the years in span."""
    return future.where(F.year("FECHA").between(*span)).select("ID", "FECHA", "TMIN", F.dayofyear("FECHA").alias("doy"))


def predictable_days(coefficients: DataFrame, clim: DataFrame, future: DataFrame, span: tuple[int, int]) -> DataFrame:
    """Days of the horizon with coefficients and the climatology of the day and the two before it."""
    days = horizon(future, span)
    for k in (1, 2):
        days = days.withColumn(f"doy{k}", F.dayofyear(F.date_sub("FECHA", k)))
    at = lambda k: clim.select("ID", F.col("doy").alias(f"doy{k or ''}"), F.col("TD_clim").alias(f"td_clim{k}"), F.col("TMIN_clim").alias(f"tmin_clim{k}"))
    days = days.join(coefficients.select("ID", "doy", *STANDARD_COLUMNS), ["ID", "doy"])
    for k in (0, 1, 2):
        days = days.join(at(k), ["ID", f"doy{k or ''}"])
    return days


def recursive(coefficients: DataFrame, clim: DataFrame, history: DataFrame, future: DataFrame, span: tuple[int, int]) -> DataFrame:
    """FECHA, ID, TD_predicted of the standard recipe.

    The two lagged values are those of the last two predicted days (at first, of the history's last two rows); a day that
    can't be predicted is skipped and leaves them as they are, while their climatology is that of the calendar days
    before. A null coefficient makes null predictions from there on. Locations with less than two rows of history have none.
    """
    # a day's linear form: TD = base + c1 * lag1 + c2 * lag2 + c3 * TMIN of lag 1
    base = F.col("td_clim0") + F.col("const_anom") + F.col("TMIN_anom_coeff") * (F.col("TMIN") - F.col("tmin_clim0")) - F.col("TD_anom_lag1") * F.col("td_clim1") - F.col("TD_anom_lag2") * F.col("td_clim2") - F.col("TMIN_anom_lag1") * F.col("tmin_clim1")
    day = F.struct(F.col("FECHA").alias("day"), base.alias("base"), F.col("TD_anom_lag1").alias("c1"), F.col("TD_anom_lag2").alias("c2"), F.col("TMIN_anom_lag1").alias("c3"), F.col("TMIN").alias("tmin"))
    days = predictable_days(coefficients, clim, future, span).groupBy("ID").agg(F.array_sort(F.collect_list(day)).alias("days"))
    seed = last_rows(history.select("ID", "FECHA", "TD", "TMIN"), 2).groupBy("ID").agg(F.max(F.when(F.col("rn") == 1, F.col("TD"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("TD"))).alias("s2"), F.max(F.when(F.col("rn") == 1, F.col("TMIN"))).alias("m1"), F.count(F.lit(1)).alias("rows")).where("rows = 2")
    none = F.expr("cast(array() as array<struct<day: date, td: double>>)")

    def step(state: Column, x: Column) -> Column:
        value = x["base"] + x["c1"] * state["lag1"] + x["c2"] * state["lag2"] + x["c3"] * state["tmin"]
        # bound once, used three times
        return F.transform(F.array(value), lambda v: F.struct(v.alias("lag1"), state["lag1"].alias("lag2"), x["tmin"].alias("tmin"), F.concat(state["out"], F.array(F.struct(x["day"].alias("day"), v.alias("td")))).alias("out")))[0]

    def month(state: Column, k: Column) -> Column:
        # days are gathered in parts, so that no long array is copied for each of them
        begin = F.struct(state["lag1"].alias("lag1"), state["lag2"].alias("lag2"), state["tmin"].alias("tmin"), none.alias("out"))
        walked = F.aggregate(F.slice("days", k * PART + 1, F.lit(PART)), begin, step)
        return F.transform(F.array(walked), lambda w: F.struct(w["lag1"].alias("lag1"), w["lag2"].alias("lag2"), w["tmin"].alias("tmin"), F.concat(state["out"], F.array(w["out"])).alias("out")))[0]

    start = F.struct(F.col("s1").alias("lag1"), F.col("s2").alias("lag2"), F.col("m1").alias("tmin"), F.expr("cast(array() as array<array<struct<day: date, td: double>>>)").alias("out"))
    parts = F.sequence(F.lit(0), F.ceil(F.size("days") / PART).cast("int") - 1)
    folded = days.join(seed, "ID").select("ID", F.explode(F.flatten(F.aggregate(parts, start, month)["out"])).alias("p"))
    return folded.select(F.col("p.day").alias("FECHA"), "ID", F.col("p.td").alias("TD_predicted"))


def forecast_group(coefficients: pd.DataFrame, clim: pd.DataFrame, history: pd.DataFrame, future: pd.DataFrame, span: tuple[int, int]) -> pd.DataFrame:
    """One location's zoned forecast: any features, lags by calendar days, days without recipe or inputs skipped."""
    empty = pd.DataFrame({"FECHA": pd.Series([], dtype=object), "ID": pd.Series([], dtype="int64"), "TD_predicted": pd.Series([], dtype=float)})
    if coefficients.empty or clim.empty or future.empty:
        return empty
    recipe: dict[int, list] = {}
    for doy, name, value in zip(coefficients["doy"], coefficients["feature_name"], coefficients["coeff"]):
        if value != 0:  # a zero coefficient doesn't ask for its input
            recipe.setdefault(int(doy), []).append((Feature(name), float(value)))
        else:
            recipe.setdefault(int(doy), [])
    clim = clim.dropna(subset=["TD_clim", "TMIN_clim"])
    means = {"TD": dict(zip(clim["doy"], clim["TD_clim"])), "TMIN": dict(zip(clim["doy"], clim["TMIN_clim"]))}
    first, last = pd.Timestamp(span[0], 1, 1), pd.Timestamp(span[1], 12, 31)
    seen: dict[str, dict] = {"TD": {}, "TMIN": {}}
    for frame, names in ((history, ("TD", "TMIN")), (future, ("TMIN",))):
        days = pd.to_datetime(frame["FECHA"])
        for name in names:
            seen[name].update({d: float(v) for d, v in zip(days, frame[name]) if pd.notna(v)})

    def anomaly(var: str, day: pd.Timestamp) -> float | None:
        value, mean = seen[var].get(day), means[var].get(day.dayofyear)
        return None if value is None or mean is None else value - mean

    out = []
    for day in pd.date_range(first, last):
        doy = day.dayofyear
        if doy not in recipe or doy not in means["TD"]:
            continue
        total = means["TD"][doy]
        for feature, value in recipe[doy]:
            x = 1.0 if feature.var is None else anomaly(feature.var, day - pd.Timedelta(days=feature.lag))
            if x is None or not np.isfinite(x):
                break
            total += value * x
        else:
            seen["TD"][day] = total
            out.append((day.date(), total))
    return pd.DataFrame({"FECHA": [d for d, _ in out], "ID": int(coefficients["ID"].iloc[0]), "TD_predicted": [v for _, v in out]}) if out else empty


def zoned(coefficients: DataFrame, clim: DataFrame, history: DataFrame, future: DataFrame, span: tuple[int, int]) -> DataFrame:
    """FECHA, ID, TD_predicted by tidy coefficients (ID, doy, feature_name, coeff): lags by calendar days, any features.

    The four inputs meet by a tag in one shuffle by ID; a location's rows are bounded by its recipe and its days, and
    some hundred locations at a time walk through the days together. One day without recipe or inputs is skipped.
    """
    part = lambda df, kind, **columns: df.select("ID", F.lit(kind).alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in TAGGED])
    first = F.lit(f"{span[0]}-01-01").cast("date")
    # the days that the longest lag among the recipes can ask for, by location
    longest = F.max(F.coalesce(F.regexp_extract("feature_name", "_lag([0-9]+)$", 1).try_cast("int"), F.lit(0)))
    reach = coefficients.where("coeff is not null").groupBy("ID").agg(longest.alias("reach"))
    recent = history.join(reach, "ID").where(F.col("FECHA") >= F.date_sub(first, F.col("reach")))
    tagged = (
        part(coefficients.where("coeff is not null"), "c", doy=F.col("doy"), feature_name=F.col("feature_name"), a=F.col("coeff"))
        .unionByName(part(clim, "m", doy=F.col("doy"), a=F.col("TD_clim"), b=F.col("TMIN_clim")))
        .unionByName(part(recent, "h", FECHA=F.col("FECHA"), a=F.col("TD"), b=F.col("TMIN")))
        .unionByName(part(future.where(F.year("FECHA").between(*span)), "f", FECHA=F.col("FECHA"), b=F.col("TMIN")))
    )

    def work(frames):
        for frame in batches_of_locations(frames):
            yield forecast_batch(frame, span)

    return tagged.repartition("ID").sortWithinPartitions("ID").mapInPandas(work, PREDICTION)


def batches_of_locations(frames):
    """Frames of rows ordered by ID, put together to about TOGETHER whole locations or ROWS rows each."""
    held, rest = [], None
    locations = rows = 0
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        ids = frame["ID"].to_numpy()
        last = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
        rest, whole = frame.iloc[last:], frame.iloc[:last]
        if last:
            held.append(whole)
            locations, rows = locations + int((np.diff(ids[:last]) != 0).sum()) + 1, rows + last
            if locations >= TOGETHER or rows >= ROWS:
                yield pd.concat(held, ignore_index=True)
                held, locations, rows = [], 0, 0
    if rest is not None and len(rest):
        held.append(rest)
    if held:
        yield pd.concat(held, ignore_index=True)


def forecast_batch(frame: pd.DataFrame, span: tuple[int, int]) -> pd.DataFrame:
    """The zoned forecasts of some locations, day by day for all of them at once; as forecast_group() has each.

    frame: the tagged rows of the locations. Values, means and coefficients stand in matrices of location by day; what is
    missing is NaN, and a day that can't be predicted stays so.
    """
    ids, place = np.unique(frame["ID"].to_numpy(np.int64), return_inverse=True)
    kind = frame["kind"].to_numpy()
    first, last = np.datetime64(f"{span[0]}-01-01"), np.datetime64(f"{span[1]}-12-31")
    names = sorted(set(frame["feature_name"].dropna()))
    specs = [Feature(n) for n in names]
    back = max([f.lag for f in specs], default=0)
    start, n_days = first - back, int((last - first).astype(int)) + 1 + back
    means = {v: np.full((len(ids), 367), np.nan) for v in ("TD", "TMIN")}
    values = {v: np.full((len(ids), n_days), np.nan) for v in ("TD", "TMIN")}
    a, b = frame["a"].to_numpy(float), frame["b"].to_numpy(float)
    own = np.flatnonzero((kind == "m") & ~np.isnan(a) & ~np.isnan(b))
    doys = frame["doy"].to_numpy(float)
    for v, x in (("TD", a), ("TMIN", b)):
        means[v][place[own], doys[own].astype(int)] = x[own]
    day = np.full(len(frame), -1)
    dated = np.flatnonzero(np.isin(kind, ["h", "f"]))
    day[dated] = (pd.to_datetime(frame["FECHA"].iloc[dated]).to_numpy().astype("datetime64[D]") - start).astype(int)
    for k, columns in (("h", ("TD", "TMIN")), ("f", ("TMIN",))):
        own = np.flatnonzero((kind == k) & (day >= 0) & (day < n_days))
        for v in columns:
            x = a[own] if v == "TD" else b[own]
            here = ~np.isnan(x)
            values[v][place[own[here]], day[own[here]]] = x[here]
    own = np.flatnonzero(kind == "c")
    recipe = np.zeros((len(ids), 367), bool)
    recipe[place[own], doys[own].astype(int)] = True
    # a zero coefficient, and one that isn't there, doesn't ask for its input
    coefficients = np.zeros((len(specs), len(ids), 367))
    of_name = {n: k for k, n in enumerate(names)}
    coefficients[np.array([of_name[n] for n in frame["feature_name"].iloc[own]], dtype=int), place[own], doys[own].astype(int)] = a[own]
    dates = start + np.arange(n_days)
    of_day = (dates - dates.astype("datetime64[Y]").astype("datetime64[D]")).astype(int) + 1
    anomaly = {v: values[v] - means[v][:, of_day] for v in values}
    out = []
    for t in range(back, n_days):
        doy = of_day[t]
        total = means["TD"][:, doy].copy()
        able = recipe[:, doy] & ~np.isnan(total)
        for k, f in enumerate(specs):
            beta = coefficients[k, :, doy]
            x = np.ones(len(ids)) if f.var is None else anomaly[f.var][:, t - f.lag]
            asked = beta != 0
            able &= ~asked | np.isfinite(x)
            total += np.where(asked, beta * np.where(np.isfinite(x), x, 0.0), 0.0)
        anomaly["TD"][able, t] = total[able] - means["TD"][able, doy]
        who = np.flatnonzero(able)
        out.append((np.full(len(who), t - back), ids[who], total[who]))
    days, who, value = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"FECHA": pd.Series((first + days).astype(object), dtype=object), "ID": who, "TD_predicted": value})


TAGGED = (("doy", "int"), ("feature_name", "string"), ("FECHA", "date"), ("a", "double"), ("b", "double"))


def monthly(predictions: DataFrame) -> DataFrame:
    """ID, FECHA, Value and year_month (yyyy_MM), as monthly files hold them."""
    return predictions.select("ID", "FECHA", F.col("TD_predicted").alias("Value"), F.date_format("FECHA", "yyyy_MM").alias("year_month"))
