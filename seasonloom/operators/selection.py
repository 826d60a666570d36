"""Selection of features and bandwidth by zone, with leave-one-year-out skill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.config import STANDARD, TuningConfig
from seasonloom.operators.gram import convolved, day_sums, leave_one_year, stat_names
from seasonloom.operators.series import feature_frame, years
from seasonloom.operators.solve import solve_masked
from seasonloom.operators.spatial import stratified_sample

ALL_DOYS = -1


def held_out_rows(frame: DataFrame, n_features: int, names, h: int, kernel: str, min_samples: int) -> DataFrame:
    """Rows of a feature frame with x (their features) and s (the leave-one-year-out statistics of their own slot).

    Statistics by (ID, year, doy) are spread and added up once, and the own year is taken off the sum over years.
    """
    stats = convolved(day_sums(frame, names, ("ID", "year", "doy")), n_features, h, kernel, keys=("ID", "year"))
    others = leave_one_year(stats, n_features).where(F.col("n") >= min_samples)
    others = others.select("ID", "year", "doy", F.array(*stat_names(n_features)).alias("s"))
    return frame.select("ID", "year", "doy", "target", F.array(*names).alias("x")).join(others, ["ID", "year", "doy"])


def unit_codes(zone, doy, granularity: str):
    """One number for a zone and unit."""
    return zone * 1000 + (doy if granularity == "doy" else 0)


def cosine_skill(rows: DataFrame, n: int, subsets: list[tuple[int, ...]], by: tuple[str, ...] = ("zone_id",), wanted: list | None = None, granularity: str = "doy") -> DataFrame:
    """by, doy, year, subset (index), cosine of predicted and true anomalies of left-out rows, for each subset of features.

    Each batch solves a subset for the rows of the units that ask for it (wanted: their codes for each subset; all units
    without), and sends sums by (by, doy, year, subset) only.
    """
    masks = np.array([[k in s for k in range(n)] for s in subsets])

    def work(frames):
        for frame in frames:
            if not len(frame):
                continue
            stats, x, y = np.stack(frame["s"].to_numpy()), np.stack(frame["x"].to_numpy()), frame["target"].to_numpy(float)
            codes = unit_codes(frame[by[0]].to_numpy(), frame["doy"].to_numpy(), granularity) if wanted is not None else None
            for k, mask in enumerate(masks):
                own = np.flatnonzero(np.isin(codes, wanted[k])) if wanted is not None else np.arange(len(frame))
                beta, _ = solve_masked(stats[own], np.repeat(mask[None], len(own), 0), n)
                p = (beta * x[own]).sum(1)
                ok = np.isfinite(p)
                p, own = p[ok], own[ok]
                part = frame.iloc[own][[*by, "doy", "year"]].assign(subset=k, spy=p * y[own], sxx=p * p, syy=y[own] * y[own])
                yield part.groupby([*by, "doy", "year", "subset"], as_index=False).sum()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    sums = rows.mapInPandas(work, f"{kinds}, doy int, year int, subset int, spy double, sxx double, syy double")
    sums = sums.groupBy(*by, "doy", "year", "subset").agg(*[F.sum(c).alias(c) for c in ("spy", "sxx", "syy")])
    return sums.select(*by, "doy", "year", "subset", F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.try_divide("spy", F.sqrt(F.col("sxx") * F.col("syy")))).alias("cosine"))


def unit_skill(cosines: DataFrame, granularity: str, by: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """by, unit, subset, skill: the mean cosine over years of a day, or over all dates of a zone (unit -1)."""
    unit = F.lit(ALL_DOYS) if granularity == "zone" else F.col("doy")
    return cosines.withColumn("unit", unit).groupBy(*by, "unit", "subset").agg(F.avg("cosine").alias("skill"))


def select(series: DataFrame, zones: DataFrame, tuning: TuningConfig = TuningConfig(), clim: DataFrame | None = None) -> DataFrame:
    """The manifest: zone_id, zone_label, doy, h, feature_list, n_features, skill, skill_baseline, skill_uplift.

    Sampled locations of all zones go through one program, the zone being a group key. For each h the rows with their
    left-out statistics are made once and kept; each round of backward elimination is one job over the distinct subsets
    that any unit proposes. What reaches the driver is one number per unit and subset.
    """
    names, spark = list(tuning.pool), series.sparkSession
    n = len(names)
    sample = stratified_sample(zones, tuning.per_zone_n, tuning.seed).select("ID", "zone_id")
    own = years(series, tuning.base.train_years).join(sample.select("ID"), "ID", "left_semi").repartition("ID")
    frame = feature_frame(own, names, clim)
    best: dict[tuple, tuple] = {}
    for h in dict.fromkeys([*tuning.h_grid, tuning.base.h]):
        rows = held_out_rows(frame, n, names, h, tuning.base.kernel, tuning.base.min_samples).join(sample, "ID").persist()

        def skills(asked):
            """Skill by zone, unit and subset; asked: subsets with the (zone, unit) that ask for them, all if None."""
            subsets = sorted(asked)
            wanted = None if None in asked.values() else [np.array(sorted({unit_codes(z, u, tuning.granularity) for z, u in asked[s]})) for s in subsets]
            found = unit_skill(cosine_skill(rows, n, subsets, wanted=wanted, granularity=tuning.granularity), tuning.granularity).where("skill is not null").collect()
            return {(r["zone_id"], r["unit"], subsets[r["subset"]]): r["skill"] for r in found}

        if h in tuning.h_grid:
            full = tuple(range(n))
            current = {(z, u): (full, v) for (z, u, _), v in skills({full: None}).items()}
            active = {k for k, (s, _) in current.items() if len(s) > 2}
            while active:
                proposals = {k: [tuple(x for x in current[k][0] if x != f) for f in current[k][0] if f] for k in active}
                asked: dict[tuple, set] = {}
                for key, subsets in proposals.items():
                    for s in subsets:
                        asked.setdefault(s, set()).add(key)
                got = skills(asked)
                for key in list(active):
                    ranked = [(got[(*key, s)], -i, s) for i, s in enumerate(proposals[key]) if (*key, s) in got]
                    top = max(ranked, default=None)
                    if top and top[0] - current[key][1] >= tuning.tol:
                        current[key] = (top[2], top[0])
                        if len(top[2]) <= 2:
                            active.discard(key)
                    else:
                        active.discard(key)
            for key, (subset, value) in current.items():
                if key not in best or value > best[key][0]:
                    best[key] = (value, h, subset)
        if h == tuning.base.h:
            base = tuple(sorted(names.index(f) for f in STANDARD)) if set(STANDARD) <= set(names) else None
            baseline = {k[:2]: v for k, v in skills({base: None}).items()} if base else {}
        rows.unpersist()
    out = [(z, u, h, ",".join(names[i] for i in s), len(s), v, baseline.get((z, u))) for (z, u), (v, h, s) in sorted(best.items())]
    made = spark.createDataFrame(out, "zone_id int, doy int, h int, feature_list string, n_features int, skill double, skill_baseline double")
    labels = zones.groupBy("zone_id").agg(F.min("zone_label").alias("zone_label")) if "zone_label" in zones.columns else zones.select("zone_id", F.lit("").alias("zone_label")).distinct()
    return made.join(labels, "zone_id").select("zone_id", "zone_label", "doy", "h", "feature_list", "n_features", "skill", "skill_baseline", (F.col("skill") - F.col("skill_baseline")).alias("skill_uplift"))


def reselect(series: DataFrame, zones: DataFrame, tuning: TuningConfig, train_end: int) -> DataFrame:
    """select() on the years up to train_end only; climatology too is made of these years."""
    return select(series.where(F.year("FECHA") <= train_end), zones, tuning)
