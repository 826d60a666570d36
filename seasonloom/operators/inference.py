"""Effect sizes of one method against another: errors by location, bootstrap and sign-flip tests."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.functions.expressions import finite

#: Locations whose draws are made at once.
TOGETHER = 256
#: Draws of 16 bits up to which a location comes 0, 1, 2, .. times: the distribution of Poisson counts of mean 1.
POISSON = tuple(int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def random_bits(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n bits of each location, from md5 digests of location, seed and block of 128: any task makes the same ones, and so does SQL."""
    blocks = range(-(-n // 128))
    raw = b"".join(hashlib.md5(f"{i}:{seed}:{k}".encode()).digest() for i in ids.tolist() for k in blocks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(ids), -1), axis=1)[:, :n]


def poisson_counts(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """How often each location comes in each of n draws: 16 bits of its own decide."""
    bits = random_bits(ids, 16 * n, seed)
    drawn = np.packbits(bits, axis=1).view(">u2").astype(np.int64)
    return np.searchsorted(np.array(POISSON), drawn, side="right")


def per_id_errors(rows: DataFrame, methods: dict[str, str], obs: str = "TD_obs") -> DataFrame:
    """ID, and se_<method>, n_<method> of each method (name: column), for locations with errors of all of them."""
    parts = []
    for name, column in methods.items():
        e = F.col(column) - F.col(obs)
        ok = F.when(finite(F.col(column)) & finite(F.col(obs)), e)
        parts += [F.sum(ok * ok).alias(f"se_{name}"), F.count(ok).alias(f"n_{name}")]
    every = " and ".join(f"n_{m} > 0" for m in methods)
    return rows.groupBy("ID").agg(*parts).where(every)


def pooled(errors: DataFrame, method: str, baseline: str) -> DataFrame:
    """rmse, rmse_baseline, delta_rmse, skill over all locations."""
    root = lambda m: F.sqrt(F.try_divide(F.sum(f"se_{m}"), F.sum(f"n_{m}").cast("double")))
    return errors.agg(root(method).alias("rmse"), root(baseline).alias("rmse_baseline")).select("rmse", "rmse_baseline", (F.col("rmse_baseline") - F.col("rmse")).alias("delta_rmse"), (1 - F.try_divide("rmse", "rmse_baseline")).alias("skill"))


def location_deltas(errors: DataFrame, method: str, baseline: str) -> DataFrame:
    """ID, delta: RMSE of the baseline less that of the method."""
    root = lambda m: F.sqrt(F.col(f"se_{m}") / F.col(f"n_{m}"))
    return errors.select("ID", (root(baseline) - root(method)).alias("delta"))


def effect_size(deltas: DataFrame) -> DataFrame:
    """n, mean_delta, win_fraction, cohens_d (sample standard deviation; null without spread)."""
    d = F.when(finite(F.col("delta")), F.col("delta"))
    sd = F.stddev_samp(d)
    return deltas.agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.avg((d > 0).cast("double")).alias("win_fraction"), F.when(sd > 0, F.try_divide(F.avg(d), sd)).alias("cohens_d"))


def bootstrap(errors: DataFrame, method: str, baseline: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """delta_rmse and skill with their 2.5 and 97.5 percentiles, over locations drawn with replacement.

    How often each location is drawn are Poisson counts of its own: the number of locations varies a little from draw to
    draw where drawing with replacement holds it, which for many locations makes no difference to the limits. Every task
    adds up its own locations for all draws, and only sums by draw are shuffled: a fixed number of rows, however many
    locations.
    """
    columns = [f"se_{method}", f"n_{method}", f"se_{baseline}", f"n_{baseline}"]

    def work(frames):
        sums = np.zeros((n_boot, 4))
        for frame in frames:
            ids, values = frame["ID"].to_numpy(np.int64), frame[columns].to_numpy(float)
            for at in range(0, len(ids), TOGETHER):
                sums += poisson_counts(ids[at : at + TOGETHER], n_boot, seed).T @ values[at : at + TOGETHER]
        yield pd.DataFrame({"draw": np.arange(n_boot), **dict(zip("abcd", sums.T))})

    draws = errors.select("ID", *columns).mapInPandas(work, "draw long, a double, b double, c double, d double").groupBy("draw").agg(*[F.sum(x).alias(x) for x in "abcd"])
    root = lambda s, n: F.sqrt(F.try_divide(F.col(s), F.col(n)))
    draws = draws.select((root("c", "d") - root("a", "b")).alias("delta"), (1 - F.try_divide(root("a", "b"), root("c", "d"))).alias("skill"))
    at = lambda c, p: F.percentile(c, p)
    limits = draws.agg(at("delta", 0.025).alias("delta_lo"), at("delta", 0.975).alias("delta_hi"), at("skill", 0.025).alias("skill_lo"), at("skill", 0.975).alias("skill_hi"), F.lit(1).alias("k"))
    return pooled(errors, method, baseline).withColumn("k", F.lit(1)).join(limits, "k").drop("k")


def sign_flip(deltas: DataFrame, n_perm: int = 5000, seed: int = 0) -> DataFrame:
    """n, observed, p_value: one-sided, (hits + 1) / (n_perm + 1) of random signs whose mean is not below the observed one,
    within rounding. A location's signs are bits of its own; sums by draw are shuffled, a fixed number of rows."""

    def work(frames):
        sums = np.zeros(n_perm + 3)
        for frame in frames:
            frame = frame[np.isfinite(frame["delta"].to_numpy(float))]
            ids, delta = frame["ID"].to_numpy(np.int64), frame["delta"].to_numpy(float)
            for at in range(0, len(ids), TOGETHER):
                signs = 1.0 - 2.0 * random_bits(ids[at : at + TOGETHER], n_perm, seed)
                sums[:n_perm] += np.abs(delta[at : at + TOGETHER]) @ signs
            sums[n_perm:] += delta.sum(), len(ids), np.abs(delta).sum()
        yield pd.DataFrame({"draw": np.arange(n_perm + 3), "s": sums})

    sums = deltas.mapInPandas(work, "draw long, s double").groupBy("draw").agg(F.sum("s").alias("s"))
    total = F.max(F.when(F.col("draw") == n_perm, F.col("s")))
    n = F.max(F.when(F.col("draw") == n_perm + 1, F.col("s")))
    size = F.max(F.when(F.col("draw") == n_perm + 2, F.col("s")))
    one = sums.agg(total.alias("total"), n.alias("n"), size.alias("size"), F.collect_list(F.when(F.col("draw") < n_perm, F.col("s"))).alias("draws"))  # n_perm numbers
    hits = F.size(F.filter("draws", lambda s: s >= F.col("total") - 1e-12 * F.col("size")))
    return one.select(F.col("n").cast("long").alias("n"), F.try_divide("total", "n").alias("observed"), ((hits + 1) / F.lit(float(n_perm + 1))).alias("p_value"))


def effect_table(rows: DataFrame, methods: dict[str, str], method: str = "tuned", baseline: str = "climatology", split: str = "ll1", n_boot: int = 1000, n_perm: int = 5000, seed: int = 0) -> DataFrame:
    """One row of a split's evidence: pooled errors with bootstrap limits, gain by location, effect size and p-value."""
    errors = per_id_errors(rows, methods)
    deltas = location_deltas(errors, method, baseline)
    one = lambda df: df.withColumn("k", F.lit(1))
    found = one(bootstrap(errors, method, baseline, n_boot, seed)).join(one(effect_size(deltas)), "k").join(one(sign_flip(deltas, n_perm, seed).select("p_value")), "k")
    return found.select(F.lit(split).alias("split"), "n", "rmse", "rmse_baseline", "delta_rmse", "delta_lo", "delta_hi", "skill", "skill_lo", "skill_hi", "mean_delta", "win_fraction", "cohens_d", "p_value")
