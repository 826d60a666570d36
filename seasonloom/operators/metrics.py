"""Comparisons of coefficient tables and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.functions.expressions import cosine, finite, known, pearson
from seasonloom.operators.fit import WIDE
from seasonloom.config import STANDARD

COEFFICIENTS = tuple(WIDE.get(n, n) for n in STANDARD) + ("r_squared_anom",)


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """in_both, only_a, only_b: how many keys, from one grouping of the tagged union."""
    side = lambda df, k: df.select(*keys, F.lit(k).alias("side"))
    seen = side(a, 1).unionByName(side(b, 2)).groupBy(*keys).agg(F.max((F.col("side") == 1).cast("int")).alias("a"), F.max((F.col("side") == 2).cast("int")).alias("b"))
    count = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n)
    return seen.agg(count((F.col("a") == 1) & (F.col("b") == 1), "in_both"), count(F.col("b") == 0, "only_a"), count(F.col("a") == 0, "only_b"))


def long(df: DataFrame, columns, value: str = "value") -> DataFrame:
    """df's keys with name and value of each column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), known(F.col(c)).alias(value)) for c in columns])).alias("p")
    return df.select(*[c for c in df.columns if c not in columns], pairs).select(*[c for c in df.columns if c not in columns], F.col("p.name").alias("name"), F.col(f"p.{value}").alias(value))


def coefficient_summary(coefficients: DataFrame, columns=COEFFICIENTS) -> DataFrame:
    """coefficient, n, mean, std (population), min, max without missing values."""
    v = F.col("value")
    return long(coefficients.select(*columns), columns).groupBy(F.col("name").alias("coefficient")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def coefficient_delta(a: DataFrame, b: DataFrame, columns=COEFFICIENTS) -> DataFrame:
    """coefficient, n, mean, std, mean_abs, max_abs of b - a over common (ID, doy), with correlation and cosine."""
    joined = a.select("ID", "doy", *columns).alias("a").join(b.select("ID", "doy", *columns).alias("b"), ["ID", "doy"])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), known(F.col(f"a.{c}")).alias("x"), known(F.col(f"b.{c}")).alias("y")) for c in columns])).alias("p")
    found = joined.select(pairs).select("p.*").where("x is not null and y is not null")
    d = F.col("y") - F.col("x")
    return found.groupBy(F.col("name").alias("coefficient")).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"), pearson(F.col("x"), F.col("y")).alias("r"), cosine(F.col("x"), F.col("y")).alias("cosine"))


def score_columns(pred: Column, obs: Column) -> list[Column]:
    """n, rmse, mae, bias, r, cosine of finite pairs; the error is pred - obs."""
    ok = finite(pred) & finite(obs)
    p, o = F.when(ok, pred), F.when(ok, obs)
    e = p - o
    return [F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), pearson(p, o).alias("r"), cosine(p, o).alias("cosine")]


def observed_join(predictions: DataFrame, observed: DataFrame) -> DataFrame:
    """Predictions with td_obs of the same (ID, FECHA)."""
    return predictions.join(observed.select("ID", "FECHA", known(F.col("Value")).alias("td_obs")), ["ID", "FECHA"])


def skill(predictions: DataFrame, observed: DataFrame, pred_col: str = "TD_predicted") -> DataFrame:
    """month (null: all), n, rmse, mae, bias, r, cosine: overall and by month from one scan."""
    joined = observed_join(predictions, observed).withColumn("month", F.month("FECHA"))
    return joined.groupingSets([[], ["month"]], "month").agg(*score_columns(F.col(pred_col), F.col("td_obs")))


def agreement(a: DataFrame, b: DataFrame, pred_col: str = "TD_predicted") -> DataFrame:
    """n, rmse, mae, bias, r, cosine of two prediction tables on common (ID, FECHA); the error is b - a."""
    joined = a.select("ID", "FECHA", F.col(pred_col).alias("x")).join(b.select("ID", "FECHA", F.col(pred_col).alias("y")), ["ID", "FECHA"])
    return joined.agg(*score_columns(F.col("y"), F.col("x")))


def monthly_delta(a: DataFrame, b: DataFrame, pred_col: str = "TD_predicted") -> DataFrame:
    """month, mean_abs: mean absolute difference of two prediction tables."""
    joined = a.select("ID", "FECHA", F.col(pred_col).alias("x")).join(b.select("ID", "FECHA", F.col(pred_col).alias("y")), ["ID", "FECHA"])
    return joined.groupBy(F.month("FECHA").alias("month")).agg(F.avg(F.abs(F.col("y") - F.col("x"))).alias("mean_abs"))


def monthly_bias(rows: DataFrame, pred_col: str = "pred_tuned", obs_col: str = "TD_obs") -> DataFrame:
    """month, n, bias: mean error of a method's backtest rows by month."""
    error = F.when(finite(F.col(pred_col)) & finite(F.col(obs_col)), F.col(pred_col) - F.col(obs_col))
    return rows.groupBy(F.month("FECHA").alias("month")).agg(F.count(error).alias("n"), F.avg(error).alias("bias"))


def verdict(score_a: DataFrame, score_b: DataFrame, label_a: str = "A", label_b: str = "B") -> DataFrame:
    """rmse_a, rmse_b, winner of two one-row scores: the lower RMSE, A if equal."""
    both = score_a.select(F.col("rmse").alias("rmse_a"), F.lit(1).alias("k")).join(score_b.select(F.col("rmse").alias("rmse_b"), F.lit(1).alias("k")), "k").drop("k")
    return both.withColumn("winner", F.when(F.col("rmse_a") <= F.col("rmse_b"), label_a).otherwise(label_b))


def extraction_check(fresh: DataFrame, stored: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """n_both, n_only_fresh, n_only_stored, max_abs, ok: whether two raw tables have the same keys and near values."""
    joined = fresh.select("ID", "FECHA", F.col("Value").alias("x"), F.lit(1).alias("f")).join(stored.select("ID", "FECHA", F.col("Value").alias("y"), F.lit(1).alias("s")), ["ID", "FECHA"], "full_outer")
    count = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n)
    got = joined.agg(count(F.col("f").isNotNull() & F.col("s").isNotNull(), "n_both"), count(F.col("s").isNull(), "n_only_fresh"), count(F.col("f").isNull(), "n_only_stored"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs"))
    return got.withColumn("ok", (F.col("n_only_fresh") == 0) & (F.col("n_only_stored") == 0) & F.coalesce(F.col("max_abs") < tolerance, F.lit(False)))
