"""Registry of the engine's queries and their SQL oracles, over the proxy series of the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.config import STANDARD, FitConfig, TuningConfig
from seasonloom.functions.expressions import bucket_of
from seasonloom.operators import baselines, forecast, gram, inference, metrics, quality, scaling, selection, series, spatial, zoned
from seasonloom.operators.fit import compared, failure_summary, failures, fit, one_step, tidy
from seasonloom.operators.metrics import COEFFICIENTS
from seasonloom.plans.oracle import conv_sql, features_sql, fit_ctes, gram_sql, kernel_sql, pearson_sql, rounded, scores_sql, solve_sql, stat_list, wide_select, with_
from seasonloom.plans.proxies import DAILY_SQL, daily, raw, raw_sql, table, zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TRAIN_END, HOLDOUT = 2000, (2001, 2001)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries():
    """Every query by name."""
    return dict(QUERIES)


def oracle_sql():
    """DuckDB SQL by query name."""
    return dict(ORACLES)


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """df with its double columns rounded to six digits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def coarse(c: str) -> str:
    """SQL of a sum of products, scaled by about 1 / e, which leaves no decimal ties to rounding."""
    return f"round({c} * {'0.000367879' if c in ('yy', 'a_2_2', 'a_2_3', 'a_3_3', 'b_2', 'b_3') else '0.367879'}, 3) AS {c}"


# ---- climatology, series and lags


@query(with_(DAILY_SQL) + f'SELECT "ID", doy, {rounded(["avg(\"TD\") AS \"TD_clim\"", "avg(\"TMIN\") AS \"TMIN_clim\""])} FROM series GROUP BY 1, 2')
def climatology_daily(spark, sf):
    """Means by location and day of year."""
    return r6(series.climatology(daily(spark, sf)))


@query(with_(DAILY_SQL) + f'SELECT "ID", doy, {rounded(["avg(\"TD\") AS \"TD_clim\"", "avg(\"TMIN\") AS \"TMIN_clim\""])} FROM series WHERE year("FECHA") <= {TRAIN_END} GROUP BY 1, 2')
def climatology_train_only(spark, sf):
    """Means over the training years only, missing values skipped."""
    return r6(series.climatology(daily(spark, sf), (1900, TRAIN_END), "skip"))


ODD, EVEN = "l_linenumber <> 3", "l_linenumber <> 2"


@query(f'WITH td AS ({raw_sql("l_extendedprice", ODD)}), tm AS ({raw_sql("l_quantity", EVEN)}) SELECT td."ID", td."FECHA", round(td."Value", 6) AS "TD", round(tm."Value", 6) AS "TMIN", CAST(dayofyear(td."FECHA") AS INTEGER) AS doy, CAST(((td."ID" % 16) + 16) % 16 AS BIGINT) AS id_bucket FROM td JOIN tm ON td."ID" = tm."ID" AND td."FECHA" = tm."FECHA"')
def prepared_series_join(spark, sf):
    """The join of two variables on location and day, with the bucket."""
    joined = series.prepared(raw(spark, sf, "l_extendedprice", ODD), raw(spark, sf, "l_quantity", EVEN))
    return r6(joined).withColumn("id_bucket", bucket_of(F.col("ID"), 16))


@query(with_(DAILY_SQL, *features_sql(STANDARD)) + 'SELECT "ID", "FECHA", doy, round(target, 6) AS target, round(f1, 6) AS tmin_anom, round(f2, 6) AS td_lag1, round(f3, 6) AS td_lag2, round(f4, 6) AS tmin_lag1 FROM feats')
def anomaly_lags(spark, sf):
    """Anomalies and row lags of complete rows."""
    frame = r6(series.feature_frame(daily(spark, sf).repartition("ID"), STANDARD))
    return frame.select("ID", "FECHA", "doy", "target", F.col("TMIN_anom").alias("tmin_anom"), F.col("TD_anom_lag1").alias("td_lag1"), F.col("TD_anom_lag2").alias("td_lag2"), F.col("TMIN_anom_lag1").alias("tmin_lag1"))


LONG = ("const", "TMIN_anom", "TMIN_anom_lag30", "TD_anom_lag7")


@query(with_(DAILY_SQL, *features_sql(LONG)) + 'SELECT "ID", "FECHA", doy, yr AS year, round(target, 6) AS target, round(f1, 6) AS tmin_anom, round(f2, 6) AS tmin_lag30, round(f3, 6) AS td_lag7 FROM feats')
def feature_frame_lag30(spark, sf):
    """A feature frame with long lags."""
    frame = r6(series.feature_frame(daily(spark, sf).repartition("ID"), LONG))
    return frame.select("ID", "FECHA", "doy", "year", "target", F.col("TMIN_anom").alias("tmin_anom"), F.col("TMIN_anom_lag30").alias("tmin_lag30"), F.col("TD_anom_lag7").alias("td_lag7"))


# ---- statistics and fits

TWO = ("const", "TMIN_anom")


@query(with_(DAILY_SQL, *features_sql(STANDARD), gram_sql(5)) + f'SELECT "ID", doy, {', '.join(map(coarse, stat_list(5)))}, n FROM gram')
def gram_day_sums(spark, sf):
    """Products by location and day of year."""
    frame = series.feature_frame(daily(spark, sf).repartition("ID"), STANDARD)
    sums = gram.day_sums(frame, STANDARD)
    return sums.select("ID", "doy", *[F.expr(coarse(c)) for c in stat_list(5)], "n")


@query(with_(DAILY_SQL, *features_sql(TWO), gram_sql(2, '"ID", yr, doy')) + f'SELECT "ID", yr AS year, doy, {', '.join(map(coarse, stat_list(2)))}, n FROM gram')
def gram_year_day_sums(spark, sf):
    """Products by location, year and day of year."""
    frame = series.feature_frame(daily(spark, sf).repartition("ID"), TWO)
    return gram.day_sums(frame, TWO, ("ID", "year", "doy")).select("ID", "year", "doy", *[F.expr(coarse(c)) for c in stat_list(2)], "n")


@query(with_(DAILY_SQL, *features_sql(TWO), gram_sql(2), kernel_sql(11, "Tricube"), conv_sql(2)) + f'SELECT "ID", CAST(doy AS INTEGER) AS doy, {', '.join(map(coarse, stat_list(2)))}, n FROM conv')
def circular_convolution(spark, sf):
    """Kernel-weighted sums of the circular window."""
    frame = series.feature_frame(daily(spark, sf).repartition("ID"), TWO)
    found = gram.convolved(gram.day_sums(frame, TWO), 2, 11, "Tricube")
    return found.select("ID", "doy", *[F.expr(coarse(c)) for c in stat_list(2)], "n")


@query(with_(DAILY_SQL, 'days AS (SELECT "ID", doy, count(*) AS n FROM series GROUP BY 1, 2)') + 'SELECT "ID", CAST(((doy - 1 + delta) % 366 + 366) % 366 + 1 AS INTEGER) AS doy, CAST(sum(n) AS BIGINT) AS n FROM days, (SELECT unnest(generate_series(-11, 11)) AS delta) GROUP BY 1, 2')
def neighbourhood_count(spark, sf):
    """Plain counts of the circular window."""
    days = daily(spark, sf).groupBy("ID", "doy").agg(F.count(F.lit(1)).alias("n"))
    spread = days.select("ID", F.explode(F.array(*[F.lit(d) for d in range(-11, 12)])).alias("d"), "doy", "n")
    return spread.groupBy("ID", (F.pmod(F.col("doy") - 1 + F.col("d"), F.lit(366)) + 1).alias("doy")).agg(F.sum("n").alias("n"))


@query(with_(*fit_ctes(STANDARD)) + wide_select(STANDARD))
def wls_fit_tricube(spark, sf):
    """The standard fit of every location and day of year."""
    return r6(fit(daily(spark, sf)))


@query(with_(*fit_ctes(STANDARD, kernel="Gaussian")) + wide_select(STANDARD))
def wls_fit_gaussian(spark, sf):
    """The fit with the Gaussian kernel."""
    return r6(fit(daily(spark, sf), FitConfig(kernel="Gaussian")))


@query(with_(*fit_ctes(STANDARD, doys="target IN (1, 60, 200, 366)")) + wide_select(STANDARD))
def wls_fit_doy_subset(spark, sf):
    """The fit of some days of year only."""
    return r6(fit(daily(spark, sf), doys=[1, 60, 200, 366]))


@query(with_(*fit_ctes(STANDARD)) + "SELECT 'fit' AS phase, CAST(NULL AS INTEGER) AS bucket_id, \"ID\", CAST(doy AS INTEGER) AS doy, 'SingularSystem' AS exception_type, 'the window''s products are singular' AS message FROM solved WHERE beta_0 IS NULL")
def fit_failures(spark, sf):
    """Failure records of singular fits."""
    return failures(fit(daily(spark, sf)))


@query(with_(*fit_ctes(STANDARD)) + "SELECT 'fit' AS phase, 'SingularSystem' AS exception_type, count(*) AS failures, count(DISTINCT \"ID\") AS locations, CAST(min(doy) AS INTEGER) AS first_doy, CAST(max(doy) AS INTEGER) AS last_doy FROM solved WHERE beta_0 IS NULL HAVING count(*) > 0")
def fit_failure_summary(spark, sf):
    """Failures by kind."""
    return failure_summary(failures(fit(daily(spark, sf))))


@query(with_(*fit_ctes(STANDARD)) + 'SELECT "ID", CAST(NULL AS INTEGER) AS zone_id, CAST(doy AS INTEGER) AS doy, feature_name, round(coeff, 6) AS coeff, round(r2, 6) AS r_squared_anom, 11 AS h FROM (' + " UNION ALL ".join(f"SELECT \"ID\", doy, '{x}' AS feature_name, beta_{i} AS coeff, r2 FROM solved" for i, x in enumerate(STANDARD)) + ")")
def tidy_coefficients(spark, sf):
    """The fit as one row per coefficient."""
    return r6(tidy(fit(daily(spark, sf))))


@query(with_(*fit_ctes(STANDARD), "pred AS (SELECT f.\"ID\", f.\"FECHA\", c.td_clim + " + " + ".join(f"s.beta_{i} * f.f{i}" for i in range(5)) + ' AS p FROM feats f JOIN solved s ON f."ID" = s."ID" AND f.doy = s.doy JOIN clim c ON f."ID" = c."ID" AND f.doy = c.doy)') + 'SELECT "ID", "FECHA", round(p, 5) AS "TD_predicted" FROM pred')
def one_step_prediction(spark, sf):
    """In-sample predictions from observed lags."""
    rows = daily(spark, sf)
    return one_step(rows, fit(rows)).select("ID", "FECHA", F.round("TD_predicted", 5).alias("TD_predicted"))


@query(with_(DAILY_SQL, 'lags AS (SELECT "ID", "FECHA", "TD", "TMIN", lag("TD", 1) OVER w AS td1, lag("TD", 2) OVER w AS td2, lag("TMIN", 1) OVER w AS tm1 FROM series WINDOW w AS (PARTITION BY "ID" ORDER BY "FECHA"))') + 'SELECT "ID", "FECHA", round("TD", 6) AS td, round(td1, 6) AS td1, round(td2, 6) AS td2, round(tm1, 6) AS tm1 FROM lags WHERE td2 IS NOT NULL')
def raw_lags(spark, sf):
    """Lags of the plain values, as the non-anomaly model has them."""
    return r6(series.raw_lags(daily(spark, sf)))


ZERO_CLIM = 'clim AS (SELECT DISTINCT "ID", doy, 0.0 AS td_clim, 0.0 AS tmin_clim FROM series)'


def one_step_sql(name: str) -> str:
    """CTE of one-step predictions."""
    return name + ' AS (SELECT f."ID", f."FECHA", c.td_clim + ' + " + ".join(f"s.beta_{i} * f.f{i}" for i in range(5)) + ' AS p FROM feats f JOIN solved s ON f."ID" = s."ID" AND f.doy = s.doy JOIN clim c ON f."ID" = c."ID" AND f.doy = c.doy)'


@query(with_(*fit_ctes(STANDARD, clim=ZERO_CLIM)) + 'SELECT "ID", CAST(doy AS INTEGER) AS doy, round(r2, 4) AS r2, n FROM solved')
def raw_model_fit(spark, sf):
    """Fits of the model of plain values: explained share of each."""
    found = fit(daily(spark, sf), clim=series.RAW)
    frame = gram.convolved(gram.day_sums(series.feature_frame(daily(spark, sf).repartition("ID"), STANDARD, series.RAW), STANDARD), 5, 11, "Tricube").select("ID", "doy", "n")
    return found.select("ID", "doy", F.round("r_squared_anom", 4).alias("r2")).join(frame, ["ID", "doy"])


@query(
    f'WITH raw_p AS (SELECT * FROM ({with_(*fit_ctes(STANDARD, clim=ZERO_CLIM), one_step_sql("pr"))}SELECT * FROM pr)), anom_p AS (SELECT * FROM ({with_(*fit_ctes(STANDARD), one_step_sql("pr"))}SELECT * FROM pr)), {DAILY_SQL}, '
    + 'j AS (SELECT a.p AS raw, b.p AS anomaly, s."TD" AS o FROM raw_p a JOIN anom_p b ON a."ID" = b."ID" AND a."FECHA" = b."FECHA" JOIN series s ON s."ID" = a."ID" AND s."FECHA" = a."FECHA"), l AS (SELECT \'raw\' AS model, raw AS p, o FROM j UNION ALL SELECT \'anomaly\', anomaly, o FROM j) '
    + "SELECT model, count(*) AS n, round(sqrt(avg((p - o) * (p - o))), 2) AS rmse, round(1 - sum((p - o) * (p - o)) / (var_pop(o) * count(*)), 4) AS r2 FROM l WHERE p IS NOT NULL AND o IS NOT NULL GROUP BY 1"
)
def raw_against_anomaly(spark, sf):
    """Errors of the model of plain values and that of anomalies on common rows."""
    found = compared(daily(spark, sf))
    return found.select("model", "n", F.round("rmse", 2).alias("rmse"), F.round("r2", 4).alias("r2"))


LOYO = (DAILY_SQL, *features_sql(TWO), gram_sql(2, '"ID", yr, doy'), kernel_sql(11, "Tricube"), conv_sql(2, '"ID", yr'), "loyo AS (SELECT \"ID\", yr, doy, " + ", ".join(f'sum({c}) OVER e - {c} AS {c}' for c in [*stat_list(2), "n"]) + ' FROM conv WINDOW e AS (PARTITION BY "ID", doy))')


@query(with_(*LOYO) + f'SELECT "ID", yr AS year, CAST(doy AS INTEGER) AS doy, {', '.join(map(coarse, stat_list(2)))}, CAST(n AS BIGINT) AS n FROM loyo')
def loyo_normal_equations(spark, sf):
    """Statistics of all other years."""
    frame = series.feature_frame(daily(spark, sf).repartition("ID"), TWO)
    stats = gram.convolved(gram.day_sums(frame, TWO, ("ID", "year", "doy")), 2, 11, "Tricube", keys=("ID", "year"))
    return gram.leave_one_year(stats, 2).select("ID", "year", "doy", *[F.expr(coarse(c)) for c in stat_list(2)], "n")


ZONES_SQL = 'zones AS (SELECT s_suppkey AS "ID", CAST(s_nationkey AS INTEGER) AS zone_id, n_name AS zone_label FROM supplier JOIN nation ON s_nationkey = n_nationkey)'


@query(
    with_(*LOYO, *solve_sql(2, "loyo", "n >= 15"), ZONES_SQL, 'pr AS (SELECT z.zone_id, f.doy, f.yr, s.beta_0 * f.f0 + s.beta_1 * f.f1 AS p, f.target AS y FROM feats f JOIN solved s ON f."ID" = s."ID" AND f.yr = s.yr AND f.doy = s.doy JOIN zones z ON f."ID" = z."ID" WHERE s.beta_0 IS NOT NULL)', "co AS (SELECT zone_id, doy, yr, CASE WHEN sum(p * p) > 0 AND sum(y * y) > 0 THEN sum(p * y) / sqrt(sum(p * p) * sum(y * y)) END AS cosine FROM pr GROUP BY 1, 2, 3)")
    + "SELECT zone_id, doy, round(avg(cosine), 5) AS skill FROM co GROUP BY 1, 2"
)
def loyo_cosine_skill(spark, sf):
    """Skill by zone and day: mean cosine over left-out years of the two-feature model."""
    frame = series.feature_frame(daily(spark, sf).repartition("ID"), TWO)
    rows = selection.held_out_rows(frame, 2, TWO, 11, "Tricube", 15).join(zones(spark, sf), "ID")
    skill = selection.unit_skill(selection.cosine_skill(rows, 2, [(0, 1)]), "doy")
    return skill.select("zone_id", F.col("unit").alias("doy"), F.round("skill", 5).alias("skill"))


# ---- zones, recipes, tuning

MANIFEST = [(z, -1, 11, "const,TMIN_anom") for z in range(25)] + [(z, d, 15, "const,TMIN_anom") for z in range(0, 25, 3) for d in (1, 100, 200)]
MANIFEST_SQL = "manifest(zone_id, doy, h, feature_list) AS (VALUES " + ", ".join(f"({z}, {d}, {h}, '{f}')" for z, d, h, f in MANIFEST) + ")"


def manifest(spark):
    """A small recipe table: all days, and some days of some zones."""
    return spark.createDataFrame(MANIFEST, "zone_id int, doy int, h int, feature_list string")


LOOKUP_SQL = "looked AS (SELECT t.zone_id, t.doy, coalesce(e.h, a.h) AS h, coalesce(e.feature_list, a.feature_list) AS feature_list FROM (SELECT zone_id, CAST(unnest(generate_series(1, 366)) AS INTEGER) AS doy FROM (SELECT DISTINCT zone_id FROM manifest)) t LEFT JOIN manifest e ON e.zone_id = t.zone_id AND e.doy = t.doy LEFT JOIN manifest a ON a.zone_id = t.zone_id AND a.doy = -1)"


@query(with_(MANIFEST_SQL, LOOKUP_SQL) + "SELECT zone_id, doy, h, feature_list FROM looked")
def zone_recipe_lookup(spark, sf):
    """The recipe of every zone and day: the day's own, else that of all days."""
    m = manifest(spark)
    days = m.select("zone_id").distinct().select("zone_id", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    return zoned.recipe_lookup(days, m).select("zone_id", "doy", "h", "feature_list")


@query(
    with_(DAILY_SQL, *features_sql(TWO), gram_sql(2), ZONES_SQL, MANIFEST_SQL, LOOKUP_SQL, kernel_sql(11, "Tricube").replace("kernel(", "k11("), kernel_sql(15, "Tricube").replace("kernel(", "k15("), "kernels AS (SELECT 11 AS h, * FROM k11 UNION ALL SELECT 15, * FROM k15)",
          'conv AS (SELECT g."ID", z.zone_id, l.doy, l.h, ' + ", ".join(f"sum(k.w * g.{c}) AS {c}" for c in stat_list(2)) + ', sum(g.n) AS n FROM gram g JOIN zones z ON g."ID" = z."ID" JOIN looked l ON l.zone_id = z.zone_id JOIN kernels k ON k.h = l.h AND l.doy = ((g.doy - 1 + k.delta) % 366 + 366) % 366 + 1 GROUP BY 1, 2, 3, 4)', *solve_sql(2))
    + 'SELECT "ID", zone_id, doy, \'const\' AS feature_name, round(beta_0, 5) AS coeff, round(r2, 5) AS r_squared_anom, h FROM solved UNION ALL SELECT "ID", zone_id, doy, \'TMIN_anom\', round(beta_1, 5), round(r2, 5), h FROM solved'
)
def zoned_fit_two_features(spark, sf):
    """Fits by zone recipe, two features, two bandwidths."""
    found = zoned.zoned_fit(daily(spark, sf), zones(spark, sf), manifest(spark), pool=TWO)
    return found.select("ID", "zone_id", "doy", "feature_name", F.round("coeff", 5).alias("coeff"), F.round("r_squared_anom", 5).alias("r_squared_anom"), "h")


@query()
def zone_selection(spark, sf):
    """Recipes selected by zone and day, with the defaults of tuning."""
    return r6(selection.select(daily(spark, sf), zones(spark, sf), TuningConfig()))


@query(with_(ZONES_SQL) + "SELECT zone_id, count(*) AS n FROM zones GROUP BY 1")
def zone_counts(spark, sf):
    """Locations by zone."""
    return spatial.zone_counts(zones(spark, sf))


@query(with_(MANIFEST_SQL) + "SELECT feature, count(*) AS n FROM (SELECT unnest(string_split(feature_list, ',')) AS feature FROM manifest) GROUP BY 1")
def feature_retention(spark, sf):
    """How often recipes hold each feature."""
    return zoned.feature_retention(manifest(spark))


@query(with_(ZONES_SQL) + "SELECT \"ID\", zone_id, zone_label FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY md5(\"ID\" || ':0'), \"ID\") AS rn FROM zones) WHERE rn <= 2")
def stratified_sample_ids(spark, sf):
    """Two locations of each zone, by digest."""
    return spatial.stratified_sample(zones(spark, sf), 2)


# ---- forecasts

def train_sql(train_end: int) -> str:
    """CTE train."""
    return f'train AS (SELECT * FROM series WHERE year("FECHA") <= {train_end})'


TRAIN_SQL = train_sql(TRAIN_END)


@query(with_(DAILY_SQL, TRAIN_SQL) + 'SELECT "ID", "FECHA", round("TD", 6) AS "TD", round("TMIN", 6) AS "TMIN", CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY "ID" ORDER BY "FECHA" DESC) AS rn FROM train) WHERE rn <= 2')
def forecast_seed_last_two(spark, sf):
    """Each location's last two rows of history."""
    rows = daily(spark, sf).where(F.year("FECHA") <= TRAIN_END)
    return r6(series.last_rows(rows.select("ID", "FECHA", "TD", "TMIN"), 2))


def split(spark, sf):
    """Training rows, held-out rows, and coefficients and means of the training rows."""
    rows = daily(spark, sf)
    train, held = rows.where(F.year("FECHA") <= TRAIN_END), series.years(rows, HOLDOUT)
    return train, held, fit(train).where("const_anom is not null"), series.climatology(train)


def recursive_ctes(train_end: int, holdout: tuple[int, int]) -> tuple[str, ...]:
    """CTEs from the tables to walk, a forecast day by day."""
    return (
        *fit_ctes(STANDARD, source="train", extra=(train_sql(train_end),)),
        "coef AS MATERIALIZED (SELECT * FROM solved WHERE beta_0 IS NOT NULL)",
        f'days AS MATERIALIZED (SELECT h."ID", h."FECHA", h."TMIN", h."TMIN" - c0.tmin_clim AS x1, c0.td_clim AS base, c1.td_clim AS td1, c2.td_clim AS td2, c1.tmin_clim AS tm1, k.beta_0, k.beta_1, k.beta_2, k.beta_3, k.beta_4, row_number() OVER (PARTITION BY h."ID" ORDER BY h."FECHA") AS rn FROM series h JOIN coef k ON k."ID" = h."ID" AND k.doy = h.doy JOIN clim c0 ON c0."ID" = h."ID" AND c0.doy = h.doy JOIN clim c1 ON c1."ID" = h."ID" AND c1.doy = dayofyear(h."FECHA" - 1) JOIN clim c2 ON c2."ID" = h."ID" AND c2.doy = dayofyear(h."FECHA" - 2) WHERE year(h."FECHA") BETWEEN {holdout[0]} AND {holdout[1]})',
        'seed AS (SELECT "ID", max(CASE WHEN rn = 1 THEN "TD" END) AS s1, max(CASE WHEN rn = 2 THEN "TD" END) AS s2, max(CASE WHEN rn = 1 THEN "TMIN" END) AS m1 FROM (SELECT *, row_number() OVER (PARTITION BY "ID" ORDER BY "FECHA" DESC) AS rn FROM train) WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2)',
        'walk AS (SELECT s."ID", CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS "FECHA", s1 AS l1, s2 AS l2, m1 AS m FROM seed s UNION ALL SELECT d."ID", d.rn, d."FECHA", d.base + d.beta_0 + d.beta_1 * d.x1 + d.beta_2 * (w.l1 - d.td1) + d.beta_3 * (w.l2 - d.td2) + d.beta_4 * (w.m - d.tm1), w.l1, d."TMIN" FROM walk w JOIN days d ON d."ID" = w."ID" AND d.rn = w.rn + 1)',
    )


RECURSIVE = recursive_ctes(TRAIN_END, HOLDOUT)


def recursive_with(*ctes: str) -> str:
    """A WITH RECURSIVE clause."""
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


@query(recursive_with(*RECURSIVE) + 'SELECT "FECHA", "ID", round(l1, 5) AS "TD_predicted" FROM walk WHERE rn > 0')
def forecast_recursive(spark, sf):
    """A year's forecast, each day from the ones before."""
    train, held, coefficients, clim = split(spark, sf)
    found = forecast.recursive(coefficients, clim, train, held, HOLDOUT)
    return found.select("FECHA", "ID", F.round("TD_predicted", 5).alias("TD_predicted"))


ZONED = (
    *features_sql(TWO, "train"), gram_sql(2), ZONES_SQL, MANIFEST_SQL, LOOKUP_SQL, kernel_sql(11, "Tricube").replace("kernel(", "k11("), kernel_sql(15, "Tricube").replace("kernel(", "k15("), "kernels AS (SELECT 11 AS h, * FROM k11 UNION ALL SELECT 15, * FROM k15)",
    'conv AS (SELECT g."ID", z.zone_id, l.doy, l.h, ' + ", ".join(f"sum(k.w * g.{c}) AS {c}" for c in stat_list(2)) + ', sum(g.n) AS n FROM gram g JOIN zones z ON g."ID" = z."ID" JOIN looked l ON l.zone_id = z.zone_id JOIN kernels k ON k.h = l.h AND l.doy = ((g.doy - 1 + k.delta) % 366 + 366) % 366 + 1 GROUP BY 1, 2, 3, 4)',
    *solve_sql(2),
)


@query(with_(DAILY_SQL, TRAIN_SQL, *ZONED) + f'SELECT h."FECHA", h."ID", round(c.td_clim + s.beta_0 + s.beta_1 * (h."TMIN" - c.tmin_clim), 4) AS "TD_predicted" FROM series h JOIN solved s ON s."ID" = h."ID" AND s.doy = h.doy JOIN clim c ON c."ID" = h."ID" AND c.doy = h.doy WHERE s.beta_0 IS NOT NULL AND year(h."FECHA") BETWEEN {HOLDOUT[0]} AND {HOLDOUT[1]}')
def forecast_zoned(spark, sf):
    """A year's forecast by zone recipes, coefficients of any features and calendar lags."""
    rows = daily(spark, sf)
    train, held = rows.where(F.year("FECHA") <= TRAIN_END), series.years(rows, HOLDOUT)
    coefficients = zoned.zoned_fit(train, zones(spark, sf), manifest(spark), pool=TWO)
    found = forecast.zoned(coefficients, series.climatology(train), train, held, HOLDOUT)
    return found.select("FECHA", "ID", F.round("TD_predicted", 4).alias("TD_predicted"))


LAGGED = ("const", "TMIN_anom", "TD_anom_lag1", "TD_anom_lag2", "TMIN_anom_lag7", "TD_anom_lag30")


@query(
    recursive_with(DAILY_SQL, TRAIN_SQL, *features_sql(LAGGED[:2], "train")[:1],
                   f'held AS MATERIALIZED (SELECT * FROM series WHERE year("FECHA") BETWEEN {HOLDOUT[0]} AND {HOLDOUT[1]})',
                   'xs AS MATERIALIZED (SELECT "ID", "FECHA", "TMIN" - c.tmin_clim AS m FROM (SELECT "ID", "FECHA", doy, "TMIN" FROM train UNION ALL SELECT "ID", "FECHA", doy, "TMIN" FROM held) JOIN clim c USING ("ID", doy))',
                   'hist AS MATERIALIZED (SELECT t."ID", t."FECHA", t."TD" - c.td_clim AS v FROM train t JOIN clim c USING ("ID", doy))',
                   f"days AS MATERIALIZED (SELECT i.\"ID\", CAST(DATE '{HOLDOUT[0]}-01-01' + CAST(k AS INTEGER) AS DATE) AS d, k, c.td_clim FROM (SELECT DISTINCT \"ID\" FROM train) i, range(date_diff('day', DATE '{HOLDOUT[0]}-01-01', DATE '{HOLDOUT[1]}-12-31') + 1) t(k) LEFT JOIN clim c ON c.\"ID\" = i.\"ID\" AND c.doy = dayofyear(DATE '{HOLDOUT[0]}-01-01' + CAST(k AS INTEGER)))",
                   # the state holds the last thirty anomalies, null where a day has none
                   f"start AS (SELECT i.\"ID\", list(h.v ORDER BY b DESC) AS s FROM (SELECT DISTINCT \"ID\" FROM train) i, range(1, 31) t(b) LEFT JOIN hist h ON h.\"ID\" = i.\"ID\" AND h.\"FECHA\" = DATE '{HOLDOUT[0]}-01-01' - CAST(b AS INTEGER) GROUP BY 1)",
                   'ins AS MATERIALIZED (SELECT d."ID", d.k, d.d, d.td_clim, x0.m AS m0, x7.m AS m7 FROM days d LEFT JOIN xs x0 ON x0."ID" = d."ID" AND x0."FECHA" = d.d LEFT JOIN xs x7 ON x7."ID" = d."ID" AND x7."FECHA" = d.d - 7)',
                   'go AS (SELECT "ID", CAST(-1 AS BIGINT) AS k, CAST(NULL AS DATE) AS d, CAST(NULL AS DOUBLE) AS p, s FROM start UNION ALL SELECT i."ID", i.k, i.d, i.td_clim + v, list_append(list_slice(g.s, 2, 30), v) FROM (SELECT g."ID", g.k, g.s, 0.5 + 0.3 * i.m0 + 0.2 * g.s[30] + 0.1 * g.s[29] - 0.1 * i.m7 + 0.15 * g.s[1] AS v FROM go g JOIN ins i ON i."ID" = g."ID" AND i.k = g.k + 1) g JOIN ins i ON i."ID" = g."ID" AND i.k = g.k + 1)')
    + 'SELECT d AS "FECHA", "ID", round(p, 4) AS "TD_predicted" FROM go WHERE p IS NOT NULL'
)
def forecast_zoned_lags(spark, sf):
    """A year's forecast with given coefficients of calendar lags 1, 2, 7 and 30; days whose inputs are missing are skipped."""
    rows = daily(spark, sf)
    train, held = rows.where(F.year("FECHA") <= TRAIN_END), series.years(rows, HOLDOUT)
    values = dict(zip(LAGGED, (0.5, 0.3, 0.2, 0.1, -0.1, 0.15)))
    recipe = F.explode(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])).alias("feature_name", "coeff")
    days = train.select("ID").distinct().select("ID", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy")).select("ID", "doy", recipe)
    found = forecast.zoned(days, series.climatology(train), train, held, HOLDOUT)
    return found.select("FECHA", "ID", F.round("TD_predicted", 4).alias("TD_predicted"))


@query(recursive_with(*RECURSIVE) + "SELECT \"ID\", \"FECHA\", round(l1, 5) AS \"Value\", strftime(\"FECHA\", '%Y_%m') AS year_month FROM walk WHERE rn > 0")
def monthly_export(spark, sf):
    """The forecast as monthly files hold it."""
    train, held, coefficients, clim = split(spark, sf)
    found = forecast.monthly(forecast.recursive(coefficients, clim, train, held, HOLDOUT))
    return found.select("ID", "FECHA", F.round("Value", 5).alias("Value"), "year_month")


# ---- completeness and repair

BROKEN_SQL = 'broken AS (SELECT * FROM solved WHERE doy NOT IN (10, 20) AND NOT (doy = 30 AND "ID" % 7 = 0))'
DAYS_SQL = "days AS (SELECT CAST(unnest(generate_series(1, 366)) AS INTEGER) AS doy)"


def broken(spark, sf):
    """A coefficient table with days and locations missing."""
    return fit(daily(spark, sf)).where("doy not in (10, 20) and not (doy = 30 and ID % 7 = 0)")


def n_locations(spark, sf):
    """How many locations there should be."""
    return table(spark, sf, "supplier").count()


@query(with_(*fit_ctes(STANDARD), BROKEN_SQL, DAYS_SQL, 'counts AS (SELECT doy, count(DISTINCT "ID") AS n FROM broken GROUP BY 1)') + "SELECT d.doy, coalesce(n, 0) AS n_ids, (SELECT count(*) FROM supplier) AS expected, n IS NULL AS missing, coalesce(n <> (SELECT count(*) FROM supplier), true) AS incomplete FROM days d LEFT JOIN counts c ON d.doy = c.doy")
def completeness_by_doy(spark, sf):
    """Locations of each day of year against those expected."""
    return quality.completeness(broken(spark, sf), n_locations(spark, sf))


@query(with_(*fit_ctes(STANDARD), BROKEN_SQL, DAYS_SQL, 'counts AS (SELECT doy, count(DISTINCT "ID") AS n FROM broken GROUP BY 1)') + "SELECT d.doy FROM days d JOIN counts c ON d.doy = c.doy WHERE n < (SELECT count(*) FROM supplier)")
def incomplete_doys(spark, sf):
    """Present days with too few locations."""
    return quality.completeness(broken(spark, sf), n_locations(spark, sf), include_missing=False, strict=False).where("incomplete").select("doy")


@query(with_(*fit_ctes(STANDARD), BROKEN_SQL, DAYS_SQL, "counts AS (SELECT doy, count(*) AS n FROM broken GROUP BY 1)") + "SELECT d.doy, coalesce(n, 0) AS rows, CASE WHEN n IS NULL THEN 'missing' WHEN n <> (SELECT count(*) FROM supplier) THEN 'wrong_count' ELSE 'ok' END AS status FROM days d LEFT JOIN counts c ON d.doy = c.doy")
def model_row_counts(spark, sf):
    """Rows by day of year against those expected."""
    return quality.row_counts(broken(spark, sf), n_locations(spark, sf))


@query("SELECT count(DISTINCT s_suppkey) AS expected FROM supplier")
def expected_ids(spark, sf):
    """Distinct locations of the grid."""
    return quality.expected_count(table(spark, sf, "supplier"), "s_suppkey")


@query(with_(*fit_ctes(STANDARD)) + wide_select(STANDARD))
def patch_coefficients(spark, sf):
    """A broken table made whole: incomplete days fitted again and patched in."""
    rows = daily(spark, sf)
    return r6(quality.patch(broken(spark, sf), fit(rows, doys=[10, 20, 30]), [10, 20, 30]))


@query(with_(*fit_ctes(STANDARD), BROKEN_SQL, "patch AS (SELECT * FROM solved WHERE doy IN (10, 20, 30, 40))") + "SELECT (SELECT count(*) FROM broken) AS rows_before, (SELECT count(*) FROM broken WHERE doy IN (10, 20, 30)) AS rows_removed, (SELECT count(*) FROM patch) AS rows_loaded, (SELECT count(*) FROM patch WHERE doy IN (10, 20, 30)) AS rows_used, (SELECT count(*) FROM broken WHERE doy NOT IN (10, 20, 30)) + (SELECT count(*) FROM patch WHERE doy IN (10, 20, 30)) AS rows_out")
def patch_summary(spark, sf):
    """Rows before, removed, loaded, used and out of a patch."""
    return quality.patch_summary(broken(spark, sf), fit(daily(spark, sf), doys=[10, 20, 30, 40]), [10, 20, 30])


@query(with_(*fit_ctes(STANDARD), 'good AS (SELECT "ID" % 8 AS b, count(DISTINCT "ID") AS ids, count(*) AS n FROM solved GROUP BY 1)', 'bad AS (SELECT "ID" % 8 AS b, count(*) AS n FROM solved WHERE beta_0 IS NULL GROUP BY 1)') + "SELECT CAST(g.b AS INTEGER) AS id_bucket, g.ids AS id_count, g.n AS coeff_rows, coalesce(bad.n, 0) AS failure_rows, CASE WHEN g.n > 0 THEN 'ok' ELSE 'empty' END AS status FROM good g LEFT JOIN bad ON g.b = bad.b")
def bucket_summary(spark, sf):
    """Counts by bucket of a training run."""
    found = fit(daily(spark, sf))
    return quality.bucket_summary(found, failures(found), 8)


# ---- comparison and scores

A_SQL, B_SQL = [*fit_ctes(STANDARD)], [*fit_ctes(STANDARD, kernel="Gaussian")]
NAMES_SQL = dict(zip(COEFFICIENTS, [f"beta_{i}" for i in range(5)] + ["r2"]))


def nested(ctes, body: str) -> str:
    """A query with its own WITH clause, as a subquery."""
    return f"({with_(*ctes)}{body})"


def two_fits(spark, sf):
    """The fit with either kernel."""
    rows = daily(spark, sf)
    return fit(rows), fit(rows, FitConfig(kernel="Gaussian"))


@query(f"""WITH a AS {nested(A_SQL, 'SELECT "ID", doy FROM solved WHERE doy <= 300')}, b AS {nested(A_SQL, 'SELECT "ID", doy FROM solved WHERE doy > 50')}
SELECT (SELECT count(*) FROM a JOIN b USING ("ID", doy)) AS in_both, (SELECT count(*) FROM a ANTI JOIN b USING ("ID", doy)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING ("ID", doy)) AS only_b""")
def coverage_counts(spark, sf):
    """Common and own keys of two coefficient tables."""
    found = fit(daily(spark, sf))
    return metrics.coverage(found.where("doy <= 300"), found.where("doy > 50"), ["ID", "doy"])


@query(with_(*A_SQL) + " UNION ALL ".join(f"SELECT '{n}' AS coefficient, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max FROM solved" for n, c in NAMES_SQL.items()))
def coefficient_summary(spark, sf):
    """Distribution of each coefficient."""
    return r5(metrics.coefficient_summary(fit(daily(spark, sf))))


def r5(df: DataFrame) -> DataFrame:
    """df with its double columns rounded to five digits."""
    return df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    f'WITH a AS {nested(A_SQL, "SELECT * FROM solved")}, b AS {nested(B_SQL, "SELECT * FROM solved")}, '
    + "j AS (" + " UNION ALL ".join(f"SELECT '{n}' AS coefficient, a.{c} AS x, b.{c} AS y FROM a JOIN b ON a.\"ID\" = b.\"ID\" AND a.doy = b.doy WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL" for n, c in NAMES_SQL.items()) + ") "
    + f"SELECT coefficient, count(*) AS n, round(avg(y - x), 5) AS mean, round(stddev_pop(y - x), 5) AS std, round(avg(abs(y - x)), 5) AS mean_abs, round(max(abs(y - x)), 5) AS max_abs, round({pearson_sql('x', 'y')}, 5) AS r, round(sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 5) AS cosine FROM j GROUP BY 1"
)
def coefficient_delta(spark, sf):
    """Differences of two coefficient tables."""
    return r5(metrics.coefficient_delta(*two_fits(spark, sf)))


PRED_A = f'SELECT l_suppkey AS "ID", CAST(l_shipdate AS DATE) AS "FECHA", avg(l_quantity) AS p FROM lineitem WHERE {ODD} GROUP BY 1, 2'
PRED_B = f'SELECT l_suppkey AS "ID", CAST(l_shipdate AS DATE) AS "FECHA", avg(l_quantity) AS p FROM lineitem WHERE {EVEN} GROUP BY 1, 2'


def two_predictions(spark, sf):
    """Two prediction tables that overlap in part."""
    of = lambda where: raw(spark, sf, "l_quantity", where).withColumnRenamed("Value", "TD_predicted")
    return of(ODD), of(EVEN)


PAIRS_SQL = f'WITH a AS ({PRED_A}), b AS ({PRED_B}), j AS (SELECT a."FECHA", a.p AS x, b.p AS y FROM a JOIN b ON a."ID" = b."ID" AND a."FECHA" = b."FECHA") '


@query(PAIRS_SQL + f"SELECT {scores_sql('y', 'x')} FROM j")
def prediction_agreement(spark, sf):
    """How far two prediction tables agree."""
    return r6(metrics.agreement(*two_predictions(spark, sf)))


@query(PAIRS_SQL + 'SELECT CAST(month("FECHA") AS INTEGER) AS month, round(avg(abs(y - x)), 6) AS mean_abs FROM j GROUP BY 1')
def prediction_monthly_delta(spark, sf):
    """Mean absolute difference by month."""
    return r6(metrics.monthly_delta(*two_predictions(spark, sf)))


OBS_SQL = f'SELECT l_suppkey AS "ID", CAST(l_shipdate AS DATE) AS "FECHA", avg(l_quantity) AS o FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2'
SKILL_SQL = f'WITH a AS ({PRED_A}), obs AS ({OBS_SQL}), j AS (SELECT month(a."FECHA") AS month, a.p, obs.o FROM a JOIN obs ON a."ID" = obs."ID" AND a."FECHA" = obs."FECHA") '


def observed(spark, sf):
    """Observations of part of the days."""
    return raw(spark, sf, "l_quantity", "l_linenumber <= 3")


@query(SKILL_SQL + f"SELECT {scores_sql('p', 'o')} FROM j")
def skill_overall(spark, sf):
    """Skill over all days."""
    return r6(metrics.skill(two_predictions(spark, sf)[0], observed(spark, sf)).where("month is null").drop("month"))


@query(SKILL_SQL + f"SELECT CAST(month AS INTEGER) AS month, {scores_sql('p', 'o')} FROM j GROUP BY 1")
def skill_monthly(spark, sf):
    """Skill by month."""
    return r6(metrics.skill(two_predictions(spark, sf)[0], observed(spark, sf)).where("month is not null"))


@query(f'WITH a AS ({PRED_A}), b AS ({PRED_B}), obs AS ({OBS_SQL}), ra AS (SELECT sqrt(avg((p - o) * (p - o))) AS r FROM a JOIN obs USING ("ID", "FECHA")), rb AS (SELECT sqrt(avg((p - o) * (p - o))) AS r FROM b JOIN obs USING ("ID", "FECHA")) SELECT round(ra.r, 6) AS rmse_a, round(rb.r, 6) AS rmse_b, CASE WHEN ra.r <= rb.r THEN \'A\' ELSE \'B\' END AS winner FROM ra, rb')
def skill_verdict(spark, sf):
    """Which of two prediction tables has the lower error."""
    a, b = two_predictions(spark, sf)
    of = lambda p: metrics.skill(p, observed(spark, sf)).where("month is null")
    return r6(metrics.verdict(of(a), of(b)))


@query(f'WITH a AS ({raw_sql("l_quantity", ODD)}), b AS ({raw_sql("l_quantity", EVEN)}), j AS (SELECT a."Value" AS x, b."Value" AS y FROM a FULL JOIN b ON a."ID" = b."ID" AND a."FECHA" = b."FECHA"), g AS (SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) FILTER (WHERE y IS NULL) AS n_only_fresh, count(*) FILTER (WHERE x IS NULL) AS n_only_stored, max(abs(x - y)) AS m FROM j) SELECT n_both, n_only_fresh, n_only_stored, round(m, 6) AS max_abs, n_only_fresh = 0 AND n_only_stored = 0 AND coalesce(m < 0.05, false) AS ok FROM g')
def extraction_check(spark, sf):
    """Whether two raw tables hold the same."""
    return r6(metrics.extraction_check(raw(spark, sf, "l_quantity", ODD), raw(spark, sf, "l_quantity", EVEN)))


@query(f'WITH r AS (SELECT l_suppkey AS "ID", CAST(l_shipdate AS DATE) AS "FECHA", l_linenumber, l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) SELECT "ID", "FECHA", l_orderkey, l_linenumber, l_quantity FROM r WHERE rn = 1')
def deduplicate_first(spark, sf):
    """The first row of each location and day, by an explicit order."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ID"), F.to_date("l_shipdate").alias("FECHA"), "l_orderkey", "l_linenumber", "l_quantity")
    return series.deduplicated(rows, ["ID", "FECHA"], [F.col("l_orderkey"), F.col("l_linenumber")])


# ---- baselines and effect sizes


@query(with_(DAILY_SQL, ZONES_SQL, 'm AS (SELECT zone_id, count(*) AS n, sum("TMIN") AS sx, sum("TD") AS sy, sum("TMIN" * "TMIN") AS sxx, sum("TMIN" * "TD") AS sxy FROM series JOIN zones USING ("ID") GROUP BY 1)', "f AS (SELECT *, n * sxx - sx * sx AS det FROM m)", "s AS (SELECT *, CASE WHEN n < 2 OR abs(det) < 1e-9 THEN 0.0 ELSE (n * sxy - sx * sy) / det END AS slope FROM f)") + "SELECT zone_id, round((sy - slope * sx) / n, 4) AS intercept, round(slope, 4) AS slope FROM s")
def zone_ols(spark, sf):
    """The regression of TD on TMIN by zone."""
    rows = daily(spark, sf).join(zones(spark, sf), "ID")
    return baselines.zone_ols(rows).select("zone_id", F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))


def ladder(spark, sf):
    """Backtest rows of the holdout year."""
    train, held, coefficients, clim = split(spark, sf)
    tuned = forecast.recursive(coefficients, clim, train, held, HOLDOUT)
    return baselines.ladder(train.unionByName(held), zones(spark, sf), tuned, TRAIN_END, HOLDOUT)


def ladder_ctes(train_end: int, holdout: tuple[int, int]) -> tuple[str, ...]:
    """CTEs from the tables to bt, the backtest rows."""
    return (
        *recursive_ctes(train_end, holdout), ZONES_SQL,
        'om AS (SELECT zone_id, count(*) AS n, sum("TMIN") AS sx, sum("TD") AS sy, sum("TMIN" * "TMIN") AS sxx, sum("TMIN" * "TD") AS sxy FROM train JOIN zones USING ("ID") GROUP BY 1)',
        "ols AS (SELECT zone_id, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS intercept FROM om)",
        'bt AS (SELECT h."ID", h."FECHA", h."TD" AS o, w.l1 AS tuned, c.td_clim AS climatology, h."TMIN" AS td_eq_tmin, ols.intercept + ols.slope * h."TMIN" AS zone_ols FROM walk w JOIN series h ON h."ID" = w."ID" AND h."FECHA" = w."FECHA" JOIN zones z ON z."ID" = h."ID" JOIN ols ON ols.zone_id = z.zone_id LEFT JOIN clim c ON c."ID" = h."ID" AND c.doy = h.doy WHERE w.rn > 0)',
    )


LADDER = ladder_ctes(TRAIN_END, HOLDOUT)
#: Scores by method from bt.
SCORES = ("lo AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, {m} AS p, o FROM bt WHERE {m} IS NOT NULL" for m in ("climatology", "td_eq_tmin", "zone_ols", "tuned")) + ")", f"sc AS (SELECT method, count(*) AS n, sqrt(avg((p - o) * (p - o))) AS rmse, avg(abs(p - o)) AS mae, avg(p - o) AS bias, {pearson_sql('p', 'o')} AS r FROM lo GROUP BY 1)")


def scores_of(split: str) -> str:
    """The score rows of a split from sc."""
    return f"SELECT '{split}' AS split, method, n, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(bias, 3) AS bias, round(r, 5) AS r, round(1 - rmse / (SELECT rmse FROM sc WHERE method = 'climatology'), 5) AS skill_vs_clim FROM sc"


@query(recursive_with(*LADDER, *SCORES) + scores_of("ll1"))
def baseline_ladder(spark, sf):
    """Scores of climatology, TD = TMIN, the zone regression and the forecast."""
    return score_digits(baselines.ladder_scores(ladder(spark, sf)))


def score_digits(scores: DataFrame) -> DataFrame:
    """Scores rounded."""
    digits = {"rmse": 3, "mae": 3, "bias": 3, "r": 5, "skill_vs_clim": 5}
    return scores.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in scores.columns])


#: The proxy series ends earlier than the model's: last training year and holdout by lead.
PROXY_SPLITS = {"ll1": (TRAIN_END, HOLDOUT), "ll2": (TRAIN_END - 1, (HOLDOUT[0] - 1, HOLDOUT[1]))}
BACKTEST_SQL = " UNION ALL ".join(f"SELECT * FROM ({recursive_with(*ladder_ctes(*x), *SCORES)}{scores_of(name)})" for name, x in PROXY_SPLITS.items())


def backtest(spark, sf):
    """Scores of all splits, each fitted on its own years."""

    def forecaster(train, held, holdout):
        clim = series.climatology(train)
        return forecast.recursive(fit(train).where("const_anom is not null"), clim, train, held, holdout)

    return baselines.backtest(daily(spark, sf), zones(spark, sf), forecaster, PROXY_SPLITS)


@query(BACKTEST_SQL)
def backtest_scores(spark, sf):
    """Scores of all methods by split."""
    return score_digits(backtest(spark, sf))


@query(f"SELECT CAST(replace(split, 'll', '') AS INTEGER) AS lead, method, rmse FROM ({BACKTEST_SQL})")
def lead_curve(spark, sf):
    """Errors by years ahead."""
    return baselines.lead_curve(score_digits(backtest(spark, sf)))


@query(recursive_with(*LADDER) + 'SELECT CAST(month("FECHA") AS INTEGER) AS month, count(tuned) AS n, round(avg(tuned - o), 3) AS bias FROM bt GROUP BY 1')
def monthly_bias(spark, sf):
    """Mean error of the forecast by month."""
    return metrics.monthly_bias(ladder(spark, sf)).withColumn("bias", F.round("bias", 3))


TWO_METHODS = {"tuned": "pred_tuned", "climatology": "pred_clim"}
ERRORS = (*LADDER, 'er AS (SELECT "ID", sum((tuned - o) * (tuned - o)) AS se_t, count(tuned) AS n_t, sum((climatology - o) * (climatology - o)) AS se_c, count(climatology) AS n_c FROM bt GROUP BY 1)')


@query(recursive_with(*ERRORS) + 'SELECT "ID", round(se_t / 1000000, 3) AS se_tuned, n_t AS n_tuned, round(se_c / 1000000, 3) AS se_climatology, n_c AS n_climatology FROM er WHERE n_t > 0 AND n_c > 0')
def per_id_error_stats(spark, sf):
    """Squared errors (millions) by location of two methods."""
    e = inference.per_id_errors(ladder(spark, sf), TWO_METHODS)
    return e.select("ID", F.round(F.col("se_tuned") / 1000000, 3).alias("se_tuned"), "n_tuned", F.round(F.col("se_climatology") / 1000000, 3).alias("se_climatology"), "n_climatology")


@query(recursive_with(*ERRORS, "de AS (SELECT sqrt(se_c / n_c) - sqrt(se_t / n_t) AS d FROM er WHERE n_t > 0 AND n_c > 0)") + "SELECT count(*) AS n, round(avg(d), 4) AS mean_delta, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_fraction, round(avg(d) / nullif(stddev_samp(d), 0), 5) AS cohens_d FROM de")
def win_fraction_cohens_d(spark, sf):
    """Share of locations that gain, and the paired effect size."""
    d = inference.effect_size(inference.location_deltas(inference.per_id_errors(ladder(spark, sf), TWO_METHODS), "tuned", "climatology"))
    return d.select("n", F.round("mean_delta", 4).alias("mean_delta"), F.round("win_fraction", 6).alias("win_fraction"), F.round("cohens_d", 5).alias("cohens_d"))


POOLED = "sqrt(sum(se_t) / sum(n_t)) AS rmse, sqrt(sum(se_c) / sum(n_c)) AS rmse_baseline FROM er WHERE n_t > 0 AND n_c > 0"
GOOD = "good AS MATERIALIZED (SELECT * FROM er WHERE n_t > 0 AND n_c > 0)"


@query(recursive_with(*ERRORS) + f"SELECT round(rmse, 3) AS rmse, round(rmse_baseline, 3) AS rmse_baseline, round(rmse_baseline - rmse, 3) AS delta_rmse, round(1 - rmse / rmse_baseline, 5) AS skill FROM (SELECT {POOLED})")
def pooled_rmse(spark, sf):
    """Errors of two methods over all locations."""
    e = inference.pooled(inference.per_id_errors(ladder(spark, sf), TWO_METHODS), "tuned", "climatology")
    return e.select(*[F.round(c, 5 if c == "skill" else 3).alias(c) for c in e.columns])


def bits16(draw: str, seed: int = 0) -> str:
    """SQL of the 16 bits of a location's draw."""
    return f"CAST('0x' || substr(md5(\"ID\" || ':{seed}:' || ({draw} // 8)), 1 + 4 * ({draw} % 8), 4) AS INTEGER)"


def sign_of(draw: str, seed: int = 0) -> str:
    """SQL of the sign of a location's draw."""
    return f"(1 - 2 * ((CAST('0x' || substr(md5(\"ID\" || ':{seed}:' || ({draw} // 128)), 1 + ({draw} % 128) // 4, 1) AS INTEGER) >> (3 - {draw} % 4)) & 1))"


N_BOOT, N_PERM = 1000, 5000
BOOT = (
    GOOD,
    f'counted AS (SELECT d, se_t, n_t, se_c, n_c, {" + ".join(f"CAST(b >= {t} AS INTEGER)" for t in inference.POISSON)} AS k FROM (SELECT *, {bits16("d")} AS b FROM good, range({N_BOOT}) t(d)))',
    "drawn AS (SELECT d, sqrt(sum(k * se_t) / sum(k * n_t)) AS a, sqrt(sum(k * se_c) / sum(k * n_c)) AS c FROM counted GROUP BY 1)",
    "lim AS (SELECT quantile_cont(c - a, 0.025) AS delta_lo, quantile_cont(c - a, 0.975) AS delta_hi, quantile_cont(1 - a / c, 0.025) AS skill_lo, quantile_cont(1 - a / c, 0.975) AS skill_hi FROM drawn)",
)
SIGNS = (
    'de AS MATERIALIZED (SELECT "ID", sqrt(se_c / n_c) - sqrt(se_t / n_t) AS delta FROM good)',
    "obs AS (SELECT count(*) AS n, sum(delta) AS total, sum(abs(delta)) AS size FROM de)",
    f"flips AS (SELECT d, sum({sign_of('d')} * abs(delta)) AS s FROM de, range({N_PERM}) t(d) GROUP BY 1)",
    f"pv AS (SELECT n, total / n AS observed, (1 + (SELECT count(*) FROM flips WHERE s >= total - 1e-12 * size)) / {N_PERM + 1}.0 AS p_value FROM obs)",
)


@query(recursive_with(*ERRORS, *BOOT) + f"SELECT round(rmse, 3) AS rmse, round(rmse_baseline, 3) AS rmse_baseline, round(rmse_baseline - rmse, 3) AS delta_rmse, round(1 - rmse / rmse_baseline, 5) AS skill, round(delta_lo, 3) AS delta_lo, round(delta_hi, 3) AS delta_hi, round(skill_lo, 5) AS skill_lo, round(skill_hi, 5) AS skill_hi FROM (SELECT {POOLED}), lim")
def bootstrap_delta_rmse(spark, sf):
    """Bootstrap limits of the gain over climatology."""
    return effect_digits(inference.bootstrap(inference.per_id_errors(ladder(spark, sf), TWO_METHODS), "tuned", "climatology", N_BOOT))


def effect_digits(df: DataFrame) -> DataFrame:
    """Errors to three digits, shares to five."""
    return df.select(*[F.round(c, 3 if "rmse" in c or "delta" in c else 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(recursive_with(*ERRORS, GOOD, *SIGNS) + "SELECT n, round(observed, 3) AS observed, round(p_value, 6) AS p_value FROM pv")
def sign_flip_test(spark, sf):
    """Permutation test of the gain over climatology."""
    e = inference.per_id_errors(ladder(spark, sf), TWO_METHODS)
    found = inference.sign_flip(inference.location_deltas(e, "tuned", "climatology"), N_PERM)
    return found.select("n", F.round("observed", 3).alias("observed"), F.round("p_value", 6).alias("p_value"))


def effect_sql(split: str) -> str:
    """The effect-size row of a split."""
    ctes = (*ladder_ctes(*PROXY_SPLITS[split]), ERRORS[-1], *BOOT, *SIGNS, "ef AS (SELECT avg(delta) AS mean_delta, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS win_fraction, avg(delta) / nullif(stddev_samp(delta), 0) AS cohens_d FROM de)")
    return recursive_with(*ctes) + f"SELECT '{split}' AS split, n, round(rmse, 3) AS rmse, round(rmse_baseline, 3) AS rmse_baseline, round(rmse_baseline - rmse, 3) AS delta_rmse, round(delta_lo, 3) AS delta_lo, round(delta_hi, 3) AS delta_hi, round(1 - rmse / rmse_baseline, 5) AS skill, round(skill_lo, 5) AS skill_lo, round(skill_hi, 5) AS skill_hi, round(mean_delta, 3) AS mean_delta, round(win_fraction, 5) AS win_fraction, round(cohens_d, 5) AS cohens_d, round(p_value, 5) AS p_value FROM (SELECT {POOLED}), lim, ef, pv"


@query(" UNION ALL ".join(f"SELECT * FROM ({effect_sql(split)})" for split in PROXY_SPLITS))
def effect_size_table(spark, sf):
    """The evidence for the forecast against climatology, a row a split."""
    out = None
    for split, (train_end, holdout) in PROXY_SPLITS.items():
        rows = daily(spark, sf)
        train, held = rows.where(F.year("FECHA") <= train_end), series.years(rows, holdout)
        tuned = forecast.recursive(fit(train).where("const_anom is not null"), series.climatology(train), train, held, holdout)
        one = inference.effect_table(baselines.ladder(rows, zones(spark, sf), tuned, train_end, holdout), TWO_METHODS, split=split, n_boot=N_BOOT, n_perm=N_PERM)
        out = one if out is None else out.unionByName(one)
    return effect_digits(out)


# ---- space, layout and scaling

SQUARES = [(z, 0, k, float(10 * (z % 5) + x), float(10 * (z // 5) + y)) for z in range(25) for k, (x, y) in enumerate(((0, 0), (9, 1), (10, 9), (4, 5), (1, 10)))]
SQUARES_SQL = "v(zone_id, seq, x, y) AS (VALUES " + ", ".join(f"({z}, {k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for z, _, k, x, y in SQUARES) + "), edges AS (SELECT a.zone_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.zone_id = b.zone_id AND b.seq = (a.seq + 1) % 5)"
POINTS_SQL = 'pts AS (SELECT c_custkey AS "ID", CAST((c_custkey * 37) % 5000 AS DOUBLE) / 100 AS x, CAST((c_custkey * 91) % 5000 AS DOUBLE) / 100 AS y FROM customer)'


def points(spark, sf):
    """Points of a plane, by customer."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("ID"), ((k * 37) % 5000).cast("double").alias("x"), ((k * 91) % 5000).cast("double").alias("y")).select("ID", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))


def polygons(spark):
    """Vertices of 25 pentagons."""
    return spark.createDataFrame(SQUARES, "zone_id int, ring int, seq int, x double, y double")


@query(with_(POINTS_SQL, SQUARES_SQL, 'hit AS (SELECT p."ID", e.zone_id FROM pts p JOIN edges e ON (e.y1 > p.y) <> (e.y2 > p.y) WHERE p.x < e.x1 + (p.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)', 'one AS (SELECT "ID", min(zone_id) AS zone_id FROM hit GROUP BY 1)') + 'SELECT p."ID", coalesce(one.zone_id, -1) AS zone_id FROM pts p LEFT JOIN one ON p."ID" = one."ID"')
def point_in_polygon(spark, sf):
    """The zone that holds each point."""
    return spatial.points_in_zones(points(spark, sf), polygons(spark))


@query(with_(POINTS_SQL, SQUARES_SQL, "far AS (SELECT p.\"ID\", e.zone_id, min(sqrt(pow(p.x - e.x1 - t * (e.x2 - e.x1), 2) + pow(p.y - e.y1 - t * (e.y2 - e.y1), 2))) AS d FROM (SELECT p.*, e.*, greatest(0, least(1, ((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2)))) AS t FROM pts p, edges e) AS q(\"ID\", x, y, zone_id, x1, y1, x2, y2, t) GROUP BY 1, 2)").replace("p.\"ID\", e.zone_id, min(sqrt(pow(p.x - e.x1 - t * (e.x2 - e.x1), 2) + pow(p.y - e.y1 - t * (e.y2 - e.y1), 2)))", "\"ID\", zone_id, min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)))") + 'SELECT "ID", CAST(min(zone_id) AS INTEGER) AS zone_id, round(min(d), 6) AS distance FROM (SELECT *, rank() OVER (PARTITION BY "ID" ORDER BY d) AS k FROM far) WHERE k = 1 GROUP BY 1')
def nearest_zone(spark, sf):
    """The zone nearest to each point."""
    return r6(spatial.nearest_zone(points(spark, sf), polygons(spark)))


@query(with_(POINTS_SQL) + 'SELECT "ID", CAST(greatest(0, least(99, round(y / 0.5))) * 100 + greatest(0, least(99, round(x / 0.5))) AS BIGINT) AS cell FROM pts')
def nearest_cell(spark, sf):
    """The grid cell nearest to each point."""
    p = points(spark, sf).select("ID", F.col("y").alias("lat"), F.col("x").alias("lon"))
    return spatial.nearest_cell(p, 0.0, 0.0, 0.5, 100, 100).select("ID", "cell")


@query("SELECT CAST(i * 7 + j AS BIGINT) AS \"ID\", -5.0 - 0.5 * i AS lat, -80.0 + 0.25 * j AS lon FROM (SELECT unnest(generate_series(0, 4)) AS i), (SELECT unnest(generate_series(0, 6)) AS j)")
def grid_index(spark, sf):
    """A grid's cells, row by row."""
    return spatial.grid_index([-5.0 - 0.5 * i for i in range(5)], [-80.0 + 0.25 * j for j in range(7)], spark)


@query("SELECT CAST(i * 3 + j AS BIGINT) AS \"ID\", DATE '2001-01-01' + CAST(t AS INTEGER) AS \"FECHA\", CAST(i * 10 + j + t * 0.5 AS FLOAT) AS \"Value\" FROM (SELECT unnest(generate_series(0, 3)) AS i), (SELECT unnest(generate_series(0, 2)) AS j), (SELECT unnest(generate_series(0, 4)) AS t)")
def raster_to_long(spark, sf):
    """Rasters as rows of cell and day."""
    days = spark.range(5).select(F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("FECHA"), F.col("id").alias("t"))
    cells = F.array(*[F.array(*[F.lit(float(i * 10 + j)) + F.col("t") * 0.5 for j in range(3)]) for i in range(4)])
    return spatial.raster_long(days.select("FECHA", cells.alias("cells")))


@query(with_(DAILY_SQL) + 'SELECT "ID", "FECHA", round("TD", 6) AS "TD" FROM series WHERE "ID" < 10')
def id_subset(spark, sf):
    """The rows of the first locations."""
    return r6(daily(spark, sf).where("ID < 10").select("ID", "FECHA", "TD"))


@query(with_(DAILY_SQL) + 'SELECT lpad(CAST(((("ID" - 50) % 16) + 16) % 16 AS VARCHAR), 4, \'0\') AS id_bucket, count(DISTINCT "ID") AS ids, count(*) AS n FROM series GROUP BY 1')
def bucket_histogram(spark, sf):
    """Locations and rows by bucket, with negative numbers among them."""
    from seasonloom.functions.expressions import bucket_name

    return daily(spark, sf).groupBy(bucket_name(F.col("ID") - 50, 16).alias("id_bucket")).agg(F.countDistinct("ID").alias("ids"), F.count(F.lit(1)).alias("n"))


RUNS = [("d", m, "cpu", p, 10 * b, b, "train", t, b * 12.0 / p * (1 + 0.06 * p) + 0.25 * t + (5.0 if m == "weak" else 0.0)) for m in ("strong", "weak") for b in (4, 8, 16) for p in (1, 2, 4) for t in range(3)]
RUNS_SQL = "runs(dataset, mode, hw, p, n_ids, B, phase, trial, wall_s) AS (VALUES " + ", ".join(f"('{d}', '{m}', '{h}', {p}, {n}, {b}, '{f}', {t}, {w!r}::DOUBLE)" for d, m, h, p, n, b, f, t, w in RUNS) + ")"
MEDIANS_SQL = "med AS (SELECT dataset, hw, phase, B, p, median(wall_s) AS wall_s, arg_min(n_ids, trial) AS n_ids FROM runs WHERE mode = 'strong' GROUP BY ALL), fam AS (SELECT *, first_value(wall_s) OVER (PARTITION BY dataset, hw, phase, B ORDER BY p) / wall_s AS speedup FROM med)"


def runs(spark):
    """Scaling measurements."""
    return spark.createDataFrame(RUNS, "dataset string, mode string, hw string, p int, n_ids int, B int, phase string, trial int, wall_s double")


@query(with_(RUNS_SQL, MEDIANS_SQL) + 'SELECT dataset, hw, phase, B AS "B", p, round(wall_s, 6) AS wall_s, n_ids, round(speedup, 6) AS speedup, round(speedup / p, 6) AS efficiency FROM fam')
def scaling_median_speedup(spark, sf):
    """Median times, speedup and efficiency by problem size."""
    return r6(scaling.family(runs(spark)).select("dataset", "hw", "phase", "B", "p", "wall_s", "n_ids", "speedup", "efficiency"))


@query(with_(RUNS_SQL, MEDIANS_SQL, 'dg AS (SELECT f.dataset, f.hw, f.phase, s.B AS n0, f.p, f.B AS b, f.wall_s, count(*) OVER (PARTITION BY f.dataset, f.hw, f.phase, s.B) AS k, first_value(f.wall_s) OVER (PARTITION BY f.dataset, f.hw, f.phase, s.B ORDER BY f.p) AS t0 FROM fam f JOIN (SELECT DISTINCT B FROM fam) s ON f.B = s.B * f.p)') + 'SELECT dataset, hw, phase, n0, p, b AS "B", round(wall_s, 6) AS wall_s, round(t0 / wall_s, 6) AS efficiency FROM dg WHERE k >= 2')
def weak_diagonals(spark, sf):
    """Efficiency where work per core is constant."""
    return r6(scaling.weak_diagonals(scaling.family(runs(spark))))


def gamma_sql(rounds: int = 3, steps: int = 400) -> str:
    """The coarse-to-fine search for gamma as chained CTEs."""
    ctes = [RUNS_SQL, MEDIANS_SQL, "pts AS (SELECT CAST(p AS DOUBLE) AS p, speedup / p AS e FROM fam)"]
    grid = f"SELECT i, exp(ln(1e-4) + i / {steps - 1}.0 * (ln(10.0::DOUBLE) - ln(1e-4))) AS g FROM range({steps}) t(i)"
    for k in range(rounds):
        ctes.append(f"g{k} AS ({grid})")
        ctes.append(f"s{k} AS (SELECT i, g, (SELECT sum(pow(e - (1 + g) / (1 + g * p), 2)) FROM pts) AS sse, coalesce(lag(g) OVER (ORDER BY i), g) AS lo, coalesce(lead(g) OVER (ORDER BY i), g) AS hi FROM g{k})")
        ctes.append(f"m{k} AS (SELECT * FROM s{k} ORDER BY sse, i LIMIT 1)")
        grid = f"SELECT t.i AS i, lo + t.i / {steps - 1}.0 * (hi - lo) AS g FROM m{k}, range({steps}) t(i)"
    return with_(*ctes) + f"SELECT round(g, 4) AS gamma FROM m{rounds - 1}"


@query(gamma_sql())
def gamma_fit(spark, sf):
    """The contention that fits the efficiencies best."""
    table_ = scaling.family(runs(spark)).select("p", "efficiency")
    return spark.createDataFrame([(round(scaling.fit_gamma(table_), 4),)], "gamma double")


@query("SELECT CAST(p AS INTEGER) AS p, round(1.063 / (1 + 0.063 * p), 6) AS efficiency, round(p * 1.063 / (1 + 0.063 * p), 6) AS speedup FROM (SELECT unnest([1, 2, 4, 8, 16, 32]) AS p)")
def contention_model(spark, sf):
    """Efficiency and speedup of cores that share a memory bus."""
    cores = spark.createDataFrame([(p,) for p in (1, 2, 4, 8, 16, 32)], "p int")
    share = scaling.contention(F.col("p"), F.lit(0.063))
    return r6(cores.select("p", share.alias("efficiency"), (share * F.col("p")).alias("speedup")))


@query(with_(DAILY_SQL) + "SELECT n_ids, n_rows, n_rows * 2.0 * 22 AS assemble_flops, n_rows * 48.0 + n_ids * 366.0 * 176 AS assemble_bytes, n_ids * 366.0 * 44 * 23 AS convolve_flops, n_ids * 366.0 * 16 * 22 AS convolve_bytes, round(n_ids * 366.0 * (125 / 3.0 + 50), 3) AS solve_flops, n_ids * 366.0 * 224 AS solve_bytes FROM (SELECT count(DISTINCT \"ID\") AS n_ids, count(*) AS n_rows FROM series)")
def cost_model(spark, sf):
    """Operations and bytes of the standard fit."""
    sizes = daily(spark, sf).agg(F.countDistinct("ID").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"))
    return scaling.cost_model(sizes).withColumn("solve_flops", F.round("solve_flops", 3))


HARDWARE = [*[(r[2], r[3], r[4], r[5], r[7], r[8]) for r in RUNS if r[1] == "strong"], *[("gpu", 1, 10 * b, b, t, b * 0.5 + t) for b in (4, 8, 16) for t in range(3)]]
HARDWARE_SQL = "runs(hw, p, n_ids, B, trial, wall_s) AS (VALUES " + ", ".join(f"('{h}', {p}, {n}, {b}, {t}, {w!r}::DOUBLE)" for h, p, n, b, t, w in HARDWARE) + ")"


@query(with_(HARDWARE_SQL, "med AS (SELECT B, hw, p, median(wall_s) AS w, arg_min(n_ids, trial) AS n FROM runs GROUP BY ALL)", "best AS (SELECT B, hw, arg_min(p, w) AS p, arg_min(n, w) AS n, min(w) AS w FROM med GROUP BY ALL)") + 'SELECT B AS "B", hw, p, n AS n_ids, round(w, 6) AS wall_s, round(w / (n * 366), 8) AS s_per_fit, round(max(w) OVER (PARTITION BY B) / w, 6) AS gain FROM best')
def hardware_comparison(spark, sf):
    """Median times of two kinds of hardware, and seconds a fit."""
    rows = spark.createDataFrame(HARDWARE, "hw string, p int, n_ids int, B int, trial int, wall_s double")
    return scaling.hardware(rows).select("B", "hw", "p", "n_ids", F.round("wall_s", 6).alias("wall_s"), F.round("s_per_fit", 8).alias("s_per_fit"), F.round("gain", 6).alias("gain"))


@query(with_(RUNS_SQL) + 'SELECT B AS "size", arg_min(p, w) AS block, round(min(w), 6) AS time_ms FROM (SELECT B, p, median(wall_s) AS w FROM runs GROUP BY 1, 2) GROUP BY 1')
def best_block(spark, sf):
    """The setting of the least median time by size."""
    return r6(scaling.best_block(runs(spark).select(F.col("B").alias("size"), F.col("p").alias("block"), F.col("wall_s").alias("time_ms"))))
