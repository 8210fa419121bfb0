"""Counts, spreads, shapes and correlations."""

from pyspark.sql import functions as F

from emberframe.operators import profile as R

from .fixtures import (
    MODEL_ROWS, OBS, ORDER_ROWS, check, model_rows, observations, order_rows, table, with_sql,
)
from .panels import SPARSE, SPARSE_FROM, sparse

COVER_NAMES = ("LC_Crop", "LC_Herbs", "LC_Bare")


def unpivot(names, expression: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {expression.format(c=chr(34) + n + chr(34))} FROM {source}" for n in names)


@check("AG1", with_sql(OBS) + """SELECT "Month", status, count(*) AS "N" FROM obs GROUP BY ALL""")
def rows_per_month(spark, folder):
    return R.count_by(observations(spark, folder), "Month", "status")


@check(
    "AG2",
    SPARSE
    + f"""SELECT "column", missing FROM (SELECT count(*) - count("LC_Crop") AS "LC_Crop", count(*) - count("LC_Herbs") AS "LC_Herbs",
  count(*) - count("LC_Bare") AS "LC_Bare", 0 AS "Year" {SPARSE_FROM}) UNPIVOT (missing FOR "column" IN ("LC_Crop", "LC_Herbs", "LC_Bare", "Year"))""",
)
def missing_per_column(spark, folder):
    return R.missing_counts(sparse(spark, folder), [*COVER_NAMES, "Year"])


@check(
    "AG3",
    SPARSE
    + f"""SELECT "column", missing FROM (SELECT count(*) - count("LC_Crop") AS "LC_Crop", count(*) - count("LC_Herbs") AS "LC_Herbs",
  count(*) - count("LC_Bare") AS "LC_Bare" {SPARSE_FROM} WHERE "Year" = 2001) UNPIVOT (missing FOR "column" IN ("LC_Crop", "LC_Herbs", "LC_Bare"))""",
)
def missing_in_last_year(spark, folder):
    return R.missing_counts(sparse(spark, folder).where("Year = 2001"), COVER_NAMES)


@check(
    "AG4",
    with_sql(OBS)
    + unpivot(("qty", "tax", "cents"), 'count_if({c} <> 0) AS nonzero, count_if({c} = 0) AS zero', "obs")
    .replace("count_if", "CAST(count_if").replace("<> 0)", "<> 0) AS BIGINT)").replace("= 0)", "= 0) AS BIGINT)"),
)
def zeros_per_column(spark, folder):
    return R.zero_counts(observations(spark, folder), ["qty", "tax", "cents"])


@check(
    "AG5",
    with_sql(OBS)
    + unpivot(("qty", "tax", "cents"), "CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high", "obs"),
)
def ranges_per_column(spark, folder):
    return R.value_range(observations(spark, folder), ["qty", "tax", "cents"])


@check(
    "AG6",
    with_sql(OBS)
    + " UNION ALL ".join(
        f"""SELECT flag, '{c}' AS variable, count(*) AS n, CAST(min({c}) AS DOUBLE) AS low,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
  CAST(avg({c}) AS DOUBLE) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS high
FROM obs GROUP BY flag"""
        for c in ("qty", "cents")
    ),
)
def five_numbers(spark, folder):
    """Minimum, quartiles, mean and maximum by return flag."""
    return R.summary(observations(spark, folder), ["qty", "cents"], ["flag"]).drop("sd")


@check("AG7", with_sql(OBS) + """SELECT DISTINCT "Year", flag FROM obs""")
def distinct_years(spark, folder):
    return observations(spark, folder).select("Year", "flag").distinct()


@check("AG8", """SELECT l_linestatus, count(*) AS "N" FROM lineitem GROUP BY ALL""")
def category_frequency(spark, folder):
    return R.frequency(table(spark, folder, "lineitem"), "l_linestatus")


@check("AG9", with_sql(OBS) + """SELECT count(*) AS rows, CAST(11 AS INT) AS columns FROM obs""")
def table_shape(spark, folder):
    return R.shape(observations(spark, folder))


CORRELATED = ("l_quantity", "l_discount", "p_size", "twice", "opposite")
CORR_ROWS = f"""{MODEL_ROWS}, c AS (SELECT l_quantity, nullif(l_discount, 0.1) AS l_discount, p_size,
  2 * l_quantity + p_size AS twice, -l_quantity AS opposite FROM rows_)"""
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM c"
    for i, a in enumerate(CORRELATED)
    for b in CORRELATED[i + 1:]
)


def correlated(spark, folder):
    return model_rows(spark, folder).select(
        "l_quantity", F.nullif("l_discount", F.lit(0.1)).alias("l_discount"), "p_size",
        (2 * F.col("l_quantity") + F.col("p_size")).alias("twice"), (-F.col("l_quantity")).alias("opposite"),
    )


@check("AG10", f"WITH {CORR_ROWS} {CORR_SQL}")
def correlations(spark, folder):
    """Pairwise complete: a missing value drops a row from its own pairs only."""
    return R.correlation_matrix(correlated(spark, folder), CORRELATED).withColumn("r", F.round("r", 8))


@check("AG11", f"WITH {CORR_ROWS} SELECT * FROM ({CORR_SQL}) WHERE r > 0.7")
def collinear_drivers(spark, folder):
    """Signed screen: the strongly negative pair is not flagged."""
    return R.collinear_pairs(correlated(spark, folder), CORRELATED).withColumn("r", F.round("r", 8))


def histogram_sql(keys: str, expected: bool) -> str:
    """Bins of ``long_`` (keys, v), by the same round steps."""
    on = f"USING ({keys})"
    tail = (
        f""", mean_ AS mean, sd_ AS sd,
  round(exp(-0.5 * pow(((start + (bin - 0.5) * step) - mean_) / sd_, 2)) / (sd_ * sqrt(2 * 3.141592653589793)) * cnt * step, 4) AS expected"""
        if expected
        else ""
    )
    inner = ", round(mean_, 8) AS mean, round(sd_, 8) AS sd, expected" if expected else ""
    return f""", s AS (SELECT {keys}, count(*) AS cnt, min(v) AS lo, max(v) AS hi, avg(v) AS mean_, stddev_samp(v) AS sd_
  FROM long_ GROUP BY {keys}),
c1 AS (SELECT *, (hi - lo) / ceil(log2(cnt) + 1 - 1e-9) AS cell FROM s), c2 AS (SELECT *, pow(10.0, floor(log10(cell))) AS base FROM c1),
c3 AS (SELECT *, CASE WHEN NOT (2 * base - cell < 1.5 * (cell - base)) THEN base
  WHEN NOT (5 * base - cell < 2.75 * (cell - 2 * base)) THEN 2 * base
  WHEN NOT (10 * base - cell < 1.5 * (cell - 5 * base)) THEN 5 * base ELSE 10 * base END AS step FROM c2),
b AS (SELECT *, floor(lo / step + 1e-10) * step AS start FROM c3),
h AS (SELECT {keys}, cnt, mean_, sd_, start, step, CAST(greatest(ceil((v - start) / step - 1e-7), 1) AS INT) AS bin, count(*) AS "N"
  FROM long_ JOIN b {on} GROUP BY ALL),
o AS (SELECT *, start + (bin - 1) * step AS lower_, start + bin * step AS upper_{tail} FROM h)
SELECT {keys}, bin, round(lower_, 8) AS lower, round(upper_, 8) AS upper, "N"{inner} FROM o"""


@check(
    "AG12",
    with_sql(
        OBS,
        """long_ AS (SELECT flag, 'cents' AS variable, CAST(cents AS DOUBLE) AS v FROM obs
  UNION ALL SELECT flag, 'qty', qty FROM obs)""",
    )
    + histogram_sql("flag, variable", False),
)
def histograms(spark, folder):
    """Round-number bins by return flag."""
    bins = R.histogram(observations(spark, folder), ["cents", "qty"], ["flag"])
    return bins.withColumns({"lower": F.round("lower", 8), "upper": F.round("upper", 8)})


@check(
    "AG13",
    f"""WITH {ORDER_ROWS}, long_ AS (SELECT 'identity' AS variable, price AS v FROM rows_ UNION ALL SELECT 'sqrt', sqrt(price) FROM rows_
  UNION ALL SELECT 'cube_root', cbrt(price) FROM rows_ UNION ALL SELECT 'log', ln(price) FROM rows_
  UNION ALL SELECT 'log10', log10(price) FROM rows_)"""
    + histogram_sql("variable", True),
)
def transformed_histograms(spark, folder):
    """One column under several transforms, each with its fitted normal."""
    bins = R.normal_histograms(order_rows(spark, folder), "price", ["identity", "sqrt", "cube_root", "log", "log10"])
    rounded = {c: F.round(c, 8) for c in ("lower", "upper", "mean", "sd")}
    return bins.withColumns({**rounded, "expected": F.round("expected", 4)})


@check(
    "AG14",
    with_sql(OBS)
    + """, r AS (SELECT status, "Month", CAST(cents AS DOUBLE) AS v, row_number() OVER (PARTITION BY status, "Month" ORDER BY cents) AS i,
  count(*) OVER (PARTITION BY status, "Month") AS n FROM obs),
d AS (SELECT *, floor((n + 3) / 2) / 2 AS depth FROM r),
h AS (SELECT status, "Month", n, (max(v) FILTER (WHERE i = floor(depth)) + max(v) FILTER (WHERE i = ceil(depth))) / 2 AS lower_hinge,
  (max(v) FILTER (WHERE i = floor((n + 1) / 2)) + max(v) FILTER (WHERE i = ceil((n + 1) / 2))) / 2 AS median,
  (max(v) FILTER (WHERE i = floor(n + 1 - depth)) + max(v) FILTER (WHERE i = ceil(n + 1 - depth))) / 2 AS upper_hinge
  FROM d GROUP BY ALL)
SELECT status, "Month", h.n, lower_hinge, median, upper_hinge,
  min(v) FILTER (WHERE v BETWEEN lower_hinge - 1.5 * (upper_hinge - lower_hinge) AND upper_hinge + 1.5 * (upper_hinge - lower_hinge)) AS lower_whisker,
  max(v) FILTER (WHERE v BETWEEN lower_hinge - 1.5 * (upper_hinge - lower_hinge) AND upper_hinge + 1.5 * (upper_hinge - lower_hinge)) AS upper_whisker,
  count(*) FILTER (WHERE NOT v BETWEEN lower_hinge - 1.5 * (upper_hinge - lower_hinge) AND upper_hinge + 1.5 * (upper_hinge - lower_hinge)) AS outliers
FROM r JOIN h USING (status, "Month") GROUP BY ALL""",
)
def box_plot_numbers(spark, folder):
    """Hinges, whiskers and outliers by status and month."""
    return R.box_stats(observations(spark, folder), "cents", ["status", "Month"])


@check(
    "AG14",
    """WITH r AS (SELECT event_type, CAST(round(value * 100) AS DOUBLE) AS v FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r),
d AS (SELECT *, floor((n + 3) / 2) / 2 AS depth FROM k),
h AS (SELECT event_type, n, (max(v) FILTER (WHERE i = floor(depth)) + max(v) FILTER (WHERE i = ceil(depth))) / 2 AS lower_hinge,
  (max(v) FILTER (WHERE i = floor((n + 1) / 2)) + max(v) FILTER (WHERE i = ceil((n + 1) / 2))) / 2 AS median,
  (max(v) FILTER (WHERE i = floor(n + 1 - depth)) + max(v) FILTER (WHERE i = ceil(n + 1 - depth))) / 2 AS upper_hinge
  FROM d GROUP BY ALL)
SELECT event_type, n, lower_hinge, median, upper_hinge,
  min(v) FILTER (WHERE v BETWEEN lower_hinge - 1.5 * (upper_hinge - lower_hinge) AND upper_hinge + 1.5 * (upper_hinge - lower_hinge)) AS lower_whisker,
  max(v) FILTER (WHERE v BETWEEN lower_hinge - 1.5 * (upper_hinge - lower_hinge) AND upper_hinge + 1.5 * (upper_hinge - lower_hinge)) AS upper_whisker,
  count(*) FILTER (WHERE NOT v BETWEEN lower_hinge - 1.5 * (upper_hinge - lower_hinge) AND upper_hinge + 1.5 * (upper_hinge - lower_hinge)) AS outliers
FROM r JOIN h USING (event_type) GROUP BY ALL""",
)
def box_plot_of_skewed_values(spark, folder):
    """A right-skewed response, where upper whiskers stop short of the maximum."""
    rows = table(spark, folder, "events").select("event_type", F.round(F.col("value") * 100).alias("v"))
    return R.box_stats(rows, "v", ["event_type"])


SCALED = ("l_quantity", "l_discount", "s_acctbal")


@check(
    "AG15",
    f"WITH {MODEL_ROWS} SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in SCALED)
    + " FROM rows_",
)
def standardised_columns(spark, folder):
    rows = model_rows(spark, folder).select("l_orderkey", "l_linenumber", *SCALED)
    return R.standardise(rows, SCALED).withColumns({c: F.round(c, 6) for c in SCALED})


@check(
    "AG15",
    f"WITH {MODEL_ROWS} SELECT p_brand, l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER (PARTITION BY p_brand)) / stddev_samp({c}) OVER (PARTITION BY p_brand), 6) AS {c}" for c in SCALED
    )
    + " FROM rows_",
)
def standardised_by_stratum(spark, folder):
    rows = model_rows(spark, folder).select("p_brand", "l_orderkey", "l_linenumber", *SCALED)
    return R.standardise(rows, SCALED, ["p_brand"]).withColumns({c: F.round(c, 6) for c in SCALED})
