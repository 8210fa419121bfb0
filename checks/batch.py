"""The batch over biomes: its screens and fits, each held against SQL on the panel's rows."""

from itertools import combinations

from pyspark.sql import functions as F

from emberframe.lineage import materialise
from emberframe.operators.logistic import fit_logistic
from emberframe.operators.ols import ols_of
from emberframe.operators.sums import sum_blocks
from emberframe.plans.models import DRIVERS, MODELS
from emberframe.plans.workflow import SCALED, screen_response

from .fixtures import MONTHLY, check, panel_sql
from .panels import full_panel

KNOWN = [*MONTHLY, "LC_Tree", "LC_Shrub", "PopDensity", "Continent", "GFED_Regions"]
KNOWN = [c for c in KNOWN if not c.startswith(("LC_TreeB", "LC_TreeN", "LC_ShrubB", "LC_ShrubN"))]
FIRE = '"Size" <> 0 AND "Ignitions" <> 0 AND "Duration" <> 0 AND '


def rows_sql(response: str) -> str:
    """Rows of the models, and the biomes whose model can be fitted, as ``m`` and ``fitted``."""
    known = " AND ".join(f'"{c}" IS NOT NULL' for c in KNOWN)
    spread = lambda m: " AND ".join(f'stddev_samp("{c}") > 0' for c in SCALED if c in m.columns())
    able = " UNION ALL ".join(
        f"""SELECT "Biomes", count(*) AS n FROM m WHERE "Biomes" = {m.biome} GROUP BY "Biomes"
  HAVING count(*) > {len(m.full()) + 2} AND min("IDL_Layer") < max("IDL_Layer") AND {spread(m)}"""
        for m in MODELS
        if m.response == response
    )
    return f"""{panel_sql()}, m AS (SELECT *, ln("PopDensity" + 1) AS "PopDensity_log", sqrt("RoadDensity") AS "RoadDensity_sqrt" FROM panel
  WHERE {'' if response == 'Fire' else FIRE}"LC_Bare" <> 1 AND "Year" <> 2016 AND {known}),
fitted AS ({able})
"""


def collinear_sql(response: str) -> str:
    pairs = list(combinations(DRIVERS, 2))
    lists = [", ".join(f"'{p[i]}'" for p in pairs) for i in (0, 1)]
    r = ", ".join(f'corr("{a}", "{b}")' for a, b in pairs)
    return (
        rows_sql(response)
        + f"""SELECT '{response}' AS response, CAST("Biomes" AS VARCHAR) AS stratum, a, b, round(r, 6) AS r FROM (SELECT "Biomes", unnest([{lists[0]}]) AS a,
  unnest([{lists[1]}]) AS b, unnest([{r}]) AS r FROM m JOIN fitted USING ("Biomes") GROUP BY "Biomes") WHERE r > 0.7"""
    )


def collinear_of(spark, folder, response):
    results, _, _ = screen_response(materialise(full_panel(spark, folder), "panel"), response)
    table = spark.createDataFrame([(response, *row) for row in results.collinear], "response string, stratum string, a string, b string, r double")
    return table.withColumn("r", F.round("r", 6))


@check("AG11 ML24 AG10", collinear_sql("Duration"))
def collinear_in_the_batch(spark, folder):
    """Collinear drivers of every biome, from the cross products that the fits use."""
    return collinear_of(spark, folder, "Duration")


@check("AG11 ML24", collinear_sql("Fire"))
def presence_collinear_in_the_batch(spark, folder):
    """The same for the presence models."""
    return collinear_of(spark, folder, "Fire")


def scores_sql(response: str) -> str:
    terms = " UNION ALL ".join(
        f"SELECT {m.biome} AS b, unnest([{', '.join(repr(t.name) for t in m.full())}]) AS term" for m in MODELS if m.response == response
    )
    return (
        rows_sql(response)
        + f"""SELECT CAST("Biomes" AS VARCHAR) AS stratum, n, term, 0.0::DOUBLE AS score FROM fitted JOIN ({terms}) ON b = "Biomes\""""
    )


def scores(spark, rows, response, fits, terms_of):
    """(stratum, n, term, score): mean product of each term with the rest that its fit leaves, measured on the rows."""
    out = []
    for fit in fits:
        terms = terms_of[fit.stratum]
        drivers = sorted({t.base.driver for t in terms if t.base.power})
        by_name = dict(zip(fit.names, fit.beta))

        def block(key, columns, terms=terms, drivers=drivers, by_name=by_name, logistic=fit.kind == "logistic"):
            import numpy as np

            at = {d: columns[i] for i, d in enumerate(drivers)}
            x = [np.ones(columns.shape[1]) if not t.base.power else at[t.base.driver] ** t.base.power for t in terms]
            x = np.array([v * columns[len(drivers)] if t.by_factor else v for v, t in zip(x, terms)])
            eta = np.array([by_name.get(t.name, 0.0) for t in terms]) @ x
            rest = columns[-1] - (1 / (1 + np.exp(-eta)) if logistic else eta)
            yield "", np.append(x @ rest, columns.shape[1])

        mine = rows.where(F.col("Biomes") == int(fit.stratum))
        (total,) = sum_blocks(mine, [], [*drivers, terms[1].factor, response], block).values()
        n = int(total[-1])
        out += [(fit.stratum, n, t.name, abs(round(float(v) / n, 6))) for t, v in zip(terms, total)]
    return spark.createDataFrame(out, "stratum string, n bigint, term string, score double")


@check("ML24 ML2 ML1", scores_sql("Duration"))
def least_squares_of_the_batch(spark, folder):
    """Every biome's quadratic model of duration: what least squares must make zero."""
    results, models, moments = screen_response(materialise(full_panel(spark, folder), "panel"), "Duration")
    fits = [ols_of(moments, str(m.biome), m.full(), "full") for m in models]
    return scores(spark, results.rows, "Duration", fits, {str(m.biome): m.full() for m in models})


@check("ML24 ML14 ML15", scores_sql("Fire"))
def logistic_of_the_batch(spark, folder):
    """Every biome's quadratic model of presence: what its maximum likelihood must make zero."""
    results, models, _ = screen_response(materialise(full_panel(spark, folder), "panel"), "Fire")
    formulas, only = {str(m.biome): m.full() for m in models}, {str(m.biome): [str(m.biome)] for m in models}
    fits = fit_logistic(results.rows, "Fire", formulas, "Biomes", only) if models else []
    return scores(spark, results.rows, "Fire", fits, formulas)
