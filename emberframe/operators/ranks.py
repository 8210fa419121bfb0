"""Exact order statistics of any column in any group, in two reads of the data.

The first read counts each group and keeps a mergeable sketch of it, which says
between which two values a wanted rank lies, up to the sketch's error. The second
read counts what lies outside these brackets and keeps the values inside, equal ones
counted together: a small share, whatever the group's size. All further work is on
these. A bracket that turns out not to hold its rank, as the sketch's error is
only very likely to be in its bounds, costs that group one more read.

A group may hold a third of the table, so no step gathers one: counts are added up
with map-side combine, and a bracket with many different values is first narrowed
by counting equal-width bins, until few are left to put in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import join_groups, materialise

#: Size of the sketches, and how far on either side of a rank its bracket reaches:
#: twice the error, as a share of the group, that 99 % of answers stay within.
SKETCH = 2000
MARGIN = 2 * 0.0019
#: Evenly spaced quantiles that a sketch is asked for.
GRID = 1000
#: Different values of a bracket that are put in order as one window.
ORDERED = 65_536
BINS = 4096
MAX_PASSES = 400


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., variable, value) without missing values."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.variable", "_p.value").dropna(subset=["value"])


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ranks: Mapping[str, Column],
    bins: int = BINS,
) -> DataFrame:
    """(keys..., variable, n, low, high, mean, sd, <one column per rank>).

    ``ranks`` maps an output name to a rank (from 1) as an expression of ``n``.
    A missing group key is a group like any other.
    """
    values = long_form(df, keys, columns)
    group = [*keys, "variable"]
    sketched = values.groupBy(*group).agg(
        F.count("value").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.kll_sketch_agg_double("value", SKETCH).alias("sketch"),
    )
    sizes = materialise(_bracketed(sketched, ranks).drop("sketch"), "sizes")
    solved = []
    open_groups = sizes.select(*group, "n", "low", "high", "ranks", "brackets")
    for _ in range(2):
        kept = materialise(_survivors(values, open_groups, group), "survivors")
        state = materialise(_counted_below(kept, open_groups, group, list(ranks)), "brackets")
        wrong = state.where("rank <= below OR rank > upto").select(*group).distinct()
        missed, most = state.agg(F.count_if(F.expr("rank <= below OR rank > upto")), F.max("held")).first()
        solved.append((kept, state if not missed else _groups_without(state, wrong, group), most or 0))
        if not missed:
            break
        whole = F.array(F.struct("low", "high"))
        open_groups = join_groups(open_groups, wrong, group).withColumn("brackets", whole)
    answers = reduce(DataFrame.unionByName, [_in_order(kept, state, group, bins, most) for kept, state, most in solved])
    wide = answers.groupBy(*group).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ranks])
    return join_groups(sizes.drop("ranks", "brackets"), wide, group)


def _bracketed(sketched: DataFrame, ranks: Mapping[str, Column]) -> DataFrame:
    """Adds the ranks of each group, and in order the brackets (low, high) that they should lie in, none overlapping."""
    wanted = F.array(*[r.cast("bigint") for r in ranks.values()])
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    below = lambda r: F.floor(((r - 1) / F.col("n") - MARGIN) * GRID).cast("int")
    above = lambda r: F.ceil((r / F.col("n") + MARGIN) * GRID).cast("int")
    each = F.transform(
        F.array_sort(F.array_distinct("ranks")),
        lambda r: F.struct(
            F.get("_grid", F.greatest(below(r), F.lit(0))).alias("low"), F.get("_grid", F.least(above(r), F.lit(GRID))).alias("high")
        ),
    )

    def merged(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], b["high"]).alias("high")))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["high"] >= b["low"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(b)))

    none = F.array().cast("array<struct<low: double, high: double>>")
    brackets = F.aggregate(each, none, merged)
    return sketched.withColumns({"ranks": wanted, "_grid": grid}).withColumn("brackets", brackets).drop("_grid")


def _survivors(values: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """(group..., after, v, c): values inside a bracket and, as null, all others, with their numbers.

    ``after`` counts the brackets that end before a value.
    """
    placed = join_groups(values, groups.select(*group, F.col("brackets.low").alias("_lows"), F.col("brackets.high").alias("_highs")), group)
    # spelled out for as many brackets as any group has, so that it compiles
    most = groups.agg(F.max(F.size("brackets"))).first()[0] or 0
    after = sum((F.coalesce(F.get("_highs", F.lit(i)) < F.col("value"), F.lit(False)).cast("int") for i in range(most)), F.lit(0))
    placed = placed.select(*group, "value", "_lows", after.alias("after"))
    inside = F.when(F.get("_lows", F.col("after")) <= F.col("value"), F.col("value"))
    return placed.groupBy(*group, "after", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))


def _counted_below(kept: DataFrame, groups: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """(group..., name, rank, low, high, below, upto, held): each rank's bracket, the counts below and up to its end, its different values.

    A rank that lies between two brackets gets the later one, which does not hold it.
    """
    totals = kept.groupBy(*group, "after", F.col("v").isNotNull().alias("inside")).agg(F.sum("c").alias("c"), F.count("v").alias("held"))
    # a few rows per group
    running = Window.partitionBy(*group).orderBy("after", "inside").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("below", F.coalesce(F.sum("c").over(running), F.lit(0))).where("inside")
    every = F.array_sort(F.collect_list(F.struct("after", (F.col("below") + F.col("c")).alias("upto"), "below", "held")))
    found = join_groups(groups, totals.groupBy(*group).agg(every.alias("_found")), group)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.get("ranks", F.lit(i)).alias("rank")) for i, name in enumerate(names)]))
    rows = found.select(*group, "brackets", "_found", each.alias("_w")).select(*group, "brackets", "_found", "_w.*")
    own = F.coalesce(F.get(F.filter("_found", lambda t: t["upto"] >= F.col("rank")), F.lit(0)), F.element_at("_found", -1))
    rows = rows.withColumn("_t", own).withColumn("_b", F.get("brackets", F.col("_t.after")))
    return rows.select(*group, "name", "rank", "_b.low", "_b.high", "_t.below", "_t.upto", "_t.held")


def _groups_without(state: DataFrame, wrong: DataFrame, group: list[str]) -> DataFrame:
    named = wrong.withColumnsRenamed({k: f"__{k}" for k in group})
    return state.join(named, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group]), "left_anti")


def _in_order(kept: DataFrame, state: DataFrame, group: list[str], bins: int, most: int) -> DataFrame:
    """(group..., name, value): the value at each rank, from the values kept inside its bracket."""
    kept = kept.where("v IS NOT NULL").select(*group, F.col("v").alias("value"), "c")
    state = state.drop("upto")
    small = []
    for _ in range(MAX_PASSES):
        small.append(state.where(F.col("held") <= ORDERED))
        state = state.where(F.col("held") > ORDERED)
        if most <= ORDERED or state.isEmpty():
            break
        most = ORDERED + 1  # counted again by the test above
        open_brackets = state.select(*group, "low", "high").distinct()
        counted = (
            join_groups(kept, open_brackets, group)
            .where("value >= low AND value <= high")
            .groupBy(*group, "low", "high", _bin(F.col("low"), F.col("high"), bins).alias("bin"))
            .agg(F.sum("c").alias("c"), F.count("value").alias("held"), F.min("value").alias("first"), F.max("value").alias("last"))
        )
        renamed = {"low": "_lo", "high": "_hi"}
        state = materialise(_pick(state.drop("held").withColumnsRenamed(renamed), counted.withColumnsRenamed(renamed), [*group, "_lo", "_hi"]), "brackets")
        state = state.select(*group, "name", "rank", "low", "high", "below", "held")
    else:
        raise RuntimeError(f"ranks are still open after {MAX_PASSES} passes")
    brackets = reduce(DataFrame.unionByName, small)
    # at most ORDERED rows per bracket
    running = Window.partitionBy(*group, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = join_groups(kept, brackets, group).where("value >= low AND value <= high")
    placed = placed.withColumn("_upto", F.col("below") + F.sum("c").over(running))
    return placed.where("rank <= _upto AND rank > _upto - c").select(*group, "name", "value")


def _bin(low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of ``value``; halves keep the span of two huge opposite values finite."""
    share = (F.col("value") / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    return F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0))


def _pick(state: DataFrame, counted: DataFrame, bracket: list[str]) -> DataFrame:
    """The bin of each bracket that holds its rank: new ends, the count below it, its different values."""
    # at most ``bins`` rows per bracket
    running = Window.partitionBy(*bracket).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
    rest = F.col("rank") - F.col("below") - F.col("before")
    return (
        join_groups(state, counted, bracket)
        .where((rest >= 1) & (rest <= F.col("c")))
        .withColumn("below", (F.col("below") + F.col("before")).cast("bigint"))
        .withColumn("low", F.col("first"))
        .withColumn("high", F.col("last"))
    )


def quantile_ranks(probabilities: Mapping[str, float]) -> dict[str, Column]:
    """Neighbouring ranks of each linear-interpolation quantile (type 7)."""
    out: dict[str, Column] = {}
    for name, p in probabilities.items():
        h = (F.col("n") - 1) * p
        out[f"{name}_a"] = F.floor(h) + 1
        out[f"{name}_b"] = F.ceil(h) + 1
    return out


def interpolated(name: str, p: float) -> Column:
    h = (F.col("n") - 1) * p
    part = h - F.floor(h)
    return F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * part


def quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """(keys..., variable, n, low, high, mean, sd, <one column per probability>), exact."""
    stats = order_statistics(df, keys, columns, quantile_ranks(probabilities))
    return stats.select(
        *keys, "variable", "n", "low", "high", "mean", "sd",
        *[interpolated(k, p).alias(k) for k, p in probabilities.items()],
    )
