"""Access by rurality and population group, over years, with losses accounted for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import EQUITY_CUTS, PER_CAPITA
from reachwell.functions.stats import ratio, weighted_mean_all, zero_share
from reachwell.operators.supply import first_rows

#: Planning-region tracts of one state, but for two water tracts that have no older counterpart (fixed values).
REGION_PATTERN, WATER_TRACTS = r"^091[1-9]0", ("09180990100", "09190990000")


def stratified(rows: DataFrame, groups: Sequence[str], *keys: str, stratum: str = "rurality", weight: str = "pop") -> DataFrame:
    """Long table of strata: stratum_type, stratum, mean_access, pct_zero, women.

    Overall, by rurality (rows without one are left out), and by population
    group (a column of weights each). Rows with unknown access are left out,
    never zeroed; see ``guards.partition_unknown``.
    """
    known = rows.where(guards.finite(F.col("access")))
    a, w = F.col("access"), F.col(weight)

    def stats(weight: Column) -> list[Column]:
        return [weighted_mean_all(a, weight).alias("mean_access"), zero_share(a, weight).alias("pct_zero"), F.sum(weight).alias("women")]

    # GROUPING SETS ((), (stratum)) in one pass.
    sets = known.rollup(*keys, stratum).agg(*stats(w), F.grouping_id().alias("level")) if not keys else None
    if keys:
        overall = known.groupBy(*keys).agg(*stats(w)).withColumn("stratum", F.lit("All"))
        by = known.where(F.col(stratum).isNotNull()).groupBy(*keys, F.col(stratum).alias("stratum")).agg(*stats(w))
    else:
        overall = sets.where("level = 1").select(F.lit("All").alias("stratum"), "mean_access", "pct_zero", "women")
        by = sets.where(F.col(stratum).isNotNull() & (F.col("level") == 0)).select(F.col(stratum).alias("stratum"), "mean_access", "pct_zero", "women")
    long = known.select(*keys, "access", F.explode(F.array(*[F.struct(F.lit(g).alias("stratum"), F.col(g).cast("double").alias("w")) for g in groups])).alias("x"))
    race = long.select(*keys, "access", "x.stratum", "x.w").groupBy(*keys, "stratum").agg(*stats(F.col("w")))
    out = overall.withColumn("stratum_type", F.lit("overall")).unionByName(by.withColumn("stratum_type", F.lit(stratum)))
    return out.unionByName(race.withColumn("stratum_type", F.lit("group")))


def with_endpoints(parts: Mapping[str, DataFrame], *keys: str, value: str = "mean_access", year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Tables of strata as one long table tagged by their type, and each stratum's first and last year with its value.

    The endpoints have stratum_type, keys, stratum, first_year, first, last_year, last and change.
    """
    long = None
    for kind, part in parts.items():
        own = part.withColumn("stratum_type", F.lit(kind))
        long = own if long is None else long.unionByName(own)
    known = long.where(guards.finite(F.col(value)))
    ends = known.groupBy("stratum_type", *keys, "stratum").agg(F.min(year).alias("first_year"), F.min_by(value, year).alias("first"), F.max(year).alias("last_year"), F.max_by(value, year).alias("last"))
    return long, ends.withColumn("change", F.col("last") - F.col("first"))


def relabel(df: DataFrame, mapping: DataFrame, year: int, check: bool = True) -> DataFrame:
    """``df`` with planning-region tracts renamed to the older ones, from 2022 on.

    ``mapping`` has legacy_geoid and new_geoid in the order of place; the first
    match of a tract wins. A planning-region tract that remains is refused.
    """
    if year < 2022:
        return df
    first = first_rows(mapping, ["new_geoid"], "place").select(F.col("new_geoid").alias("geoid"), "legacy_geoid")
    names = df.columns
    out = df.join(first, "geoid", "left").withColumn("geoid", F.coalesce("legacy_geoid", "geoid")).select(*names)
    if check:
        left = out.where(F.col("geoid").rlike(REGION_PATTERN) & ~F.col("geoid").isin(*WATER_TRACTS))
        guards._refuse("planning-region tract without an older one", left, "geoid")
    return out


def wide(estimates: DataFrame, key: str, variable: str, names: Sequence[str], values: Sequence[str] = ("estimate", "moe")) -> DataFrame:
    """One row of a key, with a column for each variable and value: estimate_<name>, moe_<name>."""
    picks = [F.max(F.when(F.col(variable) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in names]
    return estimates.groupBy(key).agg(*picks)


def equity(strata: DataFrame, key: str, reference: str) -> DataFrame:
    """Each stratum's access relative to the reference one of the same key: adds ratio, pct and class."""
    ref = strata.where(F.col("stratum") == reference).select(key, F.col("mean_access").alias("ref"))
    out = strata.where(F.col("stratum") != reference).join(ref, key, "left").withColumn("ratio", ratio(F.col("mean_access"), F.col("ref")))
    grade = F.when(F.col("ratio") <= EQUITY_CUTS[0], "Worse access").when(F.col("ratio") >= EQUITY_CUTS[1], "Better access").when(F.col("ratio").isNotNull(), "Similar")
    return out.withColumn("pct", 100 * (F.col("ratio") - 1)).withColumn("class", grade).drop("ref")


def ordered_means(strata: DataFrame, key: str) -> DataFrame:
    """Mean access over strata by population, the least and greatest stratum, and the rank: key, mean, low, high, place."""
    by = strata.groupBy(key).agg(ratio(F.sum(F.col("mean_access") * F.col("women")), F.sum("women")).alias("mean"), F.min("mean_access").alias("low"), F.max("mean_access").alias("high"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), key)))  # a row for each specialty


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, within: float = 0.0015) -> DataFrame:
    """Both sources side by side, refused where they differ by more than ``within`` or a key is missing."""
    both = a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key, "full")
    bad = both.where(F.coalesce(F.abs(F.col("first") - F.col("second")) > within, F.lit(True)))
    guards._refuse(f"sources disagree on {value}", bad, key)
    return both


def correction_effect(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """How a correction changes a value by key: direct (the key's population changed) or second-order, and rank shifts.

    Both have keys, mean, pop. One row of keys in either; ranks are by descending mean.
    """
    names = list(keys)
    both = before.select(*names, F.col("mean").alias("m0"), F.col("pop").alias("p0")).join(after.select(*names, F.col("mean").alias("m1"), F.col("pop").alias("p1")), names, "full")
    kind = F.when(F.col("p0").eqNullSafe(F.col("p1")), F.when(F.col("m0").eqNullSafe(F.col("m1")), "none").otherwise("second_order")).otherwise("direct")
    both = both.withColumn("effect", kind).withColumn("rel_change", ratio(F.col("m1") - F.col("m0"), F.col("m0")))
    ranks = [F.rank().over(Window.partitionBy(*names[:-1]).orderBy(F.desc(c))) if len(names) > 1 else F.rank().over(Window.orderBy(F.desc(c))) for c in ("m0", "m1")]
    return both.withColumn("rank_shift", ranks[1] - ranks[0])


def correction_summary(frozen: DataFrame, corrected: DataFrame, pop: DataFrame, region: Callable[[Column], Column], *keys: str, ratios: tuple[DataFrame, DataFrame] | None = None, scale: float = PER_CAPITA) -> DataFrame:
    """What a correction of one region's tracts does to the weighted mean access: one row of keys.

    ``frozen`` and ``corrected`` have keys, geoid and access (per ``scale``), for
    the same tracts; ``pop`` geoid and pop; ``region`` says of a geoid whether
    it was corrected. The change is split: ``second_order`` is that of the mean
    outside the region, ``direct`` what the region's own values add. Tracts and
    population with an access of 0 and without any are counted in both, and
    with ``ratios`` (each keys, supply, weighted_demand) how far the access
    that people have in all is from the supply that reaches anyone.
    """
    on = [*keys, "geoid"]
    both = frozen.select(*on, F.col("access").alias("f"), F.lit(True).alias("in_f")).join(corrected.select(*on, F.col("access").alias("c"), F.lit(True).alias("in_c")), on, "full")
    guards._refuse("the two results have other tracts", both.where("in_f is null or in_c is null"), "geoid")
    rows = both.drop("in_f", "in_c").join(pop.select("geoid", F.col("pop").cast("double").alias("pop")), "geoid", "left")
    p, inside = F.col("pop"), region(F.col("geoid"))
    known = lambda a: guards.finite(F.col(a)) & guards.finite(p)
    mean = lambda a, where: ratio(F.sum(F.when(known(a) & where, F.col(a) * p)), F.sum(F.when(known(a) & where, p)))
    share = lambda where: 100 * ratio(F.sum(F.when(where, p).otherwise(0.0)), F.sum(p))
    every = F.lit(True)
    out = [F.coalesce(F.sum(p), F.lit(0.0)).alias("pop_eligible")]
    for a, name in (("f", "frozen"), ("c", "corrected")):
        zero, none = F.coalesce(F.col(a) == 0, F.lit(False)), ~guards.finite(F.col(a))
        out += [mean(a, every).alias(f"mean_{name}"), mean(a, ~inside).alias(f"_outside_{name}"), mean(a, inside).alias(f"region_mean_{name}")]
        out += [F.count_if(zero).alias(f"n_zero_{name}"), share(zero).alias(f"pop_zero_pct_{name}"), F.count_if(none).alias(f"n_unknown_{name}"), share(none).alias(f"pop_unknown_pct_{name}")]
        out += [F.sum(F.when(known(a), F.col(a) * p / scale)).alias(f"_mass_{name}")]
    found = rows.groupBy(*keys).agg(*out)
    before, after = F.col("mean_frozen"), F.col("mean_corrected")
    second, direct = F.col("_outside_corrected") - F.col("_outside_frozen"), after - F.col("_outside_corrected")
    found = found.withColumns({"delta_pct": 100 * ratio(after - before, before), "second_order": second, "direct": direct, "second_order_pct": 100 * ratio(second, before), "direct_pct": 100 * ratio(direct, before)})
    for name, df in zip(("frozen", "corrected"), ratios or (), strict=False):
        own = df.groupBy(*keys).agg(F.sum(F.when(F.col("weighted_demand") > 0, F.col("supply")).otherwise(0.0)).alias("_s"))
        found = found.join(own, list(keys), "left") if keys else found.crossJoin(own)
        found = found.withColumn(f"conservation_residual_{name}", ratio(F.col(f"_mass_{name}") - F.col("_s"), F.col("_s"))).drop("_s")
    return found.drop(*[f"_{a}_{n}" for a in ("outside", "mass") for n in ("frozen", "corrected")])


def temporal_effect(means: DataFrame, key: str, spans: Sequence[tuple[int, int]]) -> DataFrame:
    """Percent changes between years in both results, and whether the correction turns their sign: key, span, frozen, corrected, sign_flip.

    ``means`` has key, year, mean_frozen and mean_corrected; years before the
    correction have both alike. Spans without both years are left out. A change
    of less than a billionth of a percent is the noise of the means' sums and
    has no sign.
    """
    sign = lambda c: F.signum(F.round(c, 9))
    out = None
    for a, b in spans:
        at = lambda c, y: F.max(F.when(F.col("year") == y, F.col(c)))
        change = lambda c: 100 * ratio(at(c, b) - at(c, a), at(c, a))  # noqa: B023, E731
        one = means.groupBy(key).agg(change("mean_frozen").alias("frozen"), change("mean_corrected").alias("corrected")).where("frozen is not null and corrected is not null")
        one = one.select(key, F.lit(f"{a}-{b}").alias("span"), "frozen", "corrected", (sign("frozen") != sign("corrected")).alias("sign_flip"))
        out = one if out is None else out.unionByName(one)
    return out


def ranking_effect(means: DataFrame, key: str) -> DataFrame:
    """Each year's order of keys by descending mean in both results, ties by key, and whether it changed: year, frozen, corrected, changed."""
    def ordered(c: str) -> Column:  # a few specialties a year
        return F.concat_ws(" > ", F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("m"), F.col(key).alias("k")))), lambda x: x["k"]))

    by = means.groupBy("year").agg(ordered("mean_frozen").alias("frozen"), ordered("mean_corrected").alias("corrected"))
    return by.withColumn("changed", F.col("frozen") != F.col("corrected"))
