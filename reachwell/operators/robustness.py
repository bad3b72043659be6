"""How much results depend on choices: population vintages, weights, specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import CLAIM_LEVEL, EPSILON, MATERIAL_CHANGE, SEAM_MEAN, SEAM_SHARE, THRESHOLDS
from reachwell.functions.stats import quantile_linear, ratio

#: What is estimated, by id (fixed values).
ESTIMANDS = {"E1": "national", "E2": "rural_metro_ratio", "E3": "aian_white_ratio"}


def rescaled(cells: DataFrame, total: float | DataFrame) -> DataFrame:
    """Cells whose population is scaled to a total, or to that of other cells."""
    if isinstance(total, DataFrame):
        total = total.agg(F.sum("pop")).head()[0]
    own = cells.agg(F.sum("pop").alias("_t"))
    return cells.crossJoin(F.broadcast(own)).withColumn("pop", F.col("pop") * total / F.col("_t")).drop("_t")  # one row


def seam_rows(first: DataFrame, second: DataFrame, states: DataFrame) -> DataFrame:
    """Cells with both surfaces' access (per 100,000), the first one's population, and the state."""
    a = first.select("cell_id", F.col("access").alias("a"), "pop")
    b = second.select("cell_id", F.col("access").alias("b"))
    rows = a.join(b, "cell_id").join(states, "cell_id", "left")
    ok = guards.finite(F.col("a")) & guards.finite(F.col("b")) & guards.finite(F.col("pop")) & (F.col("pop") >= 0)
    return rows.where(ok).select("cell_id", (F.col("a") * 1e5).alias("a"), (F.col("b") * 1e5).alias("b"), "pop", "state")


def seam_metrics(rows: DataFrame, changes: Sequence[float] = (0.01, 0.05, 0.10), thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row: means, weighted mean absolute difference and its quantiles, shares of population by relative change, and whether it passes."""
    a, b, p = F.col("a"), F.col("b"), F.col("pop")
    d = F.abs(a - b)
    share = lambda v, k: ratio(F.sum(F.when(v >= k, p).otherwise(0.0)), F.sum(p))
    gaps = [F.abs(share(a, k) - share(b, k)) for k in thresholds]
    one = rows.agg(
        ratio(F.sum(a * p), F.sum(p)).alias("mean_first"),
        ratio(F.sum(b * p), F.sum(p)).alias("mean_second"),
        ratio(F.sum(d * p), F.sum(p)).alias("pw_mad"),
        F.max(d).alias("max_change"),
        ratio(F.sum(F.when(a <= 0, p).otherwise(0.0)), F.sum(p)).alias("share_zero_first"),
        *[(F.sum(F.when((a > 0) & (d > k * a), p).otherwise(0.0)) / F.greatest(F.sum(F.when(a > 0, p).otherwise(0.0)), F.lit(1.0))).alias(f"share_gt_{round(100 * k)}") for k in changes],
        F.greatest(*gaps).alias("max_share_gap"),
    )
    spread = quantile_linear(rows.withColumn("d", d), "d", "pop", [0.5, 0.75, 0.9, 0.95, 0.99])
    rel = F.abs(F.col("mean_first") - F.col("mean_second")) / F.greatest(F.col("mean_first"), F.lit(1e-12))
    out = one.crossJoin(spread).withColumn("mean_rel_diff", rel)  # one row each
    return out.withColumn("pass", (F.col("mean_rel_diff") < SEAM_MEAN) & (F.col("max_share_gap") < SEAM_SHARE))


def seam_states(rows: DataFrame, n: int = 8) -> DataFrame:
    """The states with the largest weighted mean absolute difference: a report of the top ``n``."""
    by = rows.where("state is not null").groupBy("state").agg(ratio(F.sum(F.col("pop") * F.abs(F.col("a") - F.col("b"))), F.sum("pop")).alias("pw_mad"), F.sum("pop").alias("pop"))
    return by.orderBy(F.desc("pw_mad"), "state").limit(n)


def vintage_shift(strata: DataFrame, *keys: str) -> DataFrame:
    """Means and zero shares under both vintages, and the shift: from keys, vintage, mean_access, pct_zero."""
    at = lambda c, v: F.max(F.when(F.col("vintage") == v, F.col(c))).alias(f"{c}_{v}")
    by = strata.groupBy(*keys).agg(*[at(c, v) for c in ("mean_access", "pct_zero") for v in ("v2010", "v2020")])
    return by.withColumn("seam_mean", F.col("mean_access_v2020") - F.col("mean_access_v2010")).withColumn("seam_zero", F.col("pct_zero_v2020") - F.col("pct_zero_v2010"))


def representatives(supply: DataFrame) -> DataFrame:
    """The specialties with the least, median and most origins: role, specialty, n_origins."""
    by = supply.groupBy("specialty").agg(F.count("*").alias("n_origins"))
    order = Window.orderBy("n_origins", "specialty")  # a row for each specialty
    placed = by.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    role = F.when(F.col("i") == 1, "sparse").when(F.col("i") == F.col("n"), "dense").when(F.col("i") == F.ceil((F.col("n") + 1) / 2), "median")
    return placed.withColumn("role", role).where("role is not null").select("role", "specialty", "n_origins")


def outside(tracts: DataFrame, overlap: DataFrame, minutes: Sequence[int]) -> DataFrame:
    """Percent of the population that no origin reaches within each time: minutes, pct_outside."""
    least = overlap.where("overlap_fraction > 0").groupBy("geoid").agg(F.min("band").alias("band"))
    rows = tracts.join(least, "geoid", "left")
    cols = [F.struct(F.lit(m).alias("minutes"), (100 * ratio(F.sum(F.when(F.coalesce(F.col("band") <= m, F.lit(False)), 0.0).otherwise(F.col("pop"))), F.sum("pop"))).alias("pct_outside")) for m in minutes]
    return rows.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def long_results(sens: DataFrame, specs: DataFrame, primary: str = "base") -> DataFrame:
    """Each specification's estimates beside the primary one's, with the differences, direction and class.

    ``sens`` has variant, subspec and the estimands' columns; ``specs``
    spec_id, variant, axis, n_changed, status and contrast_only. Those that
    can't be run stay, with nulls.
    """
    long = sens.unpivot(["variant", "subspec"], list(ESTIMANDS.values()), "estimand_name", "spec_value")
    names = F.create_map(*[F.lit(x) for k, v in ESTIMANDS.items() for x in (v, k)])
    long = long.withColumn("estimand", names[F.col("estimand_name")])
    base = long.where(F.col("variant") == primary).select("subspec", "estimand", F.col("spec_value").alias("primary_value"))
    rows = specs.join(long.join(base, ["subspec", "estimand"]), "variant", "left")
    x, p = F.col("spec_value"), F.col("primary_value")
    rows = rows.withColumn("abs_diff", x - p).withColumn("rel_diff", ratio(x - p, F.abs(p)))
    rows = rows.withColumn("direction", F.when(F.col("estimand") == "E1", None).when(x < 1, "disadvantage").when(x.isNotNull(), "no_disadvantage"))
    rows = rows.withColumn("comparable", ~(F.col("contrast_only") & (F.col("estimand") == "E1")))
    holds = (F.col("estimand") == "E1") | F.coalesce(x < 1, F.lit(False))
    crossed = (F.col("estimand") == "E2") & (F.coalesce(p < CLAIM_LEVEL, F.lit(False)) != F.coalesce(x < CLAIM_LEVEL, F.lit(False)))
    grade = (
        F.when(F.col("status") == "pipeline", "not_executable")
        .when(~F.coalesce("comparable", F.lit(False)), "not_comparable_estimand_changed")
        .when(F.col("variant") == primary, "primary")
        .when(~holds, "materially_conclusion_sensitive")
        .when(crossed & F.col("is_main"), "materially_conclusion_sensitive")
        .when(F.coalesce(F.abs(F.col("rel_diff")) > MATERIAL_CHANGE, F.lit(False)), "quantitatively_sensitive")
        .otherwise("directionally_invariant")
    )
    return rows.withColumn("classification", grade)


def claims(sens: DataFrame, main: str) -> DataFrame:
    """Whether each claim holds under each variant: c1 (main ratio below a half), c2, c3 (all ratios below one), c4 (both)."""
    r, a = F.col("rural_metro_ratio"), F.col("aian_white_ratio")
    by = sens.groupBy("variant").agg(F.coalesce(F.bool_or((F.col("subspec") == main) & (r < CLAIM_LEVEL)), F.lit(False)).alias("c1"), F.bool_and(F.coalesce(r < 1, F.lit(False))).alias("c2"), F.bool_and(F.coalesce(a < 1, F.lit(False))).alias("c3"))
    return by.withColumn("c4", F.col("c2") & F.col("c3"))


def order_claim(sens: DataFrame, leaders: Sequence[str], last: str) -> DataFrame:
    """Whether the specialties with the highest national access are the leaders, and the one with the lowest is the last: variant, c5.

    Ties are in the order of names; a specialty without a value is below all.
    """
    n = F.coalesce("national", F.lit(float("-inf")))
    ranks = sens.select("variant", "subspec", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc(n), "subspec")).alias("place"), F.count("*").over(Window.partitionBy("variant")).alias("n"))
    top = F.count_if((F.col("place") <= len(leaders)) & F.col("subspec").isin(*leaders)) == len(leaders)
    return ranks.groupBy("variant").agg((top & F.bool_or((F.col("place") == F.col("n")) & (F.col("subspec") == last))).alias("c5"))


def run_gates(rows: DataFrame, variants: Sequence[str], specialties: Sequence[str], within: float = 1e-6) -> DataFrame:
    """What breaks a run's contract: gate, variant, subspec; no rows if the run may stand.

    ``rows`` has variant, subspec, national and national_check (the same mean
    computed another way). Gates: ``disagrees``, ``not_finite``, ``negative``,
    ``repeated``, ``missing``, and ``m2sfca_above_base``.
    """
    n, c = F.col("national"), F.col("national_check")
    own = rows.where(F.col("variant").isin(*variants))
    tests = {
        "disagrees": guards.finite(n) & guards.finite(c) & (F.abs(n - c) > within * F.greatest(F.abs(n), F.lit(1.0))),
        "not_finite": ~guards.finite(n),
        "negative": F.coalesce(n < 0, F.lit(False)),
    }
    failed = F.filter(F.array(*[F.when(t, F.lit(g)) for g, t in tests.items()]), lambda g: g.isNotNull())
    out = own.select(F.explode(failed).alias("gate"), "variant", "subspec")
    counts = own.groupBy("variant", "subspec").agg(F.count("*").alias("n"))
    out = out.unionByName(counts.where("n > 1").select(F.lit("repeated").alias("gate"), "variant", "subspec"))
    need = rows.sparkSession.createDataFrame([(v, s) for v in variants for s in specialties], "variant string, subspec string")
    out = out.unionByName(need.join(counts, ["variant", "subspec"], "left_anti").select(F.lit("missing").alias("gate"), "variant", "subspec"))
    at = lambda v: F.max(F.when(F.col("variant") == v, n))
    above = own.groupBy("subspec").agg(at("base").alias("base"), at("m2sfca").alias("m2")).where(F.col("m2") > F.col("base") * (1 + within))
    return out.unionByName(above.select(F.lit("m2sfca_above_base").alias("gate"), F.lit("m2sfca").alias("variant"), "subspec")).distinct()


def metro_rural_composite(rows: DataFrame, *keys: str) -> DataFrame:
    """An exploratory mean, neither national nor of one model: metropolitan people under one decay and rural people under another.

    ``rows`` has rurality, pop, and the access under the sharp and the slow
    decay (sharp, slow); other people are in neither.
    """
    metro, rural = (F.coalesce(F.col("rurality") == name, F.lit(False)) for name in ("Metropolitan", "Rural"))
    mean = lambda a, c: ratio(F.sum(F.when(c, F.col(a) * F.col("pop"))), F.sum(F.when(c, F.col("pop"))))
    by = rows.groupBy(*keys).agg(mean("sharp", metro).alias("metro"), mean("slow", rural).alias("rural"), F.sum(F.when(metro, F.col("pop")).otherwise(0.0)).alias("pm"), F.sum(F.when(rural, F.col("pop")).otherwise(0.0)).alias("pr"))
    both = ratio(F.col("metro") * F.col("pm") + F.col("rural") * F.col("pr"), F.col("pm") + F.col("pr"))
    return by.select(*keys, "metro", "rural", ratio(F.col("rural"), F.col("metro")).alias("rural_metro_ratio"), both.alias("exploratory_composite"))


def verify_claims(recorded: DataFrame, fresh: DataFrame, key: str = "variant") -> DataFrame:
    """Recorded claims that differ from recomputed ones or are missing on a side: key, claim, recorded, found."""
    names = [c for c in fresh.columns if c != key]
    old, new = (df.unpivot(key, names, "claim", value) for df, value in ((recorded, "recorded"), (fresh, "found")))
    return old.join(new, [key, "claim"], "full").where(~F.col("recorded").eqNullSafe(F.col("found")))


def leave_one_out(results: DataFrame) -> DataFrame:
    """Comparable specifications that change one thing alone: the change in value, percent and direction."""
    x, p = F.col("spec_value"), F.col("primary_value")
    rows = results.where(F.col("comparable") & (F.col("n_changed") == 1) & (F.col("status") != "pipeline"))
    flips = F.when(F.col("estimand") == "E1", False).otherwise((p < 1) != (x < 1))
    return rows.select("spec_id", "axis", "subspec", "estimand", p.alias("primary_value"), x.alias("altered"), (x - p).alias("abs_change"), (100 * ratio(x - p, F.abs(p))).alias("pct_change"), flips.alias("direction_changed"))


def robustness(results: DataFrame) -> DataFrame:
    """Spread of each estimate over the comparable specifications, and the one farthest from the primary."""
    x, p = F.col("spec_value"), F.col("primary_value")
    rows = results.where(F.col("comparable") & (F.col("status") != "pipeline"))
    far = F.struct(F.round(F.abs(x - p), 12), F.col("variant"))
    return rows.groupBy("estimand", "subspec").agg(
        F.max("primary_value").alias("primary_value"), F.count("*").alias("n_specs"), F.min(x).alias("least"), F.percentile(x, 0.25).alias("p25"), F.median(x).alias("median"), F.percentile(x, 0.75).alias("p75"), F.max(x).alias("greatest"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(F.when(F.col("estimand") == "E1", 1.0).otherwise((x < 1).cast("double"))).alias("same_direction"), F.max(far)["variant"].alias("farthest"),
    )


def gates(summary: DataFrame, total: float, within: float = 0.005) -> DataFrame:
    """Variants whose population-weighted access doesn't return the total supply, or whose values are missing or negative.

    ``summary`` has variant, mass (population times access) and least.
    """
    bad = F.abs(F.col("mass") - total) > within * abs(total)
    return summary.where(bad | (F.col("least") < 0) | ~guards.finite(F.col("mass")))


#: Ratios of a result table and what they are made of (fixed names).
RATIOS = {"rural_metro_ratio": ("rural", "metro"), "aian_white_ratio": ("aian", "white")}


def invariants(results: DataFrame, outside_: DataFrame | None = None, within: float = 1e-6, exact: float = 1e-9) -> DataFrame:
    """What can't be in results whatever the data: check, variant, subspec, what; no rows if they hold.

    ``results`` has variant, subspec, national, national_check, metro, rural,
    white, aian and the ratios of ``RATIOS``; ``outside_`` subspec, minutes and
    pct_outside. Two routes to the national mean must agree, ratios be those of
    their columns, access be finite and not negative, each variant cover each
    specialty once, and no wider catchment leave more people outside.
    """
    n, c = F.col("national"), F.col("national_check")
    tests = [("two_routes", "national", F.abs(n - c) > within * F.greatest(F.abs(n), F.lit(EPSILON)))]
    tests += [("derived_ratio", r, F.abs(F.col(r) - F.col(a) / F.nullif(F.col(b), F.lit(0.0))) > exact) for r, (a, b) in RATIOS.items()]
    for v in ("national", "metro", "rural", "white", "aian"):
        tests += [("negative", v, F.coalesce(F.col(v) < 0, F.lit(False))), ("not_finite", v, ~guards.finite(F.col(v)))]
    failed = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("check"), F.lit(w).alias("what"))) for k, w, t in tests]), lambda x: x.isNotNull())
    out = results.select("variant", "subspec", F.inline(failed)).select("check", "variant", "subspec", "what")
    names = results.agg(F.count_distinct("subspec").alias("all"))
    ragged = results.groupBy("variant").agg(F.count("*").alias("n"), F.count_distinct("subspec").alias("own")).crossJoin(F.broadcast(names)).where("n != all or own != all")
    out = out.unionByName(ragged.select(F.lit("ragged").alias("check"), "variant", F.lit(None).cast("string").alias("subspec"), F.lit("subspec").alias("what")))
    if outside_ is not None:
        before = F.lag("pct_outside").over(Window.partitionBy("subspec").orderBy("minutes"))
        wider = outside_.withColumn("before", before).where(F.col("pct_outside") > F.col("before") + exact)
        out = out.unionByName(wider.select(F.lit("not_nested").alias("check"), F.lit(None).cast("string").alias("variant"), "subspec", F.col("minutes").cast("string").alias("what")))
    return out
