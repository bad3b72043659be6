"""Queries over strata, classes, coverage and robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import BAND_WEIGHTS, DECAY_SCHEMES
from reachwell.functions import inference, scalars, stats
from reachwell.operators import classify, compare, coverage, robustness, strata
from reachwell.operators import supply as supplies
from reachwell.plans.binding import Binding
from reachwell.plans.model import _VARIANTS, STEPS, _access, _means, _variants
from reachwell.plans.registry import query, r

# Strata

_ROWS = STEPS + """, rws AS (SELECT a.geoid, a.pop, CASE WHEN reached THEN m * 1e5 END AS access, rurality, state, segment, k, a.pop * (k % 3) AS g1, CASE WHEN k % 4 = 0 THEN a.pop ELSE 0 END AS g2
  FROM acc a JOIN tracts USING (geoid)), kn AS (SELECT * FROM rws WHERE access IS NOT NULL)"""
_STAT = "sum(access * {w}) / nullif(sum({w}), 0) AS mean_access", "100 * sum(CASE WHEN access = 0 THEN {w} ELSE 0 END) / nullif(sum({w}), 0) AS pct_zero", "sum({w}) AS women"


def _stat(w: str) -> str:
    return r(*[s.format(w=w) for s in _STAT])


def _rows(b: Binding) -> DataFrame:
    k, p = F.col("k"), F.col("pop")
    found = b.tracts.join(_access(b).access.select("geoid", F.col("access_scaled").alias("access")), "geoid")
    return found.withColumn("g1", p * (k % 3)).withColumn("g2", F.when(k % 4 == 0, p).otherwise(0.0))


_STRATA = f"""SELECT 'overall' AS stratum_type, 'All' AS stratum, {_stat('pop')} FROM kn UNION ALL SELECT 'rurality', rurality, {_stat('pop')} FROM kn WHERE rurality IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'group', 'g1', {_stat('g1')} FROM kn UNION ALL SELECT 'group', 'g2', {_stat('g2')} FROM kn"""


@query(_STRATA, _ROWS)
def stratified_access(b: Binding) -> DataFrame:
    return strata.stratified(_rows(b), ["g1", "g2"])


@query(
    f"""SELECT segment, 'overall' AS stratum_type, 'All' AS stratum, {_stat('pop')} FROM kn GROUP BY 1 UNION ALL SELECT segment, 'rurality', rurality, {_stat('pop')} FROM kn WHERE rurality IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT segment, 'group', 'g1', {_stat('g1')} FROM kn GROUP BY 1 UNION ALL SELECT segment, 'group', 'g2', {_stat('g2')} FROM kn GROUP BY 1""",
    _ROWS,
)
def stratified_by_segment(b: Binding) -> DataFrame:
    return strata.stratified(_rows(b), ["g1", "g2"], "segment")


@query("SELECT state, count(*) AS rows, count(*) FILTER (access IS NULL) AS lost, " + r("count(*) FILTER (access IS NULL) * 1.0 / count(*) AS share") + " FROM rws GROUP BY 1 HAVING count(*) FILTER (access IS NULL) > 0", _ROWS)
def state_losses(b: Binding) -> DataFrame:
    return guards.state_losses(_rows(b), F.col("access").isNull())


@query("SELECT count(*) FILTER (access IS NULL) AS n_unknown, " + r("avg(CASE WHEN access IS NULL THEN 1.0 ELSE 0.0 END) AS frac_unknown") + " FROM rws", _ROWS)
def unknown_access(b: Binding) -> DataFrame:
    return guards.partition_unknown(_rows(b))[1]


@query("SELECT geoid, CASE WHEN k % 5 = 0 THEN '09001' || right(geoid, 6) ELSE geoid END AS relabelled FROM tracts")
def relabelled_tracts(b: Binding) -> DataFrame:
    own = b.tracts.select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("09110"), F.substring("geoid", 6, 6))).otherwise(F.col("geoid")).alias("geoid"), F.col("geoid").alias("was"))
    mapping = b.tracts.where("k % 5 = 0").select(F.concat(F.lit("09001"), F.substring("geoid", 6, 6)).alias("legacy_geoid"), F.concat(F.lit("09110"), F.substring("geoid", 6, 6)).alias("new_geoid"), F.col("k").alias("place"))
    later = mapping.select(F.lit("none").alias("legacy_geoid"), "new_geoid", (F.col("place") + 10**9).alias("place"))  # not the first match
    return strata.relabel(own, mapping.unionByName(later), 2022).select(F.col("was").alias("geoid"), F.col("geoid").alias("relabelled"))


@query(
    "SELECT nation, " + r(*[f"max(CASE WHEN v = '{v}' THEN {c} END) AS {c}_{v}" for c in ("estimate", "moe") for v in ("BUILDING", "MACHINERY")])
    + " FROM (SELECT state AS nation, segment AS v, sum(pop) AS estimate, CAST(count(*) AS DOUBLE) AS moe FROM tracts GROUP BY 1, 2) GROUP BY 1"
)
def wide_estimates(b: Binding) -> DataFrame:
    long = b.tracts.groupBy(F.col("state").alias("nation"), F.col("segment").alias("v")).agg(F.sum("pop").alias("estimate"), F.count("*").cast("double").alias("moe"))
    return strata.wide(long, "nation", "v", ["BUILDING", "MACHINERY"])


_SEG = _ROWS + ", seg AS (SELECT segment, rurality AS stratum, sum(access * pop) / sum(pop) AS mean_access, sum(pop) AS women FROM kn WHERE rurality IS NOT NULL GROUP BY 1, 2)"


def _segments(b: Binding) -> DataFrame:
    known = _rows(b).where("access is not null and rurality is not null")
    return known.groupBy("segment", F.col("rurality").alias("stratum")).agg(stats.weighted_mean_all(F.col("access"), F.col("pop")).alias("mean_access"), F.sum("pop").alias("women"))


@query(
    f"""SELECT segment, stratum, {r('mean_access', 'women', 'mean_access / ref AS ratio', '100 * (mean_access / ref - 1) AS pct')},
  CASE WHEN mean_access / ref <= 0.9 THEN 'Worse access' WHEN mean_access / ref >= 1.1 THEN 'Better access' ELSE 'Similar' END AS class
  FROM seg JOIN (SELECT segment, mean_access AS ref FROM seg WHERE stratum = 'Metropolitan') USING (segment) WHERE stratum <> 'Metropolitan'""",
    _SEG,
)
def equity_ratios(b: Binding) -> DataFrame:
    return strata.equity(_segments(b), "segment", "Metropolitan")


@query(f"SELECT segment, {r('mean', 'low', 'high')}, CAST(row_number() OVER (ORDER BY mean DESC, segment) AS INTEGER) AS place FROM (SELECT segment, sum(mean_access * women) / sum(women) AS mean, min(mean_access) AS low, max(mean_access) AS high FROM seg GROUP BY 1)", _SEG)
def ordered_means(b: Binding) -> DataFrame:
    return strata.ordered_means(_segments(b), "segment")


@query(f"SELECT segment, {r('count(*) / 2.0 AS first', 'count(*) / 2.0 AS second')} FROM tracts GROUP BY 1")
def reconciled_sources(b: Binding) -> DataFrame:
    one = b.tracts.groupBy("segment").agg((F.count("*") / 2).alias("v"))
    return strata.reconcile(one, one, "segment", "v")


@query(
    f"""SELECT segment, {r('m0', 'p0', 'm1', 'p1', '(m1 - m0) / m0 AS rel_change')}, CASE WHEN p0 = p1 THEN CASE WHEN m0 = m1 THEN 'none' ELSE 'second_order' END ELSE 'direct' END AS effect,
  CAST(rank() OVER (ORDER BY m1 DESC) - rank() OVER (ORDER BY m0 DESC) AS INTEGER) AS rank_shift
  FROM (SELECT segment, CAST(count(*) AS DOUBLE) AS m0, count(*) * CASE WHEN segment < 'C' THEN 1.5 ELSE 1.0 END AS m1, 1.0 AS p0, CASE WHEN segment LIKE 'M%' THEN 2.0 ELSE 1.0 END AS p1 FROM tracts GROUP BY 1)"""
)
def correction_effect(b: Binding) -> DataFrame:
    base = b.tracts.groupBy("segment").agg(F.count("*").cast("double").alias("n"))
    after = base.select("segment", (F.col("n") * F.when(F.col("segment") < "C", 1.5).otherwise(1.0)).alias("mean"), F.when(F.col("segment").startswith("M"), 2.0).otherwise(1.0).alias("pop"))
    return strata.correction_effect(base.select("segment", F.col("n").alias("mean"), F.lit(1.0).alias("pop")), after, "segment")


@query()
def hac_trends(b: Binding) -> DataFrame:
    """No SQL: tested against a direct computation."""
    return stats.hac_trend(supplies.physicians_by_year(b.panel, b.cohort), "analysis_year", "n_providers", "specialty")


@query()
def monte_carlo_means(b: Binding) -> DataFrame:
    """No SQL: drawn at random; tested by its coverage."""
    return stats.monte_carlo_mean(_rows(b).where("access is not null").withColumn("se", F.col("pop") * 0.1), "access", "pop", "se", "segment")


def _inference(b: Binding) -> DataFrame:
    """Access with three populations and their errors; the middle one is nobody in places."""
    k, p = F.col("k"), F.col("pop").cast("double")
    return _rows(b).where("access is not null").select("geoid", "segment", "rurality", "access", p.alias("all"), (p * 0.1).alias("all_se"), F.when(k % 4 == 0, p).alias("g2"), (p * 0.2).alias("g2_se"), (p * (k % 3)).alias("g1"), F.when(k % 2 == 0, p * 0.3).alias("g1_se"))


def _contrasts(b: Binding) -> DataFrame:
    groups = {"national": inference.Group("all", "all_se"), "metro": inference.Group("all", "all_se", F.col("rurality") == "Metropolitan"), "rural": inference.Group("all", "all_se", F.col("rurality") == "Rural")}
    groups |= {"g1": inference.Group("g1", "g1_se"), "g2": inference.Group("g2", "g2_se")}
    contrasts = {"metro_minus_rural": ("mean_metro", "minus", "mean_rural"), "metro_rural_ratio": ("mean_metro", "over", "mean_rural"), "g1_minus_g2": ("mean_g1", "minus", "mean_g2"), "g1zero_minus_g2zero": ("zero_g1", "minus", "zero_g2")}
    return inference.intervals(_inference(b), "access", groups, {n: inference.Contrast(*c) for n, c in contrasts.items()}, "segment")


_METRICS = ", ".join(
    f"sum(access * {w}) FILTER ({c}) / nullif(sum({w}) FILTER ({c}), 0) AS mean_{n}, 100 * sum(CASE WHEN access = 0 THEN {w} ELSE 0 END) FILTER ({c}) / nullif(sum({w}) FILTER ({c}), 0) AS zero_{n}"
    for n, w, c in (("national", "pop", "true"), ("metro", "pop", "rurality = 'Metropolitan'"), ("rural", "pop", "rurality = 'Rural'"), ("g1", "g1", "true"), ("g2", "g2", "true"))
)
_NAMED = ", ".join(
    f"{{'metric': '{m}', 'point': CAST({m} AS DOUBLE)}}"
    for m in [f"{s}_{g}" for g in ("national", "metro", "rural", "g1", "g2") for s in ("mean", "zero")] + ["metro_minus_rural", "metro_rural_ratio", "g1_minus_g2", "g1zero_minus_g2zero"]
)


@query(
    f"""SELECT segment, u.metric AS metric, round(u.point, 6) + CAST(0 AS DOUBLE) AS point FROM (
  SELECT segment, unnest([{_NAMED}]) AS u FROM (SELECT *, mean_metro - mean_rural AS metro_minus_rural, mean_metro / nullif(mean_rural, 0) AS metro_rural_ratio, mean_g1 - mean_g2 AS g1_minus_g2, zero_g1 - zero_g2 AS g1zero_minus_g2zero
  FROM (SELECT segment, {_METRICS} FROM kn GROUP BY 1)))""",
    _ROWS,
)
def contrast_points(b: Binding) -> DataFrame:
    """What the intervals of strata and their contrasts lie around."""
    return _contrasts(b).select("segment", "metric", "point")


@query()
def contrast_intervals(b: Binding) -> DataFrame:
    """No SQL: intervals of draws; tested against draws of every row."""
    return _contrasts(b)


_P = """CASE WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (th + CASE WHEN nu = 1 THEN 0 ELSE sin(th) * cos(th) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda m: list_product(list_prepend(CAST(1 AS DOUBLE), list_transform(range(1, m + 1), lambda j: 2.0::DOUBLE * j / (2 * j + 1)))) * cos(th) ** (2 * m))) END)
  ELSE 1 - sin(th) * list_sum(list_transform(range(0, nu // 2), lambda m: list_product(list_prepend(CAST(1 AS DOUBLE), list_transform(range(1, m + 1), lambda j: (2.0::DOUBLE * j - 1) / (2 * j)))) * cos(th) ** (2 * m))) END"""


@query(
    f"""SELECT specialty, n, {r('slope', 'se')}, CASE WHEN se IS NOT NULL THEN round(CASE WHEN se > 0 THEN {_P} WHEN slope = 0 THEN 1 ELSE 0 END, 6) + CAST(0 AS DOUBLE) END AS p FROM (
  SELECT *, atan(abs(slope) / nullif(se, 0) / sqrt(nu)) AS th FROM (
  SELECT specialty, n, n - 2 AS nu, CASE WHEN n >= 3 AND sxx > 0 THEN slope END AS slope, CASE WHEN n >= 3 AND sxx > 0 THEN sqrt(CASE WHEN syy - slope * slope * sxx <= 1e-14 * syy THEN 0 ELSE syy - slope * slope * sxx END / (n - 2) / sxx) END AS se
  FROM (SELECT specialty, count(*) AS n, regr_slope(v, analysis_year) AS slope, regr_sxx(v, analysis_year) AS sxx, regr_syy(v, analysis_year) AS syy
        FROM (SELECT specialty, analysis_year, count(DISTINCT npi) AS v FROM panel JOIN cohort USING (npi) GROUP BY 1, 2) WHERE analysis_year <= 2022 GROUP BY 1)))"""
)
def trend_p_values(b: Binding) -> DataFrame:
    return inference.trends(b.panel.join(b.cohort, "npi").groupBy("specialty", "analysis_year").agg(F.count_distinct("npi").alias("v")), "analysis_year", "v", "specialty")


@query()
def inferential_table(b: Binding) -> DataFrame:
    """No SQL: texts of intervals and trends; their numbers are tested."""
    series = b.panel.join(b.tracts.select((F.col("k")).alias("npi"), "segment", F.coalesce("rurality", F.lit("Unknown")).alias("stratum")), "npi").groupBy("segment", "stratum", "analysis_year").agg(F.count("*").alias("v"))
    columns = [("national_mean", "mean_national", 3), ("metro_rural_ratio", "metro_rural_ratio", 2), ("rural_pct_zero", "zero_rural", 2), ("g1_mean", "mean_g1", 3), ("g1_minus_g2_zero", "g1zero_minus_g2zero", 2)]
    return inference.inferential_table(_contrasts(b), inference.trends(series, "analysis_year", "v", "segment", "stratum"), "segment", columns, [("metro_trend", "Metropolitan"), ("rural_trend", "Rural")])


@query(
    """SELECT k, CASE WHEN 1 + k % 12 <= 3 THEN 'Metropolitan' WHEN 1 + k % 12 <= 10 THEN 'Rural' END AS rurality,
  CASE WHEN 1 + k % 12 <= 3 THEN 'Metropolitan' WHEN 1 + k % 12 <= 6 THEN 'Micropolitan' WHEN 1 + k % 12 <= 9 THEN 'Small town' ELSE 'Rural' END AS ruca_level,
  CASE WHEN 2010 + k % 15 <= 2019 THEN 2010 ELSE 2020 END AS vintage, CAST(greatest(2013, least(2022, 2010 + k % 15)) AS INTEGER) AS acs_year FROM tracts"""
)
def codes(b: Binding) -> DataFrame:
    code, year = (1 + F.col("k") % 12).cast("string"), (2010 + F.col("k") % 15).cast("int")
    return b.tracts.select("k", scalars.rurality(code).alias("rurality"), scalars.ruca_level(code).alias("ruca_level"), scalars.tract_vintage(year).alias("vintage"), scalars.survey_year(year).alias("acs_year"))


# Classes

_BIV = "xy AS (SELECT geoid, k % 97 * 1.0 AS x, round(pop, 2) AS y FROM tracts)"


def _xy(b: Binding) -> DataFrame:
    return b.tracts.select("geoid", (F.col("k") % 97).cast("double").alias("x"), F.round("pop", 2).alias("y"))


def _class_sql(breaks: str) -> str:
    one = lambda v, c: f"CASE WHEN {v} <= {c}[2] THEN 1 WHEN {v} <= {c}[3] THEN 2 ELSE 3 END"
    return f"""SELECT geoid, {one('x', 'bx')} AS var1_class, {one('y', '"by"')} AS var2_class, ({one('x', 'bx')}) || '-' || ({one('y', '"by"')}) AS bivar_class FROM xy, (SELECT {breaks} FROM xy)"""


_QB = "quantile_cont(x, [0, 1/3.0, 2/3.0, 1]) AS bx, quantile_cont(y, [0, 1/3.0, 2/3.0, 1]) AS \"by\""
_EB = "[min(x), min(x) + (max(x) - min(x)) / 3, min(x) + (max(x) - min(x)) * 2 / 3, max(x)] AS bx, [min(y), min(y) + (max(y) - min(y)) / 3, min(y) + (max(y) - min(y)) * 2 / 3, max(y)] AS \"by\""


@query(_class_sql(_QB), _BIV)
def bivariate_quantile(b: Binding) -> DataFrame:
    return classify.bivariate(_xy(b), "x", "y").drop("x", "y")


@query(_class_sql(_EB), _BIV)
def bivariate_equal(b: Binding) -> DataFrame:
    return classify.bivariate(_xy(b), "x", "y", method="equal").drop("x", "y")


@query()
def bivariate_jenks(b: Binding) -> DataFrame:
    """No SQL: natural breaks are found by dynamic programming; tested against all splits."""
    return classify.bivariate(_xy(b).withColumn("y", F.round("y", -2)), "x", "y", method="jenks").drop("x", "y")


@query(f"SELECT bivar_class, count(*) AS n FROM ({_class_sql(_QB)}) GROUP BY 1", _BIV)
def bivariate_summary(b: Binding) -> DataFrame:
    return classify.class_summary(classify.bivariate(_xy(b), "x", "y"))


@query("SELECT geoid, color FROM (" + _class_sql(_QB) + ") JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in classify.PALETTE.items()) + ") p(bivar_class, color) USING (bivar_class)", _BIV)
def bivariate_colours(b: Binding) -> DataFrame:
    return classify.coloured(classify.bivariate(_xy(b), "x", "y")).select("geoid", "color")


@query("SELECT geoid, CASE WHEN k % 101 <= 33 THEN 1 WHEN k % 101 <= 67 THEN 2 ELSE 3 END AS tertile, CASE WHEN k % 101 <= 100 / 3.0 THEN 1 WHEN k % 101 <= 200 / 3.0 THEN 2 ELSE 3 END AS third FROM tracts")
def fixed_tertiles(b: Binding) -> DataFrame:
    x = F.col("k") % 101
    return b.tracts.select("geoid", classify.fixed_class(x, [33, 67]).alias("tertile"), classify.fixed_class(x, [100 / 3, 200 / 3]).alias("third"))


@query(
    f"""SELECT geoid, {r("((p - avg(p) OVER ()) / stddev_samp(p) OVER () + (u - avg(u) OVER ()) / stddev_samp(u) OVER () - (i - avg(i) OVER ()) / stddev_samp(i) OVER ()) / 3 AS score")}
  FROM (SELECT geoid, k % 31 * 1.0 AS p, k % 17 * 1.0 AS u, pop AS i FROM tracts)"""
)
def deprivation_index(b: Binding) -> DataFrame:
    rows = b.tracts.select("geoid", (F.col("k") % 31).cast("double").alias("p"), (F.col("k") % 17).cast("double").alias("u"), F.col("pop").alias("i"))
    return classify.deprivation(rows, ["p", "u"], ["i"])


@query(f"SELECT CAST(i AS INTEGER) AS pct, {r('v[i + 1] AS value')} FROM (SELECT quantile_cont(pop, [{', '.join(str(i / 100) for i in range(101))}]) AS v FROM tracts), (SELECT unnest(range(101)) AS i)")
def population_percentiles(b: Binding) -> DataFrame:
    return classify.percentile_profile(b.tracts, "pop")


@query(f"SELECT {r('sum(CASE WHEN k % 101 <= 33 THEN pop ELSE 0 END) AS low_pop', 'sum(CASE WHEN k % 101 <= 33 AND k % 89 > 67 THEN pop ELSE 0 END) AS priority_pop')}, count(DISTINCT CASE WHEN k % 101 <= 33 AND k % 89 > 67 THEN state END) AS n_areas FROM tracts")
def priority_populations(b: Binding) -> DataFrame:
    rows = b.tracts.select("pop", "state", (F.col("k") % 101).alias("a"), (F.col("k") % 89).alias("d"))
    return classify.priority(rows, "a", "d", "pop", "state", (33, 67))


@query(f"SELECT geoid, {r('(k % 7 + k % 5) * 1.0 / nullif(k % 7 + k % 5 + k % 11, 0) AS minority_share')} FROM tracts")
def minority_shares(b: Binding) -> DataFrame:
    k = F.col("k")
    rows = b.tracts.select("geoid", (k % 7).cast("double").alias("a"), (k % 5).cast("double").alias("b"), (k % 7 + k % 5 + k % 11).cast("double").alias("t"))
    return classify.minority_share(rows, ["a", "b"], "t").select("geoid", "minority_share")


# Coverage

_F = "greatest(0, least(1, percent / 100))"
_COVERED = f"100 * sum(pop * {_F}) / nullif(sum(pop), 0)"


@query(f"SELECT specialty, {r(f'{_COVERED} AS covered_pct', 'sum(pop) AS pop')}, count(*) FILTER (percent >= 50) AS n_reached FROM cover GROUP BY 1")
def coverage_summary(b: Binding) -> DataFrame:
    return coverage.summary(b.cover, "specialty")


@query("SELECT state, " + r(*[f"100 * sum(pop * {_F}) FILTER (specialty = '{s}') / nullif(sum(pop) FILTER (specialty = '{s}'), 0) AS {s}" for s in ("AA", "BB", "CC", "DD")]) + " FROM cover GROUP BY 1")
def coverage_by_state(b: Binding) -> DataFrame:
    return coverage.pivoted(b.cover, "state", "specialty", ["AA", "BB", "CC", "DD"])


@query(f"SELECT n AS n_specialties, {r('sum(pop) AS pop', '100 * sum(pop) / sum(sum(pop)) OVER () AS pct')} FROM (SELECT geoid, max(pop) AS pop, count(*) FILTER (percent >= 50) AS n FROM cover GROUP BY 1) GROUP BY 1")
def access_breadth(b: Binding) -> DataFrame:
    return coverage.breadth(b.cover)


@query(
    f"""SELECT specialty, {r('sum(pop) AS reached', 'sum(CASE WHEN n = 1 THEN pop ELSE 0 END) AS alone', '100 * sum(CASE WHEN n = 1 THEN pop ELSE 0 END) / sum(pop) AS pct')}
  FROM cover JOIN (SELECT geoid, count(*) AS n FROM cover WHERE percent >= 50 GROUP BY 1) USING (geoid) WHERE percent >= 50 GROUP BY 1"""
)
def exclusive_access(b: Binding) -> DataFrame:
    return coverage.exclusive(b.cover)


_D = "sum(CASE WHEN percent < 50 AND rurality = 'Rural' THEN pop ELSE 0 END)"


@query(f"SELECT specialty, {r(f'{_D} AS desert_pop', f'100 * {_D} / sum(pop) AS pct_desert', f'100 * {_D} / sum(CASE WHEN percent < 50 THEN pop END) AS rural_pct_of_unreached')} FROM cover GROUP BY 1")
def access_deserts(b: Binding) -> DataFrame:
    return coverage.deserts(b.cover, "specialty")


@query(f"SELECT specialty, CASE WHEN ruca <= 3 THEN 'Metropolitan' WHEN ruca <= 6 THEN 'Micropolitan' WHEN ruca <= 9 THEN 'Small town' WHEN ruca IS NOT NULL THEN 'Rural' END AS level, {r(f'{_COVERED} AS covered_pct', 'sum(pop) AS pop')}, count(*) FILTER (percent >= 50) AS n_reached FROM cover GROUP BY 1, 2")
def coverage_by_level(b: Binding) -> DataFrame:
    return coverage.summary(b.cover.withColumn("level", scalars.ruca_level(F.col("ruca"))), "specialty", "level")


_OWN = "(CASE specialty WHEN 'AA' THEN pop * 0.5 ELSE pop * (k % 3) END)"


@query(f"SELECT specialty, {r(f'{_COVERED} AS full', f'100 * sum({_OWN} * {_F}) / sum({_OWN}) AS restricted', f'100 * sum({_OWN} * {_F}) / sum({_OWN}) - {_COVERED} AS diff')} FROM cover WHERE specialty IN ('AA', 'BB') GROUP BY 1")
def age_restricted(b: Binding) -> DataFrame:
    rows = b.cover.withColumn("adult", F.col("pop") * 0.5).withColumn("old", F.col("pop") * (F.col("k") % 3))
    return coverage.age_restricted(rows, {"AA": "adult", "BB": "old"})


_SERIES = "ser AS (SELECT segment AS specialty, b AS band, CAST(y AS INTEGER) AS year, sum(pop * least(1, (k % 101) / 100.0 * b / 120 * (1 + (y - 2013) * 0.01 * (k % 7)))) / sum(pop) * 100 AS percent FROM tracts, (VALUES (30), (60), (120), (180)) v(b), (SELECT unnest(range(2013, 2024)) AS y) GROUP BY 1, 2, 3)"


def _series(b: Binding) -> DataFrame:
    rows = b.tracts.select("segment", "pop", "k", F.explode(F.array(*[F.lit(x) for x in BAND_WEIGHTS])).alias("band")).select("*", F.explode(F.sequence(F.lit(2013), F.lit(2023))).alias("year"))
    p = F.least(F.lit(1.0), (F.col("k") % 101) / 100.0 * F.col("band") / 120 * (1 + (F.col("year") - 2013) * 0.01 * (F.col("k") % 7)))
    return rows.groupBy(F.col("segment").alias("specialty"), "band", "year").agg((stats.ratio(F.sum(F.col("pop") * p), F.sum("pop")) * 100).alias("percent"))


_BAND_P = f"""SELECT specialty, band, round(CASE WHEN e <= 1e-14 * syy THEN 0 ELSE {_P} END, 6) + CAST(0 AS DOUBLE) AS p FROM (SELECT *, n - 2 AS nu, atan(abs(slope) / sqrt(nullif(greatest(e, 0), 0) / (n - 2) / sxx) / sqrt(n - 2)) AS th FROM (
  SELECT *, syy - slope * slope * sxx AS e FROM (SELECT specialty, band, count(*) AS n, regr_slope(percent, year) AS slope, regr_sxx(percent, year) AS sxx, regr_syy(percent, year) AS syy FROM ser GROUP BY 1, 2)))"""


@query(f"SELECT * FROM (SELECT specialty, band, {r('max(CASE WHEN year = 2013 THEN percent END) AS first', 'max(CASE WHEN year = 2023 THEN percent END) AS last', 'regr_slope(percent, year) AS slope', 'regr_r2(percent, year) AS r2', 'max(CASE WHEN year = 2023 THEN percent END) - max(CASE WHEN year = 2013 THEN percent END) AS change')} FROM ser GROUP BY 1, 2) JOIN ({_BAND_P}) USING (specialty, band)", _SERIES)
def band_matrix(b: Binding) -> DataFrame:
    return coverage.band_matrix(_series(b), 2013, 2023)


def _composite_sql() -> str:
    parts = [f"SELECT specialty, '{s}' AS scheme, sum(step * CASE band {' '.join(f'WHEN {k} THEN {v}' for k, v in ws.items())} END) AS composite FROM stp GROUP BY 1" for s, ws in DECAY_SCHEMES.items()]
    return f"SELECT specialty, scheme, {r('composite')}, CAST(rank() OVER (PARTITION BY scheme ORDER BY composite DESC) AS INTEGER) AS rank FROM ({' UNION ALL '.join(parts)})"


@query(_composite_sql(), _SERIES + ", stp AS (SELECT specialty, band, percent - coalesce(lag(percent) OVER (PARTITION BY specialty ORDER BY band), 0) AS step FROM ser WHERE year = 2023)")
def decay_composites(b: Binding) -> DataFrame:
    return coverage.composites(_series(b).where("year = 2023").select("specialty", "band", "percent"), "specialty")


_ST = "stt AS (SELECT state, sum(pop) AS tot, sum(pop * (k % 101)) / sum(pop) AS a, sum(pop * (k % 97)) / sum(pop) AS b, sum(pop * (k % 101 + k % 97)) / sum(pop) AS c FROM tracts GROUP BY 1)"


def _state_scores(b: Binding) -> DataFrame:
    p, k = F.col("pop"), F.col("k")
    one = lambda x: stats.ratio(F.sum(p * x), F.sum(p))
    return b.tracts.groupBy("state").agg(F.sum("pop").alias("tot"), one(k % 101).alias("a"), one(k % 97).alias("b"), one(k % 101 + k % 97).alias("c"))


_RK = "rk AS (SELECT state, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{c}" for c in "abc") + " FROM stt)"


@query(f"SELECT 'a' AS first, 'b' AS second, {r('corr(ra, rb) AS rho')} FROM rk UNION ALL SELECT 'a', 'c', {r('corr(ra, rc) AS rho')} FROM rk", f"{_ST}, {_RK}")
def rank_correlations(b: Binding) -> DataFrame:
    return coverage.spearman(_state_scores(b), [("a", "b"), ("a", "c")])


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS spec, {r(f'100.0 * avg(CASE WHEN t{c} = ta THEN 1 ELSE 0 END) AS units', f'100 * sum(CASE WHEN t{c} = ta THEN tot ELSE 0 END) / sum(tot) AS weighted')} FROM ti" for c in "bc"),
    _ST + ", ti AS (SELECT state, tot, " + ", ".join(f"ntile(5) OVER (ORDER BY {c}, state) AS t{c}" for c in "abc") + " FROM stt)",
)
def tier_agreement(b: Binding) -> DataFrame:
    return coverage.tier_agreement(coverage.tiers(_state_scores(b), "state", ["a", "b", "c"]), "a", ["b", "c"], "tot")


@query()
def odds_ratios(b: Binding) -> DataFrame:
    """No SQL: fitted by iteration; only its rows are tested."""
    rows = b.cover.where("specialty = 'AA'").select(coverage.is_reached(F.col("percent")).cast("int").alias("reached"), F.coalesce(F.col("rurality") == "Rural", F.lit(False)).cast("int").alias("rural"), (F.col("pop") / 1e4).alias("size"))
    return coverage.odds_ratios(rows, "reached", ["rural", "size"])


# Robustness

_CW = """xw AS (SELECT segment, round(m * 1e5, 6) AS x, sum(a.pop) AS w FROM acc a JOIN tracts USING (geoid) WHERE a.pop > 0 GROUP BY 1, 2),
cw AS (SELECT segment, x, w, sum(w) OVER (PARTITION BY segment ORDER BY x) / sum(w) OVER (PARTITION BY segment) AS cw, sum(x * w) OVER (PARTITION BY segment ORDER BY x) / sum(x * w) OVER (PARTITION BY segment) AS cxw FROM xw),
lg AS (SELECT *, lag(cw) OVER p AS pw, lag(x) OVER p AS px, lag(cxw) OVER p AS pxw FROM cw WINDOW p AS (PARTITION BY segment ORDER BY x))"""


def _weighted(b: Binding) -> DataFrame:
    return b.tracts.join(_access(b).access.select("geoid", F.round("access_scaled_math", 6).alias("x")), "geoid")


@query("SELECT segment, " + r(*[f"min(CASE WHEN cw >= {p} THEN x END) AS q{round(100 * p)}" for p in (0.25, 0.5, 0.9)], digits=4) + " FROM cw GROUP BY 1", f"{STEPS}, {_CW}", digits=4)
def quantiles_step(b: Binding) -> DataFrame:
    return stats.quantile_step(_weighted(b), "x", "pop", [0.25, 0.5, 0.9], "segment")


@query(
    "SELECT segment, " + r(*[f"min(CASE WHEN pw IS NULL AND cw >= {p} THEN x WHEN cw >= {p} AND pw < {p} THEN px + (x - px) * ({p} - pw) / (cw - pw) END) AS q{round(100 * p)}" for p in (0.25, 0.5, 0.9)], digits=4) + " FROM lg GROUP BY 1",
    f"{STEPS}, {_CW}",
    digits=4,
)
def quantiles_linear(b: Binding) -> DataFrame:
    return stats.quantile_linear(_weighted(b), "x", "pop", [0.25, 0.5, 0.9], "segment")


@query(f"SELECT segment, {r('1 - sum((cw - coalesce(pw, 0)) * (cxw + coalesce(pxw, 0))) AS gini')} FROM lg GROUP BY 1", f"{STEPS}, {_CW}")
def gini(b: Binding) -> DataFrame:
    return stats.gini(_weighted(b), "x", "pop", "segment")


@query(
    f"""SELECT t AS minutes, {r('(SELECT 100 * sum(CASE WHEN band <= t THEN 0 ELSE pop END) / sum(pop) FROM tracts LEFT JOIN near USING (geoid)) AS pct_outside')} FROM (VALUES (30), (60), (120), (180)) v(t)""",
    "near AS (SELECT geoid, min(band) AS band FROM overlap WHERE overlap_fraction > 0 AND coord_id IN (SELECT coord_id FROM supply) GROUP BY 1)",
)
def outside_minutes(b: Binding) -> DataFrame:
    own = b.overlap.join(b.supply.select("coord_id"), "coord_id", "left_semi")
    return robustness.outside(b.tracts, own, list(BAND_WEIGHTS))


_SEAM = STEPS + """, two AS (SELECT a.geoid, a.pop, state, a.m * 1e5 AS x, CASE WHEN k % 9 = 0 THEN a.m * 1e5 * 1.2 ELSE a.m * 1e5 END AS y FROM acc a JOIN tracts USING (geoid)),
dw AS (SELECT round(abs(x - y), 6) AS d, sum(pop) AS w FROM two WHERE pop > 0 GROUP BY 1), dc AS (SELECT d, sum(w) OVER (ORDER BY d) / sum(w) OVER () AS cw FROM dw), dl AS (SELECT *, lag(cw) OVER (ORDER BY d) AS pw, lag(d) OVER (ORDER BY d) AS pd FROM dc)"""


def _seam(b: Binding) -> DataFrame:
    one = _access(b).access.join(b.tracts.select("geoid", "pop", "k", "state"), "geoid")
    a = F.col("access_scaled_math")
    return one.select(F.col("geoid").alias("cell_id"), a.alias("a"), F.when(F.col("k") % 9 == 0, a * 1.2).otherwise(a).alias("b"), "pop", "state")


_SH = "abs(sum(CASE WHEN x >= {k} THEN pop ELSE 0 END) / sum(pop) - sum(CASE WHEN y >= {k} THEN pop ELSE 0 END) / sum(pop))"
_GAP = "greatest(" + ", ".join(_SH.format(k=k) for k in (0, 1, 5, 10, 20, 50)) + ")"
_REL = "abs(sum(x * pop) - sum(y * pop)) / sum(pop) / greatest(sum(x * pop) / sum(pop), 1e-12)"
_OVER = "sum(CASE WHEN x > 0 AND abs(x - y) > {k} * x THEN pop ELSE 0 END) / greatest(sum(CASE WHEN x > 0 THEN pop ELSE 0 END), 1)"


@query(
    f"""SELECT {r('sum(x * pop) / sum(pop) AS mean_first', 'sum(y * pop) / sum(pop) AS mean_second', 'sum(abs(x - y) * pop) / sum(pop) AS pw_mad', 'max(abs(x - y)) AS max_change', 'sum(CASE WHEN x <= 0 THEN pop ELSE 0 END) / sum(pop) AS share_zero_first',
      *[f'{_OVER.format(k=k)} AS share_gt_{round(100 * k)}' for k in (0.01, 0.05, 0.1)], f'{_GAP} AS max_share_gap', f'{_REL} AS mean_rel_diff',
      *[f'(SELECT min(CASE WHEN pw IS NULL AND cw >= {p} THEN d WHEN cw >= {p} AND pw < {p} THEN pd + (d - pd) * ({p} - pw) / (cw - pw) END) FROM dl) AS q{round(100 * p)}' for p in (0.5, 0.75, 0.9, 0.95, 0.99)], digits=4)},
  {_REL} < 0.02 AND {_GAP} < 0.01 AS pass FROM two""",
    _SEAM,
    digits=4,
)
def seam_metrics(b: Binding) -> DataFrame:
    return robustness.seam_metrics(_seam(b).withColumn("b", F.col("b")))


@query(f"SELECT state, {r('sum(pop * abs(x - y)) / sum(pop) AS pw_mad', 'sum(pop) AS pop')} FROM two GROUP BY 1 ORDER BY sum(pop * abs(x - y)) / sum(pop) DESC, state LIMIT 8", _SEAM)
def seam_states(b: Binding) -> DataFrame:
    return robustness.seam_states(_seam(b))


@query(
    f"""SELECT segment, {r(*[f"max(CASE WHEN v = '{v}' THEN {c} END) AS {c}_{v}" for c in ('mean_access', 'pct_zero') for v in ('v2010', 'v2020')], "max(CASE WHEN v = 'v2020' THEN mean_access END) - max(CASE WHEN v = 'v2010' THEN mean_access END) AS seam_mean", "max(CASE WHEN v = 'v2020' THEN pct_zero END) - max(CASE WHEN v = 'v2010' THEN pct_zero END) AS seam_zero")}
  FROM (SELECT segment, v, sum(access * pop * f) / sum(pop * f) AS mean_access, 100 * sum(CASE WHEN access = 0 THEN pop * f ELSE 0 END) / sum(pop * f) AS pct_zero
        FROM kn, LATERAL (SELECT unnest(['v2010', 'v2020']) AS v, unnest([1 + k % 2, 1]) AS f) GROUP BY 1, 2) GROUP BY 1""",
    _ROWS,
)
def vintage_shift(b: Binding) -> DataFrame:
    known = _rows(b).where("access is not null")
    both = known.withColumn("vintage", F.lit("v2010")).withColumn("w", F.col("pop") * (1 + F.col("k") % 2)).unionByName(known.withColumn("vintage", F.lit("v2020")).withColumn("w", F.col("pop")))
    means = both.groupBy("segment", "vintage").agg(stats.weighted_mean_all(F.col("access"), F.col("w")).alias("mean_access"), stats.zero_share(F.col("access"), F.col("w")).alias("pct_zero"))
    return robustness.vintage_shift(means, "segment")


@query(
    """SELECT CASE WHEN i = 1 THEN 'sparse' WHEN i = n THEN 'dense' ELSE 'median' END AS role, specialty, n_origins FROM (
  SELECT specialty, n_origins, row_number() OVER (ORDER BY n_origins, specialty) AS i, count(*) OVER () AS n FROM (SELECT specialty, count(DISTINCT coord_id) AS n_origins FROM panel JOIN cohort USING (npi)
    WHERE match_source IS NOT NULL AND analysis_year = 1996 GROUP BY 1)) WHERE i IN (1, n) OR i = CAST(ceil((n + 1) / 2.0) AS BIGINT)"""
)
def representatives(b: Binding) -> DataFrame:
    return robustness.representatives(supplies.supply_cells(b.panel, b.cohort).where("analysis_year = 1996"))


_SPECS = [("S01", "base", "primary", 0, "frozen", False), ("S02", "sharper", "distance_decay", 1, "frozen", False), ("S03", "slower", "distance_decay", 1, "frozen", False), ("S04", "gaussian", "decay_form", 1, "frozen", False), ("S05", "drop180", "catchment_threshold", 1, "frozen", False), ("S07", "m2sfca", "formulation", 1, "frozen", True), ("S08", "network", "travel_time", 1, "pipeline", False)]
_SENS = _VARIANTS + """, sens AS (SELECT variant, segment AS subspec, sum(a * 1e5 * pop) / sum(pop) AS national, (sum(a * pop) FILTER (rurality = 'Rural') / sum(pop) FILTER (rurality = 'Rural')) / (sum(a * pop) FILTER (rurality = 'Metropolitan') / sum(pop) FILTER (rurality = 'Metropolitan')) AS rural_metro_ratio FROM va GROUP BY 1, 2),
sens3 AS (SELECT *, rural_metro_ratio * 0.9 AS aian_white_ratio FROM sens),
specs AS (SELECT * FROM (VALUES """ + ", ".join(repr(s) for s in _SPECS) + """) s(spec_id, variant, axis, n_changed, status, contrast_only)),
lng AS (SELECT variant, subspec, unnest(['E1', 'E2', 'E3']) AS estimand, unnest([national, rural_metro_ratio, aian_white_ratio]) AS x FROM sens3),
res AS (SELECT s.*, l.subspec, l.estimand, l.x, p.x AS p, NOT (contrast_only AND l.estimand = 'E1') AS comparable FROM specs s LEFT JOIN lng l USING (variant) LEFT JOIN lng p ON p.variant = 'base' AND p.subspec = l.subspec AND p.estimand = l.estimand)"""


def _sens(b: Binding) -> DataFrame:
    rows = _variants(b).join(b.tracts.select("geoid", "rurality", "segment"), "geoid")
    found = _means(rows, "variant", "segment").withColumnRenamed("segment", "subspec")
    return found.select("variant", "subspec", "national", "rural_metro_ratio", (F.col("rural_metro_ratio") * 0.9).alias("aian_white_ratio"))


def _results(b: Binding) -> DataFrame:
    specs = b.spark.createDataFrame(_SPECS, "spec_id string, variant string, axis string, n_changed int, status string, contrast_only boolean")
    return robustness.long_results(_sens(b), specs.withColumn("is_main", F.lit(True)))


@query(
    f"""SELECT spec_id, variant, axis, status, subspec, estimand, {r('p AS primary_value', 'x AS spec_value', '(x - p) / abs(p) AS rel_diff')},
  CASE WHEN status = 'pipeline' THEN 'not_executable' WHEN NOT comparable THEN 'not_comparable_estimand_changed' WHEN variant = 'base' THEN 'primary' WHEN estimand <> 'E1' AND NOT x < 1 THEN 'materially_conclusion_sensitive'
       WHEN estimand = 'E2' AND (p < 0.5) <> (x < 0.5) THEN 'materially_conclusion_sensitive' WHEN abs((x - p) / p) > 0.25 THEN 'quantitatively_sensitive' ELSE 'directionally_invariant' END AS classification FROM res""",
    _SENS,
)
def multiverse_results(b: Binding) -> DataFrame:
    return _results(b).select("spec_id", "variant", "axis", "status", "subspec", "estimand", "primary_value", "spec_value", "rel_diff", "classification")


@query("SELECT variant, bool_or(subspec = 'BUILDING' AND rural_metro_ratio < 0.5) AS c1, bool_and(rural_metro_ratio < 1) AS c2, bool_and(aian_white_ratio < 1) AS c3, bool_and(rural_metro_ratio < 1) AND bool_and(aian_white_ratio < 1) AS c4 FROM sens3 GROUP BY 1", _SENS)
def multiverse_claims(b: Binding) -> DataFrame:
    return robustness.claims(_sens(b), "BUILDING")


@query("SELECT variant, 'c2' AS claim, NOT bool_and(rural_metro_ratio < 1) AS recorded, bool_and(rural_metro_ratio < 1) AS found FROM sens3 WHERE variant = 'slower' GROUP BY 1", _SENS)
def multiverse_verification(b: Binding) -> DataFrame:
    """A record with one flipped claim: the flip is all that is reported."""
    fresh = robustness.claims(_sens(b), "BUILDING")
    flipped = fresh.withColumn("c2", F.when(F.col("variant") == "slower", ~F.col("c2")).otherwise(F.col("c2")))
    return robustness.verify_claims(flipped, fresh)


@query(f"SELECT spec_id, axis, subspec, estimand, {r('p AS primary_value', 'x AS altered', 'x - p AS abs_change', '100 * (x - p) / abs(p) AS pct_change')}, CASE WHEN estimand = 'E1' THEN false ELSE (p < 1) <> (x < 1) END AS direction_changed FROM res WHERE comparable AND n_changed = 1 AND status <> 'pipeline'", _SENS)
def multiverse_leave_one_out(b: Binding) -> DataFrame:
    return robustness.leave_one_out(_results(b))


@query(
    f"""SELECT estimand, subspec, {r('max(p) AS primary_value')}, count(*) AS n_specs, {r('min(x) AS least', 'quantile_cont(x, 0.25) AS p25', 'median(x) AS median', 'quantile_cont(x, 0.75) AS p75', 'max(x) AS greatest', 'avg(x) AS mean', 'stddev_samp(x) AS sd', "avg(CASE WHEN estimand = 'E1' OR x < 1 THEN 1.0 ELSE 0.0 END) AS same_direction")},
  arg_max(variant, round(abs(x - p), 12)) AS farthest FROM res WHERE comparable AND status <> 'pipeline' GROUP BY 1, 2""",
    _SENS,
)
def multiverse_robustness(b: Binding) -> DataFrame:
    return robustness.robustness(_results(b))


@query(f"SELECT variant, {r('sum(a * pop) AS mass', 'min(a) AS least')} FROM va WHERE variant = 'm2sfca' GROUP BY 1", _VARIANTS)
def variant_gates(b: Binding) -> DataFrame:
    """Of the variants, the modified model alone doesn't return the total supply."""
    rows = _variants(b).groupBy("variant").agg(F.sum(F.col("access") * F.col("pop")).alias("mass"), F.min("access").alias("least"))
    served = _access(b).ratios.where("not zero_demand").agg(F.sum("supply")).head()[0]
    return robustness.gates(rows.where("variant in ('base', 'sharper', 'slower', 'm2sfca', 'res500', 'gaussian')"), served)


@query(f"SELECT {r('corr(n1, n2) AS pearson')} FROM (SELECT subspec, max(CASE WHEN variant = 'base' THEN national END) AS n1, max(CASE WHEN variant = 'sharper' THEN national END) AS n2 FROM sens GROUP BY 1)", _SENS)
def variant_correlation(b: Binding) -> DataFrame:
    at = lambda v: F.max(F.when(F.col("variant") == v, F.col("national")))
    return _sens(b).groupBy("subspec").agg(at("base").alias("n1"), at("sharper").alias("n2")).agg(F.corr("n1", "n2").alias("pearson"))


_LEAVES = """summary AS (SELECT specialty, analysis_year AS year, count(*) AS n, CAST(count(*) AS DOUBLE) / 7 AS mean, min(coord_id) AS origin FROM panel JOIN cohort USING (npi) GROUP BY 1, 2),
leaves AS (SELECT specialty, 'years[' || (row_number() OVER (PARTITION BY specialty ORDER BY year) - 1) || ']' AS place, year, n, mean, origin FROM summary WHERE specialty NOT LIKE '%5'),
moved AS (SELECT specialty, place || '.mean' AS path, 'changed' AS kind, mean AS b, mean * 1.5 AS a FROM leaves WHERE specialty LIKE '%3'),
named AS (SELECT specialty, place || '.origin' AS path, 'changed' AS kind, origin AS before, origin || 'x' AS after FROM leaves WHERE specialty LIKE '%4' AND year = 1995)"""


def _record(b: Binding, mean, origin_) -> DataFrame:
    rows = b.panel.join(b.cohort, "npi").where("specialty not like '%5'").groupBy("specialty", F.col("analysis_year").alias("year")).agg(F.count("*").alias("n"), F.min("coord_id").alias("origin"))
    one = F.struct("year", "n", mean(F.col("n") / 7.0).alias("mean"), origin_(F.col("origin")).alias("origin"))
    return rows.groupBy("specialty").agg(F.array_sort(F.collect_list(one)).alias("years"), F.struct(F.sum("n").alias("rows"), F.lit("1.0").alias("version")).alias("context"))


@query("SELECT specialty, path, kind, CAST(b AS VARCHAR) IS NOT NULL AS had FROM moved UNION ALL SELECT specialty, path, kind, true FROM named", _LEAVES)
def moved_results(b: Binding) -> DataFrame:
    """Nested yearly records against a version with other means and names in places; the context isn't compared."""
    moved = _record(b, lambda m: F.when(F.col("specialty").endswith("3"), m * 1.5).otherwise(m + 1e-12), lambda o: F.when(F.col("specialty").endswith("4") & (F.col("year") == 1995), F.concat(o, F.lit("x"))).otherwise(o))
    before = _record(b, lambda m: m, lambda o: o).withColumn("context", F.struct(F.lit(0).cast("long").alias("rows"), F.lit("0.9").alias("version")))
    found = compare.differences(before, moved, ["specialty"], ignore=["context"])
    return found.select("specialty", "path", "kind", F.col("before").isNotNull().alias("had"))


@query(
    f"""SELECT specialty, n_providers, {r('covered_pop', '1e4 * n_providers / nullif(covered_pop, 0) AS per_covered', '1e4 * n_providers / pop AS per_all')} FROM (
  SELECT specialty, sum(pop * greatest(0, least(1, percent / 100))) AS covered_pop, sum(pop) AS pop FROM cover GROUP BY 1) JOIN (SELECT chr(65 + CAST(npi % 3 AS INTEGER)) || chr(65 + CAST(npi % 3 AS INTEGER)) AS specialty, count(*) AS n_providers FROM cohort GROUP BY 1
  UNION ALL SELECT 'DD', 0) USING (specialty)"""
)
def provider_density(b: Binding) -> DataFrame:
    """Of four specialties, of which the last has no provider."""
    names = F.array(F.lit("AA"), F.lit("BB"), F.lit("CC"))
    return coverage.provider_density(b.cover, b.cohort.select("npi", names[(F.col("npi") % 3).cast("int")].alias("specialty")))


@query(
    f"""SELECT stratum_type, stratum, CAST(min(year) AS INTEGER) AS first_year, {r('arg_min(v, year) AS first', 'arg_max(v, year) AS last', 'arg_max(v, year) - arg_min(v, year) AS change')}, CAST(max(year) AS INTEGER) AS last_year FROM (
  SELECT 'band' AS stratum_type, CAST(band AS VARCHAR) AS stratum, year, avg(percent) AS v FROM ser GROUP BY 1, 2, 3 UNION ALL SELECT 'specialty', specialty, year, avg(percent) FROM ser GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    _SERIES,
)
def stratum_endpoints(b: Binding) -> DataFrame:
    by = lambda c: _series(b).groupBy(F.col(c).cast("string").alias("stratum"), "year").agg(F.avg("percent").alias("mean_access"))
    return strata.with_endpoints({"band": by("band"), "specialty": by("specialty")})[1]


@query(
    """SELECT 'two_routes' AS "check", variant, subspec, 'national' AS what FROM sens3 WHERE variant = 'slower' AND subspec < 'C' UNION ALL SELECT 'derived_ratio', variant, subspec, 'rural_metro_ratio' FROM sens3 WHERE variant = 'm2sfca' AND subspec = 'FURNITURE'
  UNION ALL SELECT 'negative', variant, subspec, 'metro' FROM sens3 WHERE variant = 'sharper' AND subspec = 'MACHINERY' UNION ALL SELECT 'derived_ratio', variant, subspec, 'rural_metro_ratio' FROM sens3 WHERE variant = 'sharper' AND subspec = 'MACHINERY'
  UNION ALL SELECT 'not_finite', variant, subspec, 'white' FROM sens3 WHERE variant = 'drop180' AND subspec = 'BUILDING' UNION ALL SELECT 'ragged', 'gaussian', NULL, 'subspec' UNION ALL SELECT 'not_nested', NULL, subspec, '120' FROM (SELECT DISTINCT subspec FROM sens3) WHERE subspec < 'C'""",
    _SENS,
)
def frozen_invariants(b: Binding) -> DataFrame:
    """A result table with one fault of each kind."""
    at = lambda v, s: (F.col("variant") == v) & (F.col("subspec") == s)
    rows = _sens(b).select("variant", "subspec", "national", F.lit(2.0).alias("metro"), (2 * F.col("rural_metro_ratio")).alias("rural"), F.lit(4.0).alias("white"), (4 * F.col("aian_white_ratio")).alias("aian"), "rural_metro_ratio", "aian_white_ratio")
    rows = rows.withColumn("national_check", F.when((F.col("variant") == "slower") & (F.col("subspec") < "C"), F.col("national") * 1.1 + 1).otherwise(F.col("national")))
    rows = rows.withColumn("rural_metro_ratio", F.when(at("m2sfca", "FURNITURE"), F.col("rural_metro_ratio") + 0.1).otherwise(F.col("rural_metro_ratio")))
    rows = rows.withColumn("metro", F.when(at("sharper", "MACHINERY"), -2.0).otherwise(F.col("metro"))).withColumn("white", F.when(at("drop180", "BUILDING"), float("inf")).otherwise(F.col("white")))
    rows = rows.withColumn("aian", F.when(at("drop180", "BUILDING"), 0.0).otherwise(F.col("aian"))).withColumn("aian_white_ratio", F.when(at("drop180", "BUILDING"), 0.0).otherwise(F.col("aian_white_ratio")))
    rows = rows.where(~at("gaussian", "HOUSEHOLD"))
    names = _sens(b).select("subspec").distinct()
    outside = names.select("subspec", F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), F.lit(float(p)).alias("p")) for m, p in ((60, 30), (120, 20), (180, 10))])).alias("x")).select("subspec", "x.minutes", (F.col("x.p") + F.when((F.col("subspec") < "C") & (F.col("x.minutes") == 120), 15).otherwise(0)).alias("pct_outside"))
    return robustness.invariants(rows, outside)
