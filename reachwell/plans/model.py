"""Queries over weights, supply, access, grids, centroids and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachwell.constants import BAND_WEIGHTS, DECAY_SCHEMES
from reachwell.functions import weights as wt
from reachwell.functions.stats import ratio, trend
from reachwell.operators import access, centroid, grid, scenario, supply
from reachwell.plans.binding import Binding
from reachwell.plans.registry import query, r

BANDS = list(BAND_WEIGHTS)


def _by_band(b: Binding) -> DataFrame:
    """Overlaps by band: band, n and the sum of their fractions."""
    return b.overlap.groupBy("band").agg(F.count("*").alias("n"), F.sum("overlap_fraction").alias("area"))


_BAND_SUMS = "bs AS (SELECT CAST(band AS INTEGER) AS band, count(*) AS n, sum(overlap_fraction) AS area FROM overlap GROUP BY 1)"


@query(f"SELECT band, n, w, {r('w1 AS step1', 'w2 AS step2', 'area * w1 AS weighted_area', digits=4)} FROM bs JOIN w USING (band)", _BAND_SUMS, digits=4)
def weights_incremental(b: Binding) -> DataFrame:
    first, second = wt.incremental(BAND_WEIGHTS), wt.incremental(BAND_WEIGHTS, 2)
    of = lambda w: wt.weight_of(F.col("band"), w)
    return _by_band(b).select("band", "n", of(BAND_WEIGHTS).alias("w"), of(first).alias("step1"), of(second).alias("step2"), (F.col("area") * of(first)).alias("weighted_area"))


@query(f"SELECT band, n, {r('exp(-(band * band - 900) / 7200.0) AS w', 'exp(-(band * band) / 7200.0) AS kernel', 'area * exp(-(band * band - 900) / 7200.0) AS weighted_area', digits=4)} FROM bs", _BAND_SUMS, digits=4)
def weights_gaussian(b: Binding) -> DataFrame:
    w = wt.weight_of(F.col("band"), wt.gaussian(BANDS))
    return _by_band(b).select("band", "n", w.alias("w"), wt.gaussian_kernel(F.col("band")).alias("kernel"), (F.col("area") * w).alias("weighted_area"))


_SCHEME_ROWS = ", ".join(f"('{s}', {k}, {v}::DOUBLE)" for s, ws in DECAY_SCHEMES.items() for k, v in ws.items())


@query(f"SELECT scheme, band, w, {r('area * w AS weighted_area', digits=4)} FROM bs JOIN (VALUES {_SCHEME_ROWS}) v(scheme, band, w) USING (band)", _BAND_SUMS, digits=4)
def weights_schemes(b: Binding) -> DataFrame:
    rows = b.spark.createDataFrame([(s, k, v) for s, ws in DECAY_SCHEMES.items() for k, v in ws.items()], "scheme string, band int, w double")
    return _by_band(b).join(F.broadcast(rows), "band").select("scheme", "band", "w", (F.col("area") * F.col("w")).alias("weighted_area"))


@query("SELECT specialty, analysis_year, coord_id, CAST(count(DISTINCT npi) AS DOUBLE) AS supply FROM panel JOIN cohort USING (npi) WHERE match_source IS NOT NULL GROUP BY 1, 2, 3")
def provider_supply_cells(b: Binding) -> DataFrame:
    return supply.supply_cells(b.panel, b.cohort)


@query("""SELECT coord_id, CAST(count(DISTINCT npi) AS DOUBLE) AS supply FROM panel JOIN cohort USING (npi)
  WHERE match_source IS NOT NULL AND specialty = 'Brand#11' AND analysis_year = 1996 GROUP BY 1""")
def provider_supply(b: Binding) -> DataFrame:
    return supply.provider_supply(b.panel, b.cohort, "Brand#11", 1996)


@query("SELECT specialty, analysis_year, count(DISTINCT npi) AS n_providers FROM panel JOIN cohort USING (npi) WHERE match_source IS NOT NULL GROUP BY 1, 2")
def physicians_by_year(b: Binding) -> DataFrame:
    return supply.physicians_by_year(b.panel, b.cohort)


_COUNTS = "counts AS (SELECT specialty, analysis_year, count(DISTINCT npi) AS n FROM panel JOIN cohort USING (npi) WHERE match_source IS NOT NULL GROUP BY 1, 2)"


@query(
    f"""SELECT specialty, max(CASE WHEN analysis_year = 1995 THEN n END) AS n_first, max(CASE WHEN analysis_year = 2000 THEN n END) AS n_last,
  {r("100.0 * (max(CASE WHEN analysis_year = 2000 THEN n END) - max(CASE WHEN analysis_year = 1995 THEN n END)) / nullif(max(CASE WHEN analysis_year = 1995 THEN n END), 0) AS growth_pct")}
  FROM counts GROUP BY 1""",
    _COUNTS,
)
def workforce_growth(b: Binding) -> DataFrame:
    return supply.growth(supply.physicians_by_year(b.panel, b.cohort), "specialty", "analysis_year", "n_providers", 1995, 2000)


@query(
    f"""SELECT specialty, arg_min(n, analysis_year) AS first_value, arg_max(n, analysis_year) AS last_value, min(n) AS least_value,
  arg_min(analysis_year, n * 10000 + analysis_year) AS least_year, arg_max(n, analysis_year) - arg_min(n, analysis_year) AS abs_change,
  {r("(arg_max(n, analysis_year) - arg_min(n, analysis_year)) * 1.0 / arg_min(n, analysis_year) AS rel_change")},
  CASE WHEN arg_max(n, analysis_year) > arg_min(n, analysis_year) THEN 'up' WHEN arg_max(n, analysis_year) < arg_min(n, analysis_year) THEN 'down' ELSE 'flat' END AS direction
  FROM counts GROUP BY 1""",
    _COUNTS,
)
def endpoint_change(b: Binding) -> DataFrame:
    return supply.endpoint_change(supply.physicians_by_year(b.panel, b.cohort), "specialty", "analysis_year", "n_providers")


@query(
    """SELECT specialty, count(*) AS total, count(*) FILTER (y <= 15) AS early, count(*) FILTER (y > 15) AS late, count(*) FILTER (q = 'Metropolitan') AS metro,
  count(*) FILTER (q = 'Rural') AS rural, count(*) FILTER (y <= 15 AND q = 'Metropolitan') AS early_metro, count(*) FILTER (y > 15 AND q = 'Metropolitan') AS late_metro,
  count(*) FILTER (y <= 15 AND q = 'Rural') AS early_rural, count(*) FILTER (y > 15 AND q = 'Rural') AS late_rural, """
    + r("median(y) AS median_years", "100.0 * count(*) FILTER (y <= 15) / count(*) AS pct_early", "100.0 * count(*) FILTER (q = 'Rural') / count(*) AS pct_rural")
    + " FROM (SELECT p_brand AS specialty, p_size AS y, CASE WHEN 1 + p_partkey % 12 <= 3 THEN 'Metropolitan' WHEN 1 + p_partkey % 12 <= 10 THEN 'Rural' END AS q FROM part) GROUP BY 1"
)
def workforce_table(b: Binding) -> DataFrame:
    from reachwell.functions.scalars import career_stage, rurality

    rows = b.raw("part").select(F.col("p_brand").alias("specialty"), F.col("p_size").alias("years"), career_stage(F.col("p_size")).alias("stage"), rurality(1 + F.col("p_partkey") % 12).alias("rurality"))
    return supply.workforce_table(rows)


@query("""SELECT coalesce(s.coord_id, m.coord_id) AS coord_id, coalesce(supply, 0.0) + coalesce(n, 0.0) AS supply FROM supply s
  FULL JOIN (SELECT coord_id, CAST(count(*) AS DOUBLE) AS n FROM panel WHERE match_source IS NULL GROUP BY 1) m ON s.coord_id = m.coord_id""")
def supply_augmented(b: Binding) -> DataFrame:
    return supply.augmented(b.supply, b.panel.where("match_source is null").select("coord_id", F.lit(1).alias("n")))


@query(
    """SELECT f.specialty, active, geocoded, coalesce(mapped, 0) AS mapped, coalesce(recovered, 0) AS recovered,
  geocoded + coalesce(recovered, 0) AS geocoded_recovered, active - geocoded - coalesce(recovered, 0) AS ungeocoded_after
  FROM (SELECT specialty, count(*) AS active, count(*) FILTER (npi % 3 <> 0) AS geocoded FROM cohort GROUP BY 1) f
  LEFT JOIN (SELECT specialty, count(*) AS mapped, count(*) FILTER (o = 1) AS recovered
             FROM (SELECT npi, specialty, min(o) AS o FROM (SELECT npi, specialty, 0 AS o FROM cohort WHERE npi % 3 <> 0 UNION ALL SELECT npi, specialty, 1 FROM cohort WHERE npi % 2 = 0) GROUP BY 1, 2)
             GROUP BY 1) c USING (specialty)"""
)
def workforce_recovery(b: Binding) -> DataFrame:
    c = b.cohort
    flow = c.groupBy("specialty").agg(F.count("*").alias("active"), F.count_if(F.col("npi") % 3 != 0).alias("geocoded"))
    return supply.recovered_flow(flow, c.where("npi % 3 <> 0"), c.where("npi % 2 = 0"))


@query(
    """SELECT g AS specialty, """
    + r("sum(a * pop) / sum(pop) AS mean_per_100k", "sum(pop) AS pop")
    + """, CAST(round_even(sum(a * pop) / sum(pop) * sum(pop) / 100000, 0) AS BIGINT) AS n_derived FROM (SELECT segment AS g, k % 50 AS a, pop FROM tracts) GROUP BY 1"""
)
def workforce_derived(b: Binding) -> DataFrame:
    a = F.col("k") % 50
    return supply.derived_workforce(b.tracts.groupBy(F.col("segment").alias("specialty")).agg(ratio(F.sum(a * F.col("pop")), F.sum("pop")).alias("mean_per_100k"), F.sum("pop").alias("pop")))


_PLACES = """places AS (
  SELECT o_custkey AS npi, CAST(year(o_orderdate) AS INTEGER) AS year, lpad(CAST(l_suppkey % 97 AS VARCHAR), 5, '1') AS p, CASE WHEN l_linenumber > 5 THEN NULL ELSE lpad(CAST(l_partkey % 113 AS VARCHAR), 5, '1') END AS s,
         CASE WHEN l_suppkey % 11 = 0 THEN 'AK' WHEN l_suppkey % 13 = 0 THEN NULL ELSE 'CO' END AS state
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
own AS (SELECT * FROM places WHERE coalesce(state, '') <> 'AK'),
sec AS (SELECT * FROM own WHERE s IS NOT NULL AND s <> p),
fresh AS (SELECT * FROM sec WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.year = sec.year AND o.p = sec.s))"""


@query(
    """SELECT year, total, coalesce(with_satellite, 0) AS with_satellite, coalesce(new_zips, 0) AS new_zips, coalesce(docs_in_new, 0) AS docs_in_new,
  """
    + r("round_even(100.0 * coalesce(with_satellite, 0) / total, 1) AS pct_satellite")
    + """ FROM (SELECT year, count(DISTINCT npi) AS total FROM own GROUP BY 1)
  LEFT JOIN (SELECT year, count(DISTINCT npi) AS with_satellite FROM sec GROUP BY 1) USING (year)
  LEFT JOIN (SELECT year, count(DISTINCT s) AS new_zips, count(DISTINCT npi) AS docs_in_new FROM fresh GROUP BY 1) USING (year)""",
    _PLACES,
)
def satellite_sensitivity(b: Binding) -> DataFrame:
    state = F.when(F.col("l_suppkey") % 11 == 0, "AK").when(F.col("l_suppkey") % 13 != 0, "CO")
    rows = b.lines.select(
        F.col("o_custkey").alias("npi"), F.year("o_orderdate").alias("year"), F.lpad((F.col("l_suppkey") % 97).cast("string"), 5, "1").alias("primary_zip"),
        F.when(F.col("l_linenumber") <= 5, F.lpad((F.col("l_partkey") % 113).cast("string"), 5, "1")).alias("secondary_zip"), state.alias("primary_state"), state.alias("secondary_state"),
    )
    return supply.satellite_sensitivity(rows, "year")


# Access

_STEPS = """base AS (SELECT o.coord_id, o.band, o.geoid, overlap_fraction AS f, w1, {w2} AS wa, pop FROM overlap o JOIN supply USING (coord_id) JOIN w USING (band) JOIN tracts USING (geoid)),
dem AS (SELECT s.coord_id, supply, coalesce(d, 0.0) AS d FROM supply s LEFT JOIN (SELECT coord_id, sum(w1 * f * pop) AS d FROM base GROUP BY 1) USING (coord_id)),
rat AS (SELECT *, CASE WHEN d > 0 THEN supply / d END AS ratio, CASE WHEN d > 0 THEN supply / d ELSE 0.0 END AS rs FROM dem),
acc AS (SELECT t.geoid, t.pop, coalesce(a, 0.0) AS m, coalesce(n, 0) AS n, coalesce(reached, false) AS reached FROM tracts t LEFT JOIN (
  SELECT geoid, sum(wa * f * rs) AS a, count(DISTINCT CASE WHEN rs > 0 THEN coord_id END) AS n, bool_or(f > 0) AS reached FROM base JOIN rat USING (coord_id) GROUP BY 1) USING (geoid))"""
STEPS, STEPS2 = _STEPS.format(w2="w1"), _STEPS.format(w2="w2")
_ACCESS = f"""SELECT geoid, {r('CASE WHEN reached THEN m END AS access', 'CASE WHEN reached THEN m * 100000 END AS access_scaled')}, n AS n_providers,
  {r('m AS access_math', 'm * 100000 AS access_scaled_math')}, reached,
  CASE WHEN reached THEN 'within_modeled_catchment' ELSE 'outside_all_modeled_catchments' END AS coverage_status FROM acc"""


def _access(b: Binding, power: float = 1.0) -> access.Access:
    return access.e2sfca(b.overlap, b.tracts, b.supply, power=power)


@query(_ACCESS, STEPS)
def e2sfca_access(b: Binding) -> DataFrame:
    return _access(b).access


@query(_ACCESS, STEPS2)
def m2sfca_access(b: Binding) -> DataFrame:
    return _access(b, 2.0).access


@query(f"SELECT coord_id, supply, {r('d AS weighted_demand', 'ratio', 'rs AS ratio_for_surface')}, d <= 0 AS zero_demand, CASE WHEN d > 0 THEN 0.0 ELSE supply END AS excluded_supply FROM rat", STEPS)
def provider_ratios(b: Binding) -> DataFrame:
    return _access(b).ratios


@query(
    f"""SELECT (SELECT count(*) FROM rat WHERE d <= 0) AS n_zero_demand_origins, {r("(SELECT coalesce(sum(supply), 0.0) FROM rat WHERE d <= 0) AS supply_zero_demand",
      "(SELECT coalesce(sum(CASE WHEN d <= 0 THEN supply END), 0) / sum(supply) FROM rat) AS share_supply_zero_demand")},
  (SELECT count(DISTINCT coord_id) FROM overlap WHERE coord_id NOT IN (SELECT coord_id FROM supply)) AS n_coords_without_supply,
  (SELECT count(*) FROM overlap WHERE coord_id NOT IN (SELECT coord_id FROM supply)) AS n_rows_without_supply, CAST(0 AS BIGINT) AS n_rows_outside_bands,
  (SELECT count(*) FROM acc) AS n_tracts, (SELECT count(*) FROM acc WHERE NOT reached) AS n_outside, (SELECT count(*) FROM acc WHERE reached) AS n_within,
  (SELECT count(*) FROM acc WHERE reached AND m = 0) AS n_reached_scoring_zero, [] :: INTEGER[] AS bands_outside,
  (SELECT coalesce(list(coord_id ORDER BY coord_id), []) FROM (SELECT coord_id FROM rat WHERE d <= 0 ORDER BY 1 LIMIT 20)) AS zero_demand_coord_ids,
  (SELECT coalesce(list(coord_id ORDER BY coord_id), []) FROM (SELECT DISTINCT coord_id FROM overlap WHERE coord_id NOT IN (SELECT coord_id FROM supply) ORDER BY 1 LIMIT 20)) AS coord_ids_without_supply""",
    STEPS,
)
def e2sfca_audit(b: Binding) -> DataFrame:
    return _access(b).audit


_SPAR = STEPS + ", mean AS (SELECT sum(m * 100000 * pop) / sum(pop) AS mean FROM acc), sp AS (SELECT geoid, pop, m * 100000 AS a, CASE WHEN mean > 0 THEN m * 100000 / mean ELSE 0.0 END AS spar FROM acc, mean)"


@query(f"SELECT geoid, {r('pop', 'a AS access', 'spar')} FROM sp", _SPAR)
def relative_access(b: Binding) -> DataFrame:
    return access.relative_access(_access(b).access, b.tracts)


@query(
    f"""SELECT {r('sum(a * pop) / sum(pop) AS mean_access_per100k', 'sum(spar * pop) / sum(pop) AS spar_national_mean', 'sum(CASE WHEN spar < 0.5 THEN pop ELSE 0 END) / sum(pop) AS low_access_pop_share',
      'sum(CASE WHEN a <= 0 THEN pop ELSE 0 END) / sum(pop) AS zero_access_pop_share')}, count(*) FILTER (a > 0) AS n_reached_tracts FROM sp""",
    _SPAR,
)
def spar_summary(b: Binding) -> DataFrame:
    return access.spar_summary(_access(b).access, b.tracts)


_VARIANTS = """vw AS (SELECT v AS variant, band, ww, ww - coalesce(lead(ww) OVER p, 0.0) AS s1, pow(ww, pw) - coalesce(lead(pow(ww, pw)) OVER p, 0.0) AS s2 FROM (VALUES
    ('base', 30, 1.0, 1), ('base', 60, 0.68, 1), ('base', 120, 0.22, 1), ('base', 180, 0.09, 1), ('res500', 30, 1.0, 1), ('res500', 60, 0.68, 1), ('res500', 120, 0.22, 1), ('res500', 180, 0.09, 1),
    ('sharper', 30, 1.0, 1), ('sharper', 60, 0.42, 1), ('sharper', 120, 0.09, 1), ('sharper', 180, 0.02, 1), ('slower', 30, 1.0, 1), ('slower', 60, 0.85, 1), ('slower', 120, 0.55, 1), ('slower', 180, 0.3, 1),
    ('drop180', 30, 1.0, 1), ('drop180', 60, 0.68, 1), ('drop180', 120, 0.22, 1), ('m2sfca', 30, 1.0, 2), ('m2sfca', 60, 0.68, 2), ('m2sfca', 120, 0.22, 2), ('m2sfca', 180, 0.09, 2),
    ('gaussian', 30, 1.0, 1), ('gaussian', 60, exp(-2700 / 7200.0), 1), ('gaussian', 120, exp(-13500 / 7200.0), 1), ('gaussian', 180, exp(-31500 / 7200.0), 1)) t(v, band, ww, pw) WINDOW p AS (PARTITION BY v ORDER BY band)),
vb AS (SELECT variant, o.coord_id, o.geoid, overlap_fraction AS f, s1, s2, pop, supply FROM overlap o JOIN supply USING (coord_id) JOIN vw USING (band) JOIN tracts USING (geoid)),
vr AS (SELECT variant, coord_id, CASE WHEN sum(s1 * f * pop) > 0 THEN max(supply) / sum(s1 * f * pop) ELSE 0 END AS r FROM vb GROUP BY 1, 2),
va AS (SELECT v.variant, t.geoid, t.pop, t.rurality, t.segment, coalesce(a, 0) AS a FROM tracts t CROSS JOIN (SELECT DISTINCT variant FROM vw) v
  LEFT JOIN (SELECT variant, geoid, sum(s2 * f * r) AS a FROM vb JOIN vr USING (variant, coord_id) GROUP BY 1, 2) USING (variant, geoid))"""


def _variants(b: Binding) -> DataFrame:
    return access.variant_access(b.overlap, b.tracts, b.supply, wt.variant_table(b.spark))


def _means(rows: DataFrame, *keys: str) -> DataFrame:
    a, p = F.col("access") * 1e5, F.col("pop")
    over = lambda c: ratio(F.sum(F.when(c, a * p)), F.sum(F.when(c, p)))
    found = rows.groupBy(*keys).agg(over(F.lit(True)).alias("national"), over(F.col("rurality") == "Metropolitan").alias("metro"), over(F.col("rurality") == "Rural").alias("rural"))
    return found.withColumn("rural_metro_ratio", ratio(F.col("rural"), F.col("metro")))


_VMEANS = "sum(a * 1e5 * pop) FILTER ({c}) / sum(pop) FILTER ({c})"
_NAT, _MET, _RUR = (_VMEANS.format(c=c) for c in ("true", "rurality = 'Metropolitan'", "rurality = 'Rural'"))


@query(f"SELECT variant, {r(f'{_NAT} AS national', f'{_MET} AS metro', f'{_RUR} AS rural', f'({_RUR}) / ({_MET}) AS rural_metro_ratio')} FROM va GROUP BY 1", _VARIANTS)
def sensitivity_variants(b: Binding) -> DataFrame:
    return _means(_variants(b).join(b.tracts.select("geoid", "rurality"), "geoid"), "variant")


# Grids

_CELLS = "whole AS (SELECT geoid, sum(area) AS whole FROM bridge GROUP BY 1), cells AS (SELECT cell_id, sum(pop * area / whole) AS pop FROM bridge JOIN tracts USING (geoid) JOIN whole USING (geoid) GROUP BY 1)"


def _cells(b: Binding) -> DataFrame:
    return grid.allocate_by_area(b.tracts, b.bridge)


@query(f"SELECT cell_id, {r('pop')} FROM cells", _CELLS)
def grid_allocation(b: Binding) -> DataFrame:
    return _cells(b)


@query(f"SELECT cell_id, {r('sum(pop / n) AS pop')} FROM bridge JOIN tracts USING (geoid) JOIN (SELECT geoid, count(*) AS n FROM bridge GROUP BY 1) USING (geoid) GROUP BY 1")
def grid_allocation_centers(b: Binding) -> DataFrame:
    return grid.allocate_by_center(b.tracts.select("geoid", "pop"), b.bridge.select("geoid", "cell_id"))


_ZONES = _CELLS + """, zones AS (SELECT coord_id, band, cell_id, max(overlap_fraction) AS fraction FROM overlap JOIN bridge USING (geoid) WHERE overlap_fraction > 0 GROUP BY 1, 2, 3),
zs AS (SELECT coord_id, band, sum(pop * fraction) AS pop FROM zones JOIN cells USING (cell_id) GROUP BY 1, 2),
zr AS (SELECT coord_id, max(supply) / sum(w1 * pop) AS ratio FROM zs JOIN w USING (band) JOIN supply USING (coord_id) GROUP BY 1 HAVING sum(w1 * pop) > 0),
surf AS (SELECT c.cell_id, c.pop, coalesce(a, 0) AS a FROM cells c LEFT JOIN (SELECT cell_id, sum(w1 * ratio) AS a FROM zones JOIN zr USING (coord_id) JOIN w USING (band) GROUP BY 1) USING (cell_id))"""


def _zones(b: Binding) -> DataFrame:
    return b.overlap.where("overlap_fraction > 0").join(b.bridge.select("geoid", "cell_id"), "geoid").groupBy("coord_id", "band", "cell_id").agg(F.max("overlap_fraction").alias("fraction"))


def _surface(b: Binding) -> DataFrame:
    cells, zones = _cells(b), _zones(b)
    w1 = wt.incremental(BAND_WEIGHTS)
    demand = grid.zonal_sum(cells, zones).withColumn("wp", wt.weight_of(F.col("band"), w1) * F.col("pop")).groupBy("coord_id").agg(F.sum("wp").alias("d")).where("d > 0")
    ratios = b.supply.join(demand, "coord_id").select("coord_id", (F.col("supply") / F.col("d")).alias("ratio"))
    return grid.surface(cells, zones.select("coord_id", "band", "cell_id"), ratios, b.spark.createDataFrame(list(w1.items()), "band int, w double"))


@query(f"SELECT coord_id, band, {r('pop')} FROM zs", _ZONES)
def zonal_population(b: Binding) -> DataFrame:
    return grid.zonal_sum(_cells(b), _zones(b))


@query(f"SELECT cell_id, {r('pop', 'a * 100000 AS access')} FROM surf", _ZONES)
def access_surface(b: Binding) -> DataFrame:
    return _surface(b).withColumn("access", F.col("access") * 1e5)


@query(f"SELECT geoid, {r('1e5 * sum(a * area) / sum(area) AS mean', '1e5 * sum(a * area * pop) / nullif(sum(area * pop), 0) AS weighted_mean')} FROM bridge JOIN surf USING (cell_id) GROUP BY 1", _ZONES)
def zonal_means(b: Binding) -> DataFrame:
    return grid.zonal_means(_surface(b), b.bridge).select("geoid", (F.col("mean") * 1e5).alias("mean"), (F.col("weighted_mean") * 1e5).alias("weighted_mean"))


@query(
    f"""SELECT (SELECT count(*) FROM surf) AS n_cells_total, (SELECT count(*) FROM surf) AS n_cells_valid, {r('(SELECT sum(pop) FROM surf) AS pop_raster_total', '(SELECT sum(pop) FROM surf) AS pop_valid_total')},
  CAST(0 AS DOUBLE) AS pop_excluded_missing_access, {r('(SELECT sum(pop * a * 1e5) / sum(pop) FROM surf) AS mean_scaled')}, t AS threshold, {r('pop_ge', 'pop_ge / (SELECT sum(pop) FROM surf) AS share_pop')}
  FROM (SELECT t, (SELECT coalesce(sum(CASE WHEN a * 1e5 >= t THEN pop ELSE 0 END), 0) FROM surf) AS pop_ge FROM (VALUES (0.0::DOUBLE), (1.0), (5.0), (10.0), (20.0), (50.0)) v(t))""",
    _ZONES,
)
def cell_summaries(b: Binding) -> DataFrame:
    return grid.cell_summaries(_surface(b))


@query(
    f"""SELECT {r('sum(pop) AS eligible_population', 'sum(CASE WHEN pop > 0 AND cell_id % 97 <> 0 THEN pop ELSE 0 END) AS evaluable_population',
      'sum(CASE WHEN pop > 0 AND cell_id % 97 <> 0 AND a <= 0 THEN pop ELSE 0 END) AS zero_access_population')}, CAST(0 AS DOUBLE) AS excluded_population, CAST(0 AS BIGINT) AS n_excluded,
  {r('sum(CASE WHEN pop > 0 AND cell_id % 97 = 0 THEN pop ELSE 0 END) AS unresolved_population', '100 * sum(CASE WHEN pop > 0 AND cell_id % 97 <> 0 THEN pop ELSE 0 END) / sum(pop) AS pct_evaluable',
      'CASE WHEN sum(CASE WHEN pop > 0 AND cell_id % 97 = 0 THEN pop ELSE 0 END) <= 0 THEN 100 * sum(CASE WHEN pop > 0 AND cell_id % 97 <> 0 AND a <= 0 THEN pop ELSE 0 END) / sum(CASE WHEN pop > 0 AND cell_id % 97 <> 0 THEN pop ELSE 0 END) END AS zero_share')} FROM surf""",
    _ZONES,
)
def zero_access_audit(b: Binding) -> DataFrame:
    return grid.zero_access_audit(_surface(b).withColumn("access", F.when(F.col("cell_id") % 97 != 0, F.col("access"))))


@query(f"SELECT geoid, {r('sum(CASE WHEN coalesce(a, 0) <= 0 THEN area ELSE 0 END) / sum(area) AS fraction')} FROM bridge LEFT JOIN surf USING (cell_id) GROUP BY 1", _ZONES)
def zero_area_fraction(b: Binding) -> DataFrame:
    return grid.zero_area_fraction(_surface(b), b.bridge)


@query(f"SELECT {r('1e5 * sum(a * pop) / sum(pop) AS everyone', '1e5 * sum(a * pop * (cell_id % 5)) / sum(pop * (cell_id % 5)) AS some')} FROM surf", _ZONES)
def subgroup_means(b: Binding) -> DataFrame:
    rows = _surface(b).select((F.col("access") * 1e5).alias("access"), F.col("pop").alias("everyone"), (F.col("pop") * (F.col("cell_id") % 5)).alias("some"))
    return grid.subgroup_means(rows, ["everyone", "some"])


@query("SELECT cell_id, arg_min(state, -area * 100 + CAST(state AS INTEGER)) AS region FROM (SELECT cell_id, state, sum(area) AS area FROM bridge JOIN tracts USING (geoid) GROUP BY 1, 2) GROUP BY 1")
def dominating_state(b: Binding) -> DataFrame:
    return grid.dominating(b.bridge.withColumn("state", F.substring("geoid", 1, 2)), "state")


@query(
    """SELECT geoid, cell_x, cell_y FROM (SELECT geoid, k % 40 * 1.0 AS x0, k % 40 + 1 + k % 5 * 0.6 AS x1, k // 40 * 1.0 AS y0, k // 40 + 1 + k % 3 * 0.7 AS y1 FROM tracts) t,
  LATERAL (SELECT unnest(range(CAST(ceil(x0 / 0.5 - 0.5) AS BIGINT), CAST(ceil(x1 / 0.5 - 0.5) AS BIGINT))) AS cell_x) a, LATERAL (SELECT unnest(range(CAST(ceil(y0 / 0.5 - 0.5) AS BIGINT), CAST(ceil(y1 / 0.5 - 0.5) AS BIGINT))) AS cell_y) c"""
)
def grid_cells(b: Binding) -> DataFrame:
    k = F.col("k")
    low = F.floor(k / 40).cast("double")
    boxes = b.tracts.select("geoid", (k % 40).cast("double").alias("x0"), (k % 40 + 1 + k % 5 * 0.6).alias("x1"), low.alias("y0"), (low + 1 + k % 3 * 0.7).alias("y1"))
    return grid.cells_of(boxes, 0.5)


# Centroids

_MEMBER = """pairs AS (SELECT coord_id, geoid, sum(w1 * pop) AS wd, max(w) AS wm FROM membership JOIN w USING (band) JOIN tracts USING (geoid) GROUP BY 1, 2),
ori AS (SELECT coord_id, supply, d, supply / greatest(d, 2.220446049250313e-16) AS rr FROM supply JOIN (SELECT coord_id, sum(wd) AS d FROM pairs GROUP BY 1) USING (coord_id)),
cen AS (SELECT geoid, sum(wm * rr) AS a, bool_or(d <= 0) AS zero_demand FROM pairs JOIN ori USING (coord_id) GROUP BY 1)"""


@query(f"SELECT geoid, {r('CASE WHEN zero_demand THEN -1 ELSE a * 100000 END AS access')}, zero_demand FROM cen", _MEMBER)
def centroid_access(b: Binding) -> DataFrame:
    found = centroid.tract_access(b.membership, b.supply, b.demand)
    return found.withColumn("access", F.when(F.col("zero_demand"), -1.0).otherwise(F.col("access") * 1e5))


@query(f"SELECT {r('100 * sum(CASE WHEN coalesce(a, 0) <= 0 THEN pop ELSE 0 END) / sum(pop) AS no_access_share')} FROM tracts LEFT JOIN cen USING (geoid)", _MEMBER)
def centroid_no_access(b: Binding) -> DataFrame:
    return centroid.no_access_share(centroid.tract_access(b.membership, b.supply, b.demand), b.demand)


_QUINT = _MEMBER + """, qa AS (SELECT geoid, pop, segment, CASE WHEN coalesce(zero_demand, true) THEN 0 ELSE round(a * 1e5, 9) END AS a FROM tracts LEFT JOIN cen USING (geoid)),
cuts AS (SELECT quantile_cont(a, [0.25, 0.5, 0.75]) AS c FROM qa WHERE a > 0),
qq AS (SELECT geoid, pop, segment, CASE WHEN a <= 0 THEN 1 WHEN a <= c[1] THEN 2 WHEN a <= c[2] THEN 3 WHEN a <= c[3] THEN 4 ELSE 5 END AS quintile FROM qa, cuts)"""


def _quintiles(b: Binding) -> DataFrame:
    found = centroid.tract_access(b.membership, b.supply, b.demand).where("not zero_demand").select("geoid", F.round(F.col("access") * 1e5, 9).alias("access"))
    return centroid.quintiles(b.tracts.join(found, "geoid", "left").fillna(0.0, ["access"]))


@query("SELECT geoid, quintile FROM qq", _QUINT)
def access_quintiles(b: Binding) -> DataFrame:
    return _quintiles(b).select("geoid", "quintile")


@query(
    f"""SELECT g AS "group", q AS quintile, {r('coalesce(n, 0) AS n', 'coalesce(100 * n / sum(n) OVER (PARTITION BY g), 0) AS pct')}
  FROM (VALUES ('old'), ('young')) a(g) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) b(q)
  LEFT JOIN (SELECT 'old' AS g, quintile AS q, sum(pop * 0.4) AS n FROM qq GROUP BY 2 UNION ALL SELECT 'young', quintile, sum(CASE WHEN segment = 'BUILDING' THEN pop ELSE 0 END) FROM qq GROUP BY 2) USING (g, q)""",
    _QUINT,
)
def groups_by_quintile(b: Binding) -> DataFrame:
    rows = _quintiles(b).withColumn("old", F.col("pop") * 0.4).withColumn("young", F.when(F.col("segment") == "BUILDING", F.col("pop")).otherwise(0.0))
    return centroid.groups_by_quintile(rows, ["old", "young"])


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS denominator, {r("sum(a * d) / sum(d) * 1e5 AS mean", "(sum(a * d) FILTER (rurality = 'Metropolitan') / sum(d) FILTER (rurality = 'Metropolitan')) / greatest(sum(a * d) FILTER (rurality = 'Rural') / sum(d) FILTER (rurality = 'Rural'), 2.220446049250313e-16) AS metro_rural_ratio")}
  FROM (SELECT t.geoid, rurality, {e} AS d, coalesce(a, 0) AS a FROM tracts t LEFT JOIN (
    SELECT geoid, sum(wm * supply / greatest(d, 2.220446049250313e-16)) AS a FROM (SELECT coord_id, geoid, max(w) AS wm FROM membership JOIN w USING (band) GROUP BY 1, 2) JOIN supply USING (coord_id)
    JOIN (SELECT coord_id, sum(w1 * {e}) AS d FROM membership JOIN w USING (band) JOIN tracts USING (geoid) GROUP BY 1) USING (coord_id) GROUP BY 1) USING (geoid)) WHERE d > 0"""
        for n, e in (("all", "pop"), ("part", "pop * (1 + k % 3)"))
    )
)
def centroid_denominators(b: Binding) -> DataFrame:
    demands = b.tracts.select("geoid", "rurality", F.col("pop").alias("all"), (F.col("pop") * (1 + F.col("k") % 3)).alias("part"))
    found = centroid.denominators(b.membership, b.supply, demands, ["all", "part"])
    return found.withColumn("mean", F.col("mean") * 1e5)


_DECAY = " UNION ALL ".join(
    f"""SELECT '{name}' AS scheme, {r("100 * sum(CASE WHEN coalesce(a, 0) <= 0 THEN pop ELSE 0 END) / sum(pop) AS no_access_share", "1e5 * sum(CASE WHEN zd THEN 0 ELSE coalesce(a, 0) END * pop) / sum(pop) AS mean")}
  FROM tracts LEFT JOIN (SELECT geoid, sum(wm * supply / greatest(d, 2.220446049250313e-16)) AS a, bool_or(d <= 0) AS zd
    FROM (SELECT coord_id, geoid, max(CASE band {" ".join(f"WHEN {k} THEN {v}" for k, v in ws.items())} END) AS wm FROM membership GROUP BY 1, 2) JOIN supply USING (coord_id)
    JOIN (SELECT coord_id, sum(CASE band {" ".join(f"WHEN {k} THEN {v!r}" for k, v in wt.incremental(ws).items())} END * pop) AS d FROM membership JOIN tracts USING (geoid) GROUP BY 1) USING (coord_id) GROUP BY 1) USING (geoid)"""
    for name, ws in DECAY_SCHEMES.items()
)


@query(_DECAY)
def decay_sensitivity(b: Binding) -> DataFrame:
    out = None
    for name, ws in DECAY_SCHEMES.items():
        found = centroid.tract_access(b.membership, b.supply, b.demand, ws, check=False)
        share = centroid.no_access_share(found, b.demand, check=False)
        rows = b.tracts.join(found.where("not zero_demand"), "geoid", "left").fillna(0.0, ["access"])
        mean = rows.agg((1e5 * ratio(F.sum(F.col("access") * F.col("pop")), F.sum("pop"))).alias("mean"))
        one = share.crossJoin(mean).select(F.lit(name).alias("scheme"), "no_access_share", "mean")
        out = one if out is None else out.unionByName(one)
    return out


# Scenarios

_PROJ = """proj AS (SELECT s AS scenario_id, y AS year, 'national' AS geography_type, round((SELECT sum(supply) FROM supply) * m * (1 + (y - 2025) * g), 2) AS supply_headcount
  FROM (VALUES ('baseline', 1.0, 0.0), ('growth', 1.0, 0.05), ('loss', 0.8, -0.02)) a(s, m, g), (VALUES (2025), (2030)) b(y)),
sw AS (SELECT state, sum(pop) AS weight FROM tracts GROUP BY 1),
sh AS (SELECT scenario_id, year, state, round_even(supply_headcount, 0) AS n, round_even(supply_headcount, 0) * weight / (SELECT sum(weight) FROM sw) AS share FROM proj, sw),
st AS (SELECT scenario_id, year, state, floor(share) + CASE WHEN row_number() OVER (PARTITION BY scenario_id, year ORDER BY round(share - floor(share), 9) DESC, state) <= n - sum(floor(share)) OVER (PARTITION BY scenario_id, year) THEN 1 ELSE 0 END AS supply FROM sh),
os AS (SELECT scenario_id, year, coord_id, state, s.supply * st.supply / sum(s.supply) OVER (PARTITION BY scenario_id, year, state) AS supply FROM supply s JOIN st USING (state)),
sd AS (SELECT coord_id, sum(w1 * overlap_fraction * pop) AS d FROM overlap JOIN tracts USING (geoid) JOIN w USING (band) GROUP BY 1 HAVING sum(w1 * overlap_fraction * pop) > 0),
sa AS (SELECT scenario_id, year, geoid, sum(w1 * overlap_fraction * os.supply / d) AS a FROM overlap JOIN w USING (band) JOIN sd USING (coord_id) JOIN os USING (coord_id) WHERE os.supply > 0 GROUP BY 1, 2, 3),
cube AS (SELECT scenario_id, year, 1e5 * sum(a * pop) / (SELECT sum(pop) FROM tracts) AS mean, 1 - sum(CASE WHEN a > 0 THEN pop ELSE 0 END) / (SELECT sum(pop) FROM tracts) AS zero, count(*) FILTER (a > 0) AS n FROM sa JOIN tracts USING (geoid) GROUP BY 1, 2)"""


def _projection(b: Binding) -> DataFrame:
    total = b.supply.agg(F.sum("supply").alias("total"))
    rows = b.spark.createDataFrame([(s, y, m, g) for s, m, g in (("baseline", 1.0, 0.0), ("growth", 1.0, 0.05), ("loss", 0.8, -0.02)) for y in (2025, 2030)], "scenario_id string, year int, m double, g double")
    return rows.crossJoin(F.broadcast(total)).select("scenario_id", "year", F.lit("national").alias("geography_type"), F.round(F.col("total") * F.col("m") * (1 + (F.col("year") - 2025) * F.col("g")), 2).alias("supply_headcount"))


def _states(b: Binding) -> DataFrame:
    return scenario.state_supply(scenario.national_supply(_projection(b)), b.tracts.groupBy("state").agg(F.sum("pop").alias("weight")))


@query("SELECT scenario_id, year, state, CAST(supply AS DOUBLE) AS supply FROM st", _PROJ)
def scenario_states(b: Binding) -> DataFrame:
    return _states(b)


@query(f"SELECT scenario_id, year, coord_id, state, {r('supply')} FROM os WHERE supply > 0", _PROJ)
def scenario_origins(b: Binding) -> DataFrame:
    return scenario.origin_supply(_states(b), b.supply)[0]


def _cube(b: Binding) -> DataFrame:
    return scenario.scenario_access(b.overlap, b.tracts, scenario.origin_supply(_states(b), b.supply)[0])


@query(f"SELECT scenario_id, year, {r('mean AS mean_access_per100k', 'zero AS zero_access_pop_share')}, n AS n_reached_tracts FROM cube", _PROJ)
def scenario_access(b: Binding) -> DataFrame:
    return _cube(b)


@query(f"SELECT scenario_id, year, {r('mean AS mean_access_per100k', 'mean - max(CASE WHEN scenario_id = ' + chr(39) + 'baseline' + chr(39) + ' THEN mean END) OVER (PARTITION BY year) AS change')} FROM cube", _PROJ)
def scenario_change(b: Binding) -> DataFrame:
    return scenario.change_from_baseline(_cube(b), "mean_access_per100k", "year").select("scenario_id", "year", "mean_access_per100k", "change")


@query(f"SELECT specialty, count(*) AS n, {r('regr_slope(n, analysis_year) AS slope', 'regr_r2(n, analysis_year) AS r2')} FROM counts GROUP BY 1", _COUNTS)
def annual_trend(b: Binding) -> DataFrame:
    return trend(supply.physicians_by_year(b.panel, b.cohort), "analysis_year", "n_providers", "specialty").drop("t")
