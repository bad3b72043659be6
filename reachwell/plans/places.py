"""Queries over places of work, claims and their checks, scenarios, hot spots, gates and palettes.

Parts are providers here and suppliers their places; lines are claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachwell.constants import AGE_BANDS, SPECIALTY_CODES
from reachwell.functions.stats import weighted_mean_positive
from reachwell.guards import unmatched_keys
from reachwell.operators import centroid, classify, robustness, scenario, sites, strata, supply
from reachwell.plans.analysis import _ROWS, _SENS, _inference, _sens
from reachwell.plans.binding import Binding, origin
from reachwell.plans.model import _PROJ, _VARIANTS, _projection, _states, _variants
from reachwell.plans.registry import query, r
from reachwell.storage import kept
from reachwell.streaming.supply import windowed_supply

# Places

_LOC = """raws AS (SELECT *, l_orderkey * 10 + l_linenumber AS place, min(l_suppkey) OVER (PARTITION BY l_partkey) AS home FROM lineitem WHERE l_suppkey % 20 = l_partkey % 20),
locs AS (SELECT CAST(l_partkey AS VARCHAR) AS npi, 'A' || l_suppkey AS address_key, place, CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 7 <> 0 THEN lpad(CAST(l_suppkey // 40 AS VARCHAR), 5, '8') END AS zip5,
         30 + l_suppkey % 15 + 0.001::DOUBLE * (place % 7) AS lat, -120 + l_suppkey % 40 + 0.01::DOUBLE * (place % 5) AS lon, l_suppkey = home AS is_primary, l_suppkey % 3 = 0 AS rural FROM raws),
can0 AS (SELECT npi, address_key, arg_min(zip5, place) FILTER (zip5 IS NOT NULL) AS zip5, arg_min(lat, place) AS lat, arg_min(lon, place) AS lon, bool_or(is_primary) AS is_primary, bool_or(rural) AS rural, npi || '::' || address_key AS location_id FROM locs GROUP BY 1, 2),
can1 AS (SELECT *, count(*) OVER (PARTITION BY npi) AS n_locations, radians(max(CASE WHEN is_primary THEN lat END) OVER (PARTITION BY npi)) AS a1, max(CASE WHEN is_primary THEN lon END) OVER (PARTITION BY npi) AS o1 FROM can0),
can AS (SELECT *, 2 * 6371.0088 * asin(least(1.0, sqrt(sin((radians(lat) - a1) / 2) ** 2 + cos(a1) * cos(radians(lat)) * sin(radians(lon - o1) / 2) ** 2))) AS distance_km, ln(n_locations) AS log_locations FROM can1)"""


def _locations(b: Binding) -> DataFrame:
    s, place = F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = b.raw("lineitem").where("l_suppkey % 20 = l_partkey % 20")
    home = rows.groupBy("l_partkey").agg(F.min("l_suppkey").alias("home"))
    return rows.join(home, "l_partkey").select(
        F.col("l_partkey").cast("string").alias("npi"), F.concat(F.lit("A"), s.cast("string")).alias("address_key"), place.alias("place"),
        F.when((F.col("l_linenumber") % 2 == 0) & (s % 7 != 0), F.lpad(F.floor(s / 40).cast("string"), 5, "8")).alias("zip5"),
        (30 + s % 15 + F.lit(0.001) * (place % 7)).alias("lat"), (-120 + s % 40 + F.lit(0.01) * (place % 5)).alias("lon"),
        F.when(s == F.col("home"), "Yes").otherwise("no").alias("is_primary"), F.when(s % 3 == 0, "1").otherwise("0").alias("rural"),
    )


def _canonical(b: Binding) -> DataFrame:
    return sites.canonical(_locations(b))


@query(f"SELECT npi, address_key, zip5, {r('lat', 'lon', 'distance_km', 'log_locations')}, is_primary, rural, location_id, n_locations FROM can", _LOC)
def canonical_places(b: Binding) -> DataFrame:
    return _canonical(b)


_CLAIMS = _LOC + """, prov AS (SELECT 'P' || pay AS payer_id, 'R' || CASE WHEN p_partkey % 11 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS provider_id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS npi FROM part, (VALUES (0), (1)) v(pay)),
lookup AS (SELECT payer_id, provider_id, min(npi) AS npi FROM prov WHERE npi <> '' GROUP BY 1, 2 HAVING count(DISTINCT npi) = 1),
single AS (SELECT s_suppkey, 'A' || s_suppkey AS address_key, lpad(CAST(s_suppkey // 40 AS VARCHAR), 5, '8') AS zip5 FROM supplier WHERE s_suppkey % 9 <> 0),
cl AS (SELECT npi, CAST(o_orderdate AS DATE) AS service_date, CASE WHEN l_linenumber = 1 THEN address_key || 'x' ELSE address_key END AS address_key, zip5, 'H' || l_linenumber AS hcpcs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN lookup ON payer_id = 'P' || l_linenumber % 2 AND provider_id = 'R' || l_partkey JOIN single ON s_suppkey = l_suppkey
  WHERE l_suppkey % 20 = l_partkey % 20 AND NOT coalesce(l_quantity > 45, false) AND CAST(npi AS BIGINT) % 4 <> 0 AND l_suppkey % 19 <> 0 AND l_linenumber <> 7 AND o_orderdate >= DATE '1996-06-01' AND CAST(o_orderdate AS DATE) <= DATE '2000-06-01'),
days0 AS (SELECT npi, service_date, address_key, zip5, count(*) AS n, coalesce(sum(CASE WHEN hcpcs <> 'H3' THEN CAST(substr(hcpcs, 2) AS DOUBLE) / 2 END), 0) AS work FROM cl GROUP BY 1, 2, 3, 4),
days AS (SELECT npi, service_date, address_key, zip5, CASE WHEN count(*) OVER d = 1 THEN 1.0 WHEN sum(work) OVER d > 0 THEN work / sum(work) OVER d ELSE n / sum(n) OVER d END AS day_fraction FROM days0 WINDOW d AS (PARTITION BY npi, service_date)),
seen AS (SELECT *, sum(day_equiv) OVER (PARTITION BY npi) AS observed_days, day_equiv / sum(day_equiv) OVER (PARTITION BY npi) AS empirical_weight FROM (SELECT npi, address_key, zip5, sum(day_fraction) AS day_equiv FROM days GROUP BY 1, 2, 3)),
zonce AS (SELECT npi, zip5, min(location_id) AS location_id FROM can WHERE zip5 IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
mt AS (SELECT npi, location_id, day_equiv, observed_days, empirical_weight, 'exact_address' AS method FROM seen JOIN can USING (npi, address_key)
  UNION ALL SELECT s.npi, z.location_id, day_equiv, observed_days, empirical_weight, 'unique_npi_zip' FROM seen s ANTI JOIN can USING (npi, address_key) JOIN zonce z ON s.npi = z.npi AND s.zip5 = z.zip5),
mtd AS (SELECT npi, location_id, sum(day_equiv) AS day_equiv, max(observed_days) AS observed_days, sum(empirical_weight) AS matched_weight, string_agg(DISTINCT method, '+' ORDER BY method) AS match_method FROM mt GROUP BY 1, 2),
enough AS (SELECT npi FROM mtd GROUP BY 1 HAVING sum(matched_weight) >= 0.5 AND max(observed_days) >= 2),
train AS (SELECT npi, location_id, is_primary, n_locations, day_equiv, day_equiv / nullif(sum(day_equiv) OVER (PARTITION BY npi), 0) AS empirical_weight
  FROM (SELECT c.*, coalesce(day_equiv, 0) AS day_equiv FROM can c SEMI JOIN enough USING (npi) LEFT JOIN mtd USING (npi, location_id) WHERE n_locations >= 2)),
sch0 AS (SELECT c.*, t.empirical_weight AS dw, bool_and(t.empirical_weight IS NOT NULL) OVER (PARTITION BY c.npi) AS whole FROM can c LEFT JOIN train t USING (npi, location_id)),
sch AS (SELECT npi, address_key, zip5, location_id, is_primary, n_locations, CASE WHEN n_locations = 1 THEN 1.0 WHEN whole THEN dw ELSE 1.0 / n_locations END AS empirical_model_weight, CASE WHEN n_locations = 1 THEN 'single_location' WHEN whole THEN 'claims_direct' ELSE 'claims_calibrated_model' END AS weight_source,
  CASE WHEN is_primary THEN 1.0 ELSE 0.0 END AS primary_only_weight, 1.0 / n_locations AS equal_weight, CASE WHEN n_locations = 1 THEN 1.0 WHEN is_primary THEN 0.8 ELSE 0.2 / (n_locations - 1) END AS primary_heavy_weight FROM sch0)"""


def _providers(b: Binding) -> DataFrame:
    p = F.col("p_partkey")
    other = F.when((p % 11 == 0) & (p > 0), p - 1).otherwise(p)
    rows = b.raw("part").select(F.explode(F.array(F.lit("P0"), F.lit("P1"))).alias("payer_id"), "p_partkey")
    return rows.select("payer_id", F.concat(F.lit("R"), other.cast("string")).alias("provider_id"), F.when(p % 13 == 0, "").otherwise(p.cast("string")).alias("npi"))


def _claims(b: Binding) -> DataFrame:
    n = F.col("l_linenumber")
    day = F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    lines = b.lines.where("l_suppkey % 20 = l_partkey % 20").select(
        F.concat(F.lit("P"), (n % 2).cast("string")).alias("payer_id"), F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("rendering_provider_id"),
        F.when(F.col("l_suppkey") % 19 == 0, "").otherwise(F.concat(F.lit("L"), F.col("l_suppkey").cast("string"))).alias("provider_location_id"),
        F.when(n == 7, "soon").otherwise(day).alias("service_date"), F.concat(F.lit("H"), n.cast("string")).alias("hcpcs"),
        F.when(F.col("l_quantity") > 45, "1").when(F.col("l_quantity") >= 10, "0").alias("denied"),
    )
    s = F.col("s_suppkey").cast("string")
    places = b.raw("supplier").select(F.explode(F.array(F.lit("P0"), F.lit("P1"))).alias("payer_id"), "s_suppkey")
    twice = F.explode(F.when(F.col("s_suppkey") % 9 == 0, F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit(""))))
    places = places.select("payer_id", F.concat(F.lit("L"), s).alias("location_id"), F.concat(F.lit("A"), s).alias("a"), F.lpad(F.floor(F.col("s_suppkey") / 40).cast("string"), 5, "8").alias("zip5"), twice.alias("t"))
    places = places.select("payer_id", "location_id", F.concat("a", "t").alias("address_key"), "zip5")
    targets = b.raw("part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("string").alias("npi"))
    found = sites.relevant_claims(lines, _providers(b), targets, places, "1996-06-01", "2000-06-01")
    return found.withColumn("address_key", F.when(F.col("hcpcs") == "H1", F.concat("address_key", F.lit("x"))).otherwise(F.col("address_key")))


def _days(claims: DataFrame) -> DataFrame:
    return sites.day_fractions(claims.withColumn("work_rvu", F.when(F.col("hcpcs") != "H3", F.substring("hcpcs", 2, 1).cast("double") / 2)))


def _matched(b: Binding) -> tuple[DataFrame, DataFrame]:
    return sites.match_sites(sites.observed(_days(_claims(b))), _canonical(b))


def _training(claims: DataFrame, places: DataFrame) -> DataFrame:
    return sites.training_rows(places, sites.match_sites(sites.observed(_days(claims)), places)[0], 0.5, 2.0)


def _schemes(b: Binding, claims: DataFrame | None = None) -> DataFrame:
    places = _canonical(b)
    direct = _training(_claims(b) if claims is None else claims, places).select("npi", "location_id", F.col("empirical_weight").alias("direct_weight"))
    return sites.schemes(places.withColumn("predicted_weight", 1 / F.col("n_locations")), direct)


@query("SELECT payer_id, provider_id, npi FROM lookup", _CLAIMS)
def rendering_lookup(b: Binding) -> DataFrame:
    return sites.rendering_lookup(_providers(b))


@query("SELECT npi, service_date, address_key, zip5, hcpcs, count(*) AS n FROM cl GROUP BY ALL", _CLAIMS)
def relevant_claims(b: Binding) -> DataFrame:
    rows = _claims(b)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(f"SELECT npi, service_date, address_key, zip5, {r('day_fraction')} FROM days", _CLAIMS)
def day_fractions(b: Binding) -> DataFrame:
    return _days(_claims(b))


@query(f"SELECT npi, location_id, match_method, {r('day_equiv', 'observed_days', 'matched_weight')} FROM mtd", _CLAIMS)
def matched_sites(b: Binding) -> DataFrame:
    return _matched(b)[0]


@query(f"SELECT npi, address_key, zip5, {r('day_equiv', 'observed_days', 'empirical_weight')} FROM seen ANTI JOIN can USING (npi, address_key) ANTI JOIN zonce USING (npi, zip5)", _CLAIMS)
def unmatched_sites(b: Binding) -> DataFrame:
    return _matched(b)[1].select("npi", "address_key", "zip5", "day_equiv", "observed_days", "empirical_weight")


@query(f"SELECT npi, location_id, is_primary, n_locations, {r('day_equiv', 'empirical_weight')} FROM train", _CLAIMS)
def training_places(b: Binding) -> DataFrame:
    rows = _training(_claims(b), _canonical(b))
    return rows.select("npi", "location_id", "is_primary", "n_locations", "day_equiv", "empirical_weight")


_WEIGHTS = ("empirical_model_weight", "primary_only_weight", "equal_weight", "primary_heavy_weight")


@query(f"SELECT npi, location_id, weight_source, {r(*_WEIGHTS, *[f'(1 + CAST(npi AS BIGINT) % 3) * {w} AS {w.replace('weight', 'capacity')}' for w in _WEIGHTS])} FROM sch", _CLAIMS)
def site_capacities(b: Binding) -> DataFrame:
    capacity = b.raw("part").select(F.col("p_partkey").cast("string").alias("npi"), (1.0 + F.col("p_partkey") % 3).alias("total"))
    found = sites.capacities(_schemes(b), capacity)
    return found.select("npi", "location_id", "weight_source", *_WEIGHTS, *[w.replace("weight", "capacity") for w in _WEIGHTS])


@query()
def share_model_folds(b: Binding) -> DataFrame:
    """No SQL: fitted by iteration; the model is tested against one fitted directly."""
    rows = _training(_claims(b), _canonical(b))
    return sites.cross_validated(rows.where("empirical_weight is not null"), 3).select("npi", "location_id", "empirical_weight", "predicted_weight")


@query(
    f"""SELECT npi, {r('services', 'beneficiary_days')}, n_locations, {r('secondary_share')}, weight_source FROM (SELECT CAST(l_partkey AS VARCHAR) AS npi, sum(l_quantity) AS services, sum(l_linenumber) AS beneficiary_days FROM lineitem WHERE l_partkey % 6 = 1 GROUP BY 1)
  LEFT JOIN (SELECT npi, max(n_locations) AS n_locations, 1 - max(CASE WHEN is_primary THEN empirical_model_weight END) AS secondary_share, string_agg(DISTINCT weight_source, '+' ORDER BY weight_source) AS weight_source FROM sch GROUP BY 1) USING (npi)""",
    _CLAIMS,
)
def utilisation_check(b: Binding) -> DataFrame:
    rows = b.raw("lineitem").where("l_partkey % 6 = 1").select(F.col("l_partkey").cast("string").alias("npi"), F.col("l_quantity").alias("services"), F.col("l_linenumber").alias("beneficiary_days"))
    return sites.utilisation_check(_schemes(b), rows)


@query(
    f"""SELECT npi, location_id, {r('empirical_model_weight')}, is_primary, match_method, count(DISTINCT service_date) AS days FROM (
  SELECT npi, location_id, empirical_model_weight, is_primary, 'exact_address' AS match_method, service_date FROM cl JOIN sch USING (npi, address_key)
  UNION ALL SELECT c.npi, s.location_id, s.empirical_model_weight, s.is_primary, 'unique_npi_zip', service_date FROM cl c ANTI JOIN sch USING (npi, address_key)
    JOIN (SELECT * FROM sch WHERE zip5 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY npi, zip5) = 1) s ON c.npi = s.npi AND c.zip5 = s.zip5) GROUP BY ALL""",
    _CLAIMS,
)
def visit_check(b: Binding) -> DataFrame:
    claims = kept(_claims(b))
    return sites.visit_check(_schemes(b, claims), claims)


# Scenarios


@query(f"SELECT scenario_id, year, {r('mean AS mean_access_per100k', 'zero AS zero_access_pop_share')}, n AS n_reached_tracts, {r('year * 2.0 AS demand_clinical_fte', 'year - 2000.0 AS gap_fte')} FROM cube WHERE scenario_id <> 'loss'", _PROJ)
def scenario_gaps(b: Binding) -> DataFrame:
    """Scenarios one by one through a given access function, by the second basis, beside demand and gap."""
    rows = scenario.projection(_projection(b)).withColumn("supply_clinical_fte", F.col("supply_headcount")).withColumn("supply_headcount", F.lit(1.0))
    rows = rows.withColumn("demand_clinical_fte", F.col("year") * 2.0).withColumn("gap_fte", F.col("year") - 2000.0)

    def accessibility(own: DataFrame, name: str, year: int) -> DataFrame:
        return scenario.scenario_access(b.overlap, b.tracts, own, [])

    found = scenario.project(rows, ["baseline", "growth"], [2025, 2030], b.tracts.groupBy("state").agg(F.sum("pop").alias("weight")), b.supply, accessibility, "clinical_fte")
    return scenario.with_gap(found, rows)


@query(f"SELECT scenario_id, year, state, CAST(supply AS DOUBLE) AS supply FROM st WHERE supply > 0 AND state NOT IN (SELECT state FROM supply WHERE coord_id LIKE '%1')", _PROJ)
def unplaced_targets(b: Binding) -> DataFrame:
    """Targets of states that have no origin among those whose number ends with 1."""
    return scenario.origin_supply(_states(b), b.supply.where("coord_id like '%1'"))[1]


# Clusters, shares, audits


_HOT = """lat AS (SELECT k, geoid, k % 40 AS i, k // 40 AS j, CASE WHEN k % 17 <> 0 THEN CAST(pop AS DOUBLE) END AS v FROM tracts),
hv AS (SELECT *, coalesce(v, 0) AS x FROM lat),
hs AS (SELECT a.geoid, sum(o.x) AS local, count(*) AS k FROM hv a JOIN hv o ON abs(a.i - o.i) + abs(a.j - o.j) <= 1 GROUP BY 1),
hz AS (SELECT geoid, (local - k * m) / nullif(s * sqrt((n * k - k * k) / (n - 1.0)), 0) AS z FROM hs, (SELECT avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM hv))"""


@query(f"SELECT geoid AS id, {r('z')}, CASE WHEN z <= -2.58 THEN 'Cold 99%' WHEN z <= -1.96 THEN 'Cold 95%' WHEN z <= 1.96 THEN 'n.s.' WHEN z <= 2.58 THEN 'Hot 95%' WHEN z IS NOT NULL THEN 'Hot 99%' END AS class FROM hz", _HOT)
def hot_spots(b: Binding) -> DataFrame:
    """Populations on a lattice; a tract's neighbours are beside, above and below it."""
    k = F.col("k")
    at = b.tracts.select("geoid", "pop", "k", (k % 40).alias("i"), F.floor(k / 40).alias("j"))
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("di"), F.lit(y).alias("dj")) for x, y in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = at.select(F.col("geoid").alias("id"), "i", "j", steps.alias("s")).select("id", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    pairs = near.join(at.select(F.col("geoid").alias("other"), "i", "j"), ["i", "j"]).select("id", "other")
    return classify.hot_spots(at.select(F.col("geoid").alias("id"), F.when(k % 17 != 0, F.col("pop").cast("double")).alias("value")), pairs)


@query(f"SELECT segment, {r('sum(CASE WHEN g2 > 0 THEN access * g2 END) / sum(CASE WHEN g2 > 0 THEN g2 END) AS mean')} FROM kn GROUP BY 1", _ROWS)
def positive_weight_means(b: Binding) -> DataFrame:
    return _inference(b).groupBy("segment").agg(weighted_mean_positive(F.col("access"), F.col("g2")).alias("mean"))


@query("SELECT DISTINCT coord_id FROM overlap WHERE coord_id NOT IN (SELECT coord_id FROM supply)")
def unmatched_origins(b: Binding) -> DataFrame:
    return unmatched_keys(b.overlap, b.supply, "coord_id")


@query(
    f"""SELECT segment, {r('metro', 'rural', 'rural / metro AS rural_metro_ratio', '(metro * pm + rural * pr) / (pm + pr) AS exploratory_composite')} FROM (
  SELECT segment, sum(s.a * 1e5 * s.pop) FILTER (rurality = 'Metropolitan') / sum(s.pop) FILTER (rurality = 'Metropolitan') AS metro, sum(w.a * 1e5 * s.pop) FILTER (rurality = 'Rural') / sum(s.pop) FILTER (rurality = 'Rural') AS rural,
         sum(s.pop) FILTER (rurality = 'Metropolitan') AS pm, sum(s.pop) FILTER (rurality = 'Rural') AS pr
  FROM (SELECT geoid, a, pop FROM va WHERE variant = 'sharper') s JOIN (SELECT geoid, a FROM va WHERE variant = 'slower') w USING (geoid) JOIN (SELECT geoid, segment, rurality FROM tracts) USING (geoid) GROUP BY 1)""",
    _VARIANTS,
)
def metro_rural_composite(b: Binding) -> DataFrame:
    rows = _variants(b).where("variant in ('sharper', 'slower')").groupBy("geoid").agg(*[F.max(F.when(F.col("variant") == v, F.col("access") * 1e5)).alias(n) for v, n in (("sharper", "sharp"), ("slower", "slow"))])
    return robustness.metro_rural_composite(rows.join(b.tracts.select("geoid", "pop", "rurality", "segment"), "geoid"), "segment")


@query("SELECT variant, (list_sort([a, c]) = list_sort(['BUILDING', 'MACHINERY']) AND z = 'FURNITURE') AS c5 FROM (SELECT variant, l[1] AS a, l[2] AS c, l[len(l)] AS z FROM (SELECT variant, list(subspec ORDER BY national DESC, subspec) AS l FROM sens3 GROUP BY 1))", _SENS)
def order_claims(b: Binding) -> DataFrame:
    return robustness.order_claim(_sens(b), ["BUILDING", "MACHINERY"], "FURNITURE")


@query(
    """SELECT 'disagrees' AS gate, variant, subspec FROM sens3 WHERE variant = 'slower' AND subspec < 'C' UNION SELECT 'missing', v, s FROM (VALUES ('base'), ('slower'), ('m2sfca')) a(v), (VALUES ('BUILDING'), ('MACHINERY'), ('NOBODY')) c(s)
  WHERE NOT EXISTS (SELECT 1 FROM sens3 WHERE variant = v AND subspec = s) UNION SELECT 'not_finite', variant, subspec FROM sens3 WHERE variant IN ('base', 'm2sfca') AND subspec = 'FURNITURE'
  UNION SELECT 'repeated', variant, subspec FROM sens3 WHERE variant = 'base' AND subspec = 'MACHINERY'
  UNION SELECT 'm2sfca_above_base', 'm2sfca', subspec FROM (SELECT subspec, max(CASE WHEN variant = 'base' AND subspec <> 'FURNITURE' THEN national END) AS b, max(CASE WHEN variant = 'm2sfca' AND subspec <> 'FURNITURE' THEN national END) AS m FROM sens3 GROUP BY 1) WHERE m > b * (1 + 1e-6)""",
    _SENS,
)
def run_gates(b: Binding) -> DataFrame:
    """A run with a value that disagrees, one that is missing, one that isn't finite and a repeated row."""
    rows = _sens(b).select("variant", "subspec", F.when((F.col("subspec") == "FURNITURE") & F.col("variant").isin("base", "m2sfca"), float("nan")).otherwise(F.col("national")).alias("national"), F.when((F.col("variant") == "slower") & (F.col("subspec") < "C"), 9e9).otherwise(F.col("national")).alias("national_check"))
    rows = rows.unionByName(rows.where("variant = 'base' and subspec = 'MACHINERY'"))
    return robustness.run_gates(rows, ["base", "slower", "m2sfca"], ["BUILDING", "MACHINERY", "NOBODY"])


@query(f"SELECT geoid, {', '.join(f'CAST((0 + {" + ".join(f"CASE WHEN k % {i - 20} = 0 THEN 0 ELSE k % {i} END" for i in range(low, high + 1))}) AS DOUBLE) AS {n}' for n, (low, high) in AGE_BANDS.items())} FROM tracts")
def age_band_demand(b: Binding) -> DataFrame:
    k = F.col("k")
    return centroid.age_band_demand(b.tracts.select("geoid", *[F.when(k % (i - 20) != 0, k % i).alias(f"a{i}") for i in range(27, 50)]))


_NAMES = list(SPECIALTY_CODES) + ["Other"]


@query("SELECT code, count(*) AS n FROM (SELECT CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{SPECIALTY_CODES.get(n, '')}'" for i, n in enumerate(_NAMES) if n in SPECIALTY_CODES) + " END AS code FROM part) GROUP BY 1")
def specialty_codes(b: Binding) -> DataFrame:
    """Certifications as specialties; those without one have none."""
    names = F.array(*map(F.lit, _NAMES))[(F.col("p_partkey") % len(_NAMES)).cast("int")]
    return supply.relabelled(b.raw("part").select(names.alias("code")), "code", SPECIALTY_CODES).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT specialty, n_providers, n_derived, n_providers - n_derived AS diff FROM (SELECT p_brand AS specialty, count(*) AS n_providers, count(*) + CASE WHEN p_brand LIKE '%1' THEN 1 WHEN p_brand LIKE '%2' THEN -1 ELSE 0 END AS n_derived FROM part GROUP BY 1)")
def workforce_cross_check(b: Binding) -> DataFrame:
    counts = b.cohort.groupBy("specialty").agg(F.count("*").alias("n_providers"))
    s = F.col("specialty")
    return supply.cross_checked(counts, counts.select("specialty", (F.col("n_providers") + F.when(s.endswith("1"), 1).when(s.endswith("2"), -1).otherwise(0)).alias("n_derived")))


@query(
    "SELECT new, total, with_satellite, CAST(round_even(100.0 * with_satellite / total, 1) AS DOUBLE) AS pct_satellite FROM (SELECT year AS new, count(DISTINCT npi) AS total FROM own GROUP BY 1) JOIN (SELECT year AS new, count(DISTINCT npi) AS with_satellite FROM sec GROUP BY 1) USING (new)",
    """places AS (SELECT o_custkey AS npi, o_orderpriority AS year, lpad(CAST(l_suppkey % 97 AS VARCHAR), 5, '1') AS p, lpad(CAST(l_partkey % 113 AS VARCHAR), 5, '1') AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1998),
own AS (SELECT * FROM places), sec AS (SELECT * FROM own WHERE s <> p)""",
)
def satellite_by_specialty(b: Binding) -> DataFrame:
    """One year's second places by specialty, most first."""
    rows = b.lines.where(F.year("o_orderdate") == 1998).select(F.col("o_custkey").alias("npi"), F.col("o_orderpriority").alias("new"), F.lpad((F.col("l_suppkey") % 97).cast("string"), 5, "1").alias("primary_zip"), F.lpad((F.col("l_partkey") % 113).cast("string"), 5, "1").alias("secondary_zip"), F.lit(None).cast("string").alias("primary_state"), F.lit(None).cast("string").alias("secondary_state"))
    return supply.satellite_sensitivity(rows, "new").orderBy(F.desc("pct_satellite"), "new").select("new", "total", "with_satellite", "pct_satellite")


@query("SELECT i % 3 + 1 || '-' || (i // 3 + 1) AS bivar_class, n FROM (SELECT k % 9 AS i, count(*) AS n FROM tracts GROUP BY 1)")
def palette_classes(b: Binding) -> DataFrame:
    """Classes that every palette of three has a colour for."""
    k = F.col("k") % 9
    rows = b.tracts.select(F.concat_ws("-", (k % 3 + 1).cast("string"), (F.floor(k / 3) + 1).cast("string")).alias("bivar_class"))
    for name in ("BlueYellow", "PurpleGreen", "BrownBlue", "PinkBlue"):
        rows = classify.coloured(rows, classify.palette(name)).where("color is not null").drop("color")
    return rows.groupBy("bivar_class").agg(F.count("*").alias("n"))


_NEAR = """so AS (SELECT s_suppkey AS s, 30 + s_suppkey * 37 % 100 / 10.0::DOUBLE AS lat, -110 + s_suppkey * 53 % 100 / 10.0::DOUBLE AS lon FROM supplier),
rp AS (SELECT p_partkey AS id, 30 + p_partkey * 71 % 1000 / 100.0::DOUBLE AS lat, -110 + p_partkey * 31 % 1000 / 100.0::DOUBLE AS lon FROM part),
dd AS (SELECT id, s, 2 * 6371.0088 * asin(least(1.0, sqrt(sin(radians(so.lat - rp.lat) / 2) ** 2 + cos(radians(rp.lat)) * cos(radians(so.lat)) * sin(radians(so.lon - rp.lon) / 2) ** 2))) AS km FROM rp, so WHERE abs(so.lat - rp.lat) < 0.5 AND abs(so.lon - rp.lon) < 0.5)"""


@query("SELECT 'S' || lpad(CAST(s AS VARCHAR), 7, '0') AS coord_id, count(*) AS n FROM (SELECT id, arg_min(s, km) AS s FROM dd WHERE km <= 5 GROUP BY 1) GROUP BY 1", _NEAR)
def recovered_supply(b: Binding) -> DataFrame:
    """Recovered providers at the nearest origin within five kilometres."""
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    origins = b.raw("supplier").select(origin("s_suppkey").alias("coord_id"), (30 + s * 37 % 100 / 10.0).alias("lat"), (-110 + s * 53 % 100 / 10.0).alias("lon"))
    recovered = b.raw("part").select(p.cast("string").alias("id"), (30 + p * 71 % 1000 / 100.0).alias("lat"), (-110 + p * 31 % 1000 / 100.0).alias("lon"))
    return supply.near_surface(recovered, origins, 100_000.0)


@query("SELECT strftime(time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS window_start, event_type AS coord_id, count(DISTINCT user_id) AS supply FROM events GROUP BY 1, 2")
def windowed_sightings(b: Binding) -> DataFrame:
    """The streamed count over a table: distinct users of each kind of event by thirty days."""
    found = windowed_supply(b.raw("events").select(F.col("user_id").alias("npi"), F.col("event_type").alias("coord_id"), F.col("ts").alias("seen_at")))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


# Corrections and classes by minority share

_FIX = """fx AS (SELECT geoid, segment AS s, y AS year, CAST(pop AS DOUBLE) AS pop, state < '05' AS inside, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k % 50 AS DOUBLE) END AS f,
  CASE WHEN state < '05' AND y >= 2022 THEN (k % 50) * 1.5::DOUBLE + 1 WHEN k % 13 = 0 THEN NULL ELSE (k % 50) * (1 + (y - 2021) * 0.01::DOUBLE * (k % 3)) END AS c FROM tracts, (VALUES (2021), (2022), (2023)) v(y)),
fm AS (SELECT s, year, sum(pop) AS pop_eligible, sum(f * pop) / sum(pop) FILTER (f IS NOT NULL) AS mean_frozen, sum(c * pop) / sum(pop) FILTER (c IS NOT NULL) AS mean_corrected,
  sum(f * pop) FILTER (NOT inside) / sum(pop) FILTER (f IS NOT NULL AND NOT inside) AS nf, sum(c * pop) FILTER (NOT inside) / sum(pop) FILTER (c IS NOT NULL AND NOT inside) AS nc,
  sum(f * pop) FILTER (inside) / sum(pop) FILTER (f IS NOT NULL AND inside) AS region_mean_frozen, sum(c * pop) FILTER (inside) / sum(pop) FILTER (c IS NOT NULL AND inside) AS region_mean_corrected,
  count(*) FILTER (f = 0) AS n_zero_frozen, count(*) FILTER (c = 0) AS n_zero_corrected, count(*) FILTER (f IS NULL) AS n_unknown_frozen, count(*) FILTER (c IS NULL) AS n_unknown_corrected,
  100 * coalesce(sum(pop) FILTER (f = 0), 0) / sum(pop) AS pop_zero_pct_frozen, 100 * coalesce(sum(pop) FILTER (c = 0), 0) / sum(pop) AS pop_zero_pct_corrected,
  100 * coalesce(sum(pop) FILTER (f IS NULL), 0) / sum(pop) AS pop_unknown_pct_frozen, 100 * coalesce(sum(pop) FILTER (c IS NULL), 0) / sum(pop) AS pop_unknown_pct_corrected,
  (sum(f * pop) / 1e5 - 1000) / 1000 AS conservation_residual_frozen, (sum(c * pop) / 1e5 - 1000) / 1000 AS conservation_residual_corrected FROM fx GROUP BY 1, 2)"""


def _correction(b: Binding) -> DataFrame:
    k, y, state = F.col("k"), F.col("year"), F.col("state")
    rows = b.tracts.select("geoid", "k", "state", F.col("segment").alias("s"), F.explode(F.array(F.lit(2021), F.lit(2022), F.lit(2023))).alias("year"))
    old = F.when(k % 13 != 0, (k % 50).cast("double"))
    new = F.when((state < "05") & (y >= 2022), (k % 50) * 1.5 + 1).when(k % 13 != 0, (k % 50) * (1 + (y - 2021) * 0.01 * (k % 3)))
    supply_ = rows.select("s", "year").distinct().select("s", "year", F.explode(F.array(F.struct(F.lit(1000.0).alias("supply"), F.lit(5.0).alias("weighted_demand")), F.struct(F.lit(77.0).alias("supply"), F.lit(0.0).alias("weighted_demand")))).alias("x")).select("s", "year", "x.*")
    return strata.correction_summary(rows.select("s", "year", "geoid", old.alias("access")), rows.select("s", "year", "geoid", new.alias("access")), b.tracts.select("geoid", "pop"), lambda g: F.substring(g, 1, 2) < "05", "s", "year", ratios=(supply_, supply_))


_FIXED = [f"{a}_{n}" for a in ("region_mean", "pop_zero_pct", "pop_unknown_pct", "conservation_residual") for n in ("frozen", "corrected")]


@query(
    f"""SELECT s, year, n_zero_frozen, n_zero_corrected, n_unknown_frozen, n_unknown_corrected, {r('pop_eligible', 'mean_frozen', 'mean_corrected', *_FIXED, '100 * (mean_corrected - mean_frozen) / mean_frozen AS delta_pct', 'nc - nf AS second_order', 'mean_corrected - nc AS direct',
      '100 * (nc - nf) / mean_frozen AS second_order_pct', '100 * (mean_corrected - nc) / mean_frozen AS direct_pct', digits=5)} FROM fm""",
    _FIX, digits=5,
)
def correction_summary(b: Binding) -> DataFrame:
    return _correction(b)


@query(
    " UNION ALL ".join(
        f"""SELECT s, '{a}-{c}' AS span, {r('100 * (b.mean_frozen - a.mean_frozen) / a.mean_frozen AS frozen', '100 * (b.mean_corrected - a.mean_corrected) / a.mean_corrected AS corrected', digits=5)},
  sign(b.mean_frozen - a.mean_frozen) <> sign(b.mean_corrected - a.mean_corrected) AS sign_flip FROM (SELECT * FROM fm WHERE year = {a}) a JOIN (SELECT * FROM fm WHERE year = {c}) b USING (s)"""
        for a, c in ((2021, 2022), (2022, 2023))
    ),
    _FIX, digits=5,
)
def correction_over_time(b: Binding) -> DataFrame:
    return strata.temporal_effect(_correction(b), "s", [(2021, 2022), (2022, 2023), (2013, 2023)])


@query(
    """SELECT year, frozen, corrected, frozen <> corrected AS changed FROM (SELECT year, string_agg(s, ' > ' ORDER BY mean_frozen DESC, s) AS frozen, string_agg(s, ' > ' ORDER BY mean_corrected DESC, s) AS corrected FROM fm GROUP BY 1)""",
    _FIX,
)
def correction_of_ranks(b: Binding) -> DataFrame:
    return strata.ranking_effect(_correction(b), "s")


@query(
    f"""SELECT geoid, specialty, {r('minority_share')}, ax, ay, CAST(ax AS VARCHAR) || CAST(ay AS VARCHAR) AS key FROM (SELECT c.geoid, specialty, minority_share, CAST(1 + CAST(percent > 100.0::DOUBLE / 3 AS INTEGER) + CAST(percent > 200.0::DOUBLE / 3 AS INTEGER) AS INTEGER) AS ax,
  CAST(CASE WHEN minority_share <= q[2] THEN 1 WHEN minority_share <= q[3] THEN 2 ELSE 3 END AS INTEGER) AS ay FROM cover c JOIN (SELECT geoid, 100 * (k % 17) / 16.0::DOUBLE AS minority_share FROM tracts WHERE k % 9 <> 0) USING (geoid),
  (SELECT quantile_cont(100 * (k % 17) / 16.0::DOUBLE, [0, 1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE, 1]) AS q FROM tracts WHERE k % 9 <> 0))"""
)
def coverage_by_minority(b: Binding) -> DataFrame:
    k = F.col("k")
    shares = b.tracts.select("geoid", F.when(k % 9 != 0, 16.0).otherwise(0.0).alias("women"), (k % 17).cast("double").alias("minority"))
    return classify.coverage_by_minority(b.cover.select("geoid", "specialty", "percent"), shares).select("geoid", "specialty", "minority_share", "ax", "ay", "key")
