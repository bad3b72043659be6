"""Enhanced two-step floating catchment areas over one table of overlaps.

An overlap row says which fraction of a tract lies within a travel-time band of
an origin; bands are cumulative, so a tract within 30 minutes is in the bands
beyond as well, and incremental weights give each its due. Step 1 sums the
weighted population of each origin and divides its supply by it; step 2 sums
the ratios over a tract's origins. Both are joins and sums, two shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import BAND_WEIGHTS, LOW_SPAR, PER_CAPITA
from reachwell.functions.stats import ratio
from reachwell.functions.weights import band_weights, incremental, weight_of


#: Ids that an audit lists.
LISTED = 20


@dataclass
class Access:
    """A result: access by tract, ratios by origin, one row of audit, and what they were computed with."""

    access: DataFrame
    ratios: DataFrame
    audit: DataFrame
    weights: dict[int, float]
    step1: dict[int, float]
    step2: dict[int, float]
    method: str
    maximum_minutes: int


def attach(overlap: DataFrame, tract_pop: DataFrame, supply: DataFrame, na_pop: str, check: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked inputs: overlaps of origins with supply, with the tract's population; populations; supplies."""
    overlap = overlap.select("coord_id", F.col("band").cast("int").alias("band"), "geoid", F.col("overlap_fraction").cast("double").alias("f"))
    pop = tract_pop.select("geoid", F.col("pop").cast("double").alias("pop"))
    supply = supply.select("coord_id", F.col("supply").cast("double").alias("supply"))
    if na_pop not in ("error", "zero"):
        raise guards.CatchmentError("na_pop must be error or zero")
    if check:
        tests = [("tract population repeats a tract", guards.repeated(pop, "geoid"), "geoid"), ("supply repeats an origin", guards.repeated(supply, "coord_id"), "coord_id")]
        if na_pop == "error":
            tests.append(("unknown population in pop", pop.where(~guards.finite(F.col("pop"))), "geoid"))
        guards.refuse_any(*tests)
    pop = pop.withColumn("pop", F.when(guards.finite(F.col("pop")), F.col("pop")).otherwise(0.0))
    edges = overlap.join(supply, "coord_id").join(pop, "geoid", "left")
    return edges, pop, supply


def e2sfca(
    overlap: DataFrame,
    tract_pop: DataFrame,
    supply: DataFrame,
    weights: Mapping[int, float] = BAND_WEIGHTS,
    power: float = 1.0,
    scale: float = PER_CAPITA,
    na_pop: str = "error",
    check: bool = True,
) -> Access:
    """Accessibility of every tract in ``tract_pop``; ``power`` 2 gives the modified model (M2SFCA).

    ``overlap`` has coord_id, band, geoid and overlap_fraction, ``tract_pop``
    geoid and pop, ``supply`` coord_id and supply. Origins without supply and
    bands without a weight are left out and audited. A tract of an overlap
    must have a population row. A tract that no origin reaches with a positive
    fraction has a null ``access`` and a zero ``access_math``; one that is
    reached but has no score, as from an origin of unknown supply, is an error.
    """
    weights = band_weights(weights)
    first, second = incremental(weights), incremental(weights, power)
    edges, pop, supply = attach(overlap, tract_pop, supply, na_pop, check)
    base = edges.withColumn("w1", weight_of(F.col("band"), first)).withColumn("w2", weight_of(F.col("band"), second)).where("w1 is not null")
    if check:  # the joined population is null only where there was no row
        guards._refuse("tract within a catchment has no population row", base.where("pop is null"), "geoid")

    demand = base.groupBy("coord_id").agg(F.sum(F.col("w1") * F.col("f") * F.coalesce("pop", F.lit(0.0))).alias("demand"))
    d = F.col("weighted_demand")
    ratios = supply.join(demand, "coord_id", "left").select(
        "coord_id", "supply", F.coalesce("demand", F.lit(0.0)).alias("weighted_demand")
    )
    ratios = ratios.select(
        "*",
        F.when(d > 0, F.col("supply") / d).alias("ratio"),
        F.when(d > 0, F.col("supply") / d).otherwise(0.0).alias("ratio_for_surface"),
        (d <= 0).alias("zero_demand"),
        F.when(d > 0, 0.0).otherwise(F.col("supply")).alias("excluded_supply"),
    )
    scored = base.select("coord_id", "geoid", "f", "w2").join(ratios.select("coord_id", F.col("ratio_for_surface").alias("r")), "coord_id")
    # One row for each tract and origin first, so that distinct origins are a plain count.
    pairs = scored.groupBy("geoid", "coord_id").agg(F.sum(F.col("w2") * F.col("f") * F.col("r")).alias("a"), F.max("r").alias("r"), F.max((F.col("f") > 0).cast("int")).alias("reached"))
    by_tract = pairs.groupBy("geoid").agg(F.sum("a").alias("a"), F.count_if(F.col("r") > 0).alias("n_providers"), F.max("reached").alias("reached"))
    reached = F.coalesce(F.col("reached") == 1, F.lit(False))
    # Reached but without a score: the two would disagree, so it is refused rather than taken for a zero.
    diverges = F.raise_error(F.concat(F.lit("a reached tract has no score: "), F.col("geoid").cast("string"))).cast("double")
    math = F.when(reached & F.col("a").isNull(), diverges).otherwise(F.coalesce("a", F.lit(0.0)))
    access = pop.select("geoid").distinct().join(by_tract, "geoid", "left").select(
        "geoid",
        F.when(reached, math).alias("access"),
        F.when(reached, math * scale).alias("access_scaled"),
        F.coalesce("n_providers", F.lit(0)).alias("n_providers"),
        math.alias("access_math"),
        (math * scale).alias("access_scaled_math"),
        reached.alias("reached"),
        F.when(reached, "within_modeled_catchment").otherwise("outside_all_modeled_catchments").alias("coverage_status"),
    )
    audit = _audit(overlap, supply, ratios, access, weights)
    return Access(access, ratios, audit, weights, first, second, "E2SFCA" if power == 1 else "M2SFCA", max(weights))


def _audit(overlap: DataFrame, supply: DataFrame, ratios: DataFrame, access: DataFrame, weights: Mapping[int, float]) -> DataFrame:
    """One row of what was left out and what was found; lists name the first ``LISTED`` ids."""
    def first_ids(df: DataFrame, name: str) -> DataFrame:
        ids = df.select("coord_id").distinct().orderBy("coord_id").limit(LISTED)
        return ids.agg(F.array_sort(F.collect_list("coord_id")).alias(name))

    by_origin = ratios.agg(
        F.count_if("zero_demand").alias("n_zero_demand_origins"),
        F.coalesce(F.sum("excluded_supply"), F.lit(0.0)).alias("supply_zero_demand"),
        F.coalesce(ratio(F.sum("excluded_supply"), F.sum("supply")), F.lit(0.0)).alias("share_supply_zero_demand"),
    )
    lost = overlap.join(supply.select("coord_id"), "coord_id", "left_anti")
    no_supply = lost.agg(F.count_distinct("coord_id").alias("n_coords_without_supply"), F.count("*").alias("n_rows_without_supply"))
    outside = weight_of(F.col("band"), weights).isNull()
    no_band = overlap.join(supply.select("coord_id"), "coord_id", "left_semi").agg(F.count_if(outside).alias("n_rows_outside_bands"), F.array_sort(F.collect_set(F.when(outside, F.col("band")))).alias("bands_outside"))
    tracts = access.agg(
        F.count("*").alias("n_tracts"),
        F.count_if(~F.col("reached")).alias("n_outside"),
        F.count_if("reached").alias("n_within"),
        F.count_if(F.col("reached") & (F.col("access_math") == 0)).alias("n_reached_scoring_zero"),
    )
    lists = first_ids(ratios.where("zero_demand"), "zero_demand_coord_ids").crossJoin(first_ids(lost, "coord_ids_without_supply"))
    return by_origin.crossJoin(no_supply).crossJoin(no_band).crossJoin(tracts).crossJoin(lists)  # one row each


def variant_access(overlap: DataFrame, tract_pop: DataFrame, supply: DataFrame, variants: DataFrame, check: bool = True) -> DataFrame:
    """Several weightings in one job: variant, geoid, access, pop (of every tract).

    ``variants`` has variant, band, step1 and step2, a few rows that are
    broadcast; the edges are shuffled once by origin and once by tract.
    """
    edges, pop, supply = attach(overlap, tract_pop, supply, "error", check)
    base = edges.join(F.broadcast(variants.select("variant", "band", "step1", "step2")), "band")
    demand = base.groupBy("variant", "coord_id").agg(F.sum(F.col("step1") * F.col("f") * F.col("pop")).alias("d"), F.first("supply").alias("s"))
    ratios = demand.select("variant", "coord_id", F.when(F.col("d") > 0, F.col("s") / F.col("d")).otherwise(0.0).alias("r"))
    found = base.join(ratios, ["variant", "coord_id"]).groupBy("variant", "geoid").agg(F.sum(F.col("step2") * F.col("f") * F.col("r")).alias("a"))
    every = pop.crossJoin(F.broadcast(variants.select("variant").distinct()))  # each tract once for each of a few variants
    return every.join(found, ["variant", "geoid"], "left").select("variant", "geoid", "pop", F.coalesce("a", F.lit(0.0)).alias("access"))


def relative_access(access: DataFrame, tract_pop: DataFrame, score: str = "access_scaled_math") -> DataFrame:
    """Per tract: geoid, pop, access, spar (access over its population-weighted mean; 0 if that isn't positive)."""
    rows = tract_pop.select("geoid", F.col("pop").cast("double").alias("pop")).join(access.select("geoid", F.col(score).alias("access")), "geoid", "left")
    rows = rows.fillna(0.0, ["access"])
    mean = rows.agg(ratio(F.sum(F.col("access") * F.col("pop")), F.sum("pop")).alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select("geoid", "pop", "access", F.when(F.col("mean") > 0, F.col("access") / F.col("mean")).otherwise(0.0).alias("spar"))


def spar_summary(access: DataFrame, tract_pop: DataFrame, score: str = "access_scaled_math", low: float = LOW_SPAR) -> DataFrame:
    """One row: mean access, mean spar, shares of the population with low and with no access, tracts with any."""
    rows = relative_access(access, tract_pop, score)
    pop = F.col("pop")
    return rows.agg(
        ratio(F.sum(F.col("access") * pop), F.sum(pop)).alias("mean_access_per100k"),
        ratio(F.sum(F.col("spar") * pop), F.sum(pop)).alias("spar_national_mean"),
        ratio(F.sum(F.when(F.col("spar") < low, pop).otherwise(0.0)), F.sum(pop)).alias("low_access_pop_share"),
        ratio(F.sum(F.when(F.col("access") <= 0, pop).otherwise(0.0)), F.sum(pop)).alias("zero_access_pop_share"),
        F.count_if(F.col("access") > 0).alias("n_reached_tracts"),
    )
