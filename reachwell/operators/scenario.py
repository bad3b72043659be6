"""Projected supply brought down to origins, and access under each scenario."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import BAND_WEIGHTS
from reachwell.functions.stats import ratio
from reachwell.functions.weights import incremental, weight_of

#: Columns of a projection by basis (fixed values).
BASES = {"headcount": "supply_headcount", "clinical_fte": "supply_clinical_fte"}


def projection(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A projection, given as a table or as the path of one."""
    return source if isinstance(source, DataFrame) else spark.read.parquet(source)


def national_supply(rows: DataFrame, basis: str = "headcount", check: bool = True) -> DataFrame:
    """The national row of each scenario and year: scenario_id, year, national_supply.

    There must be exactly one, with a positive supply.
    """
    if basis not in BASES:
        raise guards.CatchmentError(f"basis must be one of {sorted(BASES)}")
    own = rows.where("geography_type = 'national'").select("scenario_id", "year", F.col(BASES[basis]).alias("national_supply"))
    if check:
        guards.unique_key(own, "scenario_id", "year", what="more than one national row")
        guards.matched(rows.select(F.concat_ws("/", "scenario_id", "year").alias("k")), own.select(F.concat_ws("/", "scenario_id", "year").alias("k")), "k", "no national row")
        guards._refuse("national supply isn't positive", own.where(~guards.finite(F.col("national_supply")) | (F.col("national_supply") <= 0)), "scenario_id", "year")
    return own


def state_supply(national: DataFrame, weights: DataFrame) -> DataFrame:
    """Whole providers of each state that sum to the rounded national supply, by largest remainders.

    ``weights`` has state and weight. Ties of remainders go to the earlier
    state. The national supply is rounded half to even.
    """
    total = weights.agg(F.sum("weight").alias("whole"))
    rows = national.crossJoin(F.broadcast(weights.crossJoin(F.broadcast(total))))  # a row for each state
    n = F.bround("national_supply", 0)
    rows = rows.withColumn("share", n * F.col("weight") / F.col("whole")).withColumn("base", F.floor("share"))
    by = Window.partitionBy("scenario_id", "year")
    left = (n - F.sum("base").over(by)).alias("left")
    place = F.row_number().over(by.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), "state"))
    rows = rows.select("*", left, place.alias("place"))
    return rows.select("scenario_id", "year", "state", (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("double").alias("supply"))


def origin_supply(states: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each origin's supply scaled so that its state meets the target, and the targets of states without an origin.

    ``origins`` has coord_id, state and supply. A state that the scenario
    leaves out has no supply; origins without any are dropped.
    """
    base = origins.withColumn("base", F.sum("supply").over(Window.partitionBy("state")))
    keys = [c for c in ("scenario_id", "year") if c in states.columns]
    scaled = base.join(states.select(*keys, "state", F.col("supply").alias("target")), "state")
    scaled = scaled.select(*keys, "coord_id", "state", F.when(F.col("base") > 0, F.col("supply") * F.col("target") / F.col("base")).otherwise(0.0).alias("supply")).where("supply > 0")
    placed = origins.groupBy("state").agg(F.sum("supply").alias("s")).where("s > 0").select("state")
    return scaled, states.where("supply > 0").join(placed, "state", "left_anti")


def scenario_access(overlap: DataFrame, tract_pop: DataFrame, supply: DataFrame, keys: Sequence[str] = ("scenario_id", "year")) -> DataFrame:
    """Access of every tract under each scenario in one job: keys, mean, zero share, tracts reached.

    Demand doesn't depend on the scenario, so it is summed once; the ratios of
    all scenarios then go over the same edges.
    """
    first = incremental(BAND_WEIGHTS)
    rows = overlap.join(tract_pop.select("geoid", "pop"), "geoid").withColumn("wf", weight_of(F.col("band"), first) * F.col("overlap_fraction")).where("wf is not null")
    demand = rows.groupBy("coord_id").agg(F.sum(F.col("wf") * F.col("pop")).alias("d"))
    ratios = supply.join(demand.where("d > 0"), "coord_id").select(*keys, "coord_id", (F.col("supply") / F.col("d")).alias("r"))
    by_pair = rows.groupBy("coord_id", "geoid").agg(F.sum("wf").alias("wf"))
    found = by_pair.join(ratios, "coord_id").groupBy(*keys, "geoid").agg(F.sum(F.col("wf") * F.col("r")).alias("access"))
    # Tracts out of reach add population but no access: their part comes from the total.
    total = tract_pop.agg(F.sum("pop").alias("total"))
    own = found.join(tract_pop.select("geoid", "pop"), "geoid").groupBy(*keys).agg(
        F.sum(F.col("access") * F.col("pop")).alias("ap"), F.sum(F.when(F.col("access") > 0, F.col("pop")).otherwise(0.0)).alias("served"), F.count_if(F.col("access") > 0).alias("n_reached_tracts")
    )
    own = own.crossJoin(F.broadcast(total))
    return own.select(*keys, (1e5 * ratio(F.col("ap"), F.col("total"))).alias("mean_access_per100k"), (1 - ratio(F.col("served"), F.col("total"))).alias("zero_access_pop_share"), "n_reached_tracts")


def project(rows: DataFrame, scenarios: Sequence[str], years: Sequence[int], weights: DataFrame, origins: DataFrame, accessibility: Callable[..., DataFrame], basis: str = "headcount") -> DataFrame:
    """The results of a given ``accessibility(supply, scenario_id, year)`` for all scenarios and years, stacked."""
    known = {r[0] for r in rows.select("scenario_id").distinct().collect()}
    if unknown := sorted(set(scenarios) - known):
        raise guards.CatchmentError(f"unknown scenarios: {', '.join(unknown)}")
    out = None
    for scenario in scenarios:
        for year in years:
            one = rows.where((F.col("scenario_id") == scenario) & (F.col("year") == year))
            supply, _ = origin_supply(state_supply(national_supply(one, basis), weights), origins)
            found = accessibility(supply.select("coord_id", "supply"), scenario, year)
            if not isinstance(found, DataFrame):
                raise guards.CatchmentError("accessibility must return a DataFrame")
            found = found.withColumns({"scenario_id": F.lit(scenario), "year": F.lit(year)})
            out = found if out is None else out.unionByName(found)
    return out


def with_gap(access: DataFrame, rows: DataFrame) -> DataFrame:
    """Access beside the projection's demand and gap, in order of scenario and year."""
    own = rows.where("geography_type = 'national'").select("scenario_id", "year", "demand_clinical_fte", "gap_fte")
    return access.join(own, ["scenario_id", "year"], "left").orderBy("scenario_id", "year")


def change_from_baseline(cube: DataFrame, value: str, *keys: str, baseline: str = "baseline") -> DataFrame:
    """Adds the change of a value from the baseline scenario at the same keys."""
    base = F.max(F.when(F.col("scenario_id") == baseline, F.col(value))).over(Window.partitionBy(*keys))
    return cube.withColumn("change", F.col(value) - base)
