"""Access by tract centroids in nested bands, and what is reported of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import AGE_BANDS, BAND_WEIGHTS, EPSILON
from reachwell.functions.stats import ratio
from reachwell.functions.weights import incremental, weight_of


def nested(tightest: DataFrame, bands: Sequence[int]) -> DataFrame:
    """Each (coord_id, geoid) in its tightest band and in all beyond: band, coord_id, geoid."""
    wider = F.filter(F.array(*[F.lit(b) for b in sorted(bands)]), lambda b: b >= F.col("band"))
    return tightest.select(F.explode(wider).alias("band"), "coord_id", "geoid")


def tract_access(membership: DataFrame, supply: DataFrame, demand: DataFrame, weights: Mapping[int, float] = BAND_WEIGHTS, check: bool = True) -> DataFrame:
    """Tracts that an origin reaches: geoid, access, zero_demand (an origin without demand reaches it).

    Demand is summed with incremental weights; a tract counts each origin with
    the largest weight of the bands that it is in. The divisor is floored at
    the double-precision epsilon, so an origin without any demand gives a huge
    value, which the flag marks. Missing keys are refused.
    """
    if check:
        guards.matched(membership, demand, "geoid", "tract in a band has no demand row")
        guards.matched(membership, supply, "coord_id", "origin in a band has no supply row")
    rows = membership.where(F.col("band").isin(*weights)).join(demand, "geoid").withColumn("d", F.coalesce("demand", F.lit(0.0)))
    # The pairs first: each band of a pair adds its increment of demand, and the largest weight is the pair's.
    pairs = rows.groupBy("coord_id", "geoid").agg(F.sum(weight_of(F.col("band"), incremental(weights)) * F.col("d")).alias("wd"), F.max(weight_of(F.col("band"), weights)).alias("w"))
    origins = pairs.groupBy("coord_id").agg(F.sum("wd").alias("total")).join(supply, "coord_id")
    ratios = origins.select("coord_id", (F.col("supply") / F.greatest(F.col("total"), F.lit(EPSILON))).alias("r"), ((F.col("total") <= 0) & (F.col("supply") > 0)).alias("empty"))
    found = pairs.join(ratios, "coord_id").groupBy("geoid")
    return found.agg(F.sum(F.col("w") * F.col("r")).alias("access"), F.bool_or("empty").alias("zero_demand"))


def no_access_share(access: DataFrame, demand: DataFrame, check: bool = True) -> DataFrame:
    """Percent of the demand in tracts without access, one row; a tract without a row of access has none."""
    if check:
        guards.unique_key(access, "geoid", what="access repeats a tract")
        guards.matched(access, demand, "geoid", "tract with access has no demand row")
    rows = demand.join(access.select("geoid", "access"), "geoid", "left").select(F.coalesce("access", F.lit(0.0)).alias("a"), F.coalesce("demand", F.lit(0.0)).alias("w"))
    return rows.agg(F.when(F.sum("w") > 0, 100 * F.sum(F.when(F.col("a") <= 0, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("no_access_share"))


def quintiles(df: DataFrame, access: str = "access", breaks: Sequence[float] | None = None) -> DataFrame:
    """Adds quintile: 1 without access, then quartiles of the positive values (or given breaks), closed on the right."""
    a = F.coalesce(F.col(access), F.lit(0.0))
    if breaks is None:
        cuts = df.where(F.col(access) > 0).agg(F.percentile(access, [0.25, 0.5, 0.75]).alias("_cuts"))
        df = df.crossJoin(F.broadcast(cuts))  # one row
        cut = [F.get(F.col("_cuts"), i) for i in range(3)]
    else:
        cut = [F.lit(float(b)) for b in breaks]
    q = F.when(a <= 0, 1).when(a <= cut[0], 2).when(a <= cut[1], 3).when(a <= cut[2], 4).otherwise(5)
    return df.withColumn("quintile", q.cast("int")).drop("_cuts")


def groups_by_quintile(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Population of each group (a column each) in each quintile, zeros included: group, quintile, n, pct."""
    # One row for each quintile: sums first, then a few rows are turned.
    sums = df.groupBy("quintile").agg(*[F.coalesce(F.sum(g), F.lit(0.0)).alias(g) for g in groups])
    long = sums.unpivot("quintile", list(groups), "group", "n")
    every = df.sparkSession.createDataFrame([(g, q) for g in groups for q in range(1, 6)], "group string, quintile int")
    found = every.join(long, ["group", "quintile"], "left").fillna(0.0, ["n"])
    total = found.groupBy("group").agg(F.sum("n").alias("total"))
    return found.join(total, "group").select("group", "quintile", "n", F.coalesce(100 * ratio(F.col("n"), F.col("total")), F.lit(0.0)).alias("pct"))


def denominators(membership: DataFrame, supply: DataFrame, demands: DataFrame, names: Sequence[str], weights: Mapping[int, float] = BAND_WEIGHTS) -> DataFrame:
    """Mean access and metro-to-rural ratio under each definition of demand (a column each): demand, mean, ratio, rank.

    ``demands`` also has rurality. The rural mean is floored at the epsilon.
    """
    out = None
    for name in names:
        own = demands.select("geoid", F.col(name).alias("demand"), "rurality")
        rows = own.join(tract_access(membership, supply, own.select("geoid", "demand"), weights, check=False), "geoid", "left").fillna(0.0, ["access"])
        mean = lambda c: ratio(F.sum(F.when(c, F.col("access") * F.col("demand"))), F.sum(F.when(c, F.col("demand"))))
        one = rows.where("demand > 0").agg(mean(F.lit(True)).alias("mean"), mean(F.col("rurality") == "Metropolitan").alias("metro"), mean(F.col("rurality") == "Rural").alias("rural"))
        one = one.select(F.lit(name).alias("denominator"), "mean", (F.col("metro") / F.greatest(F.col("rural"), F.lit(EPSILON))).alias("metro_rural_ratio"))
        out = one if out is None else out.unionByName(one)
    return out


def age_band_demand(ages: DataFrame, bands: Mapping[str, tuple[int, int]] = AGE_BANDS, prefix: str = "a") -> DataFrame:
    """Demand of each definition by tract, from columns of single ages' groups (a27, a28, ...): geoid and a column each; null counts as 0."""
    names = {c.lower() for c in ages.columns}
    missing = sorted({f"{prefix}{i}" for low, high in bands.values() for i in range(low, high + 1)} - names)
    if missing:
        raise guards.CatchmentError(f"no columns {', '.join(missing)}")
    sums = [reduce(add, [F.coalesce(F.col(f"{prefix}{i}").cast("double"), F.lit(0.0)) for i in range(low, high + 1)]).alias(n) for n, (low, high) in bands.items()]
    return ages.select("geoid", *sums)
