"""Weights of a provider's places of work, from claims where there are any and from a model elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.functions.scalars import haversine_km, parse_bool, parse_date
from reachwell.functions.stats import ratio
from reachwell.storage import kept

#: What is missing to a threshold through the order in which doubles were added counts as reached.
NOISE = 1e-9


def canonical(locations: DataFrame, check: bool = True) -> DataFrame:
    """One row of each provider and address, with the distance from the primary place.

    ``locations`` has npi, address_key, place (its order), zip5, lat, lon,
    is_primary and rural; the first value that isn't missing is taken. Each
    provider must have one primary place and all must have coordinates.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    flag = lambda c: F.coalesce(F.bool_or(parse_bool(F.col(c))), F.lit(False)).alias(c)
    by = locations.groupBy("npi", "address_key").agg(first("zip5"), first("lat"), first("lon"), flag("is_primary"), flag("rural"))
    by = by.withColumn("location_id", F.concat_ws("::", "npi", "address_key"))
    if check:
        by = kept(by)  # read by the checks and by what follows
        guards.refuse_any(
            ("provider without exactly one primary place", by.groupBy("npi").agg(F.count_if("is_primary").alias("n")).where("n != 1"), "npi"),
            ("place without coordinates", by.where("lat is null or lon is null"), "location_id"),
        )
    each = Window.partitionBy("npi")
    home = lambda c: F.max(F.when(F.col("is_primary"), F.col(c))).over(each)
    by = by.withColumn("distance_km", haversine_km(home("lat"), home("lon"), F.col("lat"), F.col("lon"))).withColumn("n_locations", F.count("*").over(each))
    return by.withColumn("log_locations", F.log("n_locations"))


def rendering_lookup(providers: DataFrame) -> DataFrame:
    """Payer's provider ids that stand for one npi alone: payer_id, provider_id, npi."""
    by = providers.where("npi is not null and npi != ''").groupBy("payer_id", "provider_id").agg(F.count_distinct("npi").alias("n"), F.min("npi").alias("npi"))
    return by.where("n = 1").drop("n")


def relevant_claims(claims: DataFrame, providers: DataFrame, targets: DataFrame, places: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Claim lines of the target providers at places that are known and not ambiguous: npi, service_date, address_key, zip5, hcpcs.

    ``claims`` has payer_id, rendering_provider_id, provider_location_id,
    service_date, hcpcs and denied; ``places`` payer_id, location_id,
    address_key and zip5.
    """
    own = claims.where("denied is null or denied != '1'").join(rendering_lookup(providers).withColumnRenamed("provider_id", "rendering_provider_id"), ["payer_id", "rendering_provider_id"])
    own = own.join(targets.select("npi").distinct(), "npi", "left_semi").withColumn("service_date", parse_date(F.col("service_date")))
    own = own.where("service_date is not null and provider_location_id is not null and provider_location_id != ''")
    if start:
        own = own.where(F.col("service_date") >= F.lit(start).cast("date"))
    if end:
        own = own.where(F.col("service_date") <= F.lit(end).cast("date"))
    # A location with several addresses is ambiguous; one with a single address needs no choice.
    single = places.groupBy("payer_id", "location_id").agg(F.count_distinct("address_key").alias("n"), F.min("address_key").alias("address_key"), F.min("zip5").alias("zip5")).where("n = 1").drop("n")
    found = own.join(single.withColumnRenamed("location_id", "provider_location_id"), ["payer_id", "provider_location_id"])
    return found.select("npi", "service_date", "address_key", "zip5", "hcpcs")


def day_fractions(lines: DataFrame, check: bool = True) -> DataFrame:
    """A provider's day divided over its places: npi, service_date, address_key, zip5, day_fraction.

    By work units where the day has any, else by lines; a single place has the
    whole day. ``lines`` also has work_rvu, null where unknown.
    """
    by = lines.groupBy("npi", "service_date", "address_key", "zip5").agg(F.count("*").alias("lines"), F.coalesce(F.sum("work_rvu"), F.lit(0.0)).alias("work"))
    day = Window.partitionBy("npi", "service_date")
    n, work, all_lines = F.count("*").over(day), F.sum("work").over(day), F.sum("lines").over(day)
    share = F.when(n == 1, 1.0).when(work > 0, F.col("work") / F.nullif(work, F.lit(0.0))).otherwise(F.col("lines") / all_lines)
    out = by.withColumn("day_fraction", share).drop("lines", "work")
    return guards.sums_to_one(kept(out), "day_fraction", "npi", "service_date") if check else out


def observed(days: DataFrame) -> DataFrame:
    """Days at each place and its share of the provider's days: npi, address_key, zip5, day_equiv, observed_days, empirical_weight."""
    by = days.groupBy("npi", "address_key", "zip5").agg(F.sum("day_fraction").alias("day_equiv"), F.count_distinct("service_date").alias("observed_dates"))
    whole = F.sum("day_equiv").over(Window.partitionBy("npi"))
    return by.withColumn("observed_days", whole).withColumn("empirical_weight", F.col("day_equiv") / whole)


def match_sites(seen: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed places matched to canonical ones, by address or else by a zip that the provider has once; and the rest."""
    exact = seen.join(places.select("npi", "address_key", "location_id"), ["npi", "address_key"]).withColumn("method", F.lit("exact_address"))
    left = seen.join(places.select("npi", "address_key"), ["npi", "address_key"], "left_anti")
    once = places.where("zip5 is not null").groupBy("npi", "zip5").agg(F.count("*").alias("n"), F.min("location_id").alias("location_id")).where("n = 1").drop("n")
    by_zip = left.where("zip5 is not null").join(once, ["npi", "zip5"]).withColumn("method", F.lit("unique_npi_zip"))
    matched = exact.unionByName(by_zip).groupBy("npi", "location_id").agg(
        F.sum("day_equiv").alias("day_equiv"), F.max("observed_days").alias("observed_days"), F.sum("empirical_weight").alias("matched_weight"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("match_method")
    )
    return matched, left.join(once.select("npi", "zip5"), ["npi", "zip5"], "left_anti")


def training_rows(places: DataFrame, matched: DataFrame, least_coverage: float, least_days: float) -> DataFrame:
    """Places of providers with several of them and enough matched days, with their share of the days."""
    matched = kept(matched)
    enough = matched.groupBy("npi").agg(F.sum("matched_weight").alias("c"), F.max("observed_days").alias("d")).where((F.col("c") >= least_coverage - NOISE) & (F.col("d") >= least_days - NOISE)).select("npi")
    rows = places.where("n_locations >= 2").join(enough, "npi", "left_semi").join(matched.select("npi", "location_id", "day_equiv"), ["npi", "location_id"], "left").fillna(0.0, ["day_equiv"])
    return rows.withColumn("empirical_weight", ratio(F.col("day_equiv"), F.sum("day_equiv").over(Window.partitionBy("npi"))))


def share_model(rows: DataFrame, predictors: Sequence[str] = ("is_primary", "log_locations", "distance_km")):
    """A logistic model of the shares; returns a function that adds predicted_weight, shares within a provider."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    def numbers(df: DataFrame) -> DataFrame:
        return df.select("*", *[F.col(p).cast("double").alias(f"_{p}") for p in predictors])

    model = Pipeline(stages=[VectorAssembler(inputCols=[f"_{p}" for p in predictors], outputCol="_x"), GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol="empirical_weight", predictionCol="_p", regParam=1e-6)]).fit(numbers(rows))

    def predict(df: DataFrame) -> DataFrame:
        scored = model.transform(numbers(df)).withColumn("_p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_p"))))
        return scored.withColumn("predicted_weight", F.col("_p") / F.sum("_p").over(Window.partitionBy("npi"))).drop("_p", "_x", *[f"_{p}" for p in predictors])

    return predict


def cross_validated(rows: DataFrame, folds: int = 5, predictors: Sequence[str] = ("is_primary", "log_locations", "distance_km")) -> DataFrame:
    """Predictions for each provider by a model without its fold; folds by a hash of the npi."""
    fold = F.pmod(F.xxhash64("npi"), F.lit(folds))
    rows = kept(rows)  # each round of each fit reads them
    out = None
    for k in range(folds):
        one = share_model(rows.where(fold != k), predictors)(rows.where(fold == k))
        out = one if out is None else out.unionByName(one)
    return out


def schemes(places: DataFrame, direct: DataFrame, check: bool = True) -> DataFrame:
    """All weights of each place: empirical or modelled, primary alone, equal, and heavy on the primary.

    ``places`` has npi, location_id, is_primary, n_locations and
    predicted_weight; ``direct`` npi, location_id and direct_weight, used for
    providers that have one for each place. All sum to one by provider.
    """
    rows = places.join(direct, ["npi", "location_id"], "left")
    full = F.min(F.col("direct_weight").isNotNull().cast("int")).over(Window.partitionBy("npi")) == 1
    one, n, main = F.col("n_locations") == 1, F.col("n_locations"), F.col("is_primary")
    rows = rows.select(
        "*",
        F.when(one, 1.0).when(full, F.col("direct_weight")).otherwise(F.col("predicted_weight")).alias("empirical_model_weight"),
        F.when(one, "single_location").when(full, "claims_direct").otherwise("claims_calibrated_model").alias("weight_source"),
        main.cast("double").alias("primary_only_weight"),
        (1 / n).alias("equal_weight"),
        F.when(one, 1.0).when(main, 0.80).otherwise(0.20 / F.nullif(n - 1, F.lit(0))).alias("primary_heavy_weight"),
    ).drop("direct_weight")
    if check:
        guards.all_sum_to_one(rows := kept(rows), ["empirical_model_weight", "primary_only_weight", "equal_weight", "primary_heavy_weight"], "npi")
    return rows


def capacities(weighted: DataFrame, capacity: DataFrame | None = None) -> DataFrame:
    """Each place's capacity under each scheme; a provider's total is 1 unless ``capacity`` (npi, total) says otherwise."""
    if capacity is None:
        rows = weighted.withColumn("total", F.lit(1.0))
    else:
        guards.matched(weighted, capacity, "npi", "provider without a capacity")
        rows = weighted.join(guards.unique_key(capacity, "npi"), "npi")
    names = ("empirical_model_weight", "primary_only_weight", "equal_weight", "primary_heavy_weight")
    return rows.select("*", *[(F.col("total") * F.col(c)).alias(c.replace("weight", "capacity")) for c in names])


def utilisation_check(weighted: DataFrame, utilisation: DataFrame) -> DataFrame:
    """Each provider's services and beneficiary days elsewhere beside its weights: npi, services, beneficiary_days, n_locations, secondary_share, weight_source.

    ``weighted`` is that of :func:`schemes`; ``utilisation`` npi, services and
    beneficiary_days, summed by provider. Providers without weights stay.
    """
    sums = utilisation.groupBy("npi").agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in ("services", "beneficiary_days")])
    by = weighted.groupBy("npi").agg(F.max("n_locations").alias("n_locations"), (1 - F.max(F.when(F.col("is_primary"), F.col("empirical_model_weight")))).alias("secondary_share"), F.array_join(F.array_sort(F.collect_set("weight_source")), "+").alias("weight_source"))
    return sums.join(by, "npi", "left")


def visit_check(weighted: DataFrame, visits: DataFrame) -> DataFrame:
    """Days seen in another source at places that have weights: npi, location_id, empirical_model_weight, is_primary, match_method, days.

    ``visits`` has npi, address_key, zip5 and service_date. A visit matches by
    address, or else by a zip that the provider has once.
    """
    columns = ("location_id", "empirical_model_weight", "is_primary")
    exact = visits.join(weighted.select("npi", "address_key", *columns), ["npi", "address_key"]).withColumn("match_method", F.lit("exact_address"))
    left = visits.join(weighted.select("npi", "address_key"), ["npi", "address_key"], "left_anti")
    alone = F.count("*").over(Window.partitionBy("npi", "zip5"))
    once = weighted.where("zip5 is not null").withColumn("_n", alone).where("_n = 1").select("npi", "zip5", *columns)
    by_zip = left.join(once, ["npi", "zip5"]).withColumn("match_method", F.lit("unique_npi_zip"))
    return exact.unionByName(by_zip).groupBy("npi", *columns, "match_method").agg(F.count_distinct("service_date").alias("days"))
