"""Provider supply at each origin, and what the workforce tables are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import SURFACE_KM
from reachwell.functions.geometry import albers
from reachwell.functions.scalars import haversine_km, within_surface, zip5
from reachwell.functions.stats import ratio
from reachwell.operators.geometry import nearest

#: States and territories outside the contiguous ones (fixed values).
NON_CONTIGUOUS = ("AK", "HI", "PR", "GU", "VI", "AS", "MP")


def provider_supply(panel: DataFrame, cohort: DataFrame, code: str, year: int) -> DataFrame:
    """Distinct providers of one specialty at each origin in one year: coord_id, supply.

    ``panel`` has npi, analysis_year, coord_id and match_source; ``cohort``
    npi and specialty. Placeholder rows, without a source, don't count.
    """
    found = supply_cells(panel, cohort.where(F.col("specialty") == code))
    return found.where(F.col("analysis_year") == year).select("coord_id", "supply")


def supply_cells(panel: DataFrame, cohort: DataFrame) -> DataFrame:
    """All specialties and years at once: specialty, analysis_year, coord_id, supply."""
    members = cohort.where("specialty is not null").select("npi", "specialty").distinct()
    placed = panel.where("match_source is not null and coord_id is not null and analysis_year is not null")
    by = placed.select("npi", "analysis_year", "coord_id").join(members, "npi").groupBy("specialty", "analysis_year", "coord_id")
    return by.agg(F.count_distinct("npi").cast("double").alias("supply"))


def relabelled(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """The column's values renamed; others become null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return df.withColumn(column, F.create_map(*pairs)[F.col(column)])


def physicians_by_year(panel: DataFrame, cohort: DataFrame) -> DataFrame:
    """Distinct providers of each specialty and year, wherever they are: specialty, analysis_year, n_providers."""
    members = cohort.where("specialty is not null").select("npi", "specialty").distinct()
    return panel.where("match_source is not null").join(members, "npi").groupBy("specialty", "analysis_year").agg(F.count_distinct("npi").alias("n_providers"))


def growth(counts: DataFrame, key: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """First and last year side by side, with the growth in percent."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(value)))
    both = counts.groupBy(key).agg(at(first).alias("n_first"), at(last).alias("n_last"))
    return both.withColumn("growth_pct", 100 * ratio(F.col("n_last") - F.col("n_first"), F.col("n_first").cast("double")))


def workforce_table(active: DataFrame, key: str = "specialty") -> DataFrame:
    """Counts by career stage and rurality, the median years and shares: from specialty, stage, rurality, years."""
    early, metro, rural = F.col("stage") == "Early-to-mid", F.col("rurality") == "Metropolitan", F.col("rurality") == "Rural"
    late = F.col("stage") == "Late"
    found = active.groupBy(key).agg(
        F.count("*").alias("total"),
        *[F.count_if(c).alias(n) for n, c in (("early", early), ("late", late), ("metro", metro), ("rural", rural), ("early_metro", early & metro), ("late_metro", late & metro), ("early_rural", early & rural), ("late_rural", late & rural))],
        F.median("years").alias("median_years"),
    )
    return found.withColumn("pct_early", 100 * F.col("early") / F.col("total")).withColumn("pct_rural", 100 * F.col("rural") / F.col("total"))


def augmented(supply: DataFrame, recovered: DataFrame) -> DataFrame:
    """Supply with recovered providers added at their origins (coord_id, n), new origins included."""
    more = recovered.groupBy("coord_id").agg(F.sum("n").cast("double").alias("more"))
    return supply.join(more, "coord_id", "full").select("coord_id", (F.coalesce("supply", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("supply"))


def recovered_flow(flow: DataFrame, original: DataFrame, recovered: DataFrame) -> DataFrame:
    """How recovery changes the workforce flow, by specialty.

    ``original`` and ``recovered`` have npi and specialty; a provider of both
    counts as original. ``flow`` has specialty, active and geocoded.
    """
    both = original.select("npi", "specialty", F.lit(0).alias("from")).unionByName(recovered.select("npi", "specialty", F.lit(1).alias("from")))
    firsts = both.groupBy("npi", "specialty").agg(F.min("from").alias("from"))
    counts = firsts.groupBy("specialty").agg(F.count("*").alias("mapped"), F.count_if(F.col("from") == 1).alias("recovered"))
    found = flow.join(counts, "specialty", "left").fillna(0, ["mapped", "recovered"])
    found = found.withColumn("geocoded_recovered", F.col("geocoded") + F.col("recovered"))
    return found.withColumn("ungeocoded_after", F.col("active") - F.col("geocoded_recovered"))


def derived_workforce(means: DataFrame) -> DataFrame:
    """Providers that a mean per 100,000 and a population imply, rounded half to even: adds n_derived."""
    return means.withColumn("n_derived", F.bround(F.col("mean_per_100k") * F.col("pop") / 1e5, 0).cast("long"))


def cross_checked(staged: DataFrame, derived: DataFrame, most: int = 1) -> DataFrame:
    """``staged`` (specialty, n_providers) with the derived count and the difference, if both have the same specialties and counts agree up to ``most``."""
    guards.unique_key(staged, "specialty", what="a specialty repeats")
    both = staged.select("specialty", "n_providers").join(derived.select("specialty", "n_derived"), "specialty", "full")
    both = both.withColumn("diff", F.col("n_providers") - F.col("n_derived"))
    guards._refuse("counts of providers disagree", both.where(F.coalesce((F.abs("diff") > most) | (F.col("n_providers") <= 0), F.lit(True))), "specialty")
    return both


def near_surface(recovered: DataFrame, origins: DataFrame, size: float, km: float = SURFACE_KM) -> DataFrame:
    """Recovered providers by their nearest origin: coord_id, n; those farther than ``km`` from every origin are left out.

    ``recovered`` has id, ``origins`` coord_id, both lat and lon. The nearest
    is looked for on a projection of equal areas in cells of ``size`` metres,
    and its distance measured on the sphere.
    """
    place = lambda df, key: df.select(F.col(key).alias("id"), *[c.alias(n) for c, n in zip(albers(F.col("lon"), F.col("lat")), "xy", strict=True)])
    found = nearest(place(recovered, "id"), place(origins, "coord_id"), 1, size).select("id", F.col("other").alias("coord_id"))
    both = found.join(recovered.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "id").join(origins.select("coord_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "coord_id")
    return both.where(within_surface(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), km)).groupBy("coord_id").agg(F.count("*").alias("n"))


def endpoint_change(series: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """First and last year's value, the least and when it was, and the change."""
    at = F.struct(F.col(value), F.col(year))
    found = series.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.min_by(value, year).alias("first_value"), F.max_by(value, year).alias("last_value"), F.min(value).alias("least_value"), F.min(at)[year].alias("least_year")
    )
    found = found.withColumn("abs_change", F.col("last_value") - F.col("first_value"))
    found = found.withColumn("rel_change", ratio(F.col("abs_change"), F.col("first_value")))
    return found.withColumn("direction", F.when(F.col("abs_change") > 0, "up").when(F.col("abs_change") < 0, "down").otherwise("flat"))


def satellite_sensitivity(places: DataFrame, *keys: str) -> DataFrame:
    """Providers with a second place of work and the zips that only such places reach, by year or specialty.

    ``places`` has npi, primary_zip, secondary_zip, primary_state and
    secondary_state. A null state isn't outside the contiguous ones.
    """
    def inside(c: str) -> Column:
        return F.coalesce(~F.col(c).isin(*NON_CONTIGUOUS), F.lit(True))

    own = places.where(inside("primary_state") & inside("secondary_state"))
    own = own.select(*keys, "npi", zip5(F.col("primary_zip")).alias("p"), zip5(F.col("secondary_zip")).alias("s"))
    second = own.where("s is not null and (p is null or s != p)")
    fresh = second.join(own.select(*keys, F.col("p").alias("s")).where("s is not null").distinct(), [*keys, "s"], "left_anti")
    total = own.groupBy(*keys).agg(F.count_distinct("npi").alias("total"))
    with_second = second.groupBy(*keys).agg(F.count_distinct("npi").alias("with_satellite"))
    new = fresh.groupBy(*keys).agg(F.count_distinct("s").alias("new_zips"), F.count_distinct("npi").alias("docs_in_new"))
    found = total.join(with_second, list(keys), "left").join(new, list(keys), "left").fillna(0, ["with_satellite", "new_zips", "docs_in_new"])
    return found.withColumn("pct_satellite", F.coalesce(F.bround(100 * ratio(F.col("with_satellite"), F.col("total").cast("double")), 1), F.lit(0.0)))


def first_rows(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: the first in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
