"""Populations on grid cells: allocation, zonal sums, surfaces and their summaries.

Cells are rows of a long table, and a bridge (geoid, cell_id, area) says how
much of a tract lies in a cell; nothing is a dense raster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import PER_CAPITA, THRESHOLDS
from reachwell.functions.stats import ratio


def apart(df: DataFrame) -> DataFrame:
    """The side of a join that both sides are shuffled for.

    Cells and runs are many times what the files they come from let Spark
    expect, so it would send them whole to the driver and to every executor.
    """
    return df.hint("merge")


def cells_of(tracts: DataFrame, size: float) -> DataFrame:
    """Cells whose centres lie in a tract's bounding box (x0, y0, x1, y1; the low edges inclusive): geoid, cell_x, cell_y.

    Cells are numbered from the origin; the centre of number i is at (i + 1/2) * size.
    """
    def span(low: str, high: str) -> F.Column:
        first = F.ceil(F.col(low) / size - 0.5).cast("long")
        last = F.ceil(F.col(high) / size - 0.5).cast("long") - 1
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    rows = tracts.select("geoid", F.explode(span("x0", "x1")).alias("cell_x"), span("y0", "y1").alias("ys"))
    return rows.select("geoid", "cell_x", F.explode("ys").alias("cell_y"))


def allocate_by_area(pop: DataFrame, bridge: DataFrame, tolerance: float = 1e-6, check: bool = True) -> DataFrame:
    """Each tract's population over its cells in proportion to area: cell_id, pop.

    Unknown populations are none. A negative population, a non-finite or
    negative area, and a populated tract without area are refused, and the
    total must be conserved.
    """
    tracts = pop.select("geoid", F.when(guards.finite(F.col("pop")), F.col("pop").cast("double")).otherwise(0.0).alias("pop"))
    areas = bridge.groupBy("geoid").agg(F.sum("area").alias("whole"))
    if check:
        guards.refuse_any(
            ("population repeats a tract", guards.repeated(tracts, "geoid"), "geoid"),
            ("negative population", tracts.where("pop < 0"), "geoid"),
            ("area that isn't a non-negative number", bridge.where(~guards.finite(F.col("area")) | (F.col("area") < 0)), "geoid"),
            ("populated tract without any cell area", tracts.where("pop > 0").join(apart(areas.where("whole > 0")), "geoid", "left_anti"), "geoid"),
        )
    shares = bridge.join(apart(tracts), "geoid").join(apart(areas.where("whole > 0")), "geoid")
    cells = shares.groupBy("cell_id").agg(F.sum(F.col("pop") * F.col("area") / F.col("whole")).alias("pop"))
    if check:
        before, after = tracts.agg(F.coalesce(F.sum("pop"), F.lit(0.0)).alias("a")).crossJoin(cells.agg(F.coalesce(F.sum("pop"), F.lit(0.0)).alias("b"))).head()  # one row each
        guards.conserved(before, after, tolerance, "population on the grid")
    return cells


def allocate_by_center(pop: DataFrame, cells: DataFrame) -> DataFrame:
    """Each tract's population in equal parts over the cells whose centres it holds (geoid, cell_id): cell_id, pop."""
    counts = cells.groupBy("geoid").agg(F.count("*").alias("n"))
    per = pop.join(apart(counts), "geoid").select("geoid", (F.col("pop") / F.col("n")).alias("pop"))
    return cells.join(apart(per), "geoid").groupBy("cell_id").agg(F.sum("pop").alias("pop"))


def zonal_sum(cells: DataFrame, cover: DataFrame) -> DataFrame:
    """Population in each zone (coord_id, band), cells counted by the fraction covered: coord_id, band, pop."""
    return cover.join(apart(cells), "cell_id").groupBy("coord_id", "band").agg(F.sum(F.col("pop") * F.col("fraction")).alias("pop"))


def surface(cells: DataFrame, inside: DataFrame, ratios: DataFrame, step2: DataFrame) -> DataFrame:
    """Access of every cell: the weighted ratios of the zones that hold its centre (coord_id, band, cell_id), else 0.

    ``step2`` has band and w, a few rows.
    """
    parts = inside.join(F.broadcast(step2), "band").join(ratios, "coord_id").groupBy("cell_id").agg(F.sum(F.col("w") * F.col("ratio")).alias("access"))
    return cells.join(parts, "cell_id", "left").select("cell_id", "pop", F.coalesce("access", F.lit(0.0)).alias("access"))


def zonal_means(surface: DataFrame, bridge: DataFrame, *by: str) -> DataFrame:
    """Mean access of each tract by area, and by area and population: by (of the surface), geoid, mean, weighted_mean."""
    rows = bridge.join(apart(surface), "cell_id").where(guards.finite(F.col("access")))
    by_pop = F.col("area") * F.coalesce("pop", F.lit(0.0))
    return rows.groupBy(*by, "geoid").agg(ratio(F.sum(F.col("access") * F.col("area")), F.sum("area")).alias("mean"), ratio(F.sum(F.col("access") * by_pop), F.sum(by_pop)).alias("weighted_mean"))


def zero_area_fraction(surface: DataFrame, bridge: DataFrame) -> DataFrame:
    """The fraction of each tract's area whose access is zero or unknown: geoid, fraction."""
    zero = ~guards.finite(F.col("access")) | (F.col("access") <= 0)
    rows = bridge.join(apart(surface), "cell_id", "left")
    return rows.groupBy("geoid").agg(ratio(F.sum(F.when(zero, F.col("area")).otherwise(0.0)), F.sum("area")).alias("fraction"))


def cell_summaries(surface: DataFrame, thresholds: Sequence[float] = THRESHOLDS, scale: float = PER_CAPITA) -> DataFrame:
    """One row for each threshold, with the totals: population and share at or above it.

    A cell counts if its access is finite and its population finite and not negative.
    """
    a, p = F.col("access"), F.col("pop")
    known = guards.finite(p) & (p >= 0)
    use = guards.finite(a) & known
    at = [F.struct(F.lit(float(k)).alias("threshold"), F.sum(F.when(use & (a * scale >= k), p).otherwise(0.0)).alias("pop_ge")) for k in thresholds]
    total = surface.agg(
        F.count("*").alias("n_cells_total"),
        F.count_if(use).alias("n_cells_valid"),
        F.coalesce(F.sum(F.when(known, p)), F.lit(0.0)).alias("pop_raster_total"),
        F.coalesce(F.sum(F.when(use, p)), F.lit(0.0)).alias("pop_valid_total"),
        F.coalesce(F.sum(F.when(known & ~guards.finite(a), p)), F.lit(0.0)).alias("pop_excluded_missing_access"),
        ratio(F.sum(F.when(use, p * a * scale)), F.sum(F.when(use, p))).alias("mean_scaled"),
        F.array(*at).alias("at"),
    )
    rows = total.select("*", F.explode("at").alias("x")).select("*", "x.threshold", "x.pop_ge").drop("at", "x")
    return rows.withColumn("share_pop", ratio(F.col("pop_ge"), F.col("pop_valid_total")))


def zero_access_audit(surface: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: populations that are eligible, evaluable, unresolved and without access, and the share without.

    The share is null if nothing is evaluable or more than ``tolerance`` is
    unresolved. ``n_excluded`` counts the cells without a known population.
    """
    a, w = F.col("access"), F.col("pop")
    known = w.isNotNull() & ~F.isnan(w)
    ok, seen = known & (w > 0), a.isNotNull() & ~F.isnan(a)

    def total(c: F.Column) -> F.Column:
        return F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))

    found = surface.agg(
        total(known).alias("eligible_population"),
        total(ok & seen).alias("evaluable_population"),
        total(ok & seen & (a <= 0)).alias("zero_access_population"),
        F.lit(0.0).alias("excluded_population"),
        F.count_if(~known).alias("n_excluded"),
        total(ok & ~seen).alias("unresolved_population"),
    )
    e, n = F.col("eligible_population"), F.col("evaluable_population")
    found = found.withColumn("pct_evaluable", F.when(e > 0, 100 * n / e))
    return found.withColumn("zero_share", F.when((n > 0) & (F.col("unresolved_population") <= tolerance), 100 * F.col("zero_access_population") / n))


def zero_share_or_fail(surface: DataFrame, tolerance: float = 0.0) -> float:
    """The audited share, or an error where it is unknown."""
    row = zero_access_audit(surface, tolerance).head()
    if row["zero_share"] is None:
        raise guards.CatchmentError(f"zero-access share unknown: {row['unresolved_population']} of {row['eligible_population']} unresolved")
    return row["zero_share"]


def subgroup_means(surface: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Access averaged over each subgroup's population (a column each; unknown is none): one row."""
    a = F.coalesce("access", F.lit(0.0))
    return surface.agg(*[ratio(F.sum(a * F.coalesce(g, F.lit(0.0))), F.sum(F.coalesce(g, F.lit(0.0)))).alias(g) for g in groups])


def dominating(bridge: DataFrame, region: str) -> DataFrame:
    """The region with the largest area in each cell; ties go to the lower name: cell_id, region."""
    by = bridge.groupBy("cell_id", region).agg(F.sum("area").alias("area"))
    best = Window.partitionBy("cell_id").orderBy(F.desc("area"), region)
    return by.withColumn("n", F.row_number().over(best)).where("n = 1").select("cell_id", F.col(region).alias("region"))
