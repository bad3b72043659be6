"""Coverage by percent of an area within a band, and comparisons of it between specialties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachwell.constants import DECAY_SCHEMES, REACHED_PERCENT
from reachwell.functions.inference import trends
from reachwell.functions.ranges import running
from reachwell.functions.stats import ratio


def is_reached(percent: Column, least: float = REACHED_PERCENT) -> Column:
    return F.coalesce(percent >= least, F.lit(False))


def fraction(percent: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100))


def summary(cover: DataFrame, *keys: str) -> DataFrame:
    """Population covered in percent, population, and tracts reached, by keys: from pop and percent."""
    f = fraction(F.col("percent"))
    return cover.groupBy(*keys).agg((100 * ratio(F.sum(F.col("pop") * f), F.sum("pop"))).alias("covered_pct"), F.sum("pop").alias("pop"), F.count_if(is_reached(F.col("percent"))).alias("n_reached"))


def pivoted(cover: DataFrame, rows: str, columns: str, names: Sequence[str]) -> DataFrame:
    """Covered percent with a column for each of the named values."""
    f = fraction(F.col("percent"))
    return cover.groupBy(rows).pivot(columns, list(names)).agg(100 * ratio(F.sum(F.col("pop") * f), F.sum("pop")))


def breadth(cover: DataFrame) -> DataFrame:
    """Population by the number of specialties that reach its tract: n_specialties, pop, pct. From geoid, pop, percent."""
    by = cover.groupBy("geoid").agg(F.max("pop").alias("pop"), F.count_if(is_reached(F.col("percent"))).alias("n_specialties"))
    sums = by.groupBy("n_specialties").agg(F.sum("pop").alias("pop"))
    return sums.withColumn("pct", 100 * F.col("pop") / F.sum("pop").over(Window.partitionBy(F.lit(0))))  # a row for each number


def exclusive(cover: DataFrame) -> DataFrame:
    """Population that each specialty reaches, and that it alone reaches: specialty, reached, alone, pct."""
    reached = cover.where(is_reached(F.col("percent"))).select("geoid", "specialty", "pop")
    counts = reached.groupBy("geoid").agg(F.count("*").alias("n"))
    by = reached.join(counts, "geoid").groupBy("specialty").agg(F.sum("pop").alias("reached"), F.sum(F.when(F.col("n") == 1, F.col("pop")).otherwise(0.0)).alias("alone"))
    return by.withColumn("pct", 100 * ratio(F.col("alone"), F.col("reached")))


def deserts(cover: DataFrame, *keys: str) -> DataFrame:
    """Rural population out of reach, its share of all, and the rural share of the unreached. From pop, percent, rurality."""
    out = ~is_reached(F.col("percent"))
    rural = F.coalesce(F.col("rurality") == "Rural", F.lit(False))
    pop = F.col("pop")
    return cover.groupBy(*keys).agg(
        F.sum(F.when(out & rural, pop).otherwise(0.0)).alias("desert_pop"),
        (100 * ratio(F.sum(F.when(out & rural, pop).otherwise(0.0)), F.sum(pop))).alias("pct_desert"),
        (100 * ratio(F.sum(F.when(out & rural, pop).otherwise(0.0)), F.sum(F.when(out, pop)))).alias("rural_pct_of_unreached"),
    )


def age_restricted(cover: DataFrame, bands: Mapping[str, str]) -> DataFrame:
    """Covered percent of all and of the age band that each specialty serves: specialty, full, restricted, diff.

    ``bands`` maps a specialty to the column of its population.
    """
    own = F.coalesce(*[F.when(F.col("specialty") == s, F.col(c)) for s, c in bands.items()])
    f = fraction(F.col("percent"))
    rows = cover.where(F.col("specialty").isin(*bands)).withColumn("own", own)
    by = rows.groupBy("specialty").agg((100 * ratio(F.sum(F.col("pop") * f), F.sum("pop"))).alias("full"), (100 * ratio(F.sum(F.col("own") * f), F.sum("own"))).alias("restricted"))
    return by.withColumn("diff", F.col("restricted") - F.col("full"))


def band_matrix(series: DataFrame, first: int, last: int) -> DataFrame:
    """Percent of each specialty and band in the first and last year and the change, with slope, r2 and p-value over the years up to the last."""
    p, y = F.col("percent"), F.col("year")
    by = series.groupBy("specialty", "band").agg(F.max(F.when(y == first, p)).alias("first"), F.max(F.when(y == last, p)).alias("last"), F.regr_slope(p, y.cast("double")).alias("slope"), F.regr_r2(p, y.cast("double")).alias("r2"))
    by = by.withColumn("change", F.col("last") - F.col("first"))
    return by.join(trends(series, "year", "percent", "specialty", "band", last_year=last).select("specialty", "band", "p"), ["specialty", "band"], "left")


def provider_density(cover: DataFrame, providers: DataFrame, per: float = 1e4) -> DataFrame:
    """Providers for each ``per`` people covered and for each ``per`` people in all: specialty, n_providers, covered_pop, per_covered, per_all.

    ``cover`` has specialty, pop and percent, ``providers`` specialty and npi;
    a specialty without providers has 0.
    """
    by = cover.groupBy("specialty").agg(F.sum(F.col("pop") * fraction(F.col("percent"))).alias("covered_pop"), F.sum("pop").alias("pop"))
    counts = providers.groupBy("specialty").agg(F.count_distinct("npi").alias("n_providers"))
    rows = by.join(counts, "specialty", "left").fillna(0, ["n_providers"])
    return rows.select("specialty", "n_providers", "covered_pop", (per * ratio(F.col("n_providers"), F.col("covered_pop"))).alias("per_covered"), (per * ratio(F.col("n_providers"), F.col("pop"))).alias("per_all"))


def composites(bands: DataFrame, key: str, schemes: Mapping[str, Mapping[int, float]] = DECAY_SCHEMES) -> DataFrame:
    """Cumulative percents weighted by band increments under each scheme, ranked: scheme, key, composite, rank.

    Keys without a percent in each band are left out.
    """
    order = Window.partitionBy(key).orderBy("band")
    step = bands.where("percent is not null").withColumn("step", F.col("percent") - F.coalesce(F.lag("percent").over(order), F.lit(0.0)))
    by = step.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.create_map(*[F.lit(x) for kv in w.items() for x in kv])[F.col("band")] * F.col("step")).alias(s) for s, w in schemes.items()])
    size = len(next(iter(schemes.values())))
    long = by.where(F.col("n") == size).unpivot(key, list(schemes), "scheme", "composite")
    return long.withColumn("rank", F.rank().over(Window.partitionBy("scheme").orderBy(F.desc("composite"))))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], *keys: str) -> DataFrame:
    """Rank correlations, ties sharing their mean rank: keys, first, second, rho.

    Ranks come from running counts of distinct values.
    """
    out = None
    names = sorted({c for p in pairs for c in p})
    rows = df.select(*keys, *names).where(" and ".join(f"{c} is not null" for c in names))
    for c in names:
        counts = rows.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        counts = running(counts, c, {"_upto": F.col("_n")}, *keys).select(*keys, c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))
        rows = rows.join(counts, [*keys, c])
    for a, b in pairs:
        one = rows.groupBy(*keys).agg(F.corr(f"_r_{a}", f"_r_{b}").alias("rho")).select(*keys, F.lit(a).alias("first"), F.lit(b).alias("second"), "rho")
        out = one if out is None else out.unionByName(one)
    return out


def tiers(df: DataFrame, key: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Adds a tier of equal counts for each column (larger ones first, ties by key): tier_<column>.

    The tables are counties or specialties: a window over all of them is small.
    """
    return df.select("*", *[F.ntile(n).over(Window.orderBy(c, key)).alias(f"tier_{c}") for c in columns])


def tier_agreement(tiered: DataFrame, reference: str, columns: Sequence[str], weight: str) -> DataFrame:
    """Percent of units and of weight in the same tier as the reference column: column, units, weighted."""
    out = None
    for c in columns:
        same = F.col(f"tier_{c}") == F.col(f"tier_{reference}")
        one = tiered.agg((100 * F.avg(same.cast("double"))).alias("units"), (100 * ratio(F.sum(F.when(same, F.col(weight)).otherwise(0.0)), F.sum(weight))).alias("weighted")).select(F.lit(c).alias("spec"), "units", "weighted")
        out = one if out is None else out.unionByName(one)
    return out


def odds_ratios(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Logistic regression of a 0/1 outcome: term, odds ratio and its 95 % Wald interval."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.select(F.col(outcome).cast("double").alias("label"), *[F.col(p).cast("double").alias(p) for p in predictors]).dropna()
    model = GeneralizedLinearRegression(family="binomial", maxIter=50, tol=1e-10).fit(VectorAssembler(inputCols=list(predictors), outputCol="features").transform(rows))
    errors = model.summary.coefficientStandardErrors
    found = [("(intercept)", float(model.intercept), float(errors[-1])), *((p, float(c), float(e)) for p, c, e in zip(predictors, model.coefficients, errors, strict=False))]
    table = df.sparkSession.createDataFrame(found, "term string, estimate double, se double")
    e, s = F.col("estimate"), F.col("se")
    return table.select("term", F.exp(e).alias("odds_ratio"), F.exp(e - 1.96 * s).alias("low"), F.exp(e + 1.96 * s).alias("high"))


def accessible_population(fractions: DataFrame, least: float = 0.001, z: float = 1.96) -> DataFrame:
    """One row from tracts (pop, fraction): total and accessible population, percent, its binomial error and interval, tracts.

    A missing fraction is none, a missing population counts nowhere. The
    interval isn't clipped at 0 and 100. ``least`` is the fraction from which a
    tract counts as one with access.
    """
    f = F.coalesce("fraction", F.lit(0.0))
    sums = fractions.agg(F.coalesce(F.sum("pop"), F.lit(0.0)).alias("total_population"), F.coalesce(F.sum(f * F.col("pop")), F.lit(0.0)).alias("accessible_population"), F.count("*").alias("n_tracts_total"), F.count_if(f >= least).alias("n_tracts_with_access"))
    p = F.when(F.col("total_population") > 0, F.col("accessible_population") / F.col("total_population"))
    found = sums.withColumn("percent_accessible", 100 * p).withColumn("percent_se", 100 * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / F.col("total_population")))
    return found.withColumns({f"percent_ci_{side}": F.col("percent_accessible") + sign * z * F.col("percent_se") for side, sign in (("lower", -1), ("upper", 1))})
