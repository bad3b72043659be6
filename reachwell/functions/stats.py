"""Weighted statistics as aggregate expressions or small plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachwell.functions.inference import Group, intervals
from reachwell.functions.ranges import running
from reachwell.guards import finite


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the divisor is zero, null or not finite."""
    return F.when(finite(bottom) & (bottom != 0), top / bottom)


def weighted_mean_all(a: Column, w: Column) -> Column:
    """Over all rows, negative weights included; null if the weights sum to zero."""
    return ratio(F.sum(a * w), F.sum(w))


def weighted_mean_positive(a: Column, w: Column) -> Column:
    """Over rows with a positive weight and a known value."""
    use = (w > 0) & a.isNotNull()
    return ratio(F.sum(F.when(use, a * w)), F.sum(F.when(use, w)))


def zero_share(a: Column, w: Column) -> Column:
    """Percent of the weight where the value is exactly zero."""
    return 100 * ratio(F.sum(F.when(a == 0, w).otherwise(0.0)), F.sum(w))


def known(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.where(finite(F.col(value)) & finite(F.col(weight)) & (F.col(weight) > 0))


def cumulative(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """Distinct values x in order, with their weight w, the weight up to each as a share cw, and likewise of x * w (mass, cmass)."""
    sums = known(df, value, weight).groupBy(*keys, F.col(value).alias("x")).agg(F.sum(weight).alias("w"))
    sums = sums.withColumn("mass", F.col("x") * F.col("w"))
    rows = running(sums, "x", {"cw": F.col("w"), "cmass": F.col("mass")}, *keys)
    return rows.withColumns({c: ratio(F.col(c), F.col(f"{c}_total")) for c in ("cw", "cmass")}).withColumn("share", F.col("w") / F.col("cw_total"))


def quantile_step(df: DataFrame, value: str, weight: str, probs: list[float], *keys: str) -> DataFrame:
    """The least value whose cumulative share reaches each probability: q_<percent>."""
    c = cumulative(df, value, weight, *keys)
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("cw") >= p, F.col("x"))).alias(f"q{round(100 * p)}") for p in probs])


def quantile_linear(df: DataFrame, value: str, weight: str, probs: list[float], *keys: str) -> DataFrame:
    """Interpolated between cumulative shares; beyond the ends, the end values."""
    c = cumulative(df, value, weight, *keys)
    found = c.groupBy(*keys).agg(*[f(F.when(side, F.col(v))).alias(f"_{i}_{v}_{n}") for i, p in enumerate(probs) for n, f, side in (("below", F.max, F.col("cw") < p), ("from", F.min, F.col("cw") >= p)) for v in ("x", "cw")])

    def at(i: int, p: float) -> Column:
        low, high, below, upto = (F.col(f"_{i}_{v}_{n}") for v in ("x", "cw") for n in ("below", "from"))
        return F.when(low.isNull(), high).otherwise(low + (high - low) * (p - below) / (upto - below))

    return found.select(*keys, *[at(i, p).alias(f"q{round(100 * p)}") for i, p in enumerate(probs)])


def gini(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """The population Gini coefficient, by trapezoids under the Lorenz curve."""
    c = cumulative(df, value, weight, *keys)
    area = F.col("share") * (2 * F.col("cmass") - ratio(F.col("mass"), F.col("cmass_total")))
    return c.groupBy(*keys).agg((1 - F.sum(area)).alias("gini"))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + top * d or tiny), 1 + top / c or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def trend(df: DataFrame, year: str, value: str, *keys: str) -> DataFrame:
    """The least-squares slope, its r2 and t statistic; the statistic is null with two points or a perfect fit."""
    y, x = F.col(value), F.col(year).cast("double")
    sums = df.where(finite(y)).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    t = F.when((F.col("n") > 2) & (F.col("r2") < 1), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return sums.withColumn("t", t)


def hac_trend(df: DataFrame, year: str, value: str, *keys: str, lag: int = 4, last_year: int = 2022, least: int = 4) -> DataFrame:
    """Per series: slope, p_ols and p_hac (Newey-West, Bartlett weights, small-sample factor); null below ``least`` years.

    A series is a handful of years, so each is fitted on its own in pandas.
    """
    import numpy as np
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.dropna(subset=[year, value])
        own = own[own[year] <= last_year].sort_values(year)
        out = {k: rows[k].iloc[0] for k in keys} | {"slope": np.nan, "p_ols": np.nan, "p_hac": np.nan}
        n = len(own)
        if n >= least:
            x = np.column_stack([np.ones(n), own[year].astype(float)])
            bread = np.linalg.inv(x.T @ x)
            beta = bread @ x.T @ own[value].to_numpy(float)
            left = own[value].to_numpy(float) - x @ beta
            moments = x * left[:, None]
            meat = moments.T @ moments
            for k in range(1, min(lag, n - 1) + 1):
                cross = moments[k:].T @ moments[:-k]
                meat += (1 - k / (lag + 1)) * (cross + cross.T)
            hac = bread @ meat @ bread * n / (n - 2)
            ols = bread * (left @ left) / (n - 2)
            out["slope"] = beta[1]
            out["p_ols"], out["p_hac"] = (student_p(beta[1] / math.sqrt(v[1, 1]), n - 2) if v[1, 1] > 0 else np.nan for v in (ols, hac))
        return pd.DataFrame([out])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "slope double, p_ols double, p_hac double"])
    return df.select(*keys, year, value).groupBy(*keys).applyInPandas(fit, schema)


def monte_carlo_mean(df: DataFrame, access: str, estimate: str, error: str, *keys: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """The weighted mean of ``access`` and its 95 % interval when the weights are normal draws around the estimates: keys, point, low, high.

    Draws aren't clamped; a missing error is none, a negative one is refused.
    """
    found = intervals(df, access, {"all": Group(estimate, error)}, None, *keys, draws=draws, seed=seed)
    return found.where("metric = 'mean_all'").select(*keys, "point", "low", "high")
