"""Intervals of weighted statistics under sampling error, contrasts between strata, trends with p-values, and their table.

Population estimates come with standard errors, and every statistic here is a
ratio of sums over tracts. If each tract's population is a normal draw of its
own around its estimate, the sums are jointly normal, and their covariances are
sums over tracts as well. So one pass adds up the sums and their covariances,
and the draws are of the sums: as many for a thousand tracts as for a billion.
Strata that weigh by the same population share its draws, so contrasts between
them have the right error. No draw depends on how rows are partitioned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.guards import CatchmentError


class Group(NamedTuple):
    """A stratum: whose population weighs (columns of estimates and of standard errors), and where."""

    estimate: str
    error: str
    where: Column | None = None


class Contrast(NamedTuple):
    """``minus`` or ``over`` of two metrics, named ``mean_<group>`` or ``zero_<group>``."""

    first: str
    kind: str
    second: str


def root(covariance: np.ndarray) -> np.ndarray:
    """A lower triangular root of a covariance matrix that may be singular, as that of parts and their whole is."""
    left, out = covariance.astype(float).copy(), np.zeros_like(covariance, float)
    least = 1e-10 * np.diag(left)
    for k in range(len(left)):
        if left[k, k] > least[k]:
            out[k:, k] = left[k:, k] / math.sqrt(left[k, k])
            left -= np.outer(out[:, k], out[:, k])
    return out


def intervals(rows: DataFrame, access: str, groups: Mapping[str, Group], contrasts: Mapping[str, Contrast] | None = None, *keys: str, draws: int = 2000, level: float = 0.95, seed: int = 1, check: bool = True) -> DataFrame:
    """Per metric: point, low, high, and whether the interval excludes 0: keys, metric, point, low, high, excludes_zero.

    Each group has ``mean_<group>``, the mean access weighted by its population,
    and ``zero_<group>``, the percent of its population with an access of
    exactly 0. Rows with unknown access are left out; a missing estimate or
    error is none; draws aren't clamped at 0; negative errors are refused. A
    metric without any population is null.
    """
    contrasts, order = contrasts or {}, list(groups)
    names = [f"{m}_{g}" for g in order for m in ("mean", "zero")]
    for c in contrasts.values():
        if c.kind not in ("minus", "over") or not {c.first, c.second} <= set(names):
            raise CatchmentError(f"no contrast {c}")
    rows = rows.where(guards.finite(F.col(access)))
    if check:
        errors = sorted({g.error for g in groups.values()})
        guards._refuse("negative standard error", rows.select(F.explode(F.array(*[F.when(F.col(e) < 0, F.lit(e)) for e in errors])).alias("error")).where("error is not null"), "error")
    a = F.col(access).cast("double")
    parts = [F.lit(1.0), a, F.when(a == 0, 1.0).otherwise(0.0)]
    sums, where = [], []  # (group, part, its value) and what to add up
    for g in groups.values():
        inside = F.coalesce(g.where, F.lit(False)) if g.where is not None else F.lit(True)
        for p in parts:
            where.append((g, F.when(inside, p).otherwise(0.0)))
            sums.append(F.sum(F.coalesce(F.col(g.estimate).cast("double"), F.lit(0.0)) * where[-1][1]))
    pairs = [(i, j) for i in range(len(where)) for j in range(i + 1) if where[i][0].estimate == where[j][0].estimate]
    spread = [F.sum(F.pow(F.coalesce(F.col(where[i][0].error).cast("double"), F.lit(0.0)), 2) * where[i][1] * where[j][1]) for i, j in pairs]
    added = rows.groupBy(*keys).agg(F.array(*sums).alias("sums"), F.array(*spread).alias("spread"))

    def metrics(s: np.ndarray) -> dict[str, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = {}
            for i, g in enumerate(order):
                whole = np.where(s[3 * i] == 0, np.nan, s[3 * i])
                out |= {f"mean_{g}": s[3 * i + 1] / whole, f"zero_{g}": 100 * s[3 * i + 2] / whole}
            return out | {n: out[c.first] - out[c.second] if c.kind == "minus" else out[c.first] / np.where(out[c.second] == 0, np.nan, out[c.second]) for n, c in contrasts.items()}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                point = np.array(r["sums"], float)
                covariance = np.zeros((len(point), len(point)))
                for (i, j), v in zip(pairs, r["spread"], strict=True):
                    covariance[i, j] = covariance[j, i] = v
                key = zlib.crc32(repr([str(r[k]) for k in keys]).encode())
                normal = np.random.default_rng([seed, key]).standard_normal((len(point), draws))
                drawn, at = metrics(point[:, None] + root(covariance) @ normal), metrics(point)
                out = []
                for n, v in at.items():
                    known = drawn[n][np.isfinite(drawn[n])]
                    low, high = np.quantile(known, [(1 - level) / 2, (1 + level) / 2]) if len(known) and np.isfinite(v) else (np.nan, np.nan)
                    out.append([*[r[k] for k in keys], n, *[None if np.isnan(x) else float(x) for x in (v, low, high)], None if np.isnan(low) else bool(low > 0 or high < 0)])
                yield pd.DataFrame(out, columns=[*keys, "metric", "point", "low", "high", "excludes_zero"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in added.select(*keys).schema.fields]
    return added.mapInPandas(draw, ", ".join([*kinds, "metric string, point double, low double, high double, excludes_zero boolean"]))


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite series of its angle's sine and cosine."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom.cast("double")))
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = F.pmod(freedom, F.lit(2)) == 1
    start = F.when(odd, cosine).otherwise(F.lit(1.0))
    terms = F.when(freedom > 3, F.sequence(F.when(odd, 3).otherwise(2).cast("long"), freedom.cast("long") - 2, F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    state = lambda s, v: F.struct(s.alias("sum"), v.alias("term"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * cosine * cosine * (k - 1) / k
        return state(s["sum"] + term, term)

    series = F.aggregate(terms, state(start, start), add)["sum"]
    inside = F.when(odd, 2 / math.pi * (angle + F.when(freedom == 1, 0.0).otherwise(sine * series))).otherwise(sine * series)
    return F.when(freedom >= 1, F.greatest(1 - inside, F.lit(0.0)))


def trends(df: DataFrame, year: str, value: str, *keys: str, last_year: int = 2022, least: int = 3) -> DataFrame:
    """The least-squares trend over the years up to the last, with its error and p-value: keys, n, slope, se, p.

    Null with fewer than ``least`` years or without any spread of years; a
    perfect fit has an error of 0 and a p-value of 0, or of 1 if it is level.
    """
    y, x = F.col(value).cast("double"), F.col(year).cast("double")
    own = df.where(guards.finite(y) & (F.col(year) <= last_year)).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    enough = (F.col("n") >= least) & (F.col("sxx") > 0)
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    left = F.when(left <= 1e-14 * F.col("syy"), 0.0).otherwise(left)
    se = F.sqrt(left / (F.col("n") - 2) / F.col("sxx"))
    p = F.when(F.col("se") > 0, student_p(F.col("slope") / F.col("se"), F.col("n") - 2)).otherwise(F.when(F.col("slope") == 0, 1.0).otherwise(0.0))
    own = own.select(*keys, "n", F.when(enough, F.col("slope")).alias("slope"), F.when(enough & (F.col("n") > 2), se).alias("se"))
    return own.withColumn("p", F.when(F.col("se").isNotNull(), p))


def inferential_table(found: DataFrame, trend: DataFrame, key: str, columns: Sequence[tuple[str, str, int]], trend_columns: Sequence[tuple[str, str]]) -> DataFrame:
    """One row of texts for each key: ``point (low-high)`` of metrics and ``slope/yr (P=p)`` of strata.

    ``columns`` has the column's name, the metric and its digits;
    ``trend_columns`` the column's name and the stratum. What is missing is null.
    """
    one = found.groupBy(key).agg(*[F.max(F.when((F.col("metric") == m) & F.col("point").isNotNull(), F.format_string(f"%.{d}f (%.{d}f-%.{d}f)", "point", "low", "high"))).alias(n) for n, m, d in columns])
    two = trend.groupBy(key).agg(*[F.max(F.when((F.col("stratum") == s) & F.col("p").isNotNull(), F.format_string("%+.3f/yr (P=%.3f)", "slope", "p"))).alias(n) for n, s in trend_columns])
    return one.join(two, key, "left")
