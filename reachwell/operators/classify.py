"""Classes of one and two variables, clusters of values, and composite indices."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachwell.functions.ranges import running
from reachwell.functions.stats import ratio
from reachwell.guards import CatchmentError

#: Colours of schemes of three and four classes (fixed values): rows from low to high of the second variable, in a row from low to high of the first.
PALETTES = {
    ("BlueYellow", 3): "#e8e8e8 #ace4e4 #5ac8c8 #dfb0d6 #a5add3 #5698b9 #be64ac #8c62aa #3b4994",
    ("PurpleGreen", 3): "#e8e8e8 #b8d6be #73ae80 #b5b5d8 #90b2b3 #5a9178 #8c62aa #5698b9 #2a5a5b",
    ("BrownBlue", 3): "#e8e8e8 #b5c8e2 #6c83b5 #dfc27d #c3b5a0 #9e8876 #bf812d #9c7753 #7f5f3d",
    ("PinkBlue", 3): "#e8e8e8 #c8b2d1 #a07bb6 #f4b5bd #c992a7 #9e7091 #f18d9e #c76f82 #9d5266",
    ("BlueYellow", 4): "#f3f3f3 #d5e9f2 #a0d3e8 #5ac8c8 #e6d3e1 #c8b5d0 #a094bc #5698b9 #d3a5ca #b58cb3 #93749b #3b4994 #be64ac #9e4f8f #7d3a72 #5d2855",
    ("PurpleGreen", 4): "#f3f3f3 #d5e9d5 #a0d3a0 #73ae80 #d3d3e6 #b5b5c8 #9090a7 #5a9178 #b5b5d8 #9090b3 #6c6c8f #2a5a5b #8c62aa #6f4f8f #523d72 #352a55",
    ("BrownBlue", 4): "#f3f3f3 #d5d9e2 #a0afd1 #6c83b5 #e6d3b5 #c8b5a0 #a7938b #7f6f76 #dfc27d #c3a666 #a7874f #8b6838 #bf812d #a36825 #874f1d #6b3615",
    ("PinkBlue", 4): "#f3f3f3 #dfc8e1 #c89dce #a07bb6 #f9d5dd #e0b5c4 #c895ab #9e7091 #f4b5bd #db95a4 #c2758b #9d5266 #f18d9e #d86d85 #bf4d6c #a62d53",
}


def palette(name: str = "BlueYellow", classes: int = 3) -> dict[str, str]:
    """A scheme's colours by ``first-second`` class."""
    if (name, classes) not in PALETTES:
        raise CatchmentError(f"no palette {name!r} of {classes} classes")
    return {f"{i % classes + 1}-{i // classes + 1}": c for i, c in enumerate(PALETTES[name, classes].split())}


PALETTE = palette()
#: Distinct values that natural breaks are computed over on the driver; beyond them quantiles are taken.
JENKS_VALUES = 1_000_000


def jenks(values: Sequence[float], counts: Sequence[int], k: int) -> list[float]:
    """Breaks of ``k`` classes with the least sum of squares within, over sorted distinct values.

    The best cut before a value never moves back as the value moves on. So for
    each number of classes the middle value is solved first and bounds the
    cuts of both halves, and all values of one depth are solved at once.
    """
    x, w = np.array(values, float), np.array(counts, float)
    n = len(x)
    if n <= k:
        return [float(x[0]), *map(float, x)] if n else []
    v = x - (w @ x) / w.sum()  # squares of large values would drown the differences
    cw, cx, cxx = (np.append(0, np.cumsum(c)) for c in (w, w * v, w * v * v))

    def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (cxx[j] - cxx[i]) - (cx[j] - cx[i]) ** 2 / (cw[j] - cw[i])

    best = np.full(n + 1, np.inf)
    best[0], cuts = 0.0, []
    for c in range(1, k + 1):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        low, high = np.array([c]), np.array([n])  # values to solve, and between which cuts
        first, last = np.array([c - 1]), np.array([n - 1])
        while len(low):
            j = (low + high) // 2
            size = np.minimum(last, j - 1) - first + 1
            starts = np.cumsum(size) - size
            i = np.repeat(first - starts, size) + np.arange(size.sum())
            cost = best[i] + within(i, np.repeat(j, size))
            least = np.minimum.reduceat(cost, starts)
            hit = np.flatnonzero(cost == np.repeat(least, size))
            at = i[hit[np.searchsorted(hit, starts)]]
            now[j], cut[j] = least, at
            left, right = low < j, j < high
            low, high, first, last = (np.concatenate(p) for p in ((low[left], j[right] + 1), (j[left] - 1, high[right]), (first[left], at[right]), (at[left], last[right])))
        best = now
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(float(x[j - 1]))
        j = int(cut[j])
    return [float(x[0]), *reversed(ends)]


def quantiles(df: DataFrame, x: Column, probs: Sequence[float]) -> list[float] | None:
    """Interpolated between the order statistics; null and NaN are left out; None for no rows."""
    counts = df.select(x.cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    rows = running(counts, "x", {"upto": F.col("n")})
    total = rows.agg(F.max("upto_total")).head()[0]
    if total is None:
        return None
    spots = [(total - 1) * p for p in probs]
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    found = rows.agg(*[F.array(at(int(s)), at(min(int(s) + 1, total - 1))) for s in spots]).head()
    return [a + (b - a) * (s - int(s)) for (a, b), s in zip(found, spots, strict=True)]


def breaks(df: DataFrame, column: str, n: int, method: str) -> list[float]:
    """Class limits, distinct and ascending, from the least to the greatest value; null counts as 0.

    Natural breaks of more than ``JENKS_VALUES`` distinct values are those of quantiles, with a warning.
    """
    x = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    if method not in ("quantile", "equal", "jenks"):
        raise CatchmentError("method must be quantile, equal or jenks")
    if method == "jenks":
        rows = df.groupBy(x.alias("x")).count().orderBy("x").limit(JENKS_VALUES + 1).collect()
        if len(rows) <= JENKS_VALUES:
            found = jenks([r[0] for r in rows], [r[1] for r in rows], n) if rows else None
        else:
            warnings.warn(f"natural breaks need at most {JENKS_VALUES} distinct values; classes are of equal counts instead", stacklevel=2)
            method = "quantile"
    if method == "quantile":
        found = quantiles(df, x, [i / n for i in range(n + 1)])
    elif method == "equal":
        low, high = df.agg(F.min(x), F.max(x)).head()
        found = None if low is None else [low + (high - low) * i / n for i in range(n + 1)]
    if found is None:
        raise CatchmentError("no rows to classify")
    return sorted(set(found))


def class_of(x: Column, limits: Sequence[float]) -> Column:
    """Number of the class, closed on the right, the lowest closed on both sides; 1 outside all."""
    out = F.lit(1)
    for i, (low, high) in enumerate(zip(limits, limits[1:], strict=False), 1):
        out = F.when((x > low) & (x <= high), i).otherwise(out)
    return out.cast("int")


def bivariate(df: DataFrame, first: str, second: str, n: int = 3, method: str = "quantile") -> DataFrame:
    """Adds var1_class, var2_class and bivar_class of two columns."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = df.withColumn("var1_class", class_of(value(first), breaks(df, first, n, method))).withColumn("var2_class", class_of(value(second), breaks(df, second, n, method)))
    return df.withColumn("bivar_class", F.concat_ws("-", "var1_class", "var2_class"))


def coloured(df: DataFrame, palette: dict[str, str] = PALETTE) -> DataFrame:
    """Adds the colour of bivar_class; null for a class that the palette lacks."""
    return df.withColumn("color", F.create_map(*[F.lit(x) for kv in palette.items() for x in kv])[F.col("bivar_class")])


def class_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("bivar_class").agg(F.count("*").alias("n")).orderBy("bivar_class")


def fixed_class(x: Column, cuts: Sequence[float]) -> Column:
    """1 up to the first cut, 2 up to the second and so on; null for null."""
    return F.when(x.isNotNull(), reduce(add, [(x > c).cast("int") for c in cuts], F.lit(1)))


def coverage_by_minority(cover: DataFrame, shares: DataFrame, cuts: Sequence[float] = (100 / 3, 200 / 3)) -> DataFrame:
    """Coverage by fixed thirds beside tertiles of the minority share, which all specialties share: adds minority_share, ax, ay, key.

    ``cover`` has geoid and percent, ``shares`` geoid, women and minority;
    tracts without women or with an unknown share are in neither.
    """
    rows = shares.where("women > 0").select("geoid", (100 * ratio(F.col("minority"), F.col("women"))).alias("minority_share")).where("minority_share is not null and not isnan(minority_share)")
    limits = breaks(rows, "minority_share", 3, "quantile")
    both = cover.join(rows.withColumn("ay", class_of(F.col("minority_share"), limits)), "geoid")
    both = both.withColumn("ax", fixed_class(F.col("percent"), cuts).cast("int"))
    return both.withColumn("key", F.concat(F.col("ax").cast("string"), F.col("ay").cast("string")))


def hot_spots(values: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Getis-Ord Gi* with binary weights: id, z, class.

    ``values`` has id and value; ``neighbours`` (id, other) names the others
    that weigh, the id itself included.
    """
    v = values.select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
    whole = v.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    sums = neighbours.join(v.select(F.col("id").alias("other"), "value"), "other").groupBy("id").agg(F.sum("value").alias("local"), F.count("*").alias("k"))
    rows = sums.crossJoin(F.broadcast(whole))  # one row
    spread = F.col("s") * F.sqrt((F.col("n") * F.col("k") - F.col("k") * F.col("k")) / (F.col("n") - 1))
    rows = rows.select("id", ratio(F.col("local") - F.col("k") * F.col("mean"), spread).alias("z"))
    z = F.col("z")
    return rows.withColumn("class", F.when(z <= -2.58, "Cold 99%").when(z <= -1.96, "Cold 95%").when(z <= 1.96, "n.s.").when(z <= 2.58, "Hot 95%").when(z.isNotNull(), "Hot 99%"))


def deprivation(df: DataFrame, positive: Sequence[str], negative: Sequence[str], key: str = "geoid") -> DataFrame:
    """The mean of z-scores (sample deviation), negative columns reversed: key, score (null where a part is)."""
    names = [*positive, *negative]
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [(1 if c in positive else -1) * ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")) for c in names]
    return df.crossJoin(F.broadcast(stats)).select(key, (reduce(add, z) / len(z)).alias("score"))  # one row


def percentile_profile(df: DataFrame, value: str, steps: int = 100) -> DataFrame:
    """Percentiles 0 to 100 of a column as rows: pct, value."""
    ps = [i / steps for i in range(steps + 1)]
    return df.agg(F.percentile(value, ps).alias("x")).select(F.posexplode("x").alias("pct", "value"))


def priority(df: DataFrame, access: str, burden: str, pop: str, area: str, cuts: tuple[float, float]) -> DataFrame:
    """One row: population with low access, population with low access and high burden, and distinct areas of these."""
    low = F.coalesce(F.col(access) <= cuts[0], F.lit(False))
    both = low & F.coalesce(F.col(burden) > cuts[1], F.lit(False))
    return df.agg(F.sum(F.when(low, F.col(pop)).otherwise(0.0)).alias("low_pop"), F.sum(F.when(both, F.col(pop)).otherwise(0.0)).alias("priority_pop"), F.count_distinct(F.when(both, F.col(area))).alias("n_areas"))


def minority_share(df: DataFrame, groups: Sequence[str], total: str) -> DataFrame:
    """Adds the share of the groups together in the total; null for no total."""
    return df.withColumn("minority_share", ratio(reduce(add, [F.coalesce(g, F.lit(0.0)) for g in groups]), F.col(total)))
