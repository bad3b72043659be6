"""Checks that fail instead of losing, multiplying or zeroing rows in silence.

Each is one aggregate job; the error names at most five offending keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachwell.constants import NORMATIVE_TERMS, STATE_LOSS

SHOWN = 5


class CatchmentError(ValueError):
    """An input breaks a rule that the result depends on."""


def _refuse(what: str, bad: DataFrame, *keys: str) -> None:
    rows = bad.select(*keys).distinct().orderBy(*keys).limit(SHOWN).collect()
    if rows:
        count = bad.select(*keys).distinct().count()
        shown = ", ".join("/".join(map(str, r)) for r in rows)
        raise CatchmentError(f"{what}: {shown}" + (f" and {count - SHOWN} more" if count > SHOWN else ""))


def refuse_any(*checks: tuple[str, DataFrame, str]) -> None:
    """The error of the first of the checks (what, bad rows, key) that has rows; all are looked at in one job."""
    any_ = None
    for i, (_, bad, _) in enumerate(checks):
        one = bad.select(F.lit(i).alias("i")).limit(1)
        any_ = one if any_ is None else any_.unionByName(one)
    for i in sorted(r[0] for r in any_.collect()):
        what, bad, key = checks[i]
        _refuse(what, bad, key)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).count().where("count > 1")


def unique_key(df: DataFrame, *keys: str, what: str = "duplicate key") -> DataFrame:
    """``df``, if no key occurs twice."""
    _refuse(what, df.groupBy(*keys).count().where("count > 1"), *keys)
    return df


def no_nulls(df: DataFrame, column: str, key: str, what: str = "missing value") -> DataFrame:
    """``df``, if the column is neither null nor NaN anywhere."""
    _refuse(f"{what} in {column}", df.where(~finite(F.col(column))), key)
    return df


def matched(left: DataFrame, right: DataFrame, key: str, what: str = "no match") -> DataFrame:
    """``left``, if each of its keys occurs in ``right``."""
    _refuse(what, left.select(key).distinct().join(right.select(key), key, "left_anti"), key)
    return left


def many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that can't multiply the left rows."""
    return left.join(unique_key(right, key, what="the right side of a many-to-one join repeats a key"), key, how)


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def state_losses(df: DataFrame, lost: Column, geoid: str = "geoid") -> DataFrame:
    """States that lost rows: state, rows, lost, share."""
    by = df.groupBy(F.substring(geoid, 1, 2).alias("state")).agg(F.count("*").alias("rows"), F.sum(lost.cast("long")).alias("lost"))
    return by.where("lost > 0").withColumn("share", F.col("lost") / F.col("rows"))


def state_loss(df: DataFrame, lost: Column, geoid: str = "geoid", most: float = STATE_LOSS) -> DataFrame:
    """``df``, if no state lost more than the given share of its rows."""
    _refuse("state lost more rows than allowed", state_losses(df, lost, geoid).where(F.col("share") > most), "state")
    return df


def same_geography(numerator: DataFrame, denominator: DataFrame, column: str = "geography") -> str:
    """The one geography that both tables name; an error if they name none, several or different ones."""
    found = [{r[0] for r in df.select(column).distinct().limit(2).collect()} for df in (numerator, denominator)]
    if found[0] != found[1] or len(found[0]) != 1 or None in found[0]:
        raise CatchmentError(f"geographies disagree: {sorted(map(str, found[0]))} and {sorted(map(str, found[1]))}")
    return next(iter(found[0]))


def sums_to_one(df: DataFrame, value: str, *keys: str, within: float = 1e-10) -> DataFrame:
    """``df``, if the values of each key sum to one."""
    _refuse(f"{value} doesn't sum to one", df.groupBy(*keys).agg(F.sum(value).alias("s")).where(F.abs(F.col("s") - 1) > within), *keys)
    return df


def all_sum_to_one(df: DataFrame, values: list[str], *keys: str, within: float = 1e-10) -> DataFrame:
    """``df``, if each of the columns sums to one for each key; all are looked at in one job."""
    off = df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).agg(*[F.max(F.abs(F.col(v) - 1) > within).alias(v) for v in values]).head()
    for v in values:
        if off[v]:
            sums_to_one(df, v, *keys, within=within)
    return df


def conserved(before: float, after: float, within: float, what: str = "total") -> float:
    """``after``, if it equals ``before`` up to a relative error."""
    if abs(after - before) > within * max(abs(before), 1.0):
        raise CatchmentError(f"{what} not conserved: {before} became {after}")
    return after


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite; never null."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def partition_unknown(df: DataFrame, column: str = "access") -> tuple[DataFrame, DataFrame]:
    """The rows whose value is known, and one row with n_unknown and frac_unknown (0 for no rows)."""
    unknown = ~finite(F.col(column))
    account = df.agg(F.coalesce(F.sum(unknown.cast("long")), F.lit(0)).alias("n_unknown"), F.coalesce(F.avg(unknown.cast("double")), F.lit(0.0)).alias("frac_unknown"))
    return df.where(~unknown), account


def neutral(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if no text of the columns has a normative term as a whole word, in whatever case."""
    terms = "|".join(t.replace("-", "\\-") for t in NORMATIVE_TERMS)
    for c in columns:
        _refuse(f"normative term in {c}", df.where(F.col(c).rlike(rf"(?i)\b({terms})\b")), c)
    return df
