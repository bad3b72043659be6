"""Whether results moved: nested records compared leaf by leaf, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachwell import guards

LEAF = "array<struct<path:string,number:double,text:string>>"


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """All leaves under a value: arrays of (path, number, text); a null struct, array or map has none."""
    none = F.array().cast(LEAF)
    if isinstance(kind, T.StructType):
        found = F.concat(none, *[_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda v, i: _leaves(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    elif isinstance(kind, T.MapType):
        found = F.flatten(F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
    else:
        number = value.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), number.alias("number"), value.cast("string").alias("text")))).otherwise(none)
    return F.coalesce(found, none)


def flattened(df: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Every value of every row that isn't null: keys, path, number (null for what isn't one), text.

    A path names structs' fields and maps' keys with dots and arrays' places in
    brackets. Columns in ``ignore`` are recorded for other ends and not compared.
    """
    columns = [f for f in df.schema.fields if f.name not in keys and f.name not in ignore]
    all_ = F.concat(F.array().cast(LEAF), *[_leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in columns])
    return df.select(*keys, F.inline(all_))


def differences(baseline: DataFrame, current: DataFrame, keys: Sequence[str], tolerance: float = 1e-9, ignore: Sequence[str] = ()) -> DataFrame:
    """Leaves that changed, are missing now, or were added: keys, path, kind, before, after.

    Numbers differ beyond the tolerance, or if one alone is NaN; a number and a
    text differ by their texts. A repeated key is refused, since its leaves
    could not be told apart.
    """
    sides = []
    for df, name in ((baseline, "b"), (current, "c")):
        guards.unique_key(df, *keys, what="a record repeats its key")
        sides.append(flattened(df, keys, ignore).select(*keys, "path", F.lit(True).alias(f"{name}_is"), F.col("number").alias(f"{name}_number"), F.col("text").alias(f"{name}_text")))
    both = sides[0].join(sides[1], [*keys, "path"], "full")
    x, y = F.col("b_number"), F.col("c_number")
    numbers = x.isNotNull() & y.isNotNull()
    moved = F.when(numbers, F.when(F.isnan(x) | F.isnan(y), F.isnan(x) != F.isnan(y)).otherwise((x != y) & (F.abs(x - y) > tolerance))).otherwise(F.col("b_text") != F.col("c_text"))
    kind = F.when(F.col("b_is").isNull(), "added").when(F.col("c_is").isNull(), "missing").when(F.coalesce(moved, F.lit(False)), "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "path", "kind", F.col("b_text").alias("before"), F.col("c_text").alias("after"))


def unchanged(baseline: DataFrame, current: DataFrame, keys: Sequence[str], tolerance: float = 1e-9, ignore: Sequence[str] = ()) -> DataFrame:
    """``current``, if nothing differs; else an error that names the first differences."""
    found = differences(baseline, current, keys, tolerance, ignore)
    what = F.concat_ws(" ", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "path"), "kind", F.concat(F.lit("("), F.coalesce("before", F.lit("-")), F.lit(" -> "), F.coalesce("after", F.lit("-")), F.lit(")")))
    guards._refuse("results moved", found.select(what.alias("what")), "what")
    return current
