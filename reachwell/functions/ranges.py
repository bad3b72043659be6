"""Running sums and places over a whole order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachwell.storage import kept

#: Rows of a range, which one task orders.
RANGE_ROWS = 1_000_000


def running(df: DataFrame, order: str, sums: Mapping[str, Column], *keys: str) -> DataFrame:
    """Adds, for each of ``sums``, ``<name>`` up to and with the row in ascending order, and ``<name>_total``, within the keys.

    Rows are dealt to ranges of keys and order; a range's sums begin with those
    of the ranges before it. A key's rows may lie in many ranges, and a range
    may hold many keys. Rows of a key must differ in ``order``.
    """
    df = kept(df.withColumns({f"_{n}": c for n, c in sums.items()}))
    ranges = df.count() // RANGE_ROWS + 1
    df = kept(df.repartitionByRange(ranges, *keys, order).withColumn("_part", F.spark_partition_id()))  # borders are sampled, so they are kept
    own = df.groupBy(*keys, "_part").agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    if keys:
        upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        own = own.select(*keys, "_part", *[x for n in sums for x in ((F.sum(n).over(upto) - F.col(n)).alias(f"_{n}_before"), F.sum(n).over(whole).alias(f"{n}_total"))])
    else:
        rows, before, out = own.orderBy("_part").collect(), dict.fromkeys(sums, 0.0), []  # a row for each range
        total = {n: sum(r[n] or 0.0 for r in rows) for n in sums}
        for r in rows:
            out.append((r["_part"], *[x for n in sums for x in (float(before[n]), float(total[n]))]))
            before = {n: before[n] + (r[n] or 0.0) for n in sums}
        own = df.sparkSession.createDataFrame(out, ", ".join(["_part int", *[f"_{n}_before double, {n}_total double" for n in sums]]))
    along = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({n: F.sum(f"_{n}").over(along) for n in sums}).join(own, [*keys, "_part"])
    df = df.withColumns({n: F.col(n) + F.col(f"_{n}_before") for n in sums})
    return df.drop("_part", *[f"_{n}" for n in sums], *[f"_{n}_before" for n in sums])
