"""Spatial joins: every pair that meets shares a grid cell, so they are equi-joins with a residual check."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.functions.geometry import area_within, polygon_area, polygon_bounds, polygon_holds, polygon_overlap
from reachwell.operators.raster import banded
from reachwell.storage import kept


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _polygons(shapes: DataFrame) -> DataFrame:
    """Shapes with a ``polygon``, or a simple ``ring`` in its place."""
    return shapes if "polygon" in shapes.columns else shapes.withColumn("polygon", F.array("ring")).drop("ring")


def _celled(shapes: DataFrame, key: list[str], size: float, prefix: str) -> DataFrame:
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    rows = shapes.select(*key, F.col("polygon").alias(f"{prefix}shape"), x0.alias(f"{prefix}x0"), y0.alias(f"{prefix}y0"), x1.alias(f"{prefix}x1"), y1.alias(f"{prefix}y1"))
    rows = rows.withColumn("cx", F.explode(_span(F.col(f"{prefix}x0"), F.col(f"{prefix}x1"), size)))
    return rows.withColumn("cy", F.explode(_span(F.col(f"{prefix}y0"), F.col(f"{prefix}y1"), size)))


def overlaps(zones: DataFrame, tracts: DataFrame, size: float, check: bool = True) -> DataFrame:
    """The fraction of each tract's area that lies in each zone: coord_id, band, geoid, overlap_fraction.

    ``zones`` has coord_id, minutes and polygon (or ring), ``tracts`` geoid and
    polygon (or ring), both in one equal-area projection. A pair meets in every cell
    that both bounding boxes touch; it is kept in the one that holds the lower
    corner of the boxes' intersection. Tracts without area are left out.
    """
    zones, tracts = _polygons(zones), _polygons(tracts)
    if check:
        few = F.coalesce(F.exists("polygon", lambda ring: F.coalesce(F.size(ring), F.lit(0)) < 3), F.lit(True))
        bad = tracts.select(F.col("geoid").alias("k"), "polygon").unionByName(zones.select(F.col("coord_id").alias("k"), "polygon")).where(few)
        guards._refuse("ring with fewer than three points", bad, "k")
    z = _celled(zones.select("coord_id", F.round("minutes").cast("int").alias("band"), "polygon"), ["coord_id", "band"], size, "z")
    t = _celled(tracts.withColumn("area", F.abs(polygon_area(F.col("polygon")))).where("area > 0"), ["geoid", "area"], size, "t")
    meet = (F.col("zx0") <= F.col("tx1")) & (F.col("tx0") <= F.col("zx1")) & (F.col("zy0") <= F.col("ty1")) & (F.col("ty0") <= F.col("zy1"))
    once = (F.col("cx") == F.floor(F.greatest("zx0", "tx0") / size)) & (F.col("cy") == F.floor(F.greatest("zy0", "ty0") / size))
    pairs = z.join(t, ["cx", "cy"]).where(meet & once).select("coord_id", "band", "geoid", "area", "zshape", "tshape")

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            points = lambda shape: [[(p["x"], p["y"]) for p in ring] for ring in shape]
            shared = [polygon_overlap(points(a), points(b)) for a, b in zip(rows["zshape"], rows["tshape"], strict=True)]
            out = rows[["coord_id", "band", "geoid"]].copy()
            out["f"] = [min(1.0, max(0.0, s / a)) for s, a in zip(shared, rows["area"], strict=True)]
            yield out

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("coord_id", "band", "geoid").schema.fields]
    found = pairs.mapInPandas(clip, ", ".join([*kinds, "f double"])).where("f > 0")
    return found.groupBy("coord_id", "band", "geoid").agg(F.least(F.sum("f"), F.lit(1.0)).alias("overlap_fraction"))


def union_fractions(zones: DataFrame, tracts: DataFrame, size: float) -> DataFrame:
    """The fraction of each tract's area that lies in at least one zone, counted once where zones overlap: geoid, fraction.

    ``zones`` has zone and polygon, ``tracts`` geoid and polygon. A tract's
    bands of height ``size`` are computed apart from each other, each from the
    edges of the tract and of the zones whose boxes meet it; edges to the
    band's right are left out, and those to its left say only that the zone
    has begun. Tracts that meet no zone have 0, tracts without area null.
    """
    tracts, zones = _polygons(tracts), _polygons(zones)
    t, z = _celled(tracts, ["geoid"], size, "t"), _celled(zones, ["zone"], size, "z")
    meet = (F.col("zx0") < F.col("tx1")) & (F.col("tx0") < F.col("zx1")) & (F.col("zy0") < F.col("ty1")) & (F.col("ty0") < F.col("zy1"))
    once = (F.col("cx") == F.floor(F.greatest("zx0", "tx0") / size)) & (F.col("cy") == F.floor(F.greatest("zy0", "ty0") / size))
    pairs = t.join(z, ["cx", "cy"]).where(meet & once).select("geoid", "zone", "tx0", "tx1", F.explode(_span(F.col("ty0"), F.col("ty1"), size)).alias("row"))
    near = pairs.join(banded(zones, size, "zone"), ["zone", "row"]).where(F.least("xa", "xb") < F.col("tx1"))
    before = F.greatest("xa", "xb") <= F.col("tx0")
    near = near.select("geoid", "row", "zone", *[F.when(before, F.col("tx0")).otherwise(F.col(c)).alias(c) for c in ("xa", "xb")], "ya", "yb")
    met = pairs.select("geoid", "row").distinct()
    own = banded(tracts, size, "geoid").join(met, ["geoid", "row"], "left_semi").withColumn("zone", F.lit(None).cast(near.schema["zone"].dataType))
    kind = near.schema["geoid"].dataType.simpleString()

    def shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        owner = pd.factorize(rows["zone"])[0] + 1  # missing, the tract itself, is 0
        return pd.DataFrame({"geoid": [key[0]], "area": [area_within(*(rows[c].to_numpy() for c in ("xa", "ya", "xb", "yb")), owner)]})

    found = own.unionByName(near).groupBy("geoid", "row").applyInPandas(shared, f"geoid {kind}, area double").groupBy("geoid").agg(F.sum("area").alias("shared"))
    whole = F.nullif(F.abs(polygon_area(F.col("polygon"))), F.lit(0.0))
    return tracts.join(found, "geoid", "left").select("geoid", F.least(F.coalesce("shared", F.lit(0.0)) / whole, F.lit(1.0)).alias("fraction"))


def points_within(points: DataFrame, rings: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points (id, x, y) with the zones (zone, and polygon or ring) that hold them; ``how`` left keeps points in none."""
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    z = _polygons(rings).select("zone", "polygon", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    z = z.withColumn("cx", F.explode(_span(F.col("x0"), F.col("x1"), size))).withColumn("cy", F.explode(_span(F.col("y0"), F.col("y1"), size)))
    p = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    box = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    found = p.join(z, ["cx", "cy"]).where(box).where(polygon_holds(F.col("polygon"), F.col("x"), F.col("y"))).select("id", "zone")
    return found if how == "inner" else points.select("id").join(found, "id", "left")


def nearest(points: DataFrame, others: DataFrame, k: int, size: float, self_join: bool = False) -> DataFrame:
    """The ``k`` nearest others of each point, ties by id: id, other, distance, place.

    Both have id, x and y. Each point looks into its own cell and the eight
    around it, which is complete up to a distance of ``size``. Points whose k-th
    neighbour is farther look again in cells of twice the size, until these are
    as large as the extent of all points. Of others at one place only the first
    ``k`` by id can be among the nearest, and points at one place have the same.
    """
    k = min(k, others.count() - self_join)  # all that there are
    if not self_join:
        at = lambda df: df.select("id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
        spots = kept(at(points).groupBy("x", "y").agg(F.min("id").alias("spot")))
        ranks = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
        firsts = kept(at(others).withColumn("_n", ranks).where(F.col("_n") <= k).drop("_n"))
        found = _nearest(spots.withColumnRenamed("spot", "id"), firsts, k, size, False)
        return at(points).join(spots, ["x", "y"]).select("id", "spot").join(found.withColumnRenamed("id", "spot"), "spot").select("id", "other", "distance", "place")
    return _nearest(points, others, k, size, True)


def _nearest(points: DataFrame, others: DataFrame, k: int, size: float, self_join: bool) -> DataFrame:
    """What :func:`nearest` finds, with every point and every other."""
    here = others.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    todo = points.select("id", "x", "y")
    ends = todo.select("x", "y").unionByName(others.select("x", "y")).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).head()[0]
    distance = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    best = Window.partitionBy("id").orderBy("distance", "other")
    apart = F.col("id") != F.col("other") if self_join else F.lit(True)
    out = None
    while True:
        cells = here.withColumn("cx", F.floor(F.col("ox") / size)).withColumn("cy", F.floor(F.col("oy") / size))
        near = todo.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / size) - 1, F.floor(F.col("x") / size) + 1)))
        near = near.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / size) - 1, F.floor(F.col("y") / size) + 1))).join(cells, ["cx", "cy"])
        placed = near.where(apart).select("id", "other", distance.alias("distance")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        placed = kept(placed)  # read three times, and by each later round
        if ends is None or size >= ends:  # the cells hold all points
            return placed if out is None else out.unionByName(placed)
        full = placed.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") == k) & (F.col("far") <= size)).select("id")
        done = placed.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        todo = kept(todo.join(full, "id", "left_anti"))
        if todo.isEmpty():
            return out
        size *= 2


def neighbour_graph(points: DataFrame, k: int, size: float) -> DataFrame:
    """The ``k`` nearest of each point and itself: id, other."""
    return nearest(points, points, k, size, self_join=True).select("id", "other").unionByName(points.select("id", F.col("id").alias("other")))


def nested_flags(flags: DataFrame, key: str, band: str = "band", flag: str = "inside") -> DataFrame:
    """Flags made cumulative: inside a band if inside it or any smaller one."""
    return flags.withColumn(flag, F.max(F.col(flag).cast("int")).over(Window.partitionBy(key).orderBy(band).rowsBetween(Window.unboundedPreceding, 0)) == 1)
