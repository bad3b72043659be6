"""Polygons with holes, cells, and catchments on cells, against computations of another kind."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachwell.constants import BAND_WEIGHTS
from reachwell.functions import geometry as shapes
from reachwell.functions.weights import incremental
from reachwell.guards import CatchmentError
from reachwell.operators import geometry, raster
from reachwell.plans import shapes as plans
from reachwell.plans.binding import Binding
from reachwell.sources import readers

SCHEMA = f"geoid string, polygon {shapes.POLYGON}"


def star(rng, x, y, reach, n, left=True):
    angles = [2 * math.pi * (i + rng.uniform(0, 0.8)) / n for i in range(n)]
    ring = [(x + (d := reach * rng.uniform(0.4, 1)) * math.cos(a), y + d * math.sin(a)) for a in angles]
    return ring if left else ring[::-1]


def holed(rng, x, y):
    """A star around a hole, and an island beside it."""
    outer = [(x + 3 * rng.uniform(0.8, 1) * math.cos(a), y + 3 * rng.uniform(0.8, 1) * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 9)[:-1]]
    return [outer, star(rng, x, y, 1.2, 7, left=False), star(rng, x + 5, y + 1, 0.8, 5)]


def some(seed):
    rng = random.Random(seed)
    return {f"h{i}": holed(rng, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(5)} | {f"s{i}": [star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), 4, 12)] for i in range(5)} | {"tiny": [star(rng, 0.3, 0.3, 0.01, 6)]}


def frame(spark, polygons, schema=SCHEMA):
    return spark.createDataFrame(list(polygons.items()), schema)


def shoelace(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def inside(polygon, x, y):
    return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) for ring in polygon for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def test_polygons_with_holes(spark):
    polygons = some(1)
    p = F.col("polygon")
    x, y = shapes.polygon_centroid(p)
    rows = frame(spark, polygons).select("geoid", shapes.polygon_area(p).alias("a"), x.alias("x"), y.alias("y"), F.array(*shapes.polygon_bounds(p)).alias("b"), shapes.polygon_length(p).alias("l")).collect()
    for r in rows:
        rings = polygons[r["geoid"]]
        assert r["a"] == pytest.approx(sum(map(shoelace, rings)))
        assert r["b"] == [f(v[i] for ring in rings for v in ring) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1))]
        assert r["l"] == pytest.approx(sum(math.dist(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)))
        step = 0.05 if r["geoid"] != "tiny" else 0.0005
        grid = [(u, v) for u in np.arange(r["b"][0], r["b"][2], step) for v in np.arange(r["b"][1], r["b"][3], step) if inside(rings, u, v)]
        assert (r["x"], r["y"]) == pytest.approx(tuple(np.mean(grid, axis=0)), abs=2 * step)
    points = spark.createDataFrame([(i, random.Random(i).uniform(-12, 12), random.Random(-i).uniform(-12, 12)) for i in range(1, 300)], "id int, x double, y double")
    found = geometry.points_within(points, frame(spark, polygons).withColumnRenamed("geoid", "zone"), 2.5)
    want = {(q["id"], g) for q in points.collect() for g, rings in polygons.items() if inside(rings, q["x"], q["y"])}
    assert {tuple(r) for r in found.collect()} == want


def test_geojson_polygons(spark, tmp_path):
    outer, hole, island = box(0, 0, 4, 4), box(1, 1, 2, 3), box(6, 0, 7, 1)
    close = lambda ring: [list(map(float, p)) for p in ring + ring[:1]]
    features = []
    for n, turn in enumerate((1, -1)):  # rings turn either way in the file
        features += [(f"P{n}", "Polygon", [close(outer[::turn]), close(hole[::turn])]), (f"M{n}", "MultiPolygon", [[close(outer[::turn]), close(hole[::-turn])], [close(island[::turn])]])]
    features += [("E", "Polygon", []), ("L", "LineString", [[0, 0], [1, 1]])]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"geoid": g}, "geometry": {"type": t, "coordinates": c}} for g, t, c in features]}
    (tmp_path / "a.geojson").write_text(json.dumps(body))
    df = readers.geojson_polygons(spark, f"{tmp_path}/a.geojson", {"geoid": "string"})
    rows = df.select("geoid", shapes.polygon_area(F.col("polygon")).alias("a"), shapes.polygon_holds(F.col("polygon"), F.lit(1.5), F.lit(2.0)).alias("in_hole"), shapes.polygon_holds(F.col("polygon"), F.lit(0.5), F.lit(0.5)).alias("in")).collect()
    assert sorted(map(tuple, rows)) == [("M0", 15.0, False, True), ("M1", 15.0, False, True), ("P0", 14.0, False, True), ("P1", 14.0, False, True)]
    again = frame(spark, {r["geoid"]: [[(p["x"], p["y"]) for p in ring] for ring in r["polygon"]] for r in df.collect()})
    assert sorted(again.collect()) == sorted(df.collect())


@pytest.mark.parametrize("size", [0.3, 1.0, 7.0])
def test_coverage_against_clipping(spark, size):
    polygons = some(2)
    cells = raster.cells_of_runs(raster.coverage_runs(frame(spark, polygons), size, "geoid")).collect()
    assert len({(r["geoid"], r["cell_x"], r["cell_y"]) for r in cells}) == len(cells)
    area = Counter()
    for r in cells:
        area[r["geoid"]] += r["fraction"] * size * size
        assert 0 < r["fraction"] <= 1
    for g, rings in polygons.items():
        assert area[g] == pytest.approx(sum(map(shoelace, rings)), rel=1e-6 if g == "tiny" else 1e-9)
    for r in random.Random(3).sample(cells, min(len(cells), 250)):
        x, y = r["cell_x"] * size, r["cell_y"] * size
        want = shapes.polygon_overlap(polygons[r["geoid"]], [box(x, y, x + size, y + size)]) / size**2
        assert r["fraction"] == pytest.approx(want, abs=1e-9)
        assert r["cell_id"] == (r["cell_y"] << 32) + r["cell_x"]


def test_edges_upon_the_sides_of_cells(spark):
    polygons = {"box": [box(-2, -1, 3, 2)], "ring": [box(0, 0, 4, 4), box(1, 1, 3, 3)[::-1]], "diamond": [[(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)]]}
    found = defaultdict(dict)
    for r in raster.cells_of_runs(raster.coverage_runs(frame(spark, polygons), 1.0, "geoid")).collect():
        found[r["geoid"]][r["cell_x"], r["cell_y"]] = r["fraction"]
    assert found["box"] == {(x, y): 1.0 for x in range(-2, 3) for y in range(-1, 2)}
    assert found["ring"] == {(x, y): 1.0 for x in range(4) for y in range(4) if not (1 <= x < 3 and 1 <= y < 3)}
    assert sorted(found["diamond"].values()) == [0.5] * 8 + [1.0] * 4


def test_each_centre_is_in_one_tract_of_a_partition(spark):
    rng = random.Random(5)
    corner = {(i, j): (i + rng.choice([-0.25, 0.0, 0.25]), j + rng.choice([-0.25, 0.0, 0.25])) for i in range(-4, 5) for j in range(-4, 5)}
    polygons = {f"{i},{j}": [[corner[i, j], corner[i + 1, j], corner[i + 1, j + 1], corner[i, j + 1]]] for i in range(-4, 4) for j in range(-4, 4)}
    cells = raster.cells_of_runs(raster.centre_runs(frame(spark, polygons), 0.5, "geoid")).collect()
    at = Counter((r["cell_x"], r["cell_y"]) for r in cells)
    assert set(at.values()) == {1}
    assert {(x, y) for x in range(-6, 6) for y in range(-6, 6)} <= set(at)
    for r in cells:
        assert inside(polygons[r["geoid"]], (r["cell_x"] + 0.5) / 2, (r["cell_y"] + 0.5) / 2)
    polygons = some(6)
    found = {(r["geoid"], r["cell_x"], r["cell_y"]) for r in raster.cells_of_runs(raster.centre_runs(frame(spark, polygons), 0.4, "geoid")).collect()}
    assert found == {(g, x, y) for g, rings in polygons.items() for x in range(-50, 50) for y in range(-50, 50) if inside(rings, (x + 0.5) * 0.4, (y + 0.5) * 0.4)}
    counted = {r["geoid"]: r["n_cells"] for r in raster.tract_geometry(frame(spark, polygons), 0.4).collect()}
    assert counted == {g: sum(f[0] == g for f in found) or None for g in polygons}


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def test_crossings_against_all_pairs(spark):
    rng = random.Random(7)
    polygons = {f"r{i}": [[(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(n)]] for i, n in enumerate((4, 6, 9, 15, 30))}
    polygons["long"] = [[(x / 10, rng.uniform(0, 0.1)) for x in range(100)] + [(9000.0, 4000.0), (-1.0, 50.0), (3.0, -0.5)]]
    polygons |= some(8)
    want = set()
    for g, rings in polygons.items():
        es = [(p, n, ring[n], ring[(n + 1) % len(ring)]) for p, ring in enumerate(rings) for n in range(len(ring))]
        want |= {(g, (e[0] << 32) + e[1], (f[0] << 32) + f[1]) for i, e in enumerate(es) for f in es[i + 1 :] if crosses(e[2], e[3], f[2], f[3])}
    assert {tuple(r) for r in raster.crossings(frame(spark, polygons), "geoid").collect()} == want
    assert {g for g, _, _ in want} >= {"r3", "r4", "long"} and not {g for g, _, _ in want} & set(some(8))


def test_invalid_polygons_are_refused_by_key(spark):
    good = some(9)
    assert raster.valid(frame(spark, good), "geoid").count() == len(good)
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    back = [(0.0, 0.0), (4.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    cases = {"bow": ([bow], "cross: bow"), "spike": ([back], "cross: spike"), "two": ([[(0, 0), (1, 1)]], "three finite points a ring: two"), "nan": ([[(0, 0), (1, 0), (1, math.nan)]], "nan"), "none": ([], "none"), "hole": ([box(0, 0, 1, 1)[::-1]], "area: hole")}
    for name, (rings, said) in cases.items():
        rings = [[(float(x), float(y)) for x, y in ring] for ring in rings]
        with pytest.raises(CatchmentError, match=said):
            raster.valid(frame(spark, good | {name: rings}), "geoid")
    with pytest.raises(CatchmentError, match="cross: bow"):
        raster.build_grid(frame(spark, {"bow": [[(float(x), float(y)) for x, y in bow]]}).withColumn("pop", F.lit(1.0)), 1.0)


def square(spark, pop=((0, 0, 100.0), (1, 0, 300.0))):
    rows = [(f"t{x}{y}", n, [box(float(x), float(y), x + 1.0, y + 1.0)]) for x, y, n in pop]
    return spark.createDataFrame(rows, f"geoid string, pop double, polygon {shapes.POLYGON}")


def zones(spark, rows):
    return spark.createDataFrame([(c, m, [box(*b)]) for c, m, b in rows], f"coord_id string, minutes double, polygon {shapes.POLYGON}")


def test_raster_access_by_hand(spark):
    """Two tracts of one square each, cells of a quarter; a covers t00 whole and half of t10 in its second band."""
    on = raster.build_grid(square(spark), 0.25)
    assert {round(r["pop"], 9) for r in on.cells.collect()} == {6.25, 18.75}
    z = zones(spark, [("a", 30.2, (0.0, 0.0, 1.0, 1.0)), ("a", 60.0, (0.0, 0.0, 1.5, 1.0)), ("a", 45.0, (0.0, 0.0, 9.0, 9.0)), ("far", 30.0, (50.0, 50.0, 51.0, 51.0)), ("idle", 30.0, (0.0, 0.0, 2.0, 2.0))])
    supply = spark.createDataFrame([("a", 2.0), ("far", 3.0), ("nozone", 1.0)], "coord_id string, supply double")
    found = raster.raster_access(on, raster.prepare_zones(z, 0.25), supply, {30: 1.0, 60: 0.5}, scale=1.0, thresholds=[0.0, 0.005])
    demand = 0.5 * 100 + 0.5 * 250
    ratios = {r["coord_id"]: r for r in found.ratios.collect()}
    assert ratios["a"]["weighted_demand"] == pytest.approx(demand) and ratios["a"]["ratio"] == pytest.approx(2 / demand)
    assert {c: (r["ratio"], r["ratio_for_surface"], r["zero_demand"], r["excluded_supply"]) for c, r in ratios.items() if c != "a"} == {"far": (None, 0.0, True, 3.0), "nozone": (None, 0.0, True, 1.0)}
    audit = found.audit.head()
    assert (audit["n_zero_demand_origins"], audit["supply_zero_demand"], audit["bands_outside"]) == (2, 4.0, [45]) and audit["runs_dropped"] > 0
    assert audit["share_supply_zero_demand"] == pytest.approx(4 / 6)
    access = {r["geoid"]: r for r in found.access.collect()}
    assert access["t00"]["access_mean_area"] == pytest.approx(2 / demand) and access["t10"]["access_mean_population"] == pytest.approx(0.25 * 2 / demand)
    assert sum(r["access"] == 0.0 for r in found.surface.collect()) == 8  # exactly none, not nearly
    national = found.national.collect()
    assert national[0]["mean_scaled"] == pytest.approx((100 * 2 / demand + 150 * 1 / demand) / 400)
    assert {r["threshold"]: round(r["share_pop"], 9) for r in national} == {0.0: 1.0, 0.005: 0.625}
    modified = raster.raster_access(on, raster.prepare_zones(z, 0.25), supply, {30: 1.0, 60: 0.5}, power=2.0).access.where("geoid = 't10'").head()
    assert modified["access_mean_area"] == pytest.approx(0.5 * 0.25 * 2 / demand)
    with pytest.raises(CatchmentError, match="supply repeats an origin: a"):
        raster.raster_access(on, raster.prepare_zones(z, 0.25), supply.unionByName(supply.where("coord_id = 'a'")))


def test_allocation_to_centres_loses_small_tracts(spark):
    tracts = square(spark, [(0, 0, 100.0)]).unionByName(square(spark, [(5, 5, 7.0)]).withColumn("polygon", F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in box(5.0, 5.0, 5.1, 5.1)]))))
    sums = {a: raster.build_grid(tracts, 0.5, a).cells.agg(F.sum("pop")).head()[0] for a in ("area", "center")}
    assert sums == {"area": pytest.approx(107.0), "center": pytest.approx(100.0)}
    with pytest.raises(CatchmentError):
        raster.build_grid(tracts, 0.5, "nearest")


def test_sums_and_surfaces_against_cells(spark):
    """Sweeps along rows give what expanded zones give."""
    polygons, rng = some(11), random.Random(12)
    z = spark.createDataFrame([(g, float(rng.choice([30, 60, 120])), p) for g, p in polygons.items()], f"coord_id string, minutes double, polygon {shapes.POLYGON}")
    made = raster.prepare_zones(z, 0.5)
    cells = spark.createDataFrame([((y << 32) + x, x, y, rng.uniform(0, 9)) for x in range(-20, 20) for y in range(-20, 20) if rng.random() < 0.7], "cell_id long, cell_x long, cell_y long, pop double")
    direct = raster.cells_of_runs(made.cover).join(cells.select("cell_id", "pop"), "cell_id").groupBy("coord_id", "band").agg(F.sum(F.col("pop") * F.col("fraction")).alias("p")).collect()
    found = {(r[0], r[1]): r[2] for r in raster.zonal_population(cells, made.cover).collect() if r[2] > 1e-9}
    assert found == {(r[0], r[1]): pytest.approx(r[2]) for r in direct}
    ratios = spark.createDataFrame([(g, rng.uniform(0, 1)) for g in list(polygons)[:-2]], "coord_id string, ratio double")
    step2 = spark.createDataFrame(list(incremental(BAND_WEIGHTS).items()), "band int, w double")
    direct = raster.cells_of_runs(made.centres).join(ratios, "coord_id").join(step2, "band").groupBy("cell_id").agg(F.sum(F.col("w") * F.col("ratio")).alias("a"))
    rows = raster.surface(cells, made.centres, ratios, step2).join(direct, "cell_id", "left").collect()
    assert len(rows) == cells.count()
    assert all((r["access"] == 0.0) if r["a"] is None else r["access"] == pytest.approx(r["a"]) for r in rows)


def test_variants_need_their_grids(spark):
    on = raster.build_grid(square(spark), 0.25)
    with pytest.raises(CatchmentError, match="no grid of resolution"):
        raster.raster_variants({1000: (on, raster.prepare_zones(zones(spark, [("a", 30.0, (0.0, 0.0, 1.0, 1.0))]), 0.25))}, spark.createDataFrame([("a", 1.0)], "coord_id string, supply double"))


def test_overlaps_leave_holes_out(spark):
    z = spark.createDataFrame([("z", 60.0, [box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 3.0, 3.0)[::-1]])], f"coord_id string, minutes double, polygon {shapes.POLYGON}")
    t = frame(spark, {"in": [box(1.5, 1.5, 2.5, 2.5)], "half": [box(0.0, 0.0, 2.0, 2.0)], "same": [box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 3.0, 3.0)[::-1]]})
    assert {r["geoid"]: r["overlap_fraction"] for r in geometry.overlaps(z, t, 1.5).collect()} == {"half": pytest.approx(0.75), "same": pytest.approx(1.0)}


def test_union_counts_overlaps_once(spark):
    polygons = some(13)
    tracts = frame(spark, {"t": [box(-10.0, -10.0, 10.0, 10.0)], "u": [box(-3.0, -3.0, 4.0, 2.0), box(-1.0, -1.0, 1.0, 1.0)[::-1]], "off": [box(90.0, 90.0, 91.0, 91.0)]})
    zone = frame(spark, polygons).withColumnRenamed("geoid", "zone")
    whole = {r["geoid"]: r["fraction"] for r in geometry.union_fractions(zone, tracts, 1.5).collect()}
    assert whole["off"] == 0
    for g, rings in (("t", [box(-10.0, -10.0, 10.0, 10.0)]), ("u", [box(-3.0, -3.0, 4.0, 2.0), box(-1.0, -1.0, 1.0, 1.0)[::-1]])):
        points = [(x, y) for x in np.arange(-10, 10, 0.04) + 0.013 for y in np.arange(-10, 10, 0.04) + 0.017 if inside(rings, x, y)]
        assert whole[g] == pytest.approx(np.mean([any(inside(p, x, y) for p in polygons.values()) for x, y in points[::7]]), abs=0.01)
    for g in ("h0", "s1"):  # one zone, also twice and under a part of itself
        rows = frame(spark, {g: polygons[g]}).withColumnRenamed("geoid", "zone")
        twice = rows.unionByName(rows.withColumn("zone", F.lit("again")))
        for z in (rows, twice):
            got = {r["geoid"]: r["fraction"] for r in geometry.union_fractions(z, tracts, 2.0).collect()}
            assert got["t"] == pytest.approx(shapes.polygon_overlap(polygons[g], [box(-10.0, -10.0, 10.0, 10.0)]) / 400)
    sizes = [{r["geoid"]: r["fraction"] for r in geometry.union_fractions(zone, tracts, s).collect()} for s in (0.4, 50.0)]
    assert sizes[0] == {g: pytest.approx(v) for g, v in sizes[1].items()}


def test_rings_and_cumulative_bands_agree(spark, sf_dir):
    """Band weights on each tract's tightest band equal incremental weights on all bands that hold it."""
    b = Binding(spark, sf_dir)
    nested = b.membership.join(b.tracts.select("geoid", "pop"), "geoid")
    steps = spark.createDataFrame([(k, w, BAND_WEIGHTS[k]) for k, w in incremental(BAND_WEIGHTS).items()], "band int, w double, whole double")
    cumulative = nested.join(steps, "band").groupBy("coord_id").agg(F.sum(F.col("w") * F.col("pop")).alias("d"))
    rings = nested.groupBy("coord_id", "geoid").agg(F.min("band").alias("band"), F.first("pop").alias("pop")).join(steps, "band").groupBy("coord_id").agg(F.sum(F.col("whole") * F.col("pop")).alias("r"))
    rows = cumulative.join(rings, "coord_id", "full").collect()
    assert len(rows) > 50 and all(r["d"] == pytest.approx(r["r"]) for r in rows)


def test_cells_are_not_broadcast(spark, sf_dir):
    """Cells come from small files, but are many."""
    b = Binding(spark, sf_dir)
    on = raster.build_grid(plans.tract_shapes(b), plans.SIZE, check=False)
    found = raster.raster_access(on, raster.prepare_zones(plans.zone_shapes(b), plans.SIZE), b.supply, check=False)
    for df in (on.cells, raster.build_grid(plans.tract_shapes(b), plans.SIZE, "center", check=False).cells, found.access, raster.crossings(plans.tract_shapes(b), "geoid")):
        joins = re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().sparkPlan().toString())
        assert not {"geoid", "cell_id"} & set(joins)


def test_shapes_are_dealt_by_their_pieces(spark, sf_dir, monkeypatch):
    tracts = plans.tract_shapes(Binding(spark, sf_dir)).coalesce(1)
    whole = {tuple(r) for r in raster.coverage_runs(tracts, plans.SIZE, "geoid").collect()}
    monkeypatch.setattr(raster, "PIECES", 5_000)
    tasks = raster.dealt(tracts, plans.SIZE).rdd.getNumPartitions()
    assert tasks > 3 and raster.dealt(tracts, plans.SIZE / 2).rdd.getNumPartitions() > 1.4 * tasks
    assert {tuple(r) for r in raster.coverage_runs(tracts, plans.SIZE, "geoid").collect()} == whole
