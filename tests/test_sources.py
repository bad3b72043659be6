"""Readers and sinks by round trips, column expressions and spatial joins against plain Python."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from reachwell.functions import geometry as shapes
from reachwell.functions import scalars, weights
from reachwell.guards import CatchmentError
from reachwell.operators import access, geometry
from reachwell.sources import readers, sinks


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n\n007,1\n010,2\n")
    (tmp_path / "a.tsv").write_text("code\tn\n007\t1\n")
    rows = readers.csv_strings(spark, f"{tmp_path}/a.csv", ["code", "n"])
    assert [tuple(r) for r in rows.collect()] == [("007", "1"), ("010", "2")]
    rows = readers.csv_typed(spark, f"{tmp_path}/a.csv", "code string, n int")
    assert rows.dtypes == [("code", "string"), ("n", "int")] and [tuple(r) for r in rows.collect()] == [("007", 1), ("010", 2)]
    assert [tuple(r) for r in readers.by_suffix(spark, f"{tmp_path}/a.tsv", "code string, n int").collect()] == [("007", 1)]
    with pytest.raises(CatchmentError):
        readers.by_suffix(spark, f"{tmp_path}/a.csv")
    with pytest.raises(CatchmentError):
        readers.by_suffix(spark, f"{tmp_path}/a.rds")


def test_parquet_pushes_down(spark, tmp_path):
    path = f"{tmp_path}/a.parquet"
    spark.range(10).withColumn("b", F.col("id") * 2).withColumn("c", F.lit("x")).write.parquet(path)
    df = readers.parquet(spark, path, ["b"], F.col("id") > 7)
    assert sorted(r["b"] for r in df.collect()) == [16, 18]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,7)" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan
    assert readers.by_suffix(spark, path).count() == 10


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [("P", "Polygon", [square]), ("M", "MultiPolygon", [[square], [[[5, 5], [6, 5], [6, 6], [5, 5]]]])]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"geoid": g, "other": 1}, "geometry": {"type": t, "coordinates": c}} for g, t, c in features]}
    (tmp_path / "a.geojson").write_text(json.dumps(body))
    rows = readers.geojson_rings(spark, f"{tmp_path}/a.geojson", {"geoid": "string"}).withColumn("area", shapes.area(F.col("ring"))).collect()
    assert sorted((r["geoid"], r["part"], r["area"]) for r in rows) == [("M", 0, 4.0), ("M", 1, 0.5), ("P", 0, 4.0)]
    body["features"][0]["geometry"]["coordinates"].append([[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]])
    (tmp_path / "b.geojson").write_text(json.dumps(body))
    with pytest.raises(Exception, match="has holes"):
        readers.geojson_rings(spark, f"{tmp_path}/b.geojson", {"geoid": "string"}).collect()


def test_stacked_bundle_and_summary(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("y", 2)], "s string, n int")
    assert sorted(map(tuple, readers.stacked([a, b]).collect())) == [(1, "x"), (2, "y")]
    years = spark.createDataFrame([(2012,), (2019,), (2020,), (2024,)], "year int")
    pop, tracts = spark.createDataFrame([(2013,), (2019,), (2020,), (2022,)], "acs_year int"), spark.createDataFrame([(2010,), (2020,)], "vintage int")
    found = readers.bundle_years(pop, tracts, years).collect()
    assert sorted(map(tuple, found)) == [(2012, 2013, 2010), (2019, 2019, 2010), (2020, 2020, 2020), (2024, 2022, 2020)]
    with pytest.raises(CatchmentError):
        readers.bundle_years(pop.where("acs_year < 2022"), tracts, years)
    rows = [(f"s{i}", 2013 + y, 1.0 + i, "m", 500) for i in range(2) for y in range(3)]
    schema = "specialty string, year int, mean double, method string, resolution int"
    assert readers.national_summary(spark.createDataFrame(rows, schema), 2, 3).count() == 6
    for bad in (rows[:-1], [*rows[:-1], rows[0]], [*rows[:-1], (*rows[-1][:2], None, *rows[-1][3:])], [*rows[:-1], (*rows[-1][:4], 1000)]):
        with pytest.raises(CatchmentError):
            readers.national_summary(spark.createDataFrame(bad, schema), 2, 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (None, None)], "n int, s string")
    digest = sinks.write_with_digest(df, f"{tmp_path}/t")
    assert digest == sinks.row_digest(df.repartition(3)) != sinks.row_digest(df.where("n = 1"))
    assert sinks.read_verified(spark, f"{tmp_path}/t", strict=True).count() == 3
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/t")
    with pytest.warns(UserWarning):
        sinks.read_verified(spark, f"{tmp_path}/t")
    with pytest.raises(CatchmentError):
        sinks.read_verified(spark, f"{tmp_path}/t", strict=True)
    sinks.write_csv(df.where("n is not null"), f"{tmp_path}/c", "n")
    assert [p.read_text() for p in (tmp_path / "c").glob("part-*")] == ["n,s\n1,a\n2,b\n"]
    assert sinks.markdown(df.where("n is not null"), "n") == "| n | s |\n| --- | --- |\n| 1 | a |\n| 2 | b |\n"
    with pytest.raises(CatchmentError):
        sinks.markdown(df, "n", most=2)
    sinks.write_manifest(f"{tmp_path}/m.json", run="r1", n=3)
    assert sinks.read_manifest(f"{tmp_path}/m.json", run="r1") == {"run": "r1", "n": 3}
    assert sorted(p.name for p in tmp_path.glob("*.json")) == ["m.json"]
    with pytest.raises(CatchmentError):
        sinks.read_manifest(f"{tmp_path}/m.json", run="r2")


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head()


def test_scalars(spark):
    lit = F.lit
    assert tuple(one(spark, *scalars.parse_coord(lit("40.5_-75.25")), *scalars.parse_coord(lit("40.5")), *scalars.parse_coord(lit("a_b")))) == (40.5, -75.25, None, None, None, None)
    assert tuple(one(spark, scalars.in_conus(lit(40.0), lit(-100.0)), scalars.in_conus(lit(61.0), lit(-150.0)), scalars.in_conus(lit(None), lit(1.0)))) == (True, False, False)
    km = one(spark, scalars.haversine_km(lit(39.7392), lit(-104.9903), lit(40.7128), lit(-74.0060)))[0]
    a, b, c, d = map(math.radians, (39.7392, -104.9903, 40.7128, -74.0060))
    central = math.acos(math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b))
    assert km / central == pytest.approx(scalars.EARTH_KM, rel=1e-9)
    assert tuple(one(spark, scalars.within_surface(lit(0.0)), scalars.within_surface(lit(None).cast("double")))) == (True, False)
    key = scalars.address_key(lit("1 Main St. & 2nd"), lit(None), lit("Den-ver"), lit("co"), lit("80202-1234"))
    assert one(spark, key)[0] == "1MAINSTAND2ND||DENVER|CO|80202"
    assert one(spark, scalars.address_key(lit(""), lit(""), lit("x"), lit("y"), lit("none")))[0] == "||X|Y|NA"
    assert tuple(one(spark, *[scalars.parse_bool(lit(v)) for v in (" Yes", "1", "PRIMARY", "no", "", None)])) == (True, True, True, False, False, False)
    day = datetime.date(2020, 2, 29)
    assert tuple(one(spark, *[scalars.parse_date(lit(v)) for v in ("2020-02-29", "20200229", "2020/02/29", "29.2.2020", None)])) == (day, day, day, None, None)
    assert weights.parse_weights("30=1, 60=0.68") == {30: 1.0, 60: 0.68} and weights.parse_years("2013:2015") == [2013, 2014, 2015] and weights.parse_years("2013,2016") == [2013, 2016]


def test_ring_measures(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    df = spark.createDataFrame([(ring,), ([*ring, ring[0]],), (ring[::-1],)], f"ring {shapes.RING}")
    r = F.col("ring")
    found = df.select(shapes.area(r).alias("a"), *[c.alias(n) for c, n in zip(shapes.centroid(r), "xy", strict=True)], shapes.holds(r, F.lit(0.5), F.lit(2.0)).alias("in"), shapes.holds(r, F.lit(2.0), F.lit(2.0)).alias("out")).collect()
    for row in found:  # the box of 12 without the triangle of 4 whose centre is (2, 7/3)
        assert row["a"] == pytest.approx(8) and row["x"] == pytest.approx(2) and row["y"] == pytest.approx((12 * 1.5 - 4 * 7 / 3) / 8)
        assert row["in"] and not row["out"]


def test_albers_keeps_areas(spark):
    def cell(lat):
        x, y = zip(*[one(spark, *shapes.albers(F.lit(-96.0 + i * 0.01), F.lit(lat + j * 0.01))) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))], strict=True)
        return abs(sum(x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4))) / 2

    e2, a = 0.00669438002290, 6378137.0
    for lat in (30.0, 45.0):
        m = math.radians(lat + 0.005)
        w = 1 - e2 * math.sin(m) ** 2
        true = (a * (1 - e2) / w**1.5) * (a / math.sqrt(w) * math.cos(m)) * math.radians(0.01) ** 2
        assert cell(lat) == pytest.approx(true, rel=1e-5)


def test_overlaps_of_boxes_and_of_a_notch(spark):
    rng = random.Random(1)

    def box(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]

    zones = [(f"z{i}", 30 + 30 * (i % 2), (rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(1, 25), rng.uniform(1, 25))) for i in range(12)]
    tracts = [(f"t{i}", (rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(1, 8), rng.uniform(1, 8))) for i in range(40)]
    z = spark.createDataFrame([(c, float(m), box(*b)) for c, m, b in zones], f"coord_id string, minutes double, ring {shapes.RING}")
    t = spark.createDataFrame([(g, box(*b)) for g, b in tracts], f"geoid string, ring {shapes.RING}")
    want = {}
    for c, m, (x, y, w, h) in zones:
        for g, (a, b, v, k) in tracts:
            if (s := max(0.0, min(x + w, a + v) - max(x, a)) * max(0.0, min(y + h, b + k) - max(y, b))) > 0:
                want[c, m, g] = s / (v * k)
    for size in (5.0, 100.0):
        got = {(r["coord_id"], r["band"], r["geoid"]): r["overlap_fraction"] for r in geometry.overlaps(z, t, size).collect()}
        assert got == pytest.approx(want)
    assert shapes.overlap_area([(0, 0), (4, 0), (4, 3), (2, 1), (0, 3)], [(0, 0), (4, 0), (4, 3), (0, 3)]) == pytest.approx(8)
    with pytest.raises(CatchmentError):
        geometry.overlaps(z, spark.createDataFrame([("bad", [(0.0, 0.0), (1.0, 1.0)])], t.schema), 5.0)


def test_points_within(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(200)]
    rings = [("a", [(1.0, 1.0), (6.0, 1.0), (3.0, 7.0)]), ("b", [(2.0, 0.0), (9.0, 0.0), (9.0, 9.0), (2.0, 9.0)])]

    def inside(ring, x, y):
        found = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            found ^= (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
        return found

    p = spark.createDataFrame(points, "id int, x double, y double")
    r = spark.createDataFrame(rings, f"zone string, ring {shapes.RING}")
    want = {(i, z) for i, x, y in points for z, ring in rings if inside(ring, x, y)}
    assert {tuple(x) for x in geometry.points_within(p, r, 2.0).collect()} == want
    left = [tuple(x) for x in geometry.points_within(p, r, 2.0, "left").collect()]
    assert {i for i, z in left if z is None} == {i for i, _, _ in points} - {i for i, _ in want}


@pytest.mark.parametrize("size", [24.0, 500.0])
def test_nearest(spark, size):
    rng = random.Random(3)
    points = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60)] + [(60, 90.0, -70.0), (61, 90.0, -70.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    want = {}
    for i, x, y in points:
        near = sorted((math.dist((x, y), (a, b)), j) for j, a, b in points if j != i)[:3]
        want |= {(i, p + 1): (j, pytest.approx(d)) for p, (d, j) in enumerate(near)}
    assert {(r["id"], r["place"]): (r["other"], r["distance"]) for r in geometry.nearest(df, df, 3, size, self_join=True).collect()} == want


def test_neighbour_graph(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(9)], "id int, x double, y double")
    graph = {tuple(r) for r in geometry.neighbour_graph(df, 1, 500.0).collect()}
    assert graph == {(i, i) for i in range(9)} | {(i, max(0, i - 1)) for i in range(1, 9)} | {(0, 1)}
    assert geometry.nearest(df.limit(0), df.limit(0), 3, 1.0).count() == 0


def test_nested_flags(spark):
    df = spark.createDataFrame([("a", 30, False), ("a", 60, True), ("a", 120, False), ("b", 30, None), ("b", 60, False)], "k string, band int, inside boolean")
    assert {(r["k"], r["band"]) for r in geometry.nested_flags(df, "k").where("inside").collect()} == {("a", 60), ("a", 120)}


def test_reached_tract_without_score_is_refused(spark):
    overlap = spark.createDataFrame([("p", 30, "t", 1.0)], "coord_id string, band int, geoid string, overlap_fraction double")
    pop = spark.createDataFrame([("t", 100.0)], "geoid string, pop double")
    assert access.e2sfca(overlap, pop, spark.createDataFrame([("p", 2.0)], "coord_id string, supply double")).access.head()["access"] == pytest.approx(0.02)
    unknown = spark.createDataFrame([("p", None)], "coord_id string, supply double")
    with pytest.raises(Exception, match="supply|no score"):
        access.e2sfca(overlap, pop, unknown).access.collect()
    with pytest.raises(Exception, match="no score"):
        access.e2sfca(overlap, pop, unknown, check=False).access.collect()
