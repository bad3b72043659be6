"""Natural breaks of many values, comparison of results, seam populations, stored grids."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachwell.functions import geometry as shapes
from reachwell.functions import ranges
from reachwell.guards import CatchmentError
from reachwell.operators import classify, compare, raster, strata
from reachwell.storage import Store


def quadratic(x, w, k):
    """The least sum of squares within ``k`` classes, by all cuts of all values."""
    x, w = np.array(x, float), np.array(w, float)
    x = x - (w @ x) / w.sum()
    cw, cx, cxx = (np.append(0, np.cumsum(v)) for v in (w, w * x, w * x * x))
    best = np.append(0.0, np.full(len(x), np.inf))
    for _ in range(k):
        now = np.full(len(x) + 1, np.inf)
        for j in range(1, len(x) + 1):
            i = np.arange(j)
            now[j] = (best[:j] + cxx[j] - cxx[i] - (cx[j] - cx[i]) ** 2 / (cw[j] - cw[i])).min()
        best = now
    return best[-1]


def within(x, w, ends):
    x, w, total, low = np.array(x, float), np.array(w, float), 0.0, 0
    for e in ends:
        high = int(np.searchsorted(x, e, "right"))
        v, m = x[low:high], w[low:high]
        total += (m * (v - (m @ v) / m.sum()) ** 2).sum()
        low = high
    assert low == len(x)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_natural_breaks_against_the_quadratic_programme(seed):
    rng = random.Random(seed)
    n, k = rng.randrange(8, 400), rng.randrange(2, 8)
    draw = [lambda: rng.uniform(0, 1), lambda: rng.paretovariate(1), lambda: 1e9 + rng.gauss(0, 1), lambda: float(rng.randrange(500))][seed % 4]
    x = sorted({draw() for _ in range(n)})
    w = [rng.choice([1, 1, 5, 1000]) for _ in x]
    found = classify.jenks(x, w, k)
    assert found[0] == x[0] and found[-1] == x[-1] and found == sorted(found)
    assert within(x, w, found[1:]) == pytest.approx(quadratic(x, w, k), rel=1e-6)


def test_natural_breaks_of_a_hundred_thousand_values():
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([rng.normal(c, 1, 34_000) for c in (0, 20, 50)]))
    assert len(x) > 100_000
    began = time.time()
    found = classify.jenks(x, np.ones(len(x)), 3)
    assert time.time() - began < 30
    assert found[1:] == [x[x < 10].max(), x[x < 35].max(), x[-1]]  # a class ends with its greatest value
    sample = x[:: len(x) // 400]
    assert within(sample, np.ones(len(sample)), classify.jenks(sample, np.ones(len(sample)), 5)[1:]) == pytest.approx(quadratic(sample, np.ones(len(sample)), 5))


def test_breaks_fall_back_to_quantiles(spark, monkeypatch):
    monkeypatch.setattr(classify, "JENKS_VALUES", 50)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    rng = random.Random(2)
    values = [rng.paretovariate(1) for _ in range(300)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "v double")
    with pytest.warns(UserWarning, match="equal counts"):
        found = classify.breaks(df, "v", 4, "jenks")
    want = np.quantile([v or 0.0 for v in values], [0, 0.25, 0.5, 0.75, 1])
    assert found == pytest.approx(sorted(set(want))) == classify.breaks(df, "v", 4, "quantile")
    few = df.where("v is null or v < 1.05")
    assert classify.breaks(few, "v", 3, "jenks")[0] == 0.0
    with pytest.raises(CatchmentError):
        classify.breaks(df.where("false"), "v", 4, "jenks")
    assert classify.quantiles(df.where("false"), F.col("v"), [0.5]) is None


NESTED = "id string, year int, n long, tags array<string>, by map<string,struct<mean:double,note:string>>, deep array<struct<x:array<double>>>, made struct<at:string>"


def record(**more):
    base = {"id": "a", "year": 2020, "n": 3, "tags": ["x", "y"], "by": {"GO": (0.5, "ok"), "REI": (1.5, None)}, "deep": [([1.0, 2.0],), ([],)], "made": ("now",)}
    base |= more
    return tuple(base.values())


def test_differences_of_nested_records(spark):
    before = spark.createDataFrame([record(), record(id="b"), record(id="gone", by={}, deep=None, tags=None, made=None)], NESTED)
    after = spark.createDataFrame([record(n=4, tags=["x", "y", "z"], by={"GO": (0.5 + 1e-12, "no"), "MFM": (9.0, None)}, deep=[([1.0, math.nan],), ([7.0],)], made=("later",)), record(id="b"), record(id="new", by={}, deep=[], tags=[], made=None)], NESTED)
    found = compare.differences(before, after, ["id", "year"], ignore=["made"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([
        ("a", 2020, "n", "changed", "3", "4"), ("a", 2020, "tags[2]", "added", None, "z"), ("a", 2020, "by.GO.note", "changed", "ok", "no"), ("a", 2020, "by.REI.mean", "missing", "1.5", None),
        ("a", 2020, "by.MFM.mean", "added", None, "9.0"), ("a", 2020, "deep[0].x[1]", "changed", "2.0", "NaN"), ("a", 2020, "deep[1].x[0]", "added", None, "7.0"), ("gone", 2020, "n", "missing", "3", None), ("new", 2020, "n", "added", None, "3"),
    ], key=repr)
    assert compare.differences(before, before, ["id", "year"]).count() == 0
    assert compare.differences(before, after.withColumn("n", F.col("n") + 0), ["id", "year"], tolerance=10).where("path = 'n' and id = 'a'").count() == 0
    with pytest.raises(CatchmentError, match=r"results moved: a/2020/by.GO.note changed \(ok -> no\)"):
        compare.unchanged(before, after, ["id", "year"], ignore=["made"])
    assert compare.unchanged(before, before, ["id", "year"]) is before
    with pytest.raises(CatchmentError, match="repeats its key: a/2020"):
        compare.differences(before.unionByName(before.where("id = 'a'")), after, ["id", "year"])


def test_a_number_that_became_a_text(spark):
    one, two = spark.createDataFrame([(1, 2.0)], "id int, v double"), spark.createDataFrame([(1, "2.0"), (2, "x")], "id int, v string")
    assert [tuple(r) for r in compare.differences(one, two, ["id"]).collect()] == [(2, "v", "added", None, "x")]


def box(x0, y0, x1, y1):
    return [[(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def test_seam_populations_by_hand(spark):
    """Two current tracts, of which one holds no centre; former ones halve the first and leave the second out."""
    tracts = spark.createDataFrame([("a", 100.0, box(0, 0, 2, 2)), ("b", 10.0, box(5, 5, 5.2, 5.2))], f"geoid string, pop double, polygon {shapes.POLYGON}")
    former = spark.createDataFrame([("l", box(0, 0, 1, 2)), ("r", box(1, 0, 2, 2))], f"geoid string, polygon {shapes.POLYGON}")
    rows = raster.seam_populations(tracts, former, 1.0)
    totals = {(r[0], r[1]): round(r[2], 9) for r in rows.groupBy("method", "vintage").agg(F.sum("pop")).collect()}
    assert totals == {("raw", "current"): 100, ("raw", "former"): 100, ("equal_total", "current"): 100, ("equal_total", "former"): 100, ("mass_conserving", "current"): 110, ("mass_conserving", "former"): 100, ("mass_conserving_eqtot", "current"): 110, ("mass_conserving_eqtot", "former"): 110}
    former = spark.createDataFrame([("l", box(0, 0, 0.4, 2)), ("r", box(0.4, 0, 2, 2))], former.schema)  # the left one has no centre
    rows = raster.seam_populations(tracts, former, 1.0)
    totals = {(r[0], r[1]): round(r[2], 9) for r in rows.groupBy("method", "vintage").agg(F.sum("pop")).collect()}
    assert totals["raw", "former"] == 80 and totals["equal_total", "former"] == 100 and totals["mass_conserving", "former"] == 100
    with pytest.raises(CatchmentError, match="negative population: a"):
        raster.seam_populations(tracts.withColumn("pop", F.when(F.col("geoid") == "a", -1.0).otherwise(1.0)), former, 1.0)


def test_stored_grids_read_no_source_twice(spark, tmp_path):
    tracts = spark.createDataFrame([("a", 100.0, box(0, 0, 2, 2))], f"geoid string, pop double, polygon {shapes.POLYGON}")
    zones = spark.createDataFrame([("z", 30.0, box(0, 0, 1, 2))], f"coord_id string, minutes double, polygon {shapes.POLYGON}")
    for df, n in ((tracts, "tracts"), (zones, "zones")):
        df.write.parquet(f"{tmp_path}/source/{n}")
    store, asked = Store(spark, f"{tmp_path}/kept"), []

    def source(name):
        return lambda: asked.append(name) or spark.read.parquet(f"{tmp_path}/source/{name}")

    supply, found = spark.createDataFrame([("z", 2.0)], "coord_id string, supply double"), []
    for _ in range(2):
        on = raster.stored_grid(store, source("tracts"), 0.5, vintage=2020, year=2021)
        made = raster.stored_zones(store, source("zones"), 0.5, year=2021)
        found.append(raster.raster_access(on, made, supply, check=False).access)
    assert asked == ["tracts", "zones"]
    assert all("/kept/" in f for f in found[1].inputFiles()) and found[0].collect() == found[1].collect()
    raster.stored_grid(store, source("tracts"), 1.0, vintage=2020, year=2021)
    assert asked == ["tracts", "zones", "tracts"]


def test_changes_within_the_noise_of_sums_have_no_sign(spark):
    rows = [("a", 2021, 0.1 + 0.2, 1.0), ("a", 2022, 0.3, 2.0), ("b", 2021, 0.3, 1.0), ("b", 2022, 0.1 + 0.2, 2.0), ("c", 2021, 0.3, 1.0), ("c", 2022, 0.3 + 3e-11, 2.0)]
    found = strata.temporal_effect(spark.createDataFrame(rows, "s string, year int, mean_frozen double, mean_corrected double"), "s", [(2021, 2022)])
    assert {r["s"]: r["sign_flip"] for r in found.collect()} == {"a": True, "b": True, "c": False}
