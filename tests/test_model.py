"""The model on small systems with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from reachwell.functions import stats, weights
from reachwell.guards import CatchmentError
from reachwell.operators import access, centroid

EDGES = "coord_id string, band int, geoid string, overlap_fraction double"
ZONES = {10: 1.0, 20: 0.68, 30: 0.22}


def system(spark, edges, pop, supply):
    return (
        spark.createDataFrame(edges, EDGES),
        spark.createDataFrame(pop, "geoid string, pop double"),
        spark.createDataFrame(supply, "coord_id string, supply double"),
    )


def three_zones(spark):
    edges = [("P1", b, t, 1.0) for t, first in (("T1", 10), ("T2", 20), ("T3", 30)) for b in ZONES if b >= first]
    return system(spark, edges, [("T1", 1000.0), ("T2", 2000.0), ("T3", 500.0)], [("P1", 10.0)])


def by_tract(found, column="access"):
    return {r["geoid"]: r[column] for r in found.access.collect()}


def test_published_zones(spark):
    found = access.e2sfca(*three_zones(spark), weights=ZONES)
    assert found.ratios.head()["weighted_demand"] == pytest.approx(2470)
    assert by_tract(found) == pytest.approx({"T1": 10 / 2470, "T2": 0.68 * 10 / 2470, "T3": 0.22 * 10 / 2470})


def test_modified_model_squares_the_second_step(spark):
    found = access.e2sfca(*three_zones(spark), weights=ZONES, power=2.0)
    assert by_tract(found) == pytest.approx({"T1": 10 / 2470, "T2": 0.68**2 * 10 / 2470, "T3": 0.22**2 * 10 / 2470})


def test_two_tracts(spark):
    edges = [("A", 30, "T1", 1.0), ("A", 60, "T1", 1.0), ("A", 60, "T2", 0.5), ("B", 30, "T2", 1.0), ("B", 60, "T2", 1.0)]
    found = access.e2sfca(*system(spark, edges, [("T1", 100.0), ("T2", 200.0)], [("A", 3.0), ("B", 1.0)]), weights={30: 1.0, 60: 0.5})
    assert {r["coord_id"]: r["ratio"] for r in found.ratios.collect()} == pytest.approx({"A": 0.02, "B": 0.005})
    assert by_tract(found) == pytest.approx({"T1": 0.02, "T2": 0.01})
    assert by_tract(found, "n_providers") == {"T1": 1, "T2": 2}


def test_unreached_is_null_and_measured_zero_is_zero(spark):
    edges = [("P", 30, "T1", 1.0), ("Z", 30, "T2", 1.0), ("P", 30, "T3", 0.0)]
    tables = system(spark, edges, [("T1", 100.0), ("T2", 0.0), ("T3", 50.0), ("T4", 10.0)], [("P", 1.0), ("Z", 3.0)])
    found = access.e2sfca(*tables, weights={30: 1.0})
    assert by_tract(found) == {"T1": 0.01, "T2": 0.0, "T3": None, "T4": None}
    audit = found.audit.head()
    assert (audit["n_zero_demand_origins"], audit["supply_zero_demand"], audit["n_outside"]) == (1, 3.0, 2)
    assert {r["coord_id"]: r["ratio"] for r in found.ratios.collect()}["Z"] is None


def test_supply_is_conserved(spark):
    edges, pop, supply = three_zones(spark)
    rows = access.e2sfca(edges, pop, supply, weights=ZONES).access.join(pop, "geoid")
    assert rows.agg(F.sum(F.col("access") * F.col("pop"))).head()[0] == pytest.approx(10)


@pytest.mark.parametrize("broken", ["duplicate tract", "null population", "unknown tract"])
def test_guards_refuse(spark, broken):
    edges, pop, supply = three_zones(spark)
    if broken == "duplicate tract":
        pop = pop.unionByName(pop)
    elif broken == "null population":
        pop = pop.withColumn("pop", F.when(F.col("geoid") != "T1", F.col("pop")))
    else:
        pop = pop.where("geoid != 'T3'")
    with pytest.raises(CatchmentError):
        access.e2sfca(edges, pop, supply, weights=ZONES)


def test_weights():
    assert weights.gaussian([30, 60, 120, 180])[180] == pytest.approx(0.0126, abs=5e-5)
    assert weights.incremental({30: 1.0, 60: 0.5}, 2.0) == {30: 0.75, 60: 0.25}


def test_quintiles(spark):
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate([0, 0, 1, 2, 3, 4, 5, 6, 7, 8])], "i int, access double")
    found = centroid.quintiles(df).orderBy("i").collect()
    column = next(c for c in found[0].asDict() if c not in ("i", "access"))
    assert [r[column] for r in found] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_weighted_statistics(spark):
    df = spark.createDataFrame([(1.0, -1.0), (2.0, 1.0), (3.0, 1.0)], "a double, w double")
    assert df.select(stats.weighted_mean_all(F.col("a"), F.col("w"))).head()[0] == pytest.approx(4)
    df = spark.createDataFrame([(0.0, 100.0), (1e-9, 100.0), (0.5, 100.0)], "a double, w double")
    assert df.select(stats.zero_share(F.col("a"), F.col("w"))).head()[0] == pytest.approx(100 / 3)


def test_student_p():
    assert stats.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
