"""Places of work, fitted models, checks that refuse, streams and settings."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import RACE_FEMALE, TOTAL_FEMALE
from reachwell.functions import weights
from reachwell.guards import CatchmentError
from reachwell.operators import access, centroid, classify, coverage, geometry, grid, robustness, scenario, sites, strata, supply
from reachwell.sources import readers, sinks
from reachwell.streaming.supply import windowed_supply

LOCATIONS = "npi string, address_key string, place int, zip5 string, lat double, lon double, is_primary string, rural string"


def test_canonical_places_are_refused(spark):
    good = [("1", "a", 1, None, 40.0, -100.0, "yes", "0"), ("1", "a", 2, "80202", None, -101.0, "no", "1"), ("1", "b", 3, None, 41.0, -100.0, "no", None)]
    rows = {r["address_key"]: r for r in sites.canonical(spark.createDataFrame(good, LOCATIONS)).collect()}
    assert (rows["a"]["zip5"], rows["a"]["lon"], rows["a"]["is_primary"], rows["a"]["rural"], rows["a"]["distance_km"]) == ("80202", -100.0, True, True, 0.0)
    assert rows["b"]["distance_km"] == pytest.approx(6371.0088 * math.radians(1)) and rows["b"]["n_locations"] == 2
    for bad, said in (((good[2],), "exactly one primary place: 1"), ((*good, ("1", "c", 4, None, 1.0, 1.0, "TRUE", "0")), "exactly one primary place: 1"), ((*good, ("1", "c", 4, None, None, 1.0, "no", "0")), "without coordinates: 1::c")):
        with pytest.raises(CatchmentError, match=said):
            sites.canonical(spark.createDataFrame(list(bad), LOCATIONS))


def test_a_single_days_work(spark):
    lines = spark.createDataFrame([("1", "d", "a", "z", None), ("1", "d", "b", "z", None), ("1", "d", "b", "z", None), ("1", "e", "a", "z", 3.0), ("1", "e", "b", "z", 1.0), ("2", "d", "a", "z", 0.0)], "npi string, service_date string, address_key string, zip5 string, work_rvu double")
    found = {tuple(r)[:3]: r["day_fraction"] for r in sites.day_fractions(lines).collect()}
    assert found == {("1", "d", "a"): pytest.approx(1 / 3), ("1", "d", "b"): pytest.approx(2 / 3), ("1", "e", "a"): 0.75, ("1", "e", "b"): 0.25, ("2", "d", "a"): 1.0}


def test_schemes_and_capacities_refuse(spark):
    places = spark.createDataFrame([("1", "1a", True, 2, 0.7), ("1", "1b", False, 2, 0.2)], "npi string, location_id string, is_primary boolean, n_locations int, predicted_weight double")
    direct = spark.createDataFrame([], "npi string, location_id string, direct_weight double")
    with pytest.raises(CatchmentError, match="empirical_model_weight doesn't sum to one: 1"):
        sites.schemes(places, direct)
    whole = sites.schemes(places.withColumn("predicted_weight", F.col("predicted_weight") / 0.9), direct)
    with pytest.raises(CatchmentError, match="provider without a capacity: 1"):
        sites.capacities(whole, spark.createDataFrame([("2", 1.0)], "npi string, total double"))
    assert {r["location_id"]: r["primary_heavy_capacity"] for r in sites.capacities(whole).collect()} == {"1a": 0.8, "1b": pytest.approx(0.2)}


def logistic(x, y, ridge=0.0, rounds=60):
    """Coefficients (intercept first) and standard errors by iterated weighted least squares."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_odds_ratios_against_a_direct_fit(spark):
    rng = random.Random(1)
    rows = [(x := rng.gauss(0, 1), z := float(rng.random() < 0.4), int(rng.random() < 1 / (1 + math.exp(-(0.3 + 0.8 * x - 1.1 * z))))) for _ in range(800)]
    beta, error = logistic(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]))
    found = {r["term"]: r for r in coverage.odds_ratios(spark.createDataFrame([*rows, (None, 1.0, 1)], "x double, z double, y int"), "y", ["x", "z"]).collect()}
    for name, b, e in zip(("(intercept)", "x", "z"), beta, error, strict=True):
        assert (found[name]["odds_ratio"], found[name]["low"], found[name]["high"]) == pytest.approx((math.exp(b), math.exp(b - 1.96 * e), math.exp(b + 1.96 * e)), rel=1e-5)


def shares(rng, n):
    rows = []
    for i in range(n):
        k = rng.randrange(2, 5)
        raw = [math.exp(1.0 * (j == 0) - 0.05 * 10 * j + rng.gauss(0, 0.2)) for j in range(k)]
        rows += [(str(i), f"{i}{j}", j == 0, math.log(k), 10.0 * j, raw[j] / sum(raw)) for j in range(k)]
    return rows


def test_share_model_against_a_direct_fit(spark):
    rows = shares(random.Random(2), 80)
    df = spark.createDataFrame(rows, "npi string, location_id string, is_primary boolean, log_locations double, distance_km double, empirical_weight double")
    x = np.array([[float(r[2]), r[3], r[4]] for r in rows])
    beta, _ = logistic(x, np.array([r[5] for r in rows]))
    p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), x]) @ beta))
    total = {n: sum(v for r, v in zip(rows, p, strict=True) if r[0] == n) for n in {r[0] for r in rows}}
    found = {r["location_id"]: r["predicted_weight"] for r in sites.share_model(df)(df).collect()}
    assert found == {r[1]: pytest.approx(v / total[r[0]], abs=1e-4) for r, v in zip(rows, p, strict=True)}
    folds = sites.cross_validated(df, 4)
    assert sorted(r[0] for r in folds.select("location_id").collect()) == sorted(r[1] for r in rows)
    assert all(r[0] == pytest.approx(1) for r in folds.groupBy("npi").agg(F.sum("predicted_weight")).select(F.col("sum(predicted_weight)")).collect())
    held = folds.select(F.avg(F.abs(F.col("predicted_weight") - F.col("empirical_weight")))).head()[0]
    assert held < 0.08


def test_nearest_with_fewer_others_than_asked_for(spark):
    others = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1000.0, 0.0)], "id string, x double, y double")
    points = spark.createDataFrame([("p", 1.0, 0.0)], others.schema)
    assert [(r["other"], r["place"]) for r in geometry.nearest(points, others, 9, 1.0).orderBy("place").collect()] == [("a", 1), ("b", 2)]
    assert geometry.nearest(others, others, 9, 1.0, self_join=True).count() == 2
    far = spark.createDataFrame([("z", 1.0, -100.0)], "id string, lat double, lon double")
    origins = spark.createDataFrame([("o", 1.0, -100.01), ("u", 1.0, -101.0)], "coord_id string, lat double, lon double")
    assert [tuple(r) for r in supply.near_surface(far, origins, 1e5).collect()] == [("o", 1)]
    assert supply.near_surface(far, origins.where("coord_id = 'u'"), 1e5).count() == 0


def test_workforce_cross_check_refuses(spark):
    staged = spark.createDataFrame([("GO", 10), ("MFM", 5)], "specialty string, n_providers int")
    derived = spark.createDataFrame([("GO", 11), ("MFM", 5)], "specialty string, n_derived int")
    assert {r["specialty"]: r["diff"] for r in supply.cross_checked(staged, derived).collect()} == {"GO": -1, "MFM": 0}
    for a, b, said in ((staged, derived.withColumn("n_derived", F.col("n_derived") + 1), "disagree: GO"), (staged.where("specialty = 'GO'"), derived, "disagree: MFM"), (staged, derived.where("specialty = 'GO'"), "disagree: MFM"), (staged.unionByName(staged), derived, "repeats: GO")):
        with pytest.raises(CatchmentError, match=said):
            supply.cross_checked(a, b)


def test_run_gates_pass_and_fail(spark):
    rows = [(v, s, n, n * (1 + 1e-9)) for v, n in (("base", 1.0), ("m2sfca", 0.8)) for s in ("GO", "MFM")]
    schema = "variant string, subspec string, national double, national_check double"
    assert robustness.run_gates(spark.createDataFrame(rows, schema), ["base", "m2sfca"], ["GO", "MFM"]).count() == 0
    bad = [("base", "GO", -1.0, -1.0), ("base", "MFM", 1.0, 1.1), ("m2sfca", "MFM", 1.2, 1.2), ("m2sfca", "MFM", 1.2, None), ("other", "GO", math.nan, None)]
    found = {tuple(r) for r in robustness.run_gates(spark.createDataFrame(bad, schema), ["base", "m2sfca"], ["GO", "MFM"]).collect()}
    assert found == {("negative", "base", "GO"), ("disagrees", "base", "MFM"), ("repeated", "m2sfca", "MFM"), ("missing", "m2sfca", "GO"), ("m2sfca_above_base", "m2sfca", "MFM")}


def test_order_claim(spark):
    rows = [("a", s, float(n)) for s, n in (("MFM", 9), ("GO", 8), ("REI", 3), ("CFP", 1))] + [("b", "MFM", 9.0), ("b", "REI", 8.5), ("b", "GO", 8.0), ("b", "CFP", 1.0)] + [("c", "GO", 9.0), ("c", "MFM", 9.0), ("c", "CFP", None), ("c", "REI", 0.5)]
    found = {r["variant"]: r["c5"] for r in robustness.order_claim(spark.createDataFrame(rows, "variant string, subspec string, national double"), ["MFM", "GO"], "CFP").collect()}
    assert found == {"a": True, "b": False, "c": True}


def test_palettes_and_codes(spark):
    for (name, n), text in classify.PALETTES.items():
        found = classify.palette(name, n)
        assert len(found) == n * n == len(set(text.split())) and set(found) == {f"{i}-{j}" for i in range(1, n + 1) for j in range(1, n + 1)}
    assert classify.palette()["3-1"] == "#5ac8c8" and classify.palette("PinkBlue", 4)["1-4"] == "#f18d9e" and classify.PALETTE["1-3"] == "#be64ac"
    with pytest.raises(CatchmentError, match="no palette 'Grey' of 3"):
        classify.palette("Grey")
    assert len(set(RACE_FEMALE.values())) == 6 and TOTAL_FEMALE not in RACE_FEMALE.values()
    with pytest.raises(CatchmentError, match="no columns a49"):
        centroid.age_band_demand(spark.createDataFrame([tuple(["g", *[1.0] * 22])], ["geoid", *[f"a{i}" for i in range(27, 49)]]), {"adult": (31, 49)})


def test_active_bands(tmp_path, monkeypatch):
    text = "manuscript_settings:\n  drive_time_thresholds_minutes: [120, 30, 60]\n"
    for folder in ("root", "pipeline", "cwd"):
        (tmp_path / folder / "config").mkdir(parents=True)
    monkeypatch.chdir(tmp_path / "cwd")
    monkeypatch.delenv("PIPELINE_ROOT", raising=False)
    assert readers.active_bands() == [30, 60, 120, 180]
    (tmp_path / "cwd" / "config" / "isochrone_config.yaml").write_text(text)
    assert readers.active_bands() == [30, 60, 120]
    (tmp_path / "pipeline" / "config" / "isochrone_config.yaml").write_text("manuscript_settings: {drive_time_thresholds_minutes: [15]}")
    monkeypatch.setenv("PIPELINE_ROOT", str(tmp_path / "pipeline"))
    assert readers.active_bands() == [15]
    (tmp_path / "root" / "config" / "isochrone_config.yaml").write_text("other: 1\n")
    assert readers.active_bands(root=str(tmp_path / "root"), fallback=[9, 5]) == [5, 9]
    (tmp_path / "root" / "config" / "isochrone_config.yaml").write_text("a: [1,")
    assert readers.active_bands(root=str(tmp_path / "root")) == [30, 60, 120, 180]


def test_audit_and_metadata(spark):
    overlap = [(f"s{i:02}", b, "t", 1.0) for i in range(30) for b in (30, 45)] + [(f"x{i:02}", 30, "t", 1.0) for i in range(25)]
    found = access.e2sfca(spark.createDataFrame(overlap, "coord_id string, band int, geoid string, overlap_fraction double"), spark.createDataFrame([("t", 0.0)], "geoid string, pop double"), spark.createDataFrame([(f"s{i:02}", 1.0) for i in range(30)], "coord_id string, supply double"), {30: 1.0, 60: 0.5}, power=2.0)
    audit = found.audit.head()
    assert audit["zero_demand_coord_ids"] == [f"s{i:02}" for i in range(20)] and audit["coord_ids_without_supply"] == [f"x{i:02}" for i in range(20)]
    assert (audit["n_zero_demand_origins"], audit["n_coords_without_supply"], audit["n_rows_outside_bands"], audit["bands_outside"]) == (30, 25, 30, [45])
    assert (found.method, found.maximum_minutes, found.weights, found.step2) == ("M2SFCA", 60, {30: 1.0, 60: 0.5}, {30: 0.75, 60: 0.25})


def test_zero_share_fails_closed(spark):
    cells = spark.createDataFrame([(1, 10.0, 0.0), (2, 30.0, 1.0), (3, 60.0, None)], "cell_id int, pop double, access double")
    with pytest.raises(CatchmentError, match="60.0 of 100.0 unresolved"):
        grid.zero_share_or_fail(cells)
    assert grid.zero_share_or_fail(cells, 60.0) == 25.0 == grid.zero_share_or_fail(cells.where("access is not null"))


def test_scenarios_refuse(spark):
    rows = spark.createDataFrame([("baseline", 2025, "national", 10.0, 8.0)], "scenario_id string, year int, geography_type string, supply_headcount double, supply_clinical_fte double")
    assert scenario.national_supply(rows, "clinical_fte").head()["national_supply"] == 8.0
    for bad, basis, said in ((rows, "souls", "basis"), (rows.unionByName(rows), "headcount", "more than one national row"), (rows.withColumn("supply_headcount", F.lit(0.0)), "headcount", "isn't positive"), (rows.withColumn("geography_type", F.lit("state")), "headcount", "no national row: baseline/2025")):
        with pytest.raises(CatchmentError, match=said):
            scenario.national_supply(bad, basis)
    weights, origins = spark.createDataFrame([("CO", 1.0)], "state string, weight double"), spark.createDataFrame([("a", "CO", 1.0)], "coord_id string, state string, supply double")
    with pytest.raises(CatchmentError, match="unknown scenarios: growth"):
        scenario.project(rows, ["growth"], [2025], weights, origins, lambda *a: None)
    with pytest.raises(CatchmentError, match="must return a DataFrame"):
        scenario.project(rows, ["baseline"], [2025], weights, origins, lambda *a: None)
    found = scenario.project(rows, ["baseline"], [2025], weights, origins, lambda own, name, year: own).collect()
    assert [tuple(r) for r in found] == [("a", 10.0, "baseline", 2025)]


def test_projection_from_a_path(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/p")
    assert scenario.projection(f"{tmp_path}/p", spark).count() == 3


def test_stream_counts_each_provider_once(spark, tmp_path):
    """Two files with a provider in both; later ones move the watermark beyond the first window, and what comes late is left out."""
    files = [[(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-02 00:00:00"), (2, "a", "2024-01-03 00:00:00"), (None, "a", "2024-01-03 00:00:00")], [(1, "a", "2024-01-05 00:00:00"), (3, "b", "2024-01-05 00:00:00")], [(9, "z", "2024-03-20 00:00:00")], [(9, "z", "2024-03-20 01:00:00")], [(2, "late", "2024-01-04 00:00:00"), (9, "z", "2024-03-21 00:00:00")]]
    schema = "npi int, coord_id string, seen_at string"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("seen_at", F.to_timestamp("seen_at"))
    query = windowed_supply(stream, "10 days").writeStream.format("memory").queryName("supply_seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["coord_id"], r["supply"]) for r in spark.table("supply_seen").collect())
    table = spark.createDataFrame([r for f in files[:2] for r in f], schema).withColumn("seen_at", F.to_timestamp("seen_at"))
    want = sorted((r["coord_id"], r["supply"]) for r in windowed_supply(table, "10 days").collect())
    assert got == want == [("a", 2), ("b", 1)]


def test_locks_and_staged_inputs(spark, tmp_path):
    lock = tmp_path / "lock.json"
    sinks.write_atomic(str(lock), json.dumps(sinks.environment()))
    assert sinks.locked_environment(str(lock)) == sinks.environment()
    sinks.write_atomic(str(lock), json.dumps(sinks.environment() | {"numpy": "0.1", "geos": "3"}))
    with pytest.raises(CatchmentError, match="geos 3 -> None, numpy 0.1 -> "):
        sinks.locked_environment(str(lock))
    spark.range(1).write.parquet(f"{tmp_path}/here")
    sinks.staged(spark, f"{tmp_path}/here", str(lock))
    with pytest.raises(CatchmentError, match="aren't staged: .*/gone"):
        sinks.staged(spark, f"{tmp_path}/here", f"{tmp_path}/gone")


def test_frozen_manifest(spark, tmp_path):
    man, digest = tmp_path / "m.json", tmp_path / "m.sha256"
    digest.write_text(sinks.write_atomic(str(man), json.dumps({"specifications": [{"id": 1, "variant": "base", "status": "frozen"}, {"id": 2, "variant": "res500", "status": "frozen"}, {"id": 3, "variant": "later", "status": "pipeline"}]})) + "  m.json\n")
    found = sinks.frozen_manifest(str(man), str(digest))
    rows = spark.createDataFrame([("base",), ("res500",)], "variant string")
    assert sinks.complete_run(found, rows) is rows
    with pytest.raises(CatchmentError, match="weren't run: res500"):
        sinks.complete_run(found, rows.where("variant = 'base'"))
    man.write_text(man.read_text() + " ")
    with pytest.raises(CatchmentError, match="has changed since it was frozen"):
        sinks.frozen_manifest(str(man), str(digest))
    digest.write_text(sinks.write_atomic(str(man), json.dumps({"specifications": [{"id": 1}, {"id": 1}]})))
    with pytest.raises(CatchmentError, match="repeats 1"):
        sinks.frozen_manifest(str(man), str(digest))


def test_neutral_labels(spark):
    good = spark.createDataFrame([("mean access",), ("inadequately phrased",), (None,)], "label string")
    assert guards.neutral(good, "label").count() == 3
    for bad in ("Provider SHORTAGE in rural tracts", "an under-supply", "unmet needs"):
        with pytest.raises(CatchmentError, match="normative term in label"):
            guards.neutral(good.unionByName(spark.createDataFrame([(bad,)], "label string")), "label")


def test_four_bands():
    assert weights.incremental_of_four({30: 1.0, 60: 0.68, 120: 0.22, 180: 0.09}) == pytest.approx({30: 0.32, 60: 0.46, 120: 0.13, 180: 0.09})
    with pytest.raises(CatchmentError, match="not 3"):
        weights.incremental_of_four({30: 1.0, 60: 0.5, 120: 0.1})


def test_a_correction_by_hand(spark):
    """One region of two: its tract had no access and gets 9; the other's goes from 2 to 3."""
    schema = "geoid string, access double"
    old, new = spark.createDataFrame([("09a", None), ("10b", 2.0), ("10c", 0.0)], schema), spark.createDataFrame([("09a", 9.0), ("10b", 3.0), ("10c", 0.0)], schema)
    pop = spark.createDataFrame([("09a", 100.0), ("10b", 100.0), ("10c", 100.0)], "geoid string, pop double")
    ratios = spark.createDataFrame([(2.0, 5.0), (7.0, 0.0)], "supply double, weighted_demand double")
    r = strata.correction_summary(old, new, pop, lambda g: g.startswith("09"), ratios=(ratios, ratios), scale=100.0).head()
    assert (r["mean_frozen"], r["mean_corrected"], r["second_order"], r["direct"]) == (1.0, 4.0, 0.5, 2.5)
    assert (r["delta_pct"], r["second_order_pct"], r["direct_pct"]) == (300.0, 50.0, 250.0)
    assert (r["region_mean_frozen"], r["region_mean_corrected"], r["n_unknown_frozen"], r["n_unknown_corrected"], r["n_zero_frozen"]) == (None, 9.0, 1, 0, 1)
    assert (r["pop_unknown_pct_frozen"], r["pop_zero_pct_corrected"]) == (pytest.approx(100 / 3), pytest.approx(100 / 3))
    assert (r["conservation_residual_frozen"], r["conservation_residual_corrected"]) == (0.0, 5.0)
    with pytest.raises(CatchmentError, match="other tracts: 10c"):
        strata.correction_summary(old, new.where("geoid <> '10c'"), pop, lambda g: g.startswith("09"))


def test_thresholds_are_reached_within_the_noise_of_sums(spark):
    places = spark.createDataFrame([(n, f"{n}{j}", 2) for n in "123" for j in "ab"], "npi string, location_id string, n_locations int")
    matched = [("1", "1a", 1.0, 1.9999999999999998, 0.49999999999999994), ("2", "2a", 1.0, 1.99, 0.7), ("3", "3a", 1.0, 2.0, 0.49)]
    found = sites.training_rows(places, spark.createDataFrame(matched, "npi string, location_id string, day_equiv double, observed_days double, matched_weight double"), 0.5, 2.0)
    assert {r["location_id"]: r["empirical_weight"] for r in found.collect()} == {"1a": 1.0, "1b": 0.0}


def test_checked_tables_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    locations = spark.createDataFrame([("1", "a", 1, None, 40.0, -100.0, "yes", "0"), ("1", "b", 2, None, 41.0, -100.0, "no", None)], LOCATIONS)
    places = sites.canonical(locations.mapInArrow(counted, LOCATIONS))
    direct = spark.createDataFrame([("1", "1::a", 0.75), ("1", "1::b", 0.25)], "npi string, location_id string, direct_weight double")
    rows = sites.schemes(places.withColumn("predicted_weight", 1 / F.col("n_locations")), direct)
    assert {r["location_id"]: r["empirical_model_weight"] for r in rows.collect()} == {"1::a": 0.75, "1::b": 0.25}
    assert made.value == 2


def test_equal_places_are_searched_once(spark, monkeypatch):
    rng, seen = random.Random(5), []
    inner = geometry._nearest

    def counted(points, others, *more):
        seen.append((points.count(), others.count()))
        return inner(points, others, *more)

    monkeypatch.setattr(geometry, "_nearest", counted)
    spots = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(12)]
    points, others = [(i, *rng.choice(spots[:6])) for i in range(300)], [(f"{i:03}", *rng.choice(spots)) for i in range(200)]
    found = geometry.nearest(*[spark.createDataFrame(rows, f"id {kind}, x double, y double") for rows, kind in ((points, "long"), (others, "string"))], 3, 2.0)
    want = {}
    for i, x, y in points:
        for place, (d, o) in enumerate(sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), o) for o, u, v in others)[:3], 1):
            want[i, place] = (o, d)
    assert {(r["id"], r["place"]): (r["other"], r["distance"]) for r in found.collect()} == want
    assert seen == [(6, 36)]
