"""Running sums over ranges, kept tables, intervals and trends, against direct computations."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachwell.functions import inference, ranges, stats
from reachwell.functions.inference import Contrast, Group
from reachwell.guards import CatchmentError
from reachwell.operators import coverage
from reachwell.storage import Store, kept


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("rows", [7, 1_000_000])
def test_running_sums(spark, monkeypatch, keys, rows):
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    rng = random.Random(1)
    data = [(rng.choice("aaaab"), float(i * 37 % 100), rng.uniform(0, 1), rng.randrange(5)) for i in range(100)]
    df = spark.createDataFrame(data, "g string, x double, w double, n int").repartition(3)
    found = ranges.running(df, "x", {"sw": F.col("w"), "sn": F.col("n")}, *keys)
    assert "SinglePartition" not in plan(found).split("AdaptiveSparkPlan")[-1]
    got = found.collect()
    assert len(got) == 100
    for r in got:
        own = [d for d in data if not keys or d[0] == r["g"]]
        assert r["sw"] == pytest.approx(sum(d[2] for d in own if d[1] <= r["x"])) and r["sw_total"] == pytest.approx(sum(d[2] for d in own))
        assert r["sn"] == sum(d[3] for d in own if d[1] <= r["x"]) and r["n"] == next(d[3] for d in own if d[1] == r["x"])
    assert ranges.running(df.where("false"), "x", {"sw": F.col("w")}, *keys).count() == 0


def weighted_quantiles(x, w, p):
    order = np.argsort(x, kind="stable")
    values = sorted(set(x))
    share = np.array([w[x == v].sum() for v in values]).cumsum() / w.sum()
    step = values[int(np.argmax(share >= p - 1e-12))]
    return step, float(np.interp(p, share, values)), order


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_and_gini_over_many_ranges(spark, monkeypatch, keys):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    rng = random.Random(2)
    data = [(rng.choice("aaab"), float(rng.randrange(0, 60)), rng.uniform(0.1, 2)) for _ in range(300)] + [("a", math.nan, 1.0), ("a", 5.0, 0.0), ("b", None, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, w double")
    probs = [0.1, 0.5, 0.9]
    step = {r["g"] if keys else None: r for r in stats.quantile_step(df, "x", "w", probs, *keys).collect()}
    line = {r["g"] if keys else None: r for r in stats.quantile_linear(df, "x", "w", probs, *keys).collect()}
    gini = {r["g"] if keys else None: r["gini"] for r in stats.gini(df, "x", "w", *keys).collect()}
    for g in "ab" if keys else [None]:
        own = np.array([d[1:] for d in data[:300] if g in (None, d[0])])
        for p in probs:
            s, q, _ = weighted_quantiles(own[:, 0], own[:, 1], p)
            assert step[g][f"q{round(100 * p)}"] == s and line[g][f"q{round(100 * p)}"] == pytest.approx(q)
        x, w = own[:, 0], own[:, 1]
        pairs = np.abs(x[:, None] - x[None, :]) * w[:, None] * w[None, :]
        assert gini[g] == pytest.approx(pairs.sum() / 2 / w.sum() ** 2 / ((x * w).sum() / w.sum()))


def test_rank_correlation_over_many_ranges(spark, monkeypatch):
    rng = random.Random(3)
    data = [(i, rng.randrange(20), rng.randrange(30), rng.random()) for i in range(200)]
    df = spark.createDataFrame(data, "i int, a int, b int, c double")
    found = []
    for rows in (5, 1_000_000):
        monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
        found.append({(r["first"], r["second"]): r["rho"] for r in coverage.spearman(df, [("a", "b"), ("a", "c")]).collect()})
    rank = lambda v: np.array([np.mean([i + 1 for i, s in enumerate(sorted(v)) if s == u]) for u in v])
    cols = {n: rank([d[k] for d in data]) for k, n in ((1, "a"), (2, "b"), (3, "c"))}
    for f in found:
        assert f == {p: pytest.approx(np.corrcoef(cols[p[0]], cols[p[1]])[0, 1]) for p in f}


def made(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["metro", "rural", None]), 0.0 if rng.random() < 0.2 else rng.uniform(0, 5), rng.uniform(10, 100), rng.uniform(5, 40), rng.uniform(0, 30), 9.0) for i in range(n)]


SCHEMA = "id int, r string, a double, e double, s double, e2 double, s2 double"
CONTRASTS = {"d": Contrast("mean_metro", "minus", "mean_rural"), "q": Contrast("mean_metro", "over", "mean_rural"), "z": Contrast("zero_g", "minus", "zero_metro"), "same": Contrast("mean_all", "minus", "mean_all")}


def groups():
    return {"all": Group("e", "s"), "metro": Group("e", "s", F.col("r") == "metro"), "rural": Group("e", "s", F.col("r") == "rural"), "g": Group("e2", "s2")}


def test_intervals_against_draws_of_every_row(spark):
    data = made(80, 4)
    df = spark.createDataFrame(data, SCHEMA)
    found = {r["metric"]: r for r in inference.intervals(df, "a", groups(), CONTRASTS, draws=20_000).collect()}
    rng, a = np.random.default_rng(5), np.array([d[2] for d in data])
    where = {"all": np.ones(80, bool), "metro": np.array([d[1] == "metro" for d in data]), "rural": np.array([d[1] == "rural" for d in data]), "g": np.ones(80, bool)}
    e, s, e2, s2 = (np.array([d[k] for d in data]) for k in (3, 4, 5, 6))

    def metrics(w, w2):
        out = {}
        for g, c in where.items():
            x = (w2 if g == "g" else w)[..., c]
            out |= {f"mean_{g}": (x * a[c]).sum(-1) / x.sum(-1), f"zero_{g}": 100 * (x * (a[c] == 0)).sum(-1) / x.sum(-1)}
        return out | {"d": out["mean_metro"] - out["mean_rural"], "q": out["mean_metro"] / out["mean_rural"], "z": out["zero_g"] - out["zero_metro"], "same": out["mean_all"] * 0}

    drawn, point = metrics(e + s * rng.standard_normal((20_000, 80)), e2 + s2 * rng.standard_normal((20_000, 80))), metrics(e, e2)
    assert set(found) == set(point)
    for m, r in found.items():
        low, high = np.quantile(drawn[m], [0.025, 0.975])
        assert r["point"] == pytest.approx(point[m], abs=1e-9)
        assert (r["low"], r["high"]) == pytest.approx((low, high), abs=0.06 * max(high - low, 1e-9))
        assert r["excludes_zero"] == (r["low"] > 0 or r["high"] < 0)


def test_a_contrast_is_covered(spark):
    """Populations are drawn around the truth; the intervals hold the true contrast 19 times in 20."""
    rng = random.Random(6)
    base = [(rng.choice(["metro", "rural"]), rng.uniform(0, 5), rng.uniform(50, 100)) for _ in range(60)]
    mean = lambda r: sum(a * e for x, a, e in base if x == r) / sum(e for x, _, e in base if x == r)
    truth = mean("metro") - mean("rural")
    rows = [(k, r, a, e + rng.gauss(0, 20), 20.0) for k in range(300) for r, a, e in base]
    df = spark.createDataFrame(rows, "k int, r string, a double, e double, s double")
    own = {"metro": Group("e", "s", F.col("r") == "metro"), "rural": Group("e", "s", F.col("r") == "rural")}
    found = inference.intervals(df, "a", own, {"d": Contrast("mean_metro", "minus", "mean_rural")}, "k").where("metric = 'd'").collect()
    assert len(found) == 300 and 0.91 < np.mean([r["low"] <= truth <= r["high"] for r in found]) < 0.98


def test_intervals_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(made(500, 7), SCHEMA)
    one, two = (sorted(map(tuple, inference.intervals(d, "a", groups(), CONTRASTS, "r").collect()), key=repr) for d in (df.coalesce(1), df.repartition(13, "id")))
    for x, y in zip(one, two, strict=True):
        assert x[:2] == y[:2] and [v for v in x[2:5] if v is not None] == pytest.approx([v for v in y[2:5] if v is not None], rel=1e-7, abs=1e-7)
    assert "Generate" not in plan(inference.intervals(df, "a", groups(), CONTRASTS))


def test_intervals_of_odd_inputs(spark):
    df = spark.createDataFrame([(1, "metro", 2.0, 10.0, None, None, 1.0), (2, "metro", None, 99.0, 1.0, 1.0, 1.0), (3, "metro", math.nan, 99.0, 1.0, 1.0, 1.0)], SCHEMA)
    found = {r["metric"]: tuple(r)[1:] for r in inference.intervals(df, "a", groups(), CONTRASTS).collect()}
    assert found["mean_metro"] == (2.0, 2.0, 2.0, True) and found["mean_rural"] == (None, None, None, None) and found["d"] == (None, None, None, None)
    with pytest.raises(CatchmentError, match="negative standard error: s"):
        inference.intervals(df.withColumn("s", F.lit(-1.0)), "a", groups())
    with pytest.raises(CatchmentError, match="no contrast"):
        inference.intervals(df, "a", groups(), {"x": Contrast("mean_all", "minus", "mean_nobody")})


def test_student_p(spark):
    rows = [(t, nu) for t in (-7.0, -2.0, -0.1, 0.0, 0.5, 1.0, 3.3, 40.0) for nu in (*range(1, 14), 50)]
    for r in spark.createDataFrame(rows, "t double, nu int").withColumn("p", inference.student_p(F.col("t"), F.col("nu"))).collect():
        assert r["p"] == pytest.approx(stats.student_p(r["t"], r["nu"]), abs=1e-12)


def test_trends(spark):
    rng = random.Random(8)
    series = {"a": [(2013 + i, 5 + 0.3 * i + rng.gauss(0, 1)) for i in range(10)], "b": [(2013, 1.0), (2014, 2.0)], "c": [(2013 + i, 2.0 * i) for i in range(4)], "d": [(2013 + i, 7.0) for i in range(4)], "e": [(2015, 1.0), (2015, 2.0), (2015, 4.0)]}
    rows = [(k, y, v) for k, own in series.items() for y, v in own] + [("a", 2023, 99.0), ("b", 2015, None)]
    found = {r["k"]: r for r in inference.trends(spark.createDataFrame(rows, "k string, y int, v double"), "y", "v", "k").collect()}
    y, v = np.array(series["a"]).T
    x = y - y.mean()
    slope = (x @ v) / (x @ x)
    se = math.sqrt(((v - v.mean() - slope * x) ** 2).sum() / 8 / (x @ x))
    assert (found["a"]["slope"], found["a"]["se"], found["a"]["p"]) == pytest.approx((slope, se, stats.student_p(slope / se, 8)))
    assert tuple(found["b"])[2:] == (None, None, None) == tuple(found["e"])[2:]
    assert found["c"]["p"] == 0 and found["d"]["p"] == 1 and found["d"]["slope"] == 0


def test_inferential_table(spark):
    found = spark.createDataFrame([("GO", "mean_all", 1.23456, 1.0, 2.0), ("GO", "q", 0.5, 0.25, 0.75), ("REI", "mean_all", None, None, None)], "s string, metric string, point double, low double, high double")
    trend = spark.createDataFrame([("GO", "Rural", 0.1234, 0.0456), ("GO", "Metro", None, None)], "s string, stratum string, slope double, p double")
    rows = inference.inferential_table(found, trend, "s", [("mean", "mean_all", 3), ("ratio", "q", 2)], [("rural", "Rural"), ("metro", "Metro")]).orderBy("s").collect()
    assert list(map(tuple, rows)) == [("GO", "1.235 (1.000-2.000)", "0.50 (0.25-0.75)", "+0.123/yr (P=0.046)", None), ("REI", None, None, None, None)]


def test_store(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.range(10).write.parquet(source)
    store, made = Store(spark, f"{tmp_path}/store"), defaultdict(int)

    def build():
        made["n"] += 1
        return spark.read.parquet(source).withColumn("x", F.col("id") * 2)

    key = {"vintage": 2020, "resolution": 500}
    assert not store.holds("grid", **key)
    first = store.table("grid", build, **key)
    second = Store(spark, f"{tmp_path}/store/").table("grid", build, **key)
    assert made["n"] == 1 and sorted(first.collect()) == sorted(second.collect()) and second.count() == 10
    assert "source" not in plan(second) and all("/store/" in f for f in second.inputFiles())
    store.table("grid", build, vintage=2010, resolution=500)
    assert made["n"] == 2 and store.release("grid", **key) and not store.release("grid", **key)
    assert not store.holds("grid", **key) and store.holds("grid", vintage=2010, resolution=500)
    broken = tmp_path / "store" / "grid" / "resolution=500" / "vintage=2010" / "table" / "_SUCCESS"
    broken.unlink()  # a writing that was cut off
    store.table("grid", build, vintage=2010, resolution=500)
    assert made["n"] == 3
    with pytest.raises(CatchmentError):
        store.holds("grid", year="../2020")


def test_kept_is_computed_once(spark):
    n = spark.sparkContext.accumulator(0)
    df = spark.range(5).rdd.map(lambda r: (n.add(1), r[0])[1:]).toDF("id long")
    again = kept(df)
    assert again.count() == 5 and sorted(r[0] for r in again.collect()) == list(range(5)) and n.value == 5
