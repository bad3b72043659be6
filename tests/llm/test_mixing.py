"""Mixing against a direct computation: order by hash, add up, stop nearest to the target."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from reachwell.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, key string, of string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(docs, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """By source: target and, for each document (doc_id, text), how often it is taken in all."""
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += size_of(t)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = [s for s in names if s not in capped]
        budget = share * sum(sizes.values()) - sum(capped.values())
        given = {s: budget * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if given[s] > most * sizes[s]]
        if not over:
            break
        capped |= {s: Fraction(most * sizes[s]) for s in over}
    target, taken = capped | given, Counter()
    for s in names:
        own = [(d, t) for d, x, t in docs if x == s and size_of(t)]
        if not own:
            continue
        times = target[s] // sizes[s]
        left = target[s] - times * sizes[s]
        for d, t in own:
            taken[s, d, t] += times * size_of(t)
        for d, t in sorted(own, key=lambda x: hashlib.md5(f"{'' if x[0] is None else x[0]}:{x[1]}".encode()).hexdigest()[:15]):
            n = size_of(t)
            if 2 * left <= n and left <= n:
                break
            taken[s, d, t] += n
            left -= n
    return sizes, target, taken


def check(spark, docs, **kw):
    rows = [(d, s, t, "a", "b", "c") for d, s, t in docs]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    assert len(found) == len(docs)
    sizes, target, taken = expected(docs)
    by_id = {d: (s, t) for d, s, t in docs}
    got = Counter()
    for r in found:
        s, t = by_id[r["doc_id"]]
        assert r["size"] == size_of(t) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(float(target[s]), rel=1e-12)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        got[s, r["doc_id"], t] += r["taken"]
    assert +got == +taken
    return found, target


def made(n, sources, seed):
    rng = random.Random(seed)
    texts = lambda: " \t\n\x0b "[rng.randrange(5)].join(rng.choices(["ein", "mot", "é", "x-y", " "], k=rng.randrange(0, 40)))
    return [(i, rng.choice(sources), None if rng.random() < 0.05 else texts()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_direct_computation(spark, seed):
    sources = ["hot"] * 12 + ["b", "a", "\U00010000", "�", "", None, "Z", "é"]
    docs = made(900, sources, seed) + [(2000, "empty", None), (2001, "empty", " \t"), (2002, "long", "mot " * 200_000)]
    _, target = check(spark, docs)
    assert target["empty"] == 0


def test_nearest_sum_by_source(spark):
    docs = made(600, ["a", "b", None], 3)
    found, target = check(spark, docs)
    source = {d: s for d, s, _ in docs}
    sums, most = Counter(), Counter()
    for r in found:
        sums[source[r["doc_id"]]] += r["taken"]
        most[source[r["doc_id"]]] = max(most[source[r["doc_id"]]], r["size"])
    for s, t in target.items():
        assert abs(sums[s] - t) <= most[s] / 2


def test_repeated_rows_without_ids(spark):
    """A third of all rows are equal: as many are taken as come nearest, whichever they are."""
    docs = [(None, "a", "one two three")] * 400 + made(800, ["a", "b", "c"], 4)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    runs = [sorted(tuple(r) for r in mixing.mix(d).collect() if r["doc_id"] is None) for d in (df, df.repartition(2))]
    assert runs[0] == runs[1] and len(runs[0]) == 400
    assert {r[1] for r in runs[0]} == {3}
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["target"]] += r["taken"]
    for target, n in taken.items():
        assert abs(n - target) <= 20


def test_all_rows_equal_at_the_threshold(spark):
    docs = [(7, "a", "w " * 10)] * 50 + [(8, "b", "v " * 1000)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    own = [r for r in found if r["doc_id"] == 7]
    assert sum(r["taken"] for r in own) == own[0]["target"] == 1000
    docs = [(7, "a", "w " * 10)] * 50 + [(8, "b", "v " * 100)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    own = [r for r in found if r["doc_id"] == 7]
    assert own[0]["target"] == 700 and sum(r["taken"] for r in own) == 700


def test_many_sources_are_joined_under_salts(spark, monkeypatch):
    docs = made(300, ["hot"] * 5 + list("abcdef"), 5)
    monkeypatch.setattr(mixing, "SENT_BYTES", 0)
    check(spark, docs)


def test_reruns_agree_and_empty_table(spark):
    docs = made(200, ["a", "b", None], 6)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert sorted(mixing.mix(df).collect()) == sorted(mixing.mix(df.repartition(7)).collect())
    none = mixing.mix(df.where("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "size", "source_size", "target", "taken"]
    blank = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_a_smaller_target_is_part_of_a_larger_one(spark):
    df = spark.createDataFrame(made(400, ["a", "b"], 7), "doc_id long, source string, text string")
    small, large = ({r["doc_id"]: r["taken"] for r in mixing.mix(df, share=s).collect()} for s in (0.4, 0.7))
    assert all(large[d] >= n for d, n in small.items()) and sum(large.values()) > sum(small.values())
