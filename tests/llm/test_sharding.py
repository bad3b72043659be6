"""Groups larger than a shard's room."""

from collections import Counter, defaultdict

import pytest

from reachwell.llm import sharding


@pytest.mark.parametrize(("hot", "most"), [(2667, 8), (800, 3), (300, 1)])
def test_a_hot_group_is_on_as_few_shards_as_hold_it(spark, hot, most):
    texts = ["hot"] * hot + [f"pair {i // 2}" for i in range(1000)]
    texts += [f"alone {i}" for i in range(8000 - len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = sharding.assign(df).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(8000))
    sizes = Counter(r["shard"] for r in found)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    on, pairs = Counter(r["shard"] for r in found if r["doc_id"] < hot), defaultdict(set)
    for r in found:
        if texts[r["doc_id"]].startswith("pair"):
            pairs[texts[r["doc_id"]]].add(r["shard"])
    assert len(on) <= most
    assert sum(len(s) == 1 for s in pairs.values()) > 0.9 * len(pairs)


def test_planned():
    assert sharding.planned([25, 7, 3], [10, 10, 10, 10]) == [[(0, 10), (1, 10), (2, 5)], [(3, 7)], [(3, 3)]]
    assert sharding.planned([], [1, 0]) == []
