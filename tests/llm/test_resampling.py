"""Importance resampling against a direct computation, word by word."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reachwell.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight string, row string, bucket string"


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], len(words)


def buckets(text, m=10_000):
    return [zlib.crc32(f.encode()) % m for f in features(text)[0]]


def expected(docs, target, percent=25, least=20):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000))))
    out = []
    for d, x in docs:
        own = buckets(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(own), weight, score, features(x)[1] >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(able) * percent // 100
    place = {id(r): i + 1 for i, r in enumerate(able)}
    return sorted(([*r[:4], place[id(r)] if place.get(id(r), drawn + 1) <= drawn else None] for r in out), key=repr)


def found(spark, docs, target, parts=3):
    df = spark.createDataFrame([(d, x, "a", "b", "c") for d, x in docs], SCHEMA).repartition(parts)
    items = spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    rows = resampling.resample(df, items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((list(r) for r in rows), key=repr)


def made(n, seed):
    rng = random.Random(seed)
    pool = [f"{p}{i}" for p in ("mot", "WORT", "é", "数", "x") for i in range(60)] + ["z" * 47, "z" * 48, "z" * 49, "q" * 5000, "Ünï"]
    gaps = [" ", "  ", "\n", "-", "\x00", "", " , "]
    return [(i, "".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randrange(0, 90)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_direct_computation(spark, seed):
    docs = made(300, seed) + [(1000, None), (1001, ""), (1002, " \n-"), (1003, "one two " * 60_000), (1004, "w" * 200_000)]
    target = [x for _, x in made(40, seed + 10)] + [None, "", "!"]
    assert found(spark, docs, target) == expected(docs, target)


def test_ties_and_repeated_rows(spark):
    texts = [x for _, x in made(30, 5)]
    docs = [(i % 7, texts[i % 30]) for i in range(60)] + [(None, texts[3])] * 40 + [(3, "a " * 25), (3, "b " * 25)]
    assert found(spark, docs, texts[:5]) == expected(docs, texts[:5]) == found(spark, docs, texts[:5], 7)


def test_a_third_of_the_rows_equal_over_many_ranges(spark, monkeypatch):
    docs = made(120, 6) + [(9, "same " * 30)] * 60
    real = resampling.numbered
    monkeypatch.setattr(resampling, "numbered", lambda df, *order: real(df, *order, task_rows=10))
    assert found(spark, docs, ["same " * 30]) == expected(docs, ["same " * 30])


def test_empty_tables(spark):
    docs = made(50, 7)
    assert found(spark, docs, []) == expected(docs, [])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    assert found(spark, [(1, None), (2, " ")], ["a"]) == [[1, 0, 0, r[3], None] if r[0] == 1 else [2, 0, 0, r[3], None] for r in expected([(1, None), (2, " ")], ["a"])]


def test_texts_that_touch_in_the_buffer():
    texts = pa.array(["ab", "", None, "cd ef", "gh", "ij"])
    got, row, words = resampling.features(texts, 10_000)
    assert words.tolist() == [1, 0, 0, 2, 1, 1]
    want = sorted((i, b) for i, x in enumerate(texts.to_pylist()) for b in buckets(x))
    assert sorted(zip(row.tolist(), got.tolist(), strict=True)) == want
    part = texts.slice(3, 2)
    got, row, _ = resampling.features(part, 10_000)
    assert sorted(zip(row.tolist(), got.tolist(), strict=True)) == sorted((i, b) for i, x in enumerate(part.to_pylist()) for b in buckets(x))


def test_checksums_of_all_sizes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    starts, sizes = rng.integers(0, 2000, 300), rng.integers(0, 200, 300)
    state = resampling.advanced(np.full(300, 0xFFFFFFFF, np.uint32), data, starts, sizes)
    assert [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)] == (state ^ np.uint32(0xFFFFFFFF)).tolist()
