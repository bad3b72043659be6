"""Near duplicates, lines, vectors and passages against brute force."""

import random
import re

import numpy as np
import pytest

from reachwell.llm import embeddings, lines, neardup, substrings
from reachwell.llm.decontamination import words_of


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def alike(a, b, least=0.8):
    return bool(a) and len(a & b) >= least * len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=150)
        out.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            near = list(words)
            for _ in range(rng.choice([0, 1, 2, 12])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(" ".join(near))
    return [*out, "one two", "one two", "One, TWO", None, None, "", "!!!", "!!!", "long " + "very " * 30_000]


def shingled(text):
    w = words_of(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_neardup_classes(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, id long, component string").repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    sets = [shingled(t) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])]
    assert [found[i] for i in range(len(sets))] == union(len(sets), pairs)
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(found.values())


def test_neardup_of_nothing(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neardup_weights(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 50), (2, "a b c d e " * 48), (3, "a b c d e " * 3)], "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, weights="count").collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_line_dedup(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choices([f"mot{i}" for i in range(300)], k=rng.randrange(4, 40))) for _ in range(30)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            if rng.random() < 0.5:
                words = line.split()
                words[rng.randrange(len(words))] = "neu"
                line = " ".join(words)
            own.append(rng.choice(["", "  ", "\t"]) + (line.upper() if rng.random() < 0.2 else line))
        docs.append((i, "\n".join(own), "extra"))
    docs += [(40, None, "extra"), (41, "", "extra"), (42, "\n \n", "extra"), (43, docs[0][1], "extra")]
    df = spark.createDataFrame(docs, "doc_id long, text string, id string").repartition(4)

    spots = [(d, p, line.strip(" \t\n\x0b\f\r").lower()) for d, t, _ in docs for p, line in enumerate((t or "").split("\n"))]
    spots = [s for s in spots if s[2]]
    piece = re.compile(rf"(?=(.{{1,{lines.SHINGLE}}}))\S{{1,{lines.STRIDE}}}\s*")
    sets = [set(piece.findall(s[2])) for s in spots]
    roots = union(len(spots), [(i, j) for j in range(len(spots)) for i in range(j) if spots[i][2] == spots[j][2] or alike(sets[i], sets[j])])
    gone = {spots[i][:2] for i, r in enumerate(roots) if r != i}
    want = {d: t and "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t, _ in docs}
    found = lines.dedup(df)
    assert found.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


def test_line_dedup_of_nothing(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "EACH", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 12))
    x = [(c + rng.normal(size=12) * s).tolist() for c in centers for s in (0, 0.1, 0.2, 0.3, 0.4) for _ in range(4)]
    bad = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None] * 6, [float("inf")] + [1.0] * 11]
    rows = [(i, v, 7) for i, v in enumerate([*x, *bad, [1e-200] * 12, [1e200] * 12, [1.0, 2.0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int").repartition(3)
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    fine = [i for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in fine}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = [(i, j) for j in fine for i in fine if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    roots = union(len(rows), pairs)
    assert [found[i]["component_id"] for i in range(len(rows))] == roots
    assert [found[i]["n_links"] for i in range(len(rows))] == [sum(i in p for p in pairs) for i in range(len(rows))]
    assert len(pairs) > 100


def test_substrings(spark):
    rng = random.Random(2)

    def say(n):
        return " ".join(rng.choices([f"term{i}" for i in range(5000)], k=n))

    passage = say(60)
    a, b = f"{say(80)} {passage} {say(50)}", f"{say(33)} {passage} {say(90)}"
    docs = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, say(100), "x"), (4, None, "x"), (5, "", "x"), (6, "é" * 3000, "x")], "doc_id long, text string, digest string")
    found = [r for r in substrings.repeats(docs).collect() if r["doc_id"] != 6]
    assert [(r["doc_id"], r["first_doc_id"]) for r in found] == [(2, 1)]
    hit = b[found[0]["begin"] : found[0]["end"]]
    assert hit in a and len(hit) > 0.8 * len(passage)
    left = {r["doc_id"]: r["text"] for r in substrings.remove(docs).collect()}
    assert left[1] == a and left[2] == b.replace(hit, "", 1) and left[4] is None and left[5] == ""
    assert substrings.repeats(docs.limit(0)).count() == 0
