"""Rows that share a doc_id or have none, in the near-duplicate stages."""

from collections import Counter

import pytest

from reachwell.llm import lines, neardup

T, U, V = (" ".join(f"{p}{i}" for i in range(60)) for p in "tuv")
SCHEMA = "doc_id long, text string, row string, h long"


def kept(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = neardup.dedup(df, **kw)
    assert found.columns == df.columns
    return Counter((r["doc_id"], r["text"]) for r in found.collect())


def test_a_text_of_a_repeated_id_survives(spark):
    assert kept(spark, [(3, T), (5, T), (5, U)]) == Counter({(3, T): 1, (5, U): 1})
    assert kept(spark, [(3, T), (5, T), (5, U), (9, U)]) == Counter({(3, T): 1, (5, U): 1})
    rows = spark.createDataFrame([(3, T), (5, T), (5, U), (9, U), (9, U + " more")], "doc_id long, text string")
    found = Counter(map(tuple, neardup.classes(rows).collect()))
    assert found == Counter({(3, 3, True): 1, (5, 3, False): 1, (5, 5, True): 1, (9, 5, False): 2})


def test_two_texts_of_one_id_in_a_class(spark):
    near = T + " end"
    assert sum(kept(spark, [(5, T), (5, near), (7, T)]).values()) == 1
    assert {r["class_id"] for r in neardup.classes(spark.createDataFrame([(5, T), (5, near), (7, T)], "doc_id long, text string")).collect()} == {5}


def test_rows_without_an_id(spark):
    """They are linked as all others and stay only where no other document of their class does."""
    assert kept(spark, [(None, T), (4, T), (None, U), (None, U + " end"), (None, V)]) == Counter({(4, T): 1, (None, U): 1, (None, V): 1}) or kept(spark, [(None, T), (4, T), (None, U), (None, U + " end"), (None, V)]) == Counter({(4, T): 1, (None, U + " end"): 1, (None, V): 1})
    found = neardup.classes(spark.createDataFrame([(None, T), (4, T), (None, V)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, 4, False), (4, 4, True), (None, None, True)], key=repr)


@pytest.mark.parametrize("n", [2, 300])
def test_repeated_rows_are_one_document(spark, n):
    rows = [(8, T)] * n + [(8, None), (8, None), (8, ""), (8, "- !"), (None, U), (None, U)]
    assert kept(spark, rows) == Counter({(8, T): 1, (8, None): 2, (8, ""): 1, (8, "- !"): 1, (None, U): 1})


def test_lines_of_rows_without_an_id(spark):
    line, other = "the same long line of words here", "another line that nobody else has"
    rows = [(None, f"{line}\n{other}"), (None, line), (3, line), (3, f"first\n{line}")]
    found = Counter((r["doc_id"], r["text"]) for r in lines.dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)).collect())
    assert found[3, ""] == 1 and found[3, "first"] == 1
    assert found == Counter({(None, f"{line}\n{other}"): 1, (None, ""): 1, (3, ""): 1, (3, "first"): 1}) or found == Counter({(None, other): 1, (None, line): 1, (3, ""): 1, (3, "first"): 1})
    same = [(None, line), (None, line), (3, line)]  # equal rows are one document
    assert Counter((r["doc_id"], r["text"]) for r in lines.dedup(spark.createDataFrame(same, "doc_id long, text string")).collect()) == Counter({(None, line): 2, (3, ""): 1})


def test_very_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long.upper()), (3, long + " z" * 40), (4, "x" * 400_000), (5, "short")]
    found = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: long, 2: "", 3: "", 4: "x" * 400_000, 5: "short"}
