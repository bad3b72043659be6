"""Decontamination by parts of the benchmark, and words with white space outside ASCII."""

from collections import Counter

from reachwell.llm import decontamination


def test_remove_unites_the_hits_of_all_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "TURN_BYTES", 1)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(13))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, " ".join([*(t for _, t in items), *["q"] * 1462])), (2, " ".join([*(t for _, t in items), *["q"] * 1502])), (3, None), (4, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")  # 78 of 1,540 words are hit, and 78 of 1,580
    assert len(decontamination.searchers(benchmark, 13, 40)) > 3
    for part_bytes in (40, 8 << 20):
        kept = decontamination.remove(df, benchmark, part_bytes=part_bytes)
        assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_white_space_outside_ascii_belongs_to_words(spark):
    words = ["pourquoi\xa0?", "a\u3000b", "c\u2028d", "e\x85f", "g\u202fh", "i"]
    text = " ".join(words)
    assert decontamination.words_of("Pourquoi\xa0? a\u3000b") == ["pourquoi\xa0", "a\u3000b"]
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "x pourquoi a b c d e f g h i y"), (3, "A\u3000b")], "doc_id long, text string")
    found = decontamination.report(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in found} == {1: (8, 6), 2: (12, 0), 3: (1, 0)}


def test_report_has_a_row_for_each_row_with_several_parts(spark):
    items = [(i, f"left{i} right{i}") for i in range(8)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "left1 right1 a left2 right2"), (1, "b left3 right3"), (None, "c"), (None, "left4 right4 left5 right5"), (2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = Counter({(1, 5, 4, ("1", "2")): 1, (1, 3, 2, ("3",)): 1, (None, 1, 0, ()): 1, (None, 4, 4, ("4", "5")): 1, (2, 0, 0, ()): 1})
    for part_bytes in (20, 8 << 20):
        found = decontamination.report(df, benchmark, part_bytes=part_bytes).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == want
