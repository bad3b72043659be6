"""Cases of the text operators at the bounds and with odd rows, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np

from reachwell.llm import embeddings, language, lines, neardup, substrings, toxicity


def test_columns_of_any_name_stay(spark):
    row = (1, "one line\none line", "a", "b", "c", "d")
    df = spark.createDataFrame([row, (2, "one line", "e", "f", "g", "h")], "doc_id long, text string, places string, lines string, row string, own string")
    assert sorted(map(tuple, lines.dedup(df).collect())) == [(1, "one line", *row[2:]), (2, "", "e", "f", "g", "h")]
    df = df.toDF("doc_id", "text", "_gone", "copy", "ranges", "id")
    assert sorted(map(tuple, substrings.remove(df).collect())) == sorted(map(tuple, df.collect()))


def test_passages_of_rows_with_the_same_id(spark):
    rng = random.Random(8)

    def say(n):
        return " ".join(rng.choices([f"word{i}" for i in range(4000)], k=n))

    passage = say(70)
    rows = [(1, f"{say(40)} {passage} {say(40)}"), (2, f"{say(30)} {passage} {say(60)}"), (2, say(250)), (None, say(90)), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter((r["doc_id"], r["text"]) for r in substrings.remove(df).collect())
    assert all(left[r] == 1 for r in [rows[0], *rows[2:]])
    (short,) = [t for d, t in left.elements() if d == 2 and t and t not in {r[1] for r in rows}]
    assert len(rows[1][1]) - len(short) > 0.8 * len(passage)


def test_chunks_against_their_definition(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé 日本\n", k=n)) for n in (1, 5, 11, 12, 13, 30, 200, 2000)] + ["x" * 5000, None, ""]
    rows = substrings.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by, content = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: r["number"]):
        by[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        assert [r["number"] for r in by[i]] == list(range(len(by[i])))
        assert "".join(text[r["begin"] : r["end"]] for r in by[i]) == (text or "")
        assert all(r["n_bytes"] == len(text[r["begin"] : r["end"]].encode()) <= substrings.GREATEST_CHUNK for r in by[i])
        for r in by[i]:
            assert content.setdefault(r["digest"], text[r["begin"] : r["end"]]) == text[r["begin"] : r["end"]]
    assert len(set(content.values())) == len(content)
    shifted = "q" + texts[7]
    again = {r["digest"] for r in substrings.chunks(spark.createDataFrame([(1, shifted)], "doc_id long, text string")).collect()}
    assert len(again & {r["digest"] for r in by[7]}) > 0.9 * len(by[7])


def test_every_language_has_a_row(spark):
    rows = [(i * 10 + j, " ".join([f"{chr(97 + i)}{chr(97 + (i + j) % 3)}oo"] * 9), f"l{i}") for i in range(8) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, sample=4)
    assert model.languages == [f"l{i}" for i in range(8)]
    repeated = language.train(df.unionByName(df).unionByName(df), sample=4)
    assert np.allclose(model.weights, repeated.weights)
    assert language.train(df.limit(0)) is None and language.identify(df.limit(0), model).count() == 0
    clash = df.toDF("doc_id", "text", "lang_pred")
    assert language.identify(clash, model).columns == ["doc_id", "lang_pred", "score", "ambiguous"]


def test_nearest_examples_over_many_blocks():
    rng = np.random.default_rng(1)
    index = toxicity.Index([f"t{i}" for i in range(900)], np.ones(900))
    index.build([(i, i % 2, {int(t): 1 for t in rng.zipf(1.4, 8) % 900}) for i in range(3000)])
    dense = np.zeros((3000, 900))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for i in range(0, 3000, 100):
        t, w = index.vectors[i]
        cosine = dense[:, t] @ w
        cosine[i] = 0
        number, got = index.nearest(t, w, 15, skip=i)
        best = np.lexsort((np.arange(3000), -np.round(cosine, 12)))[:15]
        assert i not in number and np.allclose(got, cosine[best][: len(got)]) and np.allclose(cosine[number], got)


def test_toxic_words_of_spaceless_and_rare_texts(spark):
    rng = random.Random(2)
    clean, bad = [f"w{i}" for i in range(200)], [f"{a}{b}qx" for a in "abcdefghij" for b in "klmnopqrst"]
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    rows = [(i, " ".join(rng.choices(clean, k=30) + (bad if i % 2 else [])), i % 2) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choices(han, k=60)) + ("毒毒毒毒" if i % 2 else ""), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.train(df, df.unionByName(df), df)
    assert {b for b in bad} <= set(index.terms) and "毒毒毒毒*" in index.terms
    new = [(1, "".join(rng.choices(han, k=80)) + "毒毒毒毒" + "".join(rng.choices(han, k=80))), (2, bad[57]), (3, " ".join(clean[:40])), (4, None), (4, ""), (5, "w1 " * 200_000)]
    found = toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), index).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in found) == [(1, 1), (2, 1), (3, 0), (4, 0), (4, 0), (5, 0)]
    assert toxicity.score(df.select("doc_id", "text").limit(0), index).count() == 0


def test_vectors_of_no_rows_and_of_repeated_ids(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("a", [0.0, 1.0]), ("c", [0.0, 3.0]), ("d", [-1.0, 0.1]), ("b", [1.0, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<float>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == Counter({("b", 2, "a"): 2, ("a", 2, "a"): 1, ("a", 1, "a"): 1, ("c", 1, "a"): 1, ("d", 0, "d"): 1})


def test_documents_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, "other words are here now"), (7, text + " end"), (9, "other words are here now"), (None, "x y"), (3, None), (3, "")]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {5, 7, 9, None, 3} and found[3] == 3
    assert found[5] == 5 and 5 in (found[7], found[9])
