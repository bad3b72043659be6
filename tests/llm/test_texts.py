"""Operators on single texts: extraction, packing, search, classification, sharding, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachwell.llm import decontamination, html, language, packing, queries, sharding, toxicity
from reachwell.llm.common import table

SF = "/root/testdata/sf0.01"


def test_html(spark):
    page = """<html><head><title>No</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="sidebar">Side</div>
    <div class="content"><h1>Head&amp;line</h1><p>First   <b>bold</b>&#33;
    text.</p><script>var x = "<p>no</p>";</script><p>Second part of the article, long enough to count.</p></div>
    <div class="comments"><p>A reader says so.</p></div><form><input value=x>Send</form><footer>Foot</footer></body></html>"""
    rows = [(1, "http://a.example/x", page, "x"), (2, "http://a.example/y", None, "x"), (3, None, "", "x"), (4, "odd", "plain <b>text", "x"), (5, "http://a.example/z", page, "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    text = {r["page_id"]: r["text"] for r in found.collect()}
    want = "Head&line First bold! text. Second part of the article, long enough to count."
    assert text == {1: want, 2: "", 3: "", 4: "plain text", 5: want}


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "bêta", "γ", "x1", "\n"], k=rng.randrange(1, 900))) for _ in range(40)] + [None, "", "a" * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    pieces = packing.pack(df, path, group_tokens=4096).collect()
    tokenizer, ids = Tokenizer.from_file(path), defaultdict(dict)
    for p in pieces:
        ids[p["doc_id"]][p["start"]] = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids[p["doc_id"]][p["start"]]) == p["length"]
    for i, t in enumerate(texts):
        got = []
        for start in sorted(ids[i]):
            assert start == len(got)
            got += ids[i][start]
        assert got == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert all(0 < n <= 1024 and n & (n - 1) == 0 for n in ends.values())  # full, or a power of two: no padding
    assert packing.pack(df.limit(0), path).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "é", "D"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([1, 2, 5, 13, 14, 40])] + [(7, None), (8, "..")]
    docs = [(i, "-".join(rng.choices([*vocabulary, "zz", "yy", "xx", "ww"], k=rng.randrange(60)))) for i in range(60)]
    docs += [(60 + i, f"{'q ' * k}{bench[5][1].upper()} q") for i, k in enumerate((0, 500, 900))] + [(70, None), (71, ""), (71, ""), (72, "zz, " * 5000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string").repartition(3)
    windows = defaultdict(set)
    for item, text in bench:
        w = decontamination.words_of(text or "")
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    want = Counter()
    for doc, text in docs:
        w, hit, items = decontamination.words_of(text or ""), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    items |= owners
        want[doc, len(w), len(hit), tuple(sorted(map(str, items))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = decontamination.report(df, benchmark).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found) == want
    clean = decontamination.remove(df, benchmark)
    assert clean.columns == df.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter({k[0]: n for k, n in want.items() if not k[4]})
    assert decontamination.report(df.limit(0), benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontamination.report(df, benchmark.limit(0)).collect())


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(0)
    index = toxicity.Index([f"t{i}" for i in range(60)], np.ones(60))
    examples = [(i, int(i % 3 == 0), {int(t): int(n) for t, n in zip(rng.choice(60, 5, replace=False), rng.integers(1, 4, 5), strict=True)}) for i in range(700)]
    index.build(examples)
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for _ in range(40):
        t, w = index.vector({int(k): 1 for k in rng.choice(60, 4, replace=False)})
        cosine = dense[:, t] @ w
        number, got = index.nearest(t, w, 15)
        assert np.allclose(got, np.sort(cosine)[::-1][:15])
        assert np.allclose(cosine[number], got)


def test_toxicity_held_out(spark):
    large = "/root/testdata/sf0.1"  # the smaller tables label too few documents
    rows = queries.QUERIES["op7_toxicity"](spark, large).join(table(spark, large, "labels").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    for label in (0, 1):
        assert np.mean([r["predicted"] == label for r in rows if r["toxic"] == label]) >= 0.8
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    index = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), docs)
    assert [r["score"] for r in toxicity.score(docs, index).collect()] == [0.0, 0.0]


def test_language_held_out(spark):
    rows = queries.QUERIES["op8_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and length(text) > 60").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95


def test_language_unknown(spark):
    docs = spark.createDataFrame([(1, "ein Haus und ein Hund", "de"), (2, "une maison et un chien", "fr"), (3, None, "fr"), (4, "12 !?", "de"), (5, "", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, language.train(docs)).collect()}
    assert [found[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert found[1][0] == "de" and found[2][0] == "fr"
    assert [r["lang_pred"] for r in language.identify(docs, None).collect()] == ["und"] * 5


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding(spark, shards):
    rng = random.Random(3)
    texts = ["hot"] * 300 + [f"pair {i // 2}" for i in range(200)] + [f"alone {i}" for i in range(400)] + [None, "", "", "hot é"]
    df = spark.createDataFrame([(rng.randrange(10**6), t, "x") for t in texts], "doc_id long, text string, shard string").repartition(4)
    found = sharding.assign(df, shards).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()) if t is not None else 0) for d, t, _ in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    pairs = defaultdict(set)
    text_of = {d: t for d, t, _ in df.collect()}
    for r in found:
        if (text_of[r["doc_id"]] or "").startswith("pair"):
            pairs[text_of[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) == 1 for s in pairs.values()) > 0.7 * len(pairs)
    assert sharding.assign(df.limit(0), shards).count() == 0


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    docs, small = table(spark, "/root/testdata/sf0.001", "documents"), "/root/testdata/sf0.001"
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {r[0] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, small).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, kept, small)
        after = {r[0] for r in kept.select("doc_id").collect()}
        assert kept.columns == docs.columns and after <= before, name
        assert after == before or name != "line dedup", name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect()}
    found = pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == want


def test_items_digest(spark):
    found = queries.QUERIES["op10_decontamination"](spark, "/root/testdata/sf0.001").where("n_items = 0").head()
    assert found["items_sha256"] == hashlib.sha256(b"").hexdigest()
