"""Fill-in-the-middle against a direct computation with regular expressions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reachwell.llm import infilling
from reachwell.llm.common import utf8

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, h1 string, form string, output string"


def expected(d, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return d, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return d, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return d, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "Zed", "<", ">", "<P", "P>", "S>", "<M", "<<S", "é", "数", "\U0001f600", " ", "\n", "\r\n", "1", "́", "[", "`", "@", "{", "z" * 300, "\x00"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(0, 60))) for _ in range(n)]
    return made + [x + s for x, s in zip(made[:30], ["<P>", "<S>", "<M>"] * 10, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_direct_computation(spark, seed):
    docs = list(enumerate(texts(seed, 500)))
    docs += [(5000, None), (5001, ""), (5002, "<"), (5003, "P>"), (None, "no id here"), (7, "again"), (7, "again"), (7, "again, more")]
    docs += [(6000 + i, "word " * 50_000 + "é" * i) for i in range(3)] + [(7000, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], SCHEMA).repartition(3)
    out = infilling.transform(df)
    back = out.select("*", infilling.restored(F.col("output"), F.col("form")).alias("back"))
    rows = back.collect()
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted((expected(*d) for d in docs), key=repr)
    assert sorted(((r["doc_id"], r["back"]) for r in rows), key=repr) == sorted(((d, t or "") for d, t in docs), key=repr)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_parts_that_end_like_a_sentinel(spark):
    rows = [("psm", a + b + c, f"<P>{a}<S>{c}<M>{b}") for a in ("<", "<P", "<S", "") for b in ("<M", ">", "") for c in ("<", "<M", "P>", "")]
    rows += [("spm", t, f"<S>{o[o.index('<S>') + 3 : o.rindex('<M>')]}<P>{o[3 : o.index('<S>')]}<M>{o[o.rindex('<M>') + 3 :]}") for _, t, o in rows]
    df = spark.createDataFrame(rows, "form string, text string, output string")
    assert df.where(~infilling.restored(F.col("output"), F.col("form")).eqNullSafe(F.col("text"))).count() == 0


def test_empty_table(spark):
    none = infilling.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_state_depends_on_the_last_bytes_alone():
    assert infilling.MEMORY == 2
    for a in range(12):
        for b in range(12):
            assert len(set(infilling.GOES[b, infilling.GOES[a]].tolist())) == 1


def test_scan_and_counts(monkeypatch):
    monkeypatch.setattr(infilling, "STRIP", 5)
    rows = texts(3, 200)
    data, offsets = utf8(pa.array(rows))
    emitted = infilling.scan(data, offsets)
    for text, a, z in zip(rows, offsets[:-1], offsets[1:], strict=True):
        own = emitted[a:z]
        at = lambda n: len(text[:n].encode())  # noqa: B023, E731
        assert np.flatnonzero(own & infilling.UNIT).tolist() == [at(m.start()) for m in UNITS.finditer(text)]
        assert np.flatnonzero(own & infilling.CHARACTER).tolist() == [at(i) for i in range(len(text))]
        assert np.flatnonzero(own & infilling.SENTINEL).tolist() == [at(m.end()) - 1 for m in re.finditer("<[PSM]>", text)]
    counts = infilling.Counts(emitted, infilling.UNIT)
    places = np.flatnonzero(emitted & infilling.UNIT)
    assert counts.place(np.arange(len(places))).tolist() == places.tolist()
    ends = np.arange(len(data) + 1)
    assert counts.upto(ends).tolist() == np.searchsorted(places, ends).tolist()
