"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text's terms are its lower-case words and the first four and five letters of
longer ones; a run of letters too long for a word is taken as text without
spaces, and each run of four of its letters is a term. The vector space has all
the terms that go with the label in a bounded sample of labelled documents (by a
chi-square test): that choice is part of the fitted classifier, and a text's
cosine is exact in that space. The terms' inverse document frequencies are
counted over all documents. The labelled examples are kept as
an inverted index in blocks of similar examples: for each term and block the
largest weight, and within a block the postings by term. A text's cosine with
any example of a block is at most the sum of its weights times the block's
maxima. Blocks are scored best bound first, until the bounds that are left fall
below the k-th best cosine so far: the nearest examples are exact. They vote,
weighted by their distance, and the share of toxic votes is calibrated on the
examples themselves, each left out of its own vote, by a monotone fit.

Defined cases: a text without any term of the space (null and empty ones too)
has the share of toxic labels among such examples. A document that was learnt
from is its own nearest example, so its label has a part in its score; only
held-out documents tell how good the scores are. Of rows that share a doc_id one
is learnt from. Without labelled rows every score is 0. An example labelled twice is toxic if one of its labels is. Every
row of the documents gets a row, repeated ids included. Labels, and columns
other than the text, are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, table, written
from reachwell.llm.language import held_out

#: Labelled documents that are drawn, by a hash of the id, for terms and examples.
SAMPLE = 20_000
#: Letters of a word at most; longer runs are taken as text without spaces.
LONG = 40
#: Least chi-square of a term's association with the label, and least number of examples with it.
LEAST_CHI2, LEAST_DF = 24.0, 5
#: Votes, examples in a block, and supporting examples that are returned.
NEAREST, BLOCK, EVIDENCE = 15, 64, 3
_WORD = re.compile(r"\w+")
#: Words whose terms a worker remembers; bytes of text, and labelled rows, whose counts are Python objects at once.
_CACHED, _BYTES, _ROWS = 50_000, 1 << 19, 256


def stems(word: str) -> list[str]:
    """A word's terms: itself and, marked by an asterisk, its first letters; of a run without spaces all runs of four letters."""
    if len(word) > LONG:
        return list(dict.fromkeys(f"{word[i : i + 4]}*" for i in range(len(word) - 3)))
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


class Space:
    """The chosen terms; finds a text's counts of them."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        if not text:
            return out
        known, number = self.known, self.number
        if len(known) > _CACHED:
            known.clear()
        for word, n in Counter(_WORD.findall(text.lower())).items():
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(number[s] for s in stems(word) if s in number)
            for t in own:
                out[t] = out.get(t, 0) + n
        return out


@dataclass
class Index:
    """Labelled examples in blocks, with the maxima that bound a block's cosines."""

    terms: list[str]
    idf: np.ndarray
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: list = field(default_factory=list)
    prior: float = 0.0
    knots: tuple = (np.array([0.0]), np.array([0.0]))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length one."""
        t = np.fromiter(counts, np.int64, len(counts))
        w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def build(self, examples: list[tuple[object, int, dict[int, int]]]) -> None:
        empty = [y for _, y, c in examples if not c]
        self.prior = (sum(empty) + 0.5 * bool(empty)) / (len(empty) + 1)
        rows = [(i, y, self.vector(c)) for i, y, c in examples if c]
        rows.sort(key=lambda r: (int(r[2][0][r[2][1].argmax()]), -r[2][1].max(), str(r[0])))  # alike ones share a block
        self.ids, self.labels = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        self.vectors = [r[2] for r in rows]
        n = -(-len(rows) // BLOCK)
        doc = np.repeat(np.arange(len(rows)), [len(t) for t, _ in self.vectors])
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        self.most = np.zeros((len(self.terms), n))
        np.maximum.at(self.most, (term, doc // BLOCK), weight)
        order = np.lexsort((doc, term))
        self.doc, self.weight, cuts = doc[order], weight[order], np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        # Where each term's postings of each block begin; the last column is where the term ends.
        self.begin = np.array([a + np.searchsorted(self.doc[a:b], np.arange(n + 1) * BLOCK) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).reshape(len(self.terms), n + 1)

    def _score(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """A row of cosines for each of the blocks, from the terms' postings in them."""
        begin = self.begin[terms[:, None], blocks[None]].ravel()
        n = self.begin[terms[:, None], blocks[None] + 1].ravel() - begin
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        row = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), n)
        part = self.weight[at] * np.repeat(np.repeat(weights, len(blocks)), n)
        return np.bincount(row * BLOCK + self.doc[at] % BLOCK, part, len(blocks) * BLOCK).reshape(len(blocks), BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k best examples, all above 0; ties go to the lower number.

        Blocks are scored by descending bound, some more each time, until the
        next bound is below the k-th best cosine.
        """
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        numbers, cosines, least, at, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 1
        while at < len(order) and bound[order[at]] >= least - 1e-9:
            blocks = order[at : at + step]
            blocks = blocks[bound[blocks] >= least - 1e-9]
            got = self._score(terms, weights, blocks)
            row, place = np.nonzero((got > 0) & (got >= least - 1e-9))
            number = blocks[row] * BLOCK + place
            cosine = got[row, place]
            if skip >= 0:
                cosine, number = cosine[number != skip], number[number != skip]
            numbers, cosines = np.append(numbers, number), np.append(cosines, cosine)
            if len(cosines) >= k:
                best = np.lexsort((numbers, -cosines))[:k]
                numbers, cosines = numbers[best], cosines[best]
                least = cosines[-1]
            at, step = at + step, 4 * step
        best = np.lexsort((numbers, -cosines))[:k]
        return numbers[best], cosines[best]

    def vote(self, number: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(cosine, 1))
        return float(weight @ self.labels[number] / weight.sum())

    def calibrate(self) -> None:
        """A monotone fit of the labels to the left-out votes, by pooling adjacent violators."""
        pairs = []
        for i, (t, w) in enumerate(self.vectors):
            number, cosine = self.nearest(t, w, NEAREST, skip=i)
            if len(number):
                pairs.append((self.vote(number, cosine), self.labels[i]))
        pools: list[list[float]] = []  # vote, toxic, all
        for v, y in sorted(pairs):
            pools.append([v, y, 1])
            while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
                v, y, n = pools.pop()
                pools[-1] = [(pools[-1][0] * pools[-1][2] + v * n) / (pools[-1][2] + n), pools[-1][1] + y, pools[-1][2] + n]
        if pools:
            self.knots = (np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools]))
            self.knots = (self.knots[0], np.maximum.accumulate(self.knots[1]))

    def score(self, counts: dict[int, int]) -> tuple[float, list]:
        """The calibrated score of a text, and the examples nearest to it."""
        if not counts or not len(self.labels):
            return self.prior, []
        number, cosine = self.nearest(*self.vector(counts), NEAREST)
        if not len(number):
            return self.prior, []
        value = float(np.interp(self.vote(number, cosine), *self.knots))
        return value, [{"doc_id": self.ids[n], "cosine": float(c), "toxic": int(self.labels[n])} for n, c in zip(number[:EVIDENCE], cosine[:EVIDENCE], strict=True)]


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame, sample: int = SAMPLE) -> Index:
    """An index of labelled documents.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) may be learnt from;
    ``corpus`` (text) gives the document frequencies. The counts of at most
    ``sample`` labelled documents, and the terms chosen from them, come to the
    driver.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # two numbers a row, of a bounded number
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=_BYTES):
            found = []
            for text in batch.column("text").to_pylist():
                counts = Counter()
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    for s in stems(word):
                        counts[s] += n
                found.append(list(counts.items()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(found, pa.map_(pa.string(), pa.int32()))], ["doc_id", "toxic", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(rows.mapInArrow(extract, f"doc_id {kind}, toxic int, tf map<string,int>"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    if not total:
        return Index([], np.zeros(0))
    # The statistic of the two-by-two table of having the term and being toxic.
    both, df = F.col("both"), F.col("df")
    expected = df * float(toxic) / float(total)
    chi2 = F.pow(both - expected, 2) * float(total) / F.greatest(expected * (total - toxic) * (1 - df / float(total)), F.lit(1e-9))
    strong = rows.select(F.explode(F.map_keys("tf")).alias("term"), "toxic").groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("both"))
    strong = strong.where((df >= LEAST_DF) & (df < total)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    chosen = [r[0] for r in strong.orderBy(F.desc("chi2"), "term").select("term").collect()]
    space = docs.sparkSession.sparkContext.broadcast(Space(chosen))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, n = space.value, Counter(), 0
        for batch in blocks(batches):
            for text in batch.column("text").to_pylist():
                found.update(own.counts(text).keys())
            n += batch.num_rows
        found[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    df_of = {r[0]: r[1] for r in corpus.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect()}
    every = df_of.pop(-1, 0)
    idf = np.log((every + 1) / (np.array([df_of.get(i, 0) for i in range(len(chosen))]) + 1)) + 1
    index = Index(chosen, idf)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = space.value.number
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            own = [[(number[t], n) for t, n in r if t in number] for r in batch.column("tf").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.map_(pa.int32(), pa.int32()))], ["doc_id", "toxic", "tf"])

    examples = rows.mapInArrow(pick, f"doc_id {kind}, toxic int, tf map<int,int>").toArrow().to_pylist()
    index.build([(r["doc_id"], r["toxic"], dict(r["tf"])) for r in sorted(examples, key=lambda r: str(r["doc_id"]))])
    index.calibrate()
    index.vectors = []  # scoring needs the postings alone
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Per document: doc_id, score, predicted, evidence (nearest examples: doc_id, cosine, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()
    evidence = f"array<struct<doc_id:{kind},cosine:double,toxic:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        space = Space(own.terms)
        for batch in blocks(batches, most=_BYTES):
            rows = [own.score(space.counts(t)) for t in batch.column("text").to_pylist()]
            found = pa.array([r[1] for r in rows], pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("cosine", pa.float64()), ("toxic", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()), found], ["doc_id", "score", "evidence"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence {evidence}")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove(docs: DataFrame, index: Index, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``least``; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        space = Space(own.terms)
        for batch in blocks(batches, most=_BYTES):
            yield batch.filter(pa.array([own.score(space.counts(t))[0] < least for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labels of four fifths of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = train(docs.where(~held_out()), labels.where(~held_out()), docs)
    found = score(docs, index)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op7_toxicity": op7_toxicity}
