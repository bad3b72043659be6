"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over
hashed byte n-grams (of the lower-case text, all that is not a letter taken as
a space) is fitted by logistic regression on a bounded sample of labelled
documents, the same number of each language as far as there are. A text's
margins are decoded to the codeword of the least loss, each bit's loss weighted
by how well its classifier does on a part of the sample that it was not fitted
on; the score is the share of that codeword in the softmax of the losses, and a
text whose best two scores are close is flagged as ambiguous.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and not ambiguous. With no labelled document everything is ``und``; with one
language, every text with a letter is of it. Every row of the documents gets a
row, repeated ids included; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, table

#: Labelled documents that the classifiers are fitted on, all languages together.
SAMPLE = 2400
#: Lengths of the n-grams in bytes, and hash buckets for each length.
ORDERS, BUCKETS = (2, 3, 4), 2048
#: A lead of the best score over the second below this is ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_DOCS = 64


def features(texts: list[str | None]) -> np.ndarray:
    """A row of square roots of n-gram shares for each text, of length one for each n-gram length."""
    n, width = len(texts), len(ORDERS) * BUCKETS
    raw = [f" {_OTHER.sub(' ', (t or '').lower()).strip()} ".encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    x = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    v = np.ndarray((len(x) - 7,), "<u8", x.data, strides=(1,))[: ends[-1]]
    owner = np.repeat(np.arange(n), [len(r) for r in raw])
    out = np.zeros((n, width), np.float32)
    for k, order in enumerate(ORDERS):
        h = ((v & np.uint64((1 << 8 * order) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
        inside = np.arange(len(v)) + order <= ends[owner]
        counts = np.bincount(owner[inside] * BUCKETS + h[inside].astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return out


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages, far from the others.

    Up to five languages have all the distinct splits; more have the best of
    some drawn codes, by the least distance of two rows.
    """
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, np.float32).T
    rng, bits, best, score = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > score and (np.abs(code.sum(0)) < n).all():
            best, score = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A row of shares, one for each language."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        e = np.exp(-(loss - loss.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 150) -> Model:
    """Classifiers for all bits by gradient descent with momentum; a tenth of the rows sets the bits' weights."""
    code = codewords(len(languages))
    y = code[labels]
    aside = np.arange(len(x)) % 10 == 9
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    own, target = x[~aside], y[~aside]
    for _ in range(steps):
        pull = target / (1 + np.exp(np.clip(target * (own @ w + b), -30, 30))) / max(1, len(own))
        vw, vb = 0.9 * vw + own.T @ pull - 1e-5 * w, 0.9 * vb + pull.sum(0)
        w, b = w + 10 * vw, b + 10 * vb
    held = x[aside] if aside.any() else x
    right = ((held @ w + b) * (y[aside] if aside.any() else y) > 0).mean(0)
    rate = np.clip(right, 0.51, 0.99)
    trust = np.log(rate / (1 - rate))
    return Model(languages, code, w, b, (trust / trust.sum() * code.shape[1]).astype(np.float32))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from doc_id, text and lang, or None without labelled rows.

    ``sample`` bounds the rows that are drawn, by a hash of the row, and whose
    features come to the driver; every language has a row at least, so more
    languages than that have one each.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    languages, each = sorted(counts), max(1, sample // len(counts))
    # Enough that hardly a language falls short; then the first ones of each, and repeated rows count once.
    rate = F.create_map(*[F.lit(z) for k in languages for z in (k, min(10**9, int(1e9 * (1.1 * each + 20) / counts[k])))])
    draw = F.xxhash64("doc_id", "text")
    drawn = labelled.withColumn("draw", draw).where(F.pmod("draw", F.lit(10**9)) < rate[F.col("lang")]).dropDuplicates(["draw"])
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= each)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            for at in range(0, batch.num_rows, _DOCS):
                part = batch.slice(at, _DOCS)
                x = features(part.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = drawn.mapInArrow(extract, "lang string, x binary").toArrow()
    kept: dict[str, int] = {}
    labels, x = [], []
    for lang, raw in sorted(zip(rows["lang"].to_pylist(), rows["x"].to_pylist(), strict=True), key=lambda r: (r[1], r[0])):
        if kept.setdefault(lang, 0) < each:
            kept[lang] += 1
            labels.append(languages.index(lang))
            x.append(np.frombuffer(raw, np.float16))
    if not x:
        return None
    return fit(np.array(x, np.float32), np.array(labels), languages)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks(batches):
            for at in range(0, batch.num_rows, _DOCS):
                part = batch.slice(at, _DOCS)
                texts = part.column("text").to_pylist()
                known = np.array([model is not None and t is not None and bool(_LETTER.search(t)) for t in texts])
                lang, score, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if known.any():
                    share = model.scores(features(texts))
                    best = share.argmax(1)
                    top = np.sort(share, 1)[:, ::-1]
                    lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    score = np.where(known, top[:, 0], 0.0).astype(np.float64)
                    close = known & (top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0) < AMBIGUOUS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: a fifth of them, by the checksum of the id as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op8_language_id": op8_language_id}
