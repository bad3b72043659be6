"""Importance resampling towards a target distribution of hashed word features.

The features of a text are its words and its pairs of neighbouring words; each
falls into a bucket by a checksum. A bucket's gain says how much likelier it is
among the target's texts than among all documents, a document's weight is the
mean gain of its features, and documents are drawn by the highest weights after
a Gumbel draw from their id, which draws without replacement.

Texts are read as the bytes of Arrow's buffers, many texts at once. A table
classifies each byte as part of a word, lower-cased, or not; where neighbours
differ in that, a word begins or ends. The checksum of every word advances by
one byte with each step, through a table, for all words together, longest
first; pairs go on from the state of their first word. The corpus is read
twice, once for the counts, of which a task returns one row a bucket, and once
for the weights; its text is never shuffled.

Defined cases: null texts and texts without words have no features, weight 0
and are never drawn. Rows with the same doc_id are rows of their own; they draw
alike, and in a tie the one with fewer features goes first. A null doc_id draws
as an empty one and goes last in a tie. With an empty target every bucket is
unseen there. Empty documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, numbered, table, utf8, written

#: Steps that all words take together; what is longer goes on by itself.
TOGETHER = 48
#: Byte to word byte (A-Z lower-cased), or 0.
WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def crc_table() -> np.ndarray:
    """The checksum's next state for each value of its low byte (CRC-32, reflected)."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


CRC = crc_table()


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksums' states after ``sizes`` further bytes from ``starts``, all advanced side by side."""
    order = np.argsort(-sizes, kind="stable")
    at, now = starts[order], state[order]
    longer = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, TOGETHER), minlength=TOGETHER))  # words of more than j bytes
    for j in range(TOGETHER):
        n = int(longer[j])
        if not n:
            break
        some = now[:n]
        now[:n] = CRC[(some ^ data[at[:n] + j]) & 255] ^ (some >> 8)
    for i in range(int((sizes > TOGETHER).sum())):
        rest = data[at[i] + TOGETHER : at[i] + sizes[order[i]]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the row that it is of, and each row's number of words."""
    raw, offsets = utf8(texts)
    data = WORD_BYTE[raw]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = data != 0
    edges = np.diff(inside, prepend=np.int8(0))
    starts, ends = edges == 1, edges == -1
    borders = offsets[1:-1]
    joined = borders[(borders > 0) & (borders < len(data))]
    joined = joined[(inside[joined] == 1) & (inside[joined - 1] == 1)]  # a text that begins as the one before it ends
    starts[joined] = ends[joined] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    sizes = ends - starts
    row = np.searchsorted(offsets, starts, "right") - 1
    state = advanced(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, sizes)
    first = np.flatnonzero(row[1:] == row[:-1])  # words with a next one in their text
    spaced = CRC[(state[first] ^ 32) & 255] ^ (state[first] >> 8)
    pairs = advanced(spaced, data, starts[first + 1], sizes[first + 1])
    found = (np.concatenate([state, pairs]) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    return found.astype(np.int64), np.concatenate([row, row[first]]), np.bincount(row, minlength=len(texts))


def counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket; a task returns a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in blocks(batches):
            n += np.bincount(features(batch.column("text"), buckets)[0], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the logarithm of its smoothed share of the target over that of the corpus, rounded down."""
    own, wanted = own.astype(float), wanted.astype(float)
    shares = (wanted + 1) * (own.sum() + len(own)) / ((own + 1) * (wanted.sum() + len(own)))
    return np.floor(1000 * np.log(shares)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found, row, words = features(batch.column("text"), len(gain))
            total = np.bincount(row, gain[found], len(words)).astype(np.int64)  # whole numbers below 2 ** 53
            n = words + np.maximum(words - 1, 0)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, and rank among the drawn, null otherwise.

    ``percent`` of the rows with at least ``least_words`` words are drawn.
    """
    found = weighed(docs, gains(counts(docs, buckets), counts(target, buckets)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / float(1 << 32))))
    found = found.withColumn("score", (F.col("weight") + draw).cast("long"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    able = found.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    ranked = numbered(able, *order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("row")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn towards the benchmark's words."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance_resampling": op12_importance_resampling}

ORACLE = {
    "op12_importance_resampling": r"""
WITH texts AS (
  SELECT side, id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
features AS (
  SELECT side, row, unnest(w) AS f FROM texts UNION ALL
  SELECT side, row, w[i] || ' ' || w[i + 1] FROM (SELECT side, row, w, unnest(range(1, len(w))) AS i FROM texts)),
steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
named AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
bytes AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b FROM named),
bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM bytes, steps),
counted AS (SELECT side, row, bucket, count(*) AS n FROM features JOIN bucketed USING (f) GROUP BY ALL),
own AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)
                                 / ((coalesce(s, 0) + 1) * (coalesce(CAST(sum(t) OVER () AS DOUBLE), 0) + 10000)))) AS gain FROM own),
weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 0),
ranked AS (
  SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (ORDER BY words < 20, score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM scored WHERE words >= 20) THEN place END AS rank
FROM ranked
"""
}
