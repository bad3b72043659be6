"""Near-duplicate documents by dart-throwing MinHash (DartMinHash).

A document is the weighted set of its runs of five consecutive words (lower
case, as the decontamination cuts them); a shorter one has a single run. The
weights are 1, or how often a run occurs. Darts of a hashed process are thrown
at the region of each element, its weight wide and of unbounded rank: the
width is cut at powers of two, and in each part the darts come in order of
rank with exponential gaps, all drawn from the element's hash alone. Ranks are
followed only up to the bound that gives a document about ``k (ln k + 4)``
darts in all, whatever its length, so long documents use few darts to an
element. Each dart hits one of ``k`` coordinates, and the coordinate keeps the
dart of the least rank. Two documents agree on a coordinate with the
probability of their weighted Jaccard similarity. A document with a coordinate
left empty is thrown at again with twice the bound.

Bands of four coordinates are the keys of buckets; candidates are compared by
exact Jaccard similarity, and the documents at or above the threshold are
linked; a class is a component. Equal texts are one content from the start.

Defined cases: null texts, empty texts and texts without words are classes of
their own. Rows that are equal in doc_id and text are one document; rows of one
doc_id with other texts are documents of their own, each in the class of its
text. A class has the least doc_id of its documents, and rows without a doc_id
come after all others. Empty tables give empty results. Other columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, checkpointed, digest, mix, rows_of, table, unused, utf8, written
from reachwell.llm.decontamination import spaced
from reachwell.llm.similarity import BROADCAST_ROWS, linked, shared, small, verified

#: Words of a run, and the least similarity of near duplicates.
RUN, LEAST = 5, 0.8
#: Bands of four coordinates: at a similarity of 0.8 a pair is missed once in 38,000 times.
BANDS, ROWS = 20, 4
_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, kept by a worker for texts of a block's size."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' runs of words, and the text of each."""
    x, starts, before = spaced(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    spaces = np.flatnonzero(x == 0x20)
    ends = spaces[np.searchsorted(spaces, starts)]  # a space follows each word
    n_words = np.diff(before)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    left = before[1:][owner] - np.arange(len(starts))  # words from this one to the text's last
    first = (left >= RUN) | ((n_words[owner] < RUN) & (left == n_words[owner]))
    at = np.flatnonzero(first)
    last = at + np.minimum(RUN, left[at]) - 1
    return mix((sums[ends[last]] - sums[starts[at]]) * down[starts[at]]), owner[at]


def weighted_sets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) with their counts, by text."""
    if not len(hashes):
        return hashes, owner, np.zeros(0)
    ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
    values, counts, texts, at = [], [], [], 0
    for end in ends:
        v, c = np.unique(hashes[at:end], return_counts=True)
        values.append(v)
        counts.append(c)
        texts.append(np.full(len(v), owner[at]))
        at = end
    return np.concatenate(values), np.concatenate(texts), np.concatenate(counts).astype(np.float64)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit values."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def signatures(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of ``n`` texts the ``k`` darts that are kept, as 64-bit values; 0 throughout for an empty set."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, n)
    todo = total > 0
    bound = np.zeros(n)
    bound[todo] = k * (np.log(k) + 4) / total[todo]
    # The parts [0, 1), [1, 2), [2, 4), ... of each element's width.
    top = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    element = np.repeat(np.arange(len(hashes)), top)
    part = np.arange(len(element)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(part > 0, 2.0 ** (part - 1), 0.0)
    wide = np.where(part > 0, low, 1.0)
    seed = mix(hashes[element] + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    while todo.any():
        live = np.flatnonzero(todo[owner[element]])
        rank, throw, kept = np.zeros(len(live)), 0, []
        while len(live):
            throw += 1
            dart = mix(seed[live] + np.uint64(throw * int(_BASE) % (1 << 64)))
            rank = rank - np.log(_uniform(dart ^ np.uint64(0x2545F4914F6CDD1D))) / wide[live]
            going = rank < bound[owner[element[live]]]
            live, rank, dart = live[going], rank[going], dart[going]
            inside = low[live] + wide[live] * _uniform(dart ^ np.uint64(0x5851F42D4C957F2D)) < weights[element[live]]
            hit = live[inside]
            kept.append((owner[element[hit]] * k + ((dart[inside] >> np.uint64(32)) % np.uint64(k)).astype(np.int64), rank[inside], dart[inside]))
        spot, rank, dart = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.lexsort((rank, spot))
        spot, first = np.unique(spot[order], return_index=True)
        out.reshape(-1)[spot] = dart[order][first]
        full = np.bincount(spot // k, minlength=n) == k
        todo &= ~full
        bound[todo] *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        keys[:, b] = np.uint64(b + 1)
        for r in range(ROWS):
            keys[:, b] = mix(keys[:, b] * _BASE + signature[:, b * ROWS + r])
    return keys.view(np.int64)


def banded(contents: DataFrame, weights: str = "set") -> DataFrame:
    """The bands of the rows (text and others) with words: keys, and the other columns. Equal texts have equal keys."""
    others = [c for c in contents.columns if c != "text"]
    schema = ", ".join(f"{c} {contents.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=_BYTES):
            hashes, owner, counts = weighted_sets(*runs(*utf8(batch.column("text"))))
            own = signatures(hashes, owner, counts if weights == "count" else np.ones(len(counts)), batch.num_rows, BANDS * ROWS)
            some = np.unique(owner)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands(own[some]).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in others), keys], [*others, "keys"])

    return contents.mapInArrow(run, f"{schema}, keys array<long>")


def sets(contents: DataFrame, weights: str = "set") -> DataFrame:
    """Per content with words: id, items (64-bit hashes of its runs; the n-th copy of a run has its own for counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=_BYTES):
            hashes, owner, counts = weighted_sets(*runs(*utf8(batch.column("text"))))
            if weights == "count":
                times = counts.astype(np.int64)
                copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                hashes, owner = mix(np.repeat(hashes, times) + copy.astype(np.uint64)), np.repeat(owner, times)
            n = np.bincount(owner, minlength=batch.num_rows)
            items = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), items], ["id", "items"])

    return contents.select("id", "text").mapInArrow(run, "id long, items array<long>")


def classified(docs: DataFrame, least: float = LEAST, weights: str = "set") -> DataFrame:
    """Per document, that is, per doc_id and text: doc_id, h and g (the text's digest), n (its rows), class_id, kept."""
    contents = docs.select("doc_id", *digest("text"), "text")
    some = contents.where("text is not null").withColumn("who", F.xxhash64("doc_id"))  # never null
    signed = banded(some.drop("doc_id"), weights).groupBy("h", "g").agg(F.first("keys").alias("keys"), F.min("who").alias("who"))
    signed = written(signed.withColumn("id", F.monotonically_increasing_id()))  # numbers contents once and for all

    def sets_of(ids: DataFrame) -> DataFrame:
        own = checkpointed(signed.select("h", "g", "who", "id").join(small(checkpointed(ids)), "id"))
        return sets(some.join(small(own), ["h", "g", "who"]).select("id", "text"), weights).groupBy("id").agg(F.first("items").alias("items"))  # one row of each content

    def verify(ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
        own = written(sets_of(ids))
        return lambda pairs: verified(pairs, own, least)

    found = small(linked(shared(signed), verify, sets_of, least))
    ids = signed.select("h", "g", "id")
    roots = ids.join(found, "id").join(ids.select(F.col("id").alias("component"), F.col("h").alias("root_h"), F.col("g").alias("root_g")).join(small(checkpointed(found.select("component").distinct())), "component", "left_semi"), "component")
    roots = checkpointed(roots.select("h", "g", "root_h", "root_g"))
    words = F.coalesce(F.regexp_like("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")), F.lit(False))
    own = contents.select("doc_id", "h", "g", words.alias("worded")).groupBy("doc_id", "h", "g").agg(F.bool_or("worded").alias("worded"), F.count("*").alias("n"))
    own = checkpointed(own.join(small(roots), ["h", "g"], "left").select("doc_id", "h", "g", "worded", "n", F.coalesce("root_h", "h").alias("x"), F.coalesce("root_g", "g").alias("y")))
    # A text without words shares its class with no other row. A class keeps its first document, told by a hash.
    spot, name = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "g"), F.xxhash64("doc_id", "h", "g")
    firsts = own.where("worded").groupBy("x", "y").agg(F.min("doc_id").alias("class_id"), F.min_by(name, spot).alias("first"), F.count("*").alias("size"))
    firsts = checkpointed(firsts.where("size > 1").drop("size"))
    joined = own.where("worded").join(small(firsts), ["x", "y"], "left").select("doc_id", "h", "g", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("first") == name, F.lit(True)).alias("kept"))
    return joined.unionByName(own.where("not worded").select("doc_id", "h", "g", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def classes(docs: DataFrame, least: float = LEAST, weights: str = "set") -> DataFrame:
    """Per document (doc_id and text): doc_id, class_id (the least doc_id of its class), kept (whether it stands for the class)."""
    return classified(docs, least, weights).select("doc_id", "class_id", "kept")


def dedup(docs: DataFrame, least: float = LEAST, weights: str = "set") -> DataFrame:
    """One row of ``docs``, all columns, of each class, and all rows without words."""
    found = checkpointed(classified(docs, least, weights).where("not kept or n > 1").select(F.col("doc_id").alias("of"), "h", "g", "kept"))
    row, h, g, of = (unused(c, docs.columns) for c in ("row", "h", "g", "of"))
    hashes = digest("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("doc_id").alias(of), hashes[0].alias(h), hashes[1].alias(g))

    def among(own: DataFrame, how: str) -> DataFrame:
        own = F.broadcast(own) if rows_of(own) <= BROADCAST_ROWS else own
        return rows.join(own, (rows[h] == own["h"]) & (rows[g] == own["g"]) & rows[of].eqNullSafe(own["of"]), how)

    left = among(found, "left_anti").select(row)
    again = checkpointed(found.where("kept").drop("kept"))
    if rows_of(again):  # documents of several rows; tasks keep one of each before these meet
        left = left.unionByName(among(again, "left_semi").groupBy(of, h, g).agg(F.first(row).alias(row)).select(row))
    return left.select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_neardup": op1_minhash_neardup}
