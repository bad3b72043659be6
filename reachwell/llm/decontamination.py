"""Benchmark decontamination by Wu-Manber multi-pattern search.

A document is lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters. Every run of 13 consecutive words of a benchmark item is a
pattern; an item of fewer words is one pattern. The words that lie inside an
occurrence of a pattern are hit, and a document is contaminated when at least
one in twenty of its words is hit.

The patterns are searched as bytes. A table gives, for a hashed block of text
that ends at a position, how far the search may move on without passing an
occurrence; at a shift of zero the block selects the patterns with that suffix,
and these are compared directly. The search walks through many stretches of
the text at once, each at its own pace, so that every step is one numpy
operation. Patterns of very different lengths have tables of their own, since
the shortest pattern limits the shift.

Defined cases: null and empty texts, and texts without words, have no words, no
hits and are clean. Items without words are ignored. Each row of the documents
gets a row of the report, repeated ids included. An empty benchmark hits
nothing. Other columns of the documents, whatever their names, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, table, utf8

#: Bytes of benchmark text whose tables one task holds; a larger benchmark is searched in parts.
PART_BYTES = 8 << 20
#: Bytes of documents that a task searches for one part after another; each part's tables are loaded once for them.
TURN_BYTES = 64 << 20
#: Bytes of text that one lane of the search walks through.
LANE = 2048
#: Byte to word character (lower case), or to a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_SPACE, _BREAK = np.uint8(0x20), np.uint8(0x0A)


def words_of(text: str) -> list[str]:
    """The words of one text, as the search sees them."""
    folded = _FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes()
    return [w.decode() for w in folded.split(b" ") if w]  # str.split() would also cut at the white space outside ASCII


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space before, between and after words and a line break after each text.

    Returns the bytes, the place of each word's first byte, and the number of
    words before each text (one more than there are texts).
    """
    n = len(offsets) - 1
    x = np.empty(len(data) + 2 * n, np.uint8)
    at = offsets[:-1] + 2 * np.arange(n)  # each text is preceded by a space and a break by another
    inside = np.ones(len(x), bool)
    ends = offsets[1:] + 2 * np.arange(n) + 1
    inside[at], inside[ends] = False, False
    x[inside] = _FOLD[data]
    x[at], x[ends] = _SPACE, _BREAK
    # A space stays unless a space follows; one is set before each break.
    space = x == _SPACE
    keep = np.ones(len(x), bool)
    keep[:-1] = ~(space[:-1] & space[1:])
    lengthened = np.insert(x[keep], np.flatnonzero((x[keep] == _BREAK) & ~np.append(False, x[keep][:-1] == _SPACE)), _SPACE)
    starts = np.flatnonzero((lengthened[:-1] == _SPACE) & (lengthened[1:] > _SPACE)) + 1
    return lengthened, starts, np.append(0, np.searchsorted(starts, np.flatnonzero(lengthened == _BREAK)))


def eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; ``x`` must end with eight spare bytes."""
    return np.ndarray((len(x) - 7,), "<u8", np.ascontiguousarray(x).data, strides=(1,))


class Patterns:
    """Shift and suffix tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.b = min(8, self.m)
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        self.bits = min(22, max(12, int(np.log2(len(patterns) * self.m + 1)) + 3))
        heads = np.frombuffer(b"".join(p[: self.m] + bytes(8) for p in patterns), np.uint8)
        values = eights(heads)[: len(heads) - 7]
        first = np.arange(len(patterns)) * (self.m + 8)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.uint16)
        for j in range(self.m - self.b + 1):
            h = self._hash(values[first + j] & self.mask)
            self.shift[h] = np.minimum(self.shift[h], self.m - self.b - j)
        suffix = values[first + self.m - self.b] & self.mask
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes, self.first = np.unique(suffix[self.order], return_index=True)
        self.last = np.append(self.first[1:], len(patterns))

    def _hash(self, v: np.ndarray) -> np.ndarray:
        return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """Place and number of each occurrence in ``x``, which ends with eight spare bytes."""
        n, v = len(x) - 8, eights(x)
        if n < self.m:
            return
        at = np.arange(self.m, n + 1, LANE)  # where a block ends
        stop = np.minimum(at + LANE, n + 1)
        while len(at):
            value = v[at - self.b] & self.mask
            step = self.shift[self._hash(value)].astype(np.int64)
            hit = np.flatnonzero(step == 0)
            if len(hit):
                step[hit] = 1
                place = np.minimum(np.searchsorted(self.suffixes, value[hit]), len(self.suffixes) - 1)
                for k in np.flatnonzero(self.suffixes[place] == value[hit]):
                    begin = int(at[hit[k]]) - self.m
                    for p in self.order[self.first[place[k]] : self.last[place[k]]]:
                        want = self.patterns[p]
                        if begin + len(want) <= n and x[begin : begin + len(want)].tobytes() == want:
                            yield begin, int(p)
            at = at + step
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]


class Searcher:
    """All windows of a set of benchmark items, ready to search texts for."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = 13):
        owners: dict[bytes, set] = {}
        for item, text in items:
            words = words_of(text or "")
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(f" {' '.join(words[i : i + window])} ".encode(), set()).add(item)
        self.groups: list[tuple[Patterns, list[set], list[int]]] = []
        by_length: dict[int, list[bytes]] = {}
        for p in owners:
            by_length.setdefault(min(len(p), 64).bit_length(), []).append(p)
        for own in by_length.values():
            self.groups.append((Patterns(own), [owners[p] for p in own], [p.count(b" ") - 1 for p in own]))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int]], list]]:
        """Per text: its number of words, the hit ranges of words, and the items found."""
        x, starts, before = spaced(data, offsets)
        x = np.append(x, np.zeros(8, np.uint8))
        hits: dict[int, tuple[list, set]] = {}
        for patterns, owners, sizes in self.groups:
            for begin, p in patterns.find(x):
                word = int(np.searchsorted(starts, begin + 1))
                text = int(np.searchsorted(before, word, "right")) - 1
                ranges, items = hits.setdefault(text, ([], set()))
                ranges.append((word - int(before[text]), word - int(before[text]) + sizes[p]))
                items |= owners[p]
        counts = np.diff(before)
        return [(int(counts[i]), merged(hits[i][0]), list(hits[i][1])) if i in hits else (int(counts[i]), [], []) for i in range(len(counts))]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def searchers(benchmark: DataFrame, window: int, part_bytes: int) -> list:
    """A broadcast searcher for each part of the benchmark; parts have about ``part_bytes`` of text."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = -(-size // part_bytes) or 1
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(parts)) == k)
        out.append(context.broadcast(Searcher([tuple(r) for r in part.collect()], window)))
    return out


def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The blocks of the batches, some ``TURN_BYTES`` together."""
    own: list[pa.RecordBatch] = []
    size = 0
    for block in blocks(batches):
        own.append(block)
        size += block.nbytes
        if size >= TURN_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def searched(batches: Iterator[pa.RecordBatch], parts: list) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each block with, per text, its number of words, the hit ranges and the items of all parts together."""
    for own in turns(batches) if len(parts) > 1 else ([b] for b in blocks(batches)):
        found = [[] for _ in own]
        for part in parts:
            searcher = part.value
            for i, block in enumerate(own):
                rows = searcher.search(*utf8(block.column("text")))
                found[i] = [(n, merged(old[1] + new), list({*old[2], *items})) for old, (n, new, items) in zip(found[i], rows, strict=True)] if found[i] else rows
            if len(parts) > 1:  # the tables of one part at a time
                del searcher
                vars(part).pop("_value", None)
        yield from zip(own, found, strict=True)


def is_contaminated(words: int, ranges: list[tuple[int, int]], one_in: int) -> bool:
    hit = sum(b - a for a, b in ranges)
    return hit > 0 and one_in * hit >= words


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, ranges (of hit words), items (found, sorted as strings), contaminated.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. The benchmark's
    tables are broadcast in parts of ``part_bytes``; one pass searches for all.
    """
    parts = searchers(benchmark, window, part_bytes)
    kind = docs.schema["doc_id"].dataType
    schema = "n_words long, ranges array<struct<begin:long,end:long>>, items array<string>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in searched(batches, parts):
            ranges = pa.array([[{"begin": a, "end": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), ranges, pa.array([sorted(map(str, r[2])) for r in rows], pa.list_(pa.string()))], ["doc_id", "n_words", "ranges", "items"])

    found = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind.simpleString()}, {schema}")
    n_hit = F.expr("aggregate(ranges, 0L, (n, r) -> n + r.end - r.begin)")
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not contaminated by the whole benchmark; one pass without a shuffle."""
    parts = searchers(benchmark, window, part_bytes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in searched(batches, parts):
            yield batch.filter(pa.array([not is_contaminated(r[0], r[1], one_in) for r in rows], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hits and verdict against the whole benchmark."""
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op10_decontamination": op10_decontamination}

ORACLE = {
    "op10_decontamination": r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM folded, ks WHERE len(w) >= k)),
found AS (SELECT doc_id, p.k, i, item_id FROM places p JOIN windows v ON p.k = v.k AND p.s = v.s),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, k, i FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded f LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
