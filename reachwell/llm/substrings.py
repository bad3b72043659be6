"""Repeated passages by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last sixteen bytes
falls below a threshold, not within a character, and not closer than a least
chunk size, so an insertion moves no boundary but those next to it. Chunks are
deduplicated by a 64-bit digest and their length: the first one, by (doc_id,
number), stays. One chunk taken for another by chance is too short to count. A
run of consecutive repeated chunks of at least ``least_bytes`` bytes is a
repeated passage; chance repeats of single chunks are too short to be one.

Defined cases: null and empty texts have no chunks. A text shorter than a chunk
is one chunk. A run of one character is cut at the greatest chunk size. Rows
with the same doc_id and the same text are one document; rows with the same
doc_id and other texts, and rows without one, are documents of their own, told
apart by ``copy``, a checksum of the text. Empty tables give empty results.
Other columns, whatever their names, are ignored, and kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, checkpointed, mix, table, utf8

#: Least and greatest bytes of a chunk, and the mean distance to the next boundary beyond the least.
LEAST_CHUNK, GREATEST_CHUNK, MEAN = 12, 1024, 20
#: Bytes of a passage from which it counts, about sixteen words.
LEAST_BYTES = 100
_WINDOW, _BLOCK = 16, 2 << 20
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def gear(x: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: each step doubles it and adds the byte's gear, in sixteen bits."""
    g = _GEAR[x]
    h = g.copy()
    for j in range(1, min(_WINDOW, len(x))):
        h[j:] += g[:-j] << np.uint16(j)
    return h


def boundaries(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of the texts in ``x`` end, and the text of each."""
    low = gear(x) >> np.uint16(4) < np.uint16((1 << 12) // MEAN)
    low[:-1] &= (x[1:] & 0xC0) != 0x80
    places = (np.flatnonzero(low) + 1).tolist()
    starts_char = (x & 0xC0) != 0x80
    ends, owner, p = [], [], 0
    for text, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        last = begin
        if begin == end:
            continue

        def cut(to: int) -> int:
            """The last boundary after the chunks that end before ``to``, none of them too long."""
            at = last
            while to - at > GREATEST_CHUNK:
                at += GREATEST_CHUNK
                while not starts_char[at]:
                    at -= 1
                ends.append(at)
                owner.append(text)
            return at

        while p < len(places) and places[p] <= begin:
            p += 1
        while p < len(places) and places[p] < end:
            # The window must lie within the text, or the hash would depend on what stands before it.
            if places[p] - last >= LEAST_CHUNK and places[p] - begin >= _WINDOW:
                cut(places[p])
                last = places[p]
                ends.append(last)
                owner.append(text)
            p += 1
        cut(end)
        ends.append(end)
        owner.append(text)
    return np.array(ends, np.int64), np.array(owner, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """Every chunk: digest, doc_id, copy (of the text), number, begin and end (in characters), n_bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=_BLOCK):
            x, offsets = utf8(batch.column("text"))
            if not len(x):
                continue
            ends, owner = boundaries(x, offsets)
            first = np.append(True, owner[1:] != owner[:-1])
            starts = np.where(first, offsets[owner], np.append(0, ends[:-1]))
            raw = x.tobytes()
            digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
            chars = np.append(0, np.cumsum((x & 0xC0) != 0x80))
            base = chars[offsets[owner]]
            number = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest), batch.column("doc_id").take(rows), batch.column("copy").take(rows), pa.array(number, pa.int32()), pa.array(chars[starts] - base, pa.int32()), pa.array(chars[ends] - base, pa.int32()), pa.array((ends - starts).astype(np.int32))],
                ["digest", "doc_id", "copy", "number", "begin", "end", "n_bytes"],
            )

    return docs.select("doc_id", F.hash("text").alias("copy"), "text").mapInArrow(run, f"digest long, doc_id {kind}, copy int, number int, begin int, end int, n_bytes int")


def repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every repeated passage but the first: doc_id, copy, begin, end (in characters), n_bytes, n_chunks, first_doc_id.

    ``first_doc_id`` is the document in which the passage's longest chunk comes first.
    """
    own = chunks(docs)
    spot = F.struct("doc_id", "copy", "number")
    first = own.groupBy("digest", "n_bytes").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "n_bytes", "first")
    again = own.join(first, ["digest", "n_bytes"]).where(spot != F.col("first"))
    again = again.select("doc_id", "copy", "number", "begin", "end", "n_bytes", F.col("first.doc_id").alias("first_doc_id"))
    order = Window.partitionBy("doc_id", "copy").orderBy("number")
    runs = again.withColumn("run", F.col("number") - F.dense_rank().over(order))
    longest = F.max_by("first_doc_id", F.struct("n_bytes", -F.col("number")))
    found = runs.groupBy("doc_id", "copy", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_chunks"), longest.alias("first_doc_id"))
    return found.where(F.col("n_bytes") >= least_bytes).drop("run")


def remove(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs``, all rows and columns, without the repeated passages."""
    gone = checkpointed(repeats(docs, least_bytes).groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges")))
    gone = gone.select(F.col("doc_id").alias("id"), "copy", "ranges")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.hash("text").alias("own"))
    own = own.join(gone, (F.col("own") == F.col("copy")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    # Between the ends of one passage and the beginning of the next; no end after the last.
    starts = F.concat(F.array(F.lit(0)), F.transform("ranges", lambda r: r["end"]))
    ends = F.concat(F.transform("ranges", lambda r: r["begin"]), F.array(F.length("row.text")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring("row.text", a + 1, F.greatest(b - a, F.lit(0))))
    text = F.when(F.col("ranges").isNull(), F.col("row.text")).otherwise(F.array_join(parts, ""))
    return own.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of the documents but the first."""
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
