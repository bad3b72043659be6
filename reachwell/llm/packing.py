"""Cost-balanced packing of documents into training sequences.

A document's tokens are its ids followed by an end id. Documents are packed in
groups of about a million tokens as they stream through a task. A group's
sequences hold its tokens exactly: as many full sequences as there are, and the
rest in sequences whose lengths are powers of two, which need no padding. The
cost of a stretch of ``n`` tokens is estimated as ``linear * n + quadratic *
n^2`` (attention inside the stretch). Documents longer than a sequence are cut
into full sequences and a rest; then, from the costliest down, each goes to the
sequence of the lowest cost so far that still has room for it. One that fits
nowhere is cut to fill the sequence of the lowest cost that has any room.

Defined cases: null and empty texts consist of the end id alone. Every row of
the documents is packed, repeated ids included (their pieces then share a
doc_id). An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, table

#: Tokens after which a group of documents is packed; bounds what a task holds.
GROUP_TOKENS = 1 << 20


class ByteEncoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, of a byte-level BPE in a ``tokenizers`` file.

    The file's vocabulary is handed to ``tiktoken``, which finds the same ids
    at several times the speed. Texts that hold a special token's string are
    left to ``tokenizers``.
    """

    #: Fixed value: the pre-tokeniser pattern of byte-level BPE.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("the tokenizer must be a plain byte-level BPE")
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(map(letter.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if any(s in (text or "") for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encoding.encode_ordinary(text or "")
        return array("I", ids).tobytes()


def capacities(total: int, length: int) -> list[int]:
    """Sequence lengths that hold ``total`` tokens exactly: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    room = np.array(capacities(sum(lengths), length), np.int64)
    size, cost, pieces = room.copy(), np.zeros(len(room)), []

    def place(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, at, int(size[at] - room[at])))
        room[at] -= n
        cost[at] = np.inf if room[at] == 0 else cost[at] + linear * n + quadratic * n * n

    rest, full = [], 0
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= length:
            place(doc, start, length, full)
            full, start = full + 1, start + length
        if n > start:
            rest.append((doc, start, n - start))
    for doc, start, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                at, part = int(fits[np.argmin(cost[fits])]), n
            else:
                at = int(np.argmin(cost))
                part = int(min(n, room[at]))
            place(doc, start, part, at)
            start, n = start + part, n - part
    return pieces


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` file. One pass, no shuffle: a
    group never leaves its task. ``sequence_id`` is unique in the result.
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = ByteEncoder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        keys, ids, held = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(x) // 4 for x in ids]
            pieces = assign(lengths, length, linear, quadratic)
            doc, start, n, at, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            cut = pa.array([ids[d][4 * s : 4 * (s + k)] for d, s, k, _, _ in pieces], pa.binary())
            total = np.array(lengths, np.int64)[doc]
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(n), cut, pa.array(total), pa.array(at + first), pa.array(offset)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            first += int(at.max()) + 1
            return out

        for batch in blocks(batches):
            keys.append(batch.column("doc_id"))
            new = [encoder.encode(t) + end for t in batch.column("text").to_pylist()]
            ids += new
            held += sum(map(len, new)) // 4
            if held >= group_tokens:
                yield packed()
                keys, ids, held = [], [], 0
        if ids:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op5_packing": op5_packing}
