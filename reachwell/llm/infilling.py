"""Fill-in-the-middle: a document is cut into prefix, middle and suffix, and the middle moves to the end.

Cuts lie between units: runs of ASCII letters, or single other characters. Where
they lie, and which form a document takes, comes from a hash of its id: plain
(as it was), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each
part behind its sentinel. A document that holds a sentinel itself stays plain.

A table-driven automaton reads the bytes of Arrow's buffers in one scan. Its
state is whether a run of letters goes on and how much of a sentinel has been
read; each transition emits whether a character begins, whether a unit begins
and whether a sentinel ends. The state depends on no more than the last
``MEMORY`` bytes (the table is tested for that), so the bytes are dealt to
strips that advance side by side, each from ``MEMORY`` bytes earlier. What the
transitions emit is counted by strip; the second pass looks for the cuts in
those strips alone whose counts pass the wanted units.

Defined cases: null texts are empty, and empty texts are plain. A null doc_id
hashes as an empty one. Rows with the same doc_id are documents of their own,
cut by the same draws. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, table, utf8

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes.
OTHER, CONTINUES, LETTER, OPEN, NAME, CLOSE = range(6)
#: What a transition emits, as bits.
CHARACTER, UNIT, SENTINEL = 1, 2, 4
#: Bytes of a strip, and bytes after which the state no longer depends on the one before.
STRIP, MEMORY = 256, 2


def byte_classes() -> np.ndarray:
    """The class of each byte; those of a sentinel's name are letters as well."""
    classes = np.full(256, OTHER, np.uint8)
    classes[0x80:0xC0] = CONTINUES
    for c in range(256):
        if chr(c).isascii() and chr(c).isalpha():
            classes[c] = LETTER
    classes[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = NAME
    classes[ord("<")], classes[ord(">")] = OPEN, CLOSE
    return classes


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted bits by class and state; a class plus six begins a text.

    States: 0 none, 1 in letters, 2 behind ``<``, 3 behind ``<`` and a name (in letters too).
    """
    goes, emits = np.zeros((12, 4), np.uint8), np.zeros((12, 4), np.uint8)
    for fresh in (0, 6):
        for state in range(4):
            was = 0 if fresh else state
            for c in range(6):
                letter = c in (LETTER, NAME)
                goes[c + fresh, state] = 2 if c == OPEN else 3 if c == NAME and was == 2 else int(letter)
                unit = c != CONTINUES and not (letter and was in (1, 3))
                emits[c + fresh, state] = (c != CONTINUES) * CHARACTER + unit * UNIT + (c == CLOSE and was == 3) * SENTINEL
    return goes, emits


CLASSES = byte_classes()
GOES, EMITS = automaton()


def scan(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of texts that follow one another in ``data``; padded to whole strips."""
    strips = len(data) // STRIP + 1
    kinds = np.full(strips * STRIP + MEMORY, OTHER, np.uint8)
    kinds[MEMORY : MEMORY + len(data)] = CLASSES[data]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    kinds[MEMORY + begins] += 6
    out = np.zeros((STRIP, strips), np.uint8)
    at, state = np.arange(strips) * STRIP, np.zeros(strips, np.uint8)
    for j in range(MEMORY):
        state = GOES[kinds[at + j], state]
    for j in range(STRIP):
        kind = kinds[at + MEMORY + j]
        out[j] = EMITS[kind, state]
        state = GOES[kind, state]
    out = out.T.reshape(-1)
    out[len(data) :] = 0
    return out


class Counts:
    """How many bytes emit a bit up to a place, and where the n-th of them is; kept by strip."""

    def __init__(self, emitted: np.ndarray, bit: int):
        self.is_set = ((emitted & bit) > 0).reshape(-1, STRIP)
        self.before = np.concatenate([[0], np.cumsum(self.is_set.sum(axis=1, dtype=np.int64))])

    def upto(self, place: np.ndarray) -> np.ndarray:
        """Of the bytes before each place."""
        strip = np.minimum(place // STRIP, len(self.is_set) - 1)
        inside = np.arange(STRIP) < (place - strip * STRIP)[:, None]
        return self.before[strip] + (self.is_set[strip] & inside).sum(axis=1)

    def place(self, n: np.ndarray) -> np.ndarray:
        """Of the n-th set byte, from 0."""
        strip = np.searchsorted(self.before, n, "right") - 1
        within = np.cumsum(self.is_set[strip], axis=1)
        return strip * STRIP + np.argmax(within > (n - self.before[strip])[:, None], axis=1)


def cuts(data: np.ndarray, offsets: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Per text: units ``n``, bytes of prefix and of prefix and middle, their characters, whether it holds a sentinel."""
    emitted = scan(data, offsets)
    units, characters, sentinels = (Counts(emitted, b) for b in (UNIT, CHARACTER, SENTINEL))
    before, ends = units.upto(offsets[:-1]), offsets[1:]
    n = units.upto(ends) - before
    first, second = (d % (n + 1) for d in draws)

    def after(k: np.ndarray) -> np.ndarray:
        found = ends.copy()
        some = np.flatnonzero(k < n)  # else the text's end
        if len(some):
            found[some] = units.place((before + k)[some])
        return found - offsets[:-1]

    head, body = after(np.minimum(first, second)), after(np.maximum(first, second))
    upto = [characters.upto(offsets[:-1] + x) for x in (0, head, body)]
    held = sentinels.upto(ends) > sentinels.upto(offsets[:-1])
    return {"n": n, "head": head, "body": body, "prefix_chars": upto[1] - upto[0], "middle_chars": upto[2] - upto[1], "held": held}


def draw(seed: int, group: int) -> Column:
    """A group of eight hex digits of the id's hash, from 1."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are transformed, ``spm_percent`` of these into
    spm. A task holds one block of texts; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        for batch in blocks(batches):
            data, offsets = utf8(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            got = cuts(data, offsets, (h1, h2))
            plain = (offsets[1:] == offsets[:-1]) | got["held"] | (h3 % 100 >= percent)
            form = np.where(plain, 0, np.where(h4 % 100 < spm_percent, 2, 1))
            raw, out = data.tobytes(), []
            for a, z, h, b, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), got["head"].tolist(), got["body"].tolist(), form.tolist(), strict=True):
                if f:
                    head, middle, tail = raw[a : a + h], raw[a + h : a + b], raw[a + b : z]
                    out.append(b"".join((p, head, s, tail, m, middle) if f == 1 else (s, tail, p, head, m, middle)))
                else:
                    out.append(raw[a:z])
            names = pa.array(["plain", "psm", "spm"]).take(pa.array(form))
            sizes = [pa.array(got[c], pa.int64(), mask=plain) for c in ("prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got["n"]), names, *sizes, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", *[draw(seed, k).alias(f"h{k}") for k in range(1, 5)])
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. The first sentinel of a kind is the one that was put in."""
    first, second = (F.when(form == "psm", F.lit(a)).otherwise(F.lit(b)) for a, b in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    rest = F.substring(output, F.length(first) + 1, F.length(output))
    a = F.substring_index(rest, SUFFIX, 1), F.substring_index(rest, PREFIX, 1)
    one = F.when(form == "psm", a[0]).otherwise(a[1])
    rest = F.substring(rest, F.length(one) + F.length(second) + 1, F.length(rest))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))
    whole = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(whole)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and digests of its output and of the text restored from it."""
    found = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLE = {
    "op13_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
drawn AS (
  SELECT *, list_transform(range(1, 33, 8), lambda i: CAST('0x' || substr(hex, i, 8) AS BIGINT)) AS h FROM units),
placed AS (
  SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1 :], ''), '') AS s FROM placed)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
}
