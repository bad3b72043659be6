"""Near-duplicate embeddings by an exact metric range join over pivots.

Vectors are taken as points of length one; a cosine of at least ``c`` is a
Euclidean distance of at most ``r = sqrt(2 - 2c)``. Pivots are chosen from a
bounded sample, each the farthest from those before, and every vector belongs
to the cell of its nearest pivot. By the triangle inequality a vector can only
have a neighbour in another cell if its distance to that cell's pivot is at
most the distance to its own plus ``2r``; to those cells of a lower number it
is copied as well, so each pair of cells meets once and each cell is joined on
its own. As many pivots are used as make the least work on a part of the sample
that none is chosen from: vectors in many directions at much the same distances
leave the triangle inequality little to exclude, and copies would cost more than
they save. A cell is dealt into blocks of a bounded size and the blocks are
joined by pairs, strip by strip; matrix products in single precision leave only
the borderline pairs to be decided in double precision. A task returns counts
and, instead of pairs, the components that its pairs form.

The result is exact, whatever the pivots; they only decide how much is copied.

Equal vectors are one content from the start and count as linked to each other.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are kept. Vectors of different lengths link
with nothing. Each row is a vector, repeated ids included; equal rows are
linked, by a digest of 128 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.llm.common import checkpointed, digest, table
from reachwell.llm.similarity import components

#: Vectors that pivots are chosen from, vectors for each pivot, and pivots at most.
SAMPLE, EACH, PIVOTS = 2048, 4096, 256
#: Vectors of a block (a task joins two blocks), and rows of one that meet the other at once.
BLOCK, STRIP = 16384, 512
LEAST = 0.9


def units(column: pa.Array) -> np.ndarray:
    """Rows of length one, in double precision, of vectors of equal length without nulls."""
    x = np.array(column.flatten(), np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def away(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distances of the rows of ``x`` from the pivots."""
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def cells(distance: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and which cells it is sent to."""
    own = distance.argmin(1)
    rows = np.arange(len(own))
    reach = distance <= distance[rows, own][:, None] + 2 * radius + 1e-9
    reach &= np.arange(distance.shape[1])[None] < own[:, None]
    reach[rows, own] = True
    return own, reach


def choose(sample: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Some of the sample's first half, each the farthest from the ones before: as many as compare the second half with least work."""
    half = max(1, len(sample) // 2)
    first, rest = sample[:half], sample[half:]
    chosen = [0]
    gap = 2 - 2 * first @ first[0]
    while len(chosen) < min(most, half):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, 2 - 2 * first @ first[chosen[-1]])
    distance = away(rest, first[chosen])
    best, least = 1, float(len(rest)) ** 2
    for n in sorted({2**k for k in range(1, 30) if 2**k <= len(chosen)} | {len(chosen)} - {1}):
        own, reach = cells(distance[:, :n], radius)
        homes = np.bincount(own, minlength=n)
        work = float(homes @ (2 * reach.sum(0) - homes))  # the homes with each other, and twice with the guests
        if (work, n) < (0.9 * least if best == 1 else least, best):
            best, least = n, work
    return first[chosen[:best]]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Brings the components of linked rows together; ``root`` points every row at the least one of its component."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(shorter := root[root], root):
            root[:] = shorter


def join(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of two blocks: for the rows of x, then of y, the number of linked vectors and a component.

    ``n_x`` and ``n_y`` are how many vectors each row stands for. A component
    is the least row number (y after x) that the links reach, or the row itself.
    """
    margin = 2e-7 * x.shape[1] + 1e-6
    far = 0 if same else len(x)
    root = np.arange(far + len(y))
    count_x, count_y = np.zeros(len(x)), np.zeros(len(y))
    x32, y32 = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    for at in range(0, len(x), STRIP):
        low = at if same else 0
        near = x32[at : at + STRIP] @ y32[:, low:]
        i, j = np.nonzero(near >= least - margin)
        sure = near[i, j] > least + margin
        i, j = i + at, j + low
        for k in range(0, len(i), 65536):
            some = k + np.flatnonzero(~sure[k : k + 65536])
            sure[some] = (x[i[some]] * y[j[some]]).sum(1) >= least
        if same:
            sure &= i < j
        i, j = i[sure], j[sure]
        count_x += np.bincount(i, n_y[j], len(x))
        count_y += np.bincount(j, n_x[i], len(y))
        unite(root, i, j + far)
    if same:
        count_x = count_y = count_x + count_y
    return count_x, count_y, root[: len(x)], root[far:]


def links(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """From distinct vectors (id, n, embedding): partial rows of id, links (vectors linked), root (an id that is reached)."""
    count = reps.count()
    n_pivots = int(min(PIVOTS, max(1, count // EACH)))
    radius = np.sqrt(max(0.0, 2 - 2 * least))
    drawn = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    lengths = np.array(pc.list_value_length(drawn))
    pivots = {int(d): choose(units(drawn.filter(pa.array(lengths == d))), n_pivots, radius) for d in np.unique(lengths)}
    shared = reps.sparkSession.sparkContext.broadcast(pivots)
    kind = reps.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.array(whole.column("size"))
            for d in np.unique(sizes):
                batch = whole.filter(pa.array(sizes == d))
                p = shared.value.get(int(d))
                if p is None:
                    rows, cell = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                    home = cell
                else:
                    own, reach = cells(away(units(batch.column("embedding")), p), radius)
                    rows, cell = np.nonzero(reach)
                    home = own[rows]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "n", "embedding", "size")), pa.array(cell.astype(np.int32)), pa.array(cell == home)], ["id", "n", "embedding", "size", "cell", "home"])

    vector = reps.schema["embedding"].dataType.simpleString()
    placed = reps.select("id", "n", "embedding", F.size("embedding").alias("size")).mapInArrow(place, f"id {kind}, n long, embedding {vector}, size int, cell int, home boolean")
    # Each cell's rows are dealt into blocks, and a block is sent to every block that it meets.
    sums = F.broadcast(checkpointed(placed.groupBy("size", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.sum((~F.col("home")).cast("long")).alias("guests"))))  # a row for each pivot
    dealt = placed.join(sums, ["size", "cell"])
    homes, guests = (F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(0)).cast("int") for c in ("homes", "guests"))
    block = F.pmod(F.xxhash64("id"), F.greatest(F.when(F.col("home"), homes).otherwise(guests), F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", block)
    # Pairs of home blocks (i <= j), then home block i with guest block j; a guest has the second place.
    as_first = F.transform(F.sequence(F.col("block"), homes - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(False).alias("guest"), F.lit(0).alias("side")))
    as_second = F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("guest"), F.lit(1).alias("side")))
    to_guests = F.when(guests > 0, F.transform(F.sequence(F.lit(0), F.greatest(guests - 1, F.lit(0))), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("guest"), F.lit(0).alias("side"))))
    as_guest = F.when(homes > 0, F.transform(F.sequence(F.lit(0), F.greatest(homes - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("guest"), F.lit(1).alias("side"))))
    nothing = F.array().cast("array<struct<i:int,j:int,guest:boolean,side:int>>")
    tasks = F.when(F.col("home"), F.concat(as_first, F.filter(as_second, lambda t: t["i"] < t["j"]), F.coalesce(to_guests, nothing))).otherwise(F.coalesce(as_guest, nothing))
    dealt = dealt.select("id", "n", "embedding", "size", "cell", F.explode(tasks).alias("t")).select("id", "n", "embedding", "size", "cell", "t.i", "t.j", "t.guest", "t.side")

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows["side"].to_numpy()
        same = bool(side.max() == 0) and rows["i"][0] == rows["j"][0] and not rows["guest"][0].as_py()
        first, second = (rows.filter(pa.array(side == s)) for s in (0, 1))
        if same:
            second = first
        empty = pa.table([rows["id"].slice(0, 0), pa.array([], pa.int64()), rows["id"].slice(0, 0)], ["id", "links", "root"])
        if not first.num_rows or not second.num_rows:
            return empty
        x, y = units(first["embedding"].combine_chunks()), units(second["embedding"].combine_chunks())
        count_x, count_y, own_x, own_y = join(x, y, first["n"].to_numpy(), second["n"].to_numpy(), least, same)
        ids = pa.concat_arrays([c for t in ((first,) if same else (first, second)) for c in t["id"].chunks])
        count, own = (count_x, own_x) if same else (np.append(count_x, count_y), np.append(own_x, own_y))
        some = np.flatnonzero(count > 0)
        return pa.table([ids.take(pa.array(some)), pa.array(count[some].astype(np.int64)), ids.take(pa.array(own[some]))], ["id", "links", "root"])

    return dealt.groupBy("size", "cell", "i", "j", "guest").applyInArrow(meet, f"id {kind}, links long, root {kind}")


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    e = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", e.alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    # Adding zero makes the negative zero equal to zero.
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = rows.select("vec_id", "embedding", "fine", F.when(F.col("fine"), plain).alias("plain"))
    rows = rows.select("vec_id", "embedding", "fine", *[F.when(F.col("fine"), d).alias(name) for d, name in zip(digest("plain"), "hg", strict=True)])
    reps = rows.where("fine").groupBy("h", "g").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    reps = checkpointed(reps.withColumn("id", F.monotonically_increasing_id()))  # numbers contents once and for all; a vec_id may have several
    found = checkpointed(links(reps.select("id", "n", "embedding"), least))
    component = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = reps.select("h", "g", "vec_id", "id", "n").join(sums, "id", "left").join(component, "id", "left")
    of = checkpointed(of.select("h", "g", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    of = of.join(of.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component").select("h", "g", "n_links", "component_id")
    out = rows.select("vec_id", "h", "g").join(of, ["h", "g"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_neardup": op4_embedding_neardup}

ORACLE = {
    "op4_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, len(e) AS d, list_transform(e, lambda x: x / n) AS e
      FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id
"""
}
