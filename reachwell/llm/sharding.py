"""Sharding by balanced label propagation over links between documents.

Documents are linked when their texts are equal. Groups of more than a tenth of
a shard, of which there are at most some ten for each shard, are planned first,
the largest ones before the others: a group goes where it fits with the least
room left over, or fills the emptiest shards. Documents of the other groups
begin on the shard that a hash of the id gives. In each round every one of them
looks at how its group is spread over the shards, weighs each shard's share by
the room that it has left, and asks to move to the best one; a shard admits no
more than its quota, by a hash. Documents of
a group with the same salt of the id's hash move together as a cell, so a group
has at most ``4 * shards`` cells however many documents it has: rounds join
and sum cells, never documents.

At the end the shards' sizes are made exact: shards differ by at most one
document (the law of ``rows``). Linked documents keep their shard up to its
size; the others, and what is over, fill the shards in a global order that
comes from counts by bucket, so no task orders a whole shard.

Only DataFrame functions are used. Texts are compared by their 128-bit digest.

Defined cases: null texts are linked with nothing and have size 8 and checksum
0; empty texts are equal to each other. Rows with the same doc_id are documents
of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachwell.llm.common import checkpointed, table

#: Rounds at most; they end when no cell moves.
ROUNDS = 32
#: Cells of a group for each shard, and rows that one task puts in order.
CELLS, BUCKET_ROWS = 4, 50_000


def ranked(rows: DataFrame, within: list[str], buckets: int) -> DataFrame:
    """The rows with ``rank``, gapless from 0 within each value of ``within``.

    Ranks come from a window in each of ``buckets`` hash buckets and the counts
    of the buckets before it.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    counts = rows.groupBy(*within, "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    order = Window.partitionBy(*within, "bucket").orderBy("doc_id", "row")
    return rows.withColumn("own", F.row_number().over(order) - 1).join(before, [*within, "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def planned(totals: list[int], sizes: list[int]) -> list[list[tuple[int, int]]]:
    """Per group, in the order given, the shards that hold it and the rows on each; ``sizes`` has the room of the shards."""
    room, out = list(sizes), []
    for left in totals:
        own = []
        while left:
            fits = [s for s, n in enumerate(room) if n >= left]
            shard = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            n = min(left, room[shard])
            own.append((shard, n))
            room[shard] -= n
            left -= n
        out.append(own)
    return out


def propagate(cells: DataFrame, shards: int, quota: int, rounds: int = ROUNDS, taken: list[int] | None = None) -> DataFrame:
    """Cells (key, salt, n, total, shard) on the shards where propagation takes them; ``taken`` rows of each shard are not theirs."""
    for step in range(rounds):
        load = dict(enumerate(taken or [0] * shards))
        for r in cells.groupBy("shard").agg(F.sum("n")).collect():  # a row for each shard
            load[r[0]] += r[1]
        room = F.array(*[F.lit(max(0.0, 1 - load.get(s, 0) / quota)) for s in range(shards)])
        votes = cells.groupBy("key", "shard").agg(F.sum("n").alias("votes"))
        value = F.struct(F.col("votes") * room[F.col("shard")], "votes", F.xxhash64("key", "shard"), "shard")
        best = votes.groupBy("key").agg(F.max(value).alias("best")).select("key", F.col("best.shard").alias("target"))
        asked = checkpointed(cells.join(best, "key").withColumn("asks", (F.col("target") != F.col("shard")) & (room[F.col("target")] > 0)))
        wanted = {r[0]: r[1] for r in asked.where("asks").groupBy("target").agg(F.sum("n")).collect()}
        if not wanted:
            return asked.drop("target", "asks")
        share = F.array(*[F.lit(max(0, quota - load.get(s, 0)) / wanted.get(s, 1)) for s in range(shards)])
        whole = F.col("total") * 10 <= quota
        draw = F.pmod(F.when(whole, F.xxhash64("key", F.lit(step))).otherwise(F.xxhash64("key", "salt", F.lit(step))), F.lit(1 << 20)) / float(1 << 20)
        goes = F.col("asks") & (draw < share[F.col("target")])
        cells = asked.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target", "asks")
    return checkpointed(cells)


def assign(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot."""
    text = F.col("text").cast("binary")
    docs = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards * CELLS)).cast("int").alias("salt"),
    )
    docs = checkpointed(docs)
    count = docs.count()
    buckets = count // BUCKET_ROWS + 1
    quota = max(1, count // shards)
    most = [count // shards + (s < count % shards) for s in range(shards)]
    most_of = F.array(*[F.lit(n) for n in most])
    cells = docs.where("key is not null").groupBy("key", "salt").agg(F.count("*").alias("n"))
    cells = checkpointed(cells.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > 1"))  # few cells to a key
    large = cells.where(F.col("total") * 10 > quota).select("key", "total").distinct().orderBy(F.desc("total"), "key").collect()
    plan = planned([r["total"] for r in large], most)
    held = [sum(n for own in plan for s, n in own if s == shard) for shard in range(shards)]
    begins = list(range(shards)) * CELLS
    if large and sum(most) > sum(held):  # the others begin in proportion to the room left
        free, total = [n - h for n, h in zip(most, held, strict=True)], sum(most) - sum(held)
        ends = [sum(free[: s + 1]) for s in range(shards)]
        begins = [next(s for s, end in enumerate(ends) if (2 * i + 1) * total < 2 * len(begins) * end) for i in range(len(begins))]
    begin_of = F.array(*[F.lit(s) for s in begins])
    others = cells.where(F.col("total") * 10 <= quota).withColumn("shard", begin_of[F.col("salt")])
    others = propagate(others, shards, quota, rounds, held)

    cuts = [(r["key"], [(sum(n for _, n in own[: i + 1]), s) for i, (s, _) in enumerate(own)]) for r, own in zip(large, plan, strict=True)]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cuts, "key binary, cuts array<struct<end:long,shard:int>>"))
    whole = ranked(docs.join(cuts, "key"), ["key"], buckets)
    whole = whole.withColumn("shard", F.expr("filter(cuts, c -> rank < c.end)[0].shard")).drop("cuts", "rank")
    placed = docs.join(cuts, "key", "left_anti").join(others.select("key", "salt", "shard"), ["key", "salt"], "left")
    placed = placed.unionByName(whole)
    linked = checkpointed(ranked(placed.where("shard is not null"), ["shard"], buckets // shards + 1))
    kept = linked.where(F.col("rank") < most_of[F.col("shard")])
    taken = {r[0]: r[1] for r in kept.groupBy("shard").count().collect()}  # a row for each shard
    free = [n - taken.get(s, 0) for s, n in enumerate(most)]
    begin = [sum(free[:s]) for s in range(shards)]
    over = linked.where(F.col("rank") >= most_of[F.col("shard")]).drop("rank", "shard")
    rest = placed.where("shard is null").drop("shard").unionByName(over)
    rest = ranked(rest.withColumn("one", F.lit(0)), ["one"], buckets).drop("one")
    shard = reduce(add, [(F.col("rank") >= b + n).cast("int") for b, n in zip(begin[:-1], free[:-1], strict=True)], F.lit(0))
    rest = rest.withColumn("shard", shard)
    shift = F.array(*[F.lit(taken.get(s, 0) - b) for s, b in enumerate(begin)])
    rest = rest.withColumn("rank", F.col("rank") + shift[F.col("shard")])
    columns = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("rank").cast("long").alias("slot")]
    return kept.select(*columns).unionByName(rest.select(*columns))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 24 shards whose row counts differ by at most one."""
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
