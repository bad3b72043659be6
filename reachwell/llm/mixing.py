"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target number of words. Sources share ``share`` times all
words by their weights; a target stops at ``most`` times the words of its
source, and the excess goes to the others by weight. So a target is the lesser
of that limit and ``level * weight``, and only the level has to be found: it
rises with each sum over the sources until no further source is over its limit.

A source is taken whole as often as its target allows. The rest of the target
is met by the documents whose hash lies under a threshold of the source, once
more each. The hash doesn't depend on the target, so what a smaller target takes
is part of what a larger one takes. Thresholds come from histograms: words are
summed by source and the leading bits of the hash, the bucket in which the sums
pass the target is found, and that bucket alone is divided further by the next
bits, until it holds one hash. The document at the threshold is taken if this
brings the sum nearer to the target. Rows are filtered by threshold, never
sorted, and meet a source's threshold in a broadcast table or, where that would
be large, under as many salts as divide a source that holds most of the rows.

Only DataFrame functions are used.

Defined cases: null texts and texts of white space have size 0 and nothing is
taken of them. Rows without a source are a source of their own, the last one.
Rows that are equal in doc_id, text and source have the same hash; as many of
them are taken as come nearest to the target, and a hash of their row's number
says which. A null doc_id hashes as an empty one. An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachwell.llm.common import checkpointed, numbered, rows_of, table, written

#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash, and those by which one histogram divides.
KEY_BITS, STEP_BITS = 60, 12
#: Bytes of a table by source that is sent to all executors; a larger one is joined under ``SALTS`` salts.
SENT_BYTES, SALTS = 8 << 20, 64


def sized(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, ``of`` for the source, never null and in its order, and two hashes: ``key`` of the content, ``row`` of the row's number."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias("of"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(content), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << KEY_BITS) - 1).alias("row"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Sources (of, source_size) with their ``target``; the order of sources says whose weight is which."""
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    sources = numbered(sources, F.col("of")).withColumn("weight", F.array(*map(F.lit, weights))[turn]).drop("place")
    sources = checkpointed(sources.withColumn("limit", F.col("source_size") * most))
    level, last = 0.0, None
    while level != last:  # rises, since only sources over their limit leave the sum
        over = F.col("limit") < F.lit(level) * F.col("weight")
        total, kept, weight = sources.agg(F.sum("source_size"), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        last, level = level, (share * (total or 0) - (kept or 0)) / weight if weight else float("inf")
    return sources.select("of", "source_size", F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def cut(rows: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Where each source's sizes, summed in the order of ``key``, pass its budget.

    ``rows`` has of, size and the key; ``budgets`` has of and ``left``, less
    than the sizes' sum. Returns, by source: ``bound`` (a key), ``left`` (the
    budget without the sizes of smaller keys), ``n`` and ``total`` (rows and
    sizes at the bound).
    """
    rows, shift, found = rows.select("of", "size", F.col(key).alias("at")), KEY_BITS, []
    while True:
        shift = max(0, shift - STEP_BITS)
        rows = rows.withColumn("bucket", F.shiftright("at", shift))
        sums = rows.groupBy("of", "bucket").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("bound"))
        own = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as a step has buckets
        sums = sums.join(budgets, "of").withColumn("before", F.sum("total").over(own) - F.col("total"))
        sums = sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("total")))
        sums = checkpointed(sums.withColumn("left", F.col("left") - F.col("before")).drop("before"))  # a row for each source
        found.append(sums.where(F.col("least") == F.col("bound")).select("of", "bound", "left", "n", "total"))
        open_ = checkpointed(sums.where(F.col("least") < F.col("bound")).select("of", "bucket", "left"))
        if not rows_of(open_):
            return reduce(DataFrame.unionByName, found)
        budgets = open_.select("of", "left")
        rows = checkpointed(rows.join(open_, ["of", "bucket"], "left_semi").drop("bucket"))


def attached(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source, inner."""
    by_source = checkpointed(by_source)
    names = by_source.agg(F.sum(F.octet_length("of"))).first()[0] or 0
    if names + rows_of(by_source) * 100 <= SENT_BYTES:
        return rows.join(F.broadcast(by_source), "of")
    salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["of", "salt"]).drop("salt")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken.

    ``weights`` repeat over the sources in the order of their code points.
    ``taken`` is the size times the number of times that the mix holds the row.
    """
    rows = written(sized(docs))
    sources = checkpointed(rows.groupBy("of").agg(F.sum("size").alias("source_size")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets(sources, weights, share, most).withColumn("times", times)
    plan = checkpointed(plan.withColumn("left", F.col("target") - F.col("times") * F.col("source_size")))
    some = rows.where("size > 0")
    cuts = checkpointed(cut(some, plan.where("left > 0").select("of", "left"), "key"))
    shared = checkpointed(cuts.where("n > 1").select("of", F.col("bound").alias("key"), "left"))
    near = F.col("left") * 2 > F.col("total")
    cuts = cuts.select("of", "bound", (near & (F.col("n") == 1)).alias("takes"))
    if rows_of(shared):  # rows that are equal, or whose hashes are
        equal = some.join(shared, ["of", "key"], "left_semi")
        ties = cut(equal, shared.select("of", "left"), "row").select("of", F.col("bound").alias("row_bound"), near.alias("row_takes"))
        cuts = cuts.join(ties, "of", "left")
    else:
        cuts = cuts.withColumns({"row_bound": F.lit(None).cast("long"), "row_takes": F.lit(None).cast("boolean")})
    plan = plan.join(cuts, "of", "left")
    in_row = (F.col("row") < F.col("row_bound")) | ((F.col("row") == F.col("row_bound")) & F.col("row_takes"))
    under = (F.col("key") < F.col("bound")) | ((F.col("key") == F.col("bound")) & (F.col("takes") | in_row))
    taken = F.col("size") * (F.col("times") + F.when(under, 1).otherwise(0))
    return attached(rows, plan.drop("left")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by the weights 3, 1, 2, of one and a half times their words, takes of each."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op11_mixing": op11_mixing}

ORACLE = {
    "op11_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS top
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source)),
levels AS (
  SELECT top, weight, source, (1.5 * sum(source_size) OVER () - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW o AS (ORDER BY top / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size,
         least(CAST(top AS DOUBLE), coalesce((SELECT level FROM levels WHERE top >= level * weight ORDER BY top / weight, source NULLS LAST LIMIT 1),
                                             CAST('inf' AS DOUBLE)) * weight) AS target
  FROM sources),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
sums AS (
  SELECT doc_id, size, source_size, target, times, target - times * source_size AS remainder,
         sum(size) OVER (PARTITION BY r.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN upto <= remainder OR (upto - size <= remainder AND 2 * (remainder - (upto - size)) > size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sums
"""
}
