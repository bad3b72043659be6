"""Links between sets by Jaccard similarity, and the components that links form.

All of it is joins and sums over DataFrames. An ``id`` stands for a distinct
content, so exact copies never meet each other here. Its signature is cut into
bands, the ``keys`` of buckets: ids that share a key may be alike.

Links are found in rounds. In the first ones every id is compared with a few
ids of each of its buckets, unless they are in one component already. A hash of
the id alone draws them, so buckets with much the same ids draw the same ones,
and a group of near copies that meets in many bands costs few comparisons for
each member; a small bucket is compared completely. Then the ids of buckets
that still hold several components are compared with all of other components by
the prefix filter: sets with a Jaccard similarity of at least ``t`` share an
element among the first ``n - ceil(t n) + 1`` of each, in any common order (rare
ones first), and the places of the first one that they share bound how many they
can share in all. That step is exact, whatever the sizes of the buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachwell.llm.common import checkpointed, rows_of, written

#: Rows of two numbers up to which a table is broadcast instead of shuffled.
BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows. For checkpointed tables of a few numbers a row."""
    return F.broadcast(df) if rows_of(df) <= BROADCAST_ROWS else df


def shared(signatures: DataFrame) -> DataFrame:
    """The rows (key, id) of the buckets with more than one id, of ``signatures`` that have an id once, with its keys."""
    buckets = signatures.select("id", F.explode("keys").alias("key"))
    keys = checkpointed(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return checkpointed(buckets.join(small(keys), "key").select("key", "id"))


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """Per id with a link: id, component (the least id that it reaches).

    ``links`` has a and b. Each round points the larger neighbours of an id,
    then the smaller ones, at the least; chains shorten by half or more, and
    the rounds end when every id points at its component.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(least, "u")
        after = after.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
        edges = checkpointed(after)
        # Settled when every id points once, at one that points nowhere.
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if twice.unionByName(edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u"))).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return checkpointed(found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, items) have a Jaccard similarity of ``least`` or more."""
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= F.lit(least) * (F.size("x") + F.size("y") - common)
    sized = F.least(F.size("x"), F.size("y")) >= F.lit(least) * F.greatest(F.size("x"), F.size("y"))
    return pairs.join(a, "a").join(b, "b").where(sized & (F.size("x") > 0)).where(alike).select("a", "b")


def rare_pairs(sets: DataFrame, component: DataFrame, least: float) -> DataFrame:
    """Pairs of different components that the prefix filter lets through: a, b.

    The rows of an element's largest component never meet each other: only the
    rows of its other components are joined with all. From the first element
    that two sets share, at the places i and j, they share at most
    ``min(n - i, m - j)``; the rows of later ones bound no less strictly.
    """
    items = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    # An element of one set alone links nothing, but it takes a place in the prefix: before all others.
    counts = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    order = F.shiftleft(F.least("df", F.lit(1 << 14)).cast("long"), 48).bitwiseOR(F.shiftrightunsigned("item", 16))
    length = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    ranked = items.join(counts, "item").select("id", "n", order.alias("item")).groupBy("id", "n").agg(F.collect_list("item").alias("items"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("items")).withColumn("length", (length - F.col("alone")).cast("int")).where("length > 0")
    prefix = ranked.select("id", "n", "alone", F.posexplode(F.slice(F.sort_array("items"), F.lit(1), F.col("length"))).alias("i", "item")).withColumn("i", F.col("i") + F.col("alone"))
    prefix = written(prefix.select("id", "n", "i", "item").join(small(component), "id"))
    by = prefix.groupBy("item", "component").agg(F.count("*").alias("c")).groupBy("item").agg(F.max(F.struct("c", "component"))["component"].alias("largest"), F.count("*").alias("parts"))
    fewer = prefix.join(by.where("parts > 1").select("item", "largest"), "item").where("component != largest")
    other = prefix.select("item", F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("of"))
    share = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = share >= F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-9
    pairs = fewer.join(other, "item").where((F.col("component") != F.col("of")) & enough)
    return pairs.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


def drawn(seeds: range) -> list[F.Column]:
    """Aggregates: the members of a bucket that a hash draws, one for each seed, and their components."""
    order = [F.xxhash64("id", F.lit(s)) for s in seeds]
    return [F.array(*[F.min_by("id", h) for h in order]).alias("ids"), F.array(*[F.min_by("component", h) for h in order]).alias("components")]


def drawn_pairs(members: DataFrame, seeds: range) -> DataFrame:
    """Pairs of each member (key, id, component) with the drawn ids of its bucket that are in other components: a, b."""
    centers = members.groupBy("key").agg(*drawn(seeds)).select("key", F.explode(F.array_distinct(F.arrays_zip("ids", "components"))).alias("c"))
    centers = checkpointed(centers.select("key", F.col("c.ids").alias("b"), F.col("c.components").alias("of")))
    pairs = members.join(small(centers), "key").where(F.col("component") != F.col("of"))
    return pairs.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


#: Ids of a bucket up to which all its sketches are compared.
SMALL_BUCKET = 32
#: Ids that each member is compared with in its buckets, round by round.
DRAWS = (2, 8)


def members_of(buckets: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows (key, id) of the buckets that hold several ids; one shuffle of a few numbers a row.

    With ``bits``, rows also have a ``sketch``, and those whose sketch differs in
    more bits from all others of a bucket of up to SMALL_BUCKET ids are left out.
    """
    own = Window.partitionBy("key")
    columns = [c for c in ("key", "id", "sketch") if c in buckets.columns]
    ends = buckets.select(*columns, F.min("id").over(own).alias("low"), F.max("id").over(own).alias("high")).where("low < high")
    if bits is not None:
        ends = ends.withColumn("n", F.count("*").over(own))
        ends = ends.withColumn("all", F.collect_list(F.when(F.col("n") <= SMALL_BUCKET, F.col("sketch"))).over(own))
        close = F.filter("all", lambda s: F.bit_count(s.bitwiseXOR(F.col("sketch"))) <= bits)
        ends = ends.where((F.col("n") > SMALL_BUCKET) | (F.size(close) > 1))  # itself and another
    return checkpointed(ends.select("key", "id"))


def linked(members: DataFrame, verify: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], sets_of: Callable[[DataFrame], DataFrame], least: float, draws: tuple[int, ...] = DRAWS) -> DataFrame:
    """Per id with a link: id, component.

    ``members`` (key, id), checkpointed, are the rows of the buckets that hold
    several ids, an id in a bucket once. ``verify`` takes the ids that
    have candidates and returns a function that keeps the linked ones of pairs
    (a, b) of them; ``sets_of`` takes ids and returns their sets (id, items).
    """
    verified = verify(members.select("id").distinct())
    open_members, links, found, seeds = members.withColumn("component", F.col("id")), None, None, 0
    for n in draws:
        more = verified(drawn_pairs(open_members, range(seeds, seeds + n)))
        seeds += n
        links = checkpointed(more if links is None else links.unionByName(more))
        found = components(links)
        # Buckets that still hold several components, unless all but one of their ids have been compared with the others.
        of = open_members.drop("component").join(small(found), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        mixed = of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *drawn(range(seeds)))
        mixed = checkpointed(mixed.where((F.col("low") < F.col("high")) & (F.size(F.array_distinct("ids")) < F.col("n") - 1)).select("key"))
        open_members = checkpointed(of.join(small(mixed), "key", "left_semi"))
        if not rows_of(open_members):
            return found
    open_ids = checkpointed(open_members.select("id", "component").distinct())
    pairs = checkpointed(rare_pairs(sets_of(open_ids.select("id")), open_ids, least))
    return components(links.unionByName(verified(pairs)))
