"""The model's tables, made from the driver's star schema: customers are tracts, suppliers origins, parts providers.

Each has its SQL twin in ``TABLES``, the common part of every oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = """
tracts AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS geoid,
         greatest(c_acctbal, 0.0) AS pop, c_custkey AS k, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state,
         c_mktsegment AS segment, CASE WHEN 1 + c_custkey % 12 <= 10 THEN 1 + c_custkey % 12 END AS ruca,
         CASE WHEN 1 + c_custkey % 12 <= 3 THEN 'Metropolitan' WHEN 1 + c_custkey % 12 <= 10 THEN 'Rural' END AS rurality
  FROM customer),
overlap AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS coord_id,
         CASE WHEN l_quantity <= 3 THEN 30 WHEN l_quantity <= 5 THEN 60 WHEN l_quantity <= 8 THEN 120 ELSE 180 END AS band,
         geoid, least(round(sum(l_discount * 10), 4), 1.0) AS overlap_fraction
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN tracts ON o_custkey = k
  WHERE l_quantity <= 10 AND o_orderstatus = 'F' AND l_suppkey % 17 <> 0 GROUP BY 1, 2, 3),
supply AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS coord_id, CAST(1 + s_suppkey % 7 AS DOUBLE) AS supply,
         lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state FROM supplier WHERE s_suppkey % 10 <> 0),
panel AS (
  SELECT l_partkey AS npi, CAST(year(o_orderdate) AS INTEGER) AS analysis_year,
         'S' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS coord_id, nullif(l_returnflag, 'R') AS match_source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cohort AS (SELECT p_partkey AS npi, p_brand AS specialty FROM part),
membership AS (
  SELECT b AS band, coord_id, geoid
  FROM (SELECT coord_id, geoid, min(band) AS t FROM overlap WHERE overlap_fraction > 0 AND coord_id IN (SELECT coord_id FROM supply) GROUP BY 1, 2)
  JOIN (VALUES (30), (60), (120), (180)) v(b) ON b >= t),
bridge AS (SELECT geoid, (k * 7 + i) % (SELECT greatest(1, count(*) // 2) FROM tracts) AS cell_id, CAST(1 + (k + i) % 5 AS DOUBLE) AS area
           FROM tracts, (VALUES (0), (1), (2)) v(i) WHERE i <= k % 3),
cover AS (
  SELECT geoid, specialty, pop, state, rurality, ruca, segment, k, 120.0 * ((k * 13 + length(specialty) * 7 + s * 29) % 101) / 100 - 10 AS percent
  FROM tracts, (VALUES ('AA', 1), ('BB', 2), ('CC', 3), ('DD', 4)) v(specialty, s)),
w AS (SELECT * FROM (VALUES (30, 1.00, 0.32, 0.5376), (60, 0.68, 0.46, 0.414), (120, 0.22, 0.13, 0.0403), (180, 0.09, 0.09, 0.0081)) v(band, w, w1, w2))
"""


def origin(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 7, "0"))


class Binding:
    """The tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def tracts(self) -> DataFrame:
        """geoid (its first two digits the state), pop, k, state, segment, ruca, rurality."""
        state = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
        code = 1 + F.col("c_custkey") % 12
        return self.raw("customer").select(
            F.concat(state, F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("geoid"),
            F.greatest("c_acctbal", F.lit(0.0)).alias("pop"),
            F.col("c_custkey").alias("k"),
            state.alias("state"),
            F.col("c_mktsegment").alias("segment"),
            F.when(code <= 10, code).alias("ruca"),
            F.when(code <= 3, "Metropolitan").when(code <= 10, "Rural").alias("rurality"),
        )

    @property
    def lines(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    @property
    def overlap(self) -> DataFrame:
        """coord_id, band, geoid, overlap_fraction; zero fractions and origins without supply occur."""
        q = F.col("l_quantity")
        band = F.when(q <= 3, 30).when(q <= 5, 60).when(q <= 8, 120).otherwise(180)
        rows = self.lines.where("l_quantity <= 10 and o_orderstatus = 'F' and l_suppkey % 17 <> 0")
        rows = rows.join(self.tracts.select("k", "geoid"), F.col("o_custkey") == F.col("k"))
        return rows.groupBy(origin("l_suppkey").alias("coord_id"), band.alias("band"), "geoid").agg(F.least(F.round(F.sum(F.col("l_discount") * 10), 4), F.lit(1.0)).alias("overlap_fraction"))

    @property
    def supply(self) -> DataFrame:
        state = F.lpad(F.col("s_nationkey").cast("string"), 2, "0")
        return self.raw("supplier").where("s_suppkey % 10 <> 0").select(origin("s_suppkey").alias("coord_id"), (1 + F.col("s_suppkey") % 7).cast("double").alias("supply"), state.alias("state"))

    @property
    def panel(self) -> DataFrame:
        """npi, analysis_year, coord_id, match_source (null: a placeholder)."""
        return self.lines.select(F.col("l_partkey").alias("npi"), F.year("o_orderdate").alias("analysis_year"), origin("l_suppkey").alias("coord_id"), F.nullif("l_returnflag", F.lit("R")).alias("match_source"))

    @property
    def cohort(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("npi"), F.col("p_brand").alias("specialty"))

    @property
    def membership(self) -> DataFrame:
        """Nested: each tract of an origin with supply in its tightest band and those beyond."""
        from reachwell.operators.centroid import nested

        near = self.overlap.where("overlap_fraction > 0").join(self.supply.select("coord_id"), "coord_id", "left_semi")
        return nested(near.groupBy("coord_id", "geoid").agg(F.min("band").alias("band")), [30, 60, 120, 180])

    @property
    def demand(self) -> DataFrame:
        return self.tracts.select("geoid", F.col("pop").alias("demand"))

    @property
    def bridge(self) -> DataFrame:
        """Each tract on one to three cells: geoid, cell_id, area."""
        half = self.tracts.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("half"))
        rows = self.tracts.select("geoid", "k", F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))).alias("i")).crossJoin(F.broadcast(half))
        return rows.select("geoid", ((F.col("k") * 7 + F.col("i")) % F.col("half")).alias("cell_id"), (1 + (F.col("k") + F.col("i")) % 5).cast("double").alias("area"))

    @property
    def cover(self) -> DataFrame:
        """Percent of each tract within an hour of four specialties, some below 0 and above 100."""
        four = F.explode(F.array(*[F.struct(F.lit(s).alias("specialty"), F.lit(i).alias("s")) for i, s in enumerate(("AA", "BB", "CC", "DD"), 1)]))
        rows = self.tracts.select("*", four.alias("x"))
        percent = 120.0 * ((F.col("k") * 13 + F.length("x.specialty") * 7 + F.col("x.s") * 29) % 101) / 100 - 10
        return rows.select("geoid", "x.specialty", "pop", "state", "rurality", "ruca", "segment", "k", percent.alias("percent"))
