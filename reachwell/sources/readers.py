"""Tables from files, with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.constants import BAND_WEIGHTS
from reachwell.functions.geometry import oriented
from reachwell.functions.scalars import survey_year, tract_vintage
from reachwell.guards import CatchmentError, matched


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """A CSV with a header, all columns as strings: codes keep their leading zeros."""
    return spark.read.csv(path, header=True, sep=sep, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def csv_typed(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, schema=schema, enforceSchema=False)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A dataset with its filter and columns pushed to the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def by_suffix(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None) -> DataFrame:
    """A Parquet or delimited file, by the ending of its name; ``.tsv`` and ``.txt`` have tabs unless told otherwise."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix in (".csv", ".tsv", ".txt"):
        if schema is None:
            raise CatchmentError("a delimited file needs a schema")
        return csv_typed(spark, path, schema, sep or ("," if suffix == ".csv" else "\t"))
    raise CatchmentError(f"no reader for {suffix or path!r}")


def _geojson(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    """The named properties, and ``parts``: arrays of rings, the outer one first, of each polygon or multipolygon."""
    point = "array<double>"
    props = ", ".join(f"{k}:{t}" for k, t in properties.items())
    text = spark.read.text(path, wholetext=True)
    shape = f"struct<type:string,features:array<struct<properties:struct<{props}>,geometry:struct<type:string,coordinates:string>>>>"
    features = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    own = features.select(*[F.col(f"f.properties.{k}").alias(k) for k in properties], F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one = F.array(F.from_json("c", f"array<array<{point}>>"))
    many = F.from_json("c", f"array<array<array<{point}>>>")
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many)
    points = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return own.select(*properties, points.alias("parts"))


def geojson_rings(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    """Outer rings of a GeoJSON file's polygons and multipolygons, with the named properties: ..., part, ring.

    A polygon with holes is an error: its outer ring alone would be too large.
    """
    parts = _geojson(spark, path, properties).select(*properties, F.posexplode("parts").alias("part", "rings"))
    whole = F.when(F.size("rings") > 1, F.raise_error(F.lit("a polygon has holes"))).otherwise(F.col("rings")[0])
    return parts.select(*properties, "part", whole.alias("ring"))


def geojson_polygons(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    """Polygons and multipolygons of a GeoJSON file, holes included, with the named properties: ..., polygon.

    Empty geometries and those of other types are left out.
    """
    found = _geojson(spark, path, properties).select(*properties, oriented(F.col("parts")).alias("polygon"))
    return found.where(F.size("polygon") > 0)


def active_bands(names: Sequence[str] = ("manuscript_settings", "drive_time_thresholds_minutes"), file: str = "config/isochrone_config.yaml", root: str | None = None, fallback: Sequence[int] = tuple(BAND_WEIGHTS)) -> list[int]:
    """Bands of a settings file, ascending: of the given root, else of PIPELINE_ROOT, else of the working folder; the fallback if none has any.

    A file that can't be read as YAML counts as without bands.
    """
    import yaml

    for folder in (root, os.environ.get("PIPELINE_ROOT"), os.getcwd()):
        path = Path(folder or "", file)
        if not folder or not path.is_file():
            continue
        try:
            found = yaml.safe_load(path.read_text(encoding="utf-8"))
        except yaml.YAMLError:
            found = None
        for n in names:
            found = found.get(n) if isinstance(found, dict) else None
        return sorted(int(b) for b in found or fallback)
    return sorted(int(b) for b in fallback)


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Per-state tables as one, columns by name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def bundle_years(population: DataFrame, geometry: DataFrame, years: DataFrame) -> DataFrame:
    """The survey year and tract vintage of each year; an error if the bundle lacks one of them.

    ``population`` has acs_year, ``geometry`` vintage, ``years`` year.
    """
    asked = years.select("year", survey_year(F.col("year")).alias("acs_year"), tract_vintage(F.col("year")).alias("vintage"))
    matched(asked, population, "acs_year", "the bundle has no population of a year")
    matched(asked, geometry, "vintage", "the bundle has no tracts of a vintage")
    return asked


def national_summary(df: DataFrame, specialties: int = 7, years: int = 11) -> DataFrame:
    """A run's summary (specialty, year, mean, method, resolution), if it is whole and of one kind."""
    row = df.agg(
        F.count("*").alias("n"), F.count_distinct("specialty", "year").alias("cells"), F.count_distinct("specialty").alias("s"), F.count_distinct("year").alias("y"),
        F.count_if(F.col("mean").isNull() | F.isnan("mean")).alias("missing"), F.count_distinct("method", "resolution").alias("kinds"),
    ).head()
    want = specialties * years
    if (row["n"], row["cells"], row["s"], row["y"], row["missing"], row["kinds"]) != (want, want, specialties, years, 0, 1):
        raise CatchmentError(f"summary isn't whole: {row.asDict()}")
    return df
