"""Results on disk, with digests to read them back by."""

from __future__ import annotations

import hashlib
import json
import os
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.guards import CatchmentError


def row_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their count and the sums of their hashes, computed by Spark."""
    h = F.xxhash64(*[F.to_json(F.struct(*sorted(df.columns)))])
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).head()
    return hashlib.sha256(repr(tuple(map(str, row))).encode()).hexdigest()


def write_with_digest(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Writes Parquet by Spark's commit protocol, and beside it a one-row table with the digest of what was written."""
    df.write.mode(mode).parquet(path)
    digest = row_digest(df.sparkSession.read.parquet(path))
    df.sparkSession.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode(mode).json(f"{path}.digest")
    return digest


def read_verified(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The table; a warning, or an error if ``strict``, where it doesn't match its digest."""
    df = spark.read.parquet(path)
    want = spark.read.json(f"{path}.digest", schema="digest string").head()[0]
    if row_digest(df) != want:
        if strict:
            raise CatchmentError(f"{path} doesn't match its digest")
        warnings.warn(f"{path} doesn't match its digest", stacklevel=2)
    return df


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A small result as one CSV part with a header, in a stated order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, *order: str, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise CatchmentError(f"more than {most} rows are no table to read")
    lines = [df.columns, ["---"] * len(df.columns), *([str(v) for v in r] for r in rows)]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def write_atomic(path: str, text: str) -> str:
    """A driver-side text file by a temporary one and a rename; returns its digest."""
    target = Path(path)
    part = target.with_name(f".{target.name}.{os.getpid()}")
    part.write_text(text, encoding="utf-8")
    os.replace(part, target)
    return hashlib.sha256(text.encode()).hexdigest()


def write_manifest(path: str, **values: object) -> str:
    return write_atomic(path, json.dumps(values, indent=1, sort_keys=True, default=str))


def read_manifest(path: str, **expected: object) -> dict:
    """A manifest, if it has the expected values: the run that is meant, not the newest one."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if wrong := {k: found.get(k) for k, v in expected.items() if found.get(k) != v}:
        raise CatchmentError(f"manifest {path} has other values: {wrong}")
    return found


def frozen_manifest(path: str, digest_path: str) -> dict:
    """A JSON manifest whose digest is still the one recorded beside it; specifications must have ids of their own."""
    recorded = Path(digest_path).read_text(encoding="utf-8").split()
    text = Path(path).read_bytes()
    if not recorded or hashlib.sha256(text).hexdigest() != recorded[0]:
        raise CatchmentError(f"manifest {path} has changed since it was frozen: make a new version with a new digest")
    found = json.loads(text)
    ids = [s.get("id") for s in found.get("specifications", [])]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}, key=str):
        raise CatchmentError(f"manifest {path} repeats {', '.join(map(str, repeated))}")
    return found


def complete_run(manifest: dict, results: DataFrame) -> DataFrame:
    """``results``, if every variant that the manifest calls frozen is among them."""
    want = {s["variant"] for s in manifest.get("specifications", []) if s.get("status") == "frozen"}
    have = {r[0] for r in results.select("variant").distinct().collect()}
    if missing := sorted(want - have):
        raise CatchmentError(f"variants of the manifest weren't run: {', '.join(missing)}")
    return results


def environment() -> dict[str, str]:
    """Versions that numbers may depend on."""
    import platform

    import numpy
    import pandas
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "spark": pyspark.__version__}


def locked_environment(path: str) -> dict[str, str]:
    """The environment, if it is the one of the lock file (JSON); an error that names what drifted."""
    want, have = json.loads(Path(path).read_text(encoding="utf-8")), environment()
    if drift := sorted(k for k in want.keys() | have.keys() if want.get(k) != have.get(k)):
        raise CatchmentError("environment differs from the lock: " + ", ".join(f"{k} {want.get(k)} -> {have.get(k)}" for k in drift))
    return have


def staged(spark: SparkSession, *paths: str) -> None:
    """An error that names the inputs that aren't there, before anything is computed."""
    context = spark.sparkContext
    missing = []
    for p in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at):
            missing.append(p)
    if missing:
        raise CatchmentError(f"inputs aren't staged: {', '.join(missing)}")
