"""An extension: supply kept up to date from a stream of provider sightings.

The model itself has no streams. A sighting (npi, coord_id, seen_at) counts its
provider once at each origin and in each window of time; those later than the
watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_supply(sightings: DataFrame, window: str = "30 days", late: str = "1 day") -> DataFrame:
    """Distinct providers at each origin by window of time: window_start, coord_id, supply. For a stream or a table.

    Sightings of a provider that the window has already are dropped first, so
    counts are exact; the state of both steps goes with the window.
    """
    seen = sightings.withWatermark("seen_at", late).withColumn("w", F.window("seen_at", window)).select("w", "coord_id", "npi")
    once = seen.where("npi is not null").dropDuplicates(["w", "coord_id", "npi"])
    return once.groupBy("w", "coord_id").agg(F.count("*").alias("supply")).select(F.col("w.start").alias("window_start"), "coord_id", "supply")
