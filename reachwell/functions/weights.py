"""Distance-decay weights: validated on the driver, used as expressions of the band."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.constants import BAND_WEIGHTS, GAUSSIAN_SIGMA
from reachwell.guards import CatchmentError


def band_weights(weights: Mapping[int | str, float]) -> dict[int, float]:
    """The weights by band in ascending order; they must be non-negative and not rise with the band."""
    found = {}
    for band, w in weights.items():
        if w is None or math.isnan(w) or w < 0:
            raise CatchmentError(f"weight of band {band} must be a non-negative number")
        if not re.fullmatch(r"\d+", str(band)):
            raise CatchmentError(f"band {band!r} isn't a whole number of minutes")
        found[int(band)] = float(w)
    if not found:
        raise CatchmentError("no band weights")
    found = dict(sorted(found.items()))
    values = list(found.values())
    if any(b > a + 1e-9 for a, b in zip(values, values[1:], strict=False)):
        raise CatchmentError("band weights rise with travel time")
    return found


def incremental(weights: Mapping[int, float], power: float = 1.0) -> dict[int, float]:
    """``W_b^p - W_(b+1)^p``, the weight beyond the last band being 0."""
    weights = band_weights(weights)
    if power < 1:
        raise CatchmentError("the power must be at least 1")
    if power != 1 and max(weights.values()) > 1:
        raise CatchmentError("weights above 1 can't be raised to a power")
    raised = [w**power for w in weights.values()]
    steps = [a - b for a, b in zip(raised, [*raised[1:], 0.0], strict=True)]
    return {b: 0.0 if -1e-9 < s < 0 else s for b, s in zip(weights, steps, strict=True)}


def incremental_of_four(weights: Mapping[int, float]) -> dict[int, float]:
    """The increments of exactly four bands' weights."""
    if len(weights) != 4:
        raise CatchmentError(f"four bands are asked for, not {len(weights)}")
    return incremental(weights)


def gaussian(bands: Sequence[int], sigma: float = GAUSSIAN_SIGMA) -> dict[int, float]:
    """The Gaussian kernel at the bands' outer edges, relative to the first one's."""
    if sigma < 1e-9:
        raise CatchmentError("sigma must be positive")
    if any(b < 0 for b in bands):
        raise CatchmentError("minutes must not be negative")
    bands = sorted(bands)
    kernel = [math.exp(-(b * b) / (2 * sigma * sigma)) for b in bands]
    return {b: k / kernel[0] for b, k in zip(bands, kernel, strict=True)}


def gaussian_kernel(minutes: Column, sigma: float = GAUSSIAN_SIGMA) -> Column:
    return F.exp(-(minutes * minutes) / (2 * sigma * sigma))


def weight_of(band: Column, weights: Mapping[int, float]) -> Column:
    """The band's weight; null for a band outside the weights."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable((int(b), float(w)) for b, w in weights.items())])[band.cast("int")]


def parse_weights(text: str) -> dict[int, float]:
    """Of ``30=1,60=0.68``."""
    pairs = [p.split("=") for p in text.split(",") if p.strip()]
    return band_weights({int(b): float(w) for b, w in pairs})


def parse_years(text: str) -> list[int]:
    """Of ``2013:2023`` or ``2013,2015``."""
    if ":" in text:
        first, last = map(int, text.split(":"))
        return list(range(first, last + 1))
    return [int(y) for y in text.split(",")]


def variants() -> dict[str, dict]:
    """The sensitivity grid by name: weights, power and cell size in metres."""
    def one(weights: Mapping[int, float] = BAND_WEIGHTS, power: float = 1.0, resolution: int = 1000) -> dict:
        return {"weights": dict(weights), "power": power, "resolution": resolution}

    return {
        "base": one(),
        "sharper": one({30: 1.00, 60: 0.42, 120: 0.09, 180: 0.02}),
        "slower": one({30: 1.00, 60: 0.85, 120: 0.55, 180: 0.30}),
        "drop180": one({30: 1.00, 60: 0.68, 120: 0.22}),
        "res500": one(resolution=500),
        "gaussian": one(gaussian(list(BAND_WEIGHTS))),
        "m2sfca": one(power=2.0),
    }


def variant_table(spark: SparkSession, grid: Mapping[str, dict] | None = None) -> DataFrame:
    """The grid as rows: variant, band, w, step1, step2."""
    rows = []
    for name, v in (grid or variants()).items():
        first, second = incremental(v["weights"]), incremental(v["weights"], v["power"])
        rows += [(name, b, w, first[b], second[b]) for b, w in band_weights(v["weights"]).items()]
    return spark.createDataFrame(rows, "variant string, band int, w double, step1 double, step2 double")
