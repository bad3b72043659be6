"""Column expressions for codes, keys, dates and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reachwell.constants import CONUS_LAT, CONUS_LON, EARLY_CAREER_YEARS, EARTH_KM, SURFACE_KM

#: Words that mean yes (fixed values).
TRUE_WORDS = ("1", "true", "t", "yes", "y", "primary", "rural")


def rurality(code: Column) -> Column:
    """Metropolitan for codes 1 to 3, Rural for 4 to 10, else null; the code may be a string."""
    c = code.cast("string").try_cast("double")
    return F.when((c >= 1) & (c <= 3), "Metropolitan").when((c >= 4) & (c <= 10), "Rural")


def ruca_level(code: Column) -> Column:
    """Four levels: up to 3, up to 6, up to 9, above."""
    c = code.cast("string").try_cast("double")
    return F.when(c <= 3, "Metropolitan").when(c <= 6, "Micropolitan").when(c <= 9, "Small town").when(c.isNotNull(), "Rural")


def tract_vintage(year: Column) -> Column:
    return F.when(year <= 2019, 2010).when(year.isNotNull(), 2020)


def survey_year(year: Column, first: int = 2013, last: int = 2022) -> Column:
    """The year, clamped to those that have been published."""
    return F.when(year.isNotNull(), F.greatest(F.lit(first), F.least(F.lit(last), year)))


def career_stage(years: Column, cutoff: int = EARLY_CAREER_YEARS) -> Column:
    return F.when(years <= cutoff, "Early-to-mid").when(years.isNotNull(), "Late")


def within_surface(km: Column, radius: float = SURFACE_KM) -> Column:
    return F.coalesce(km <= radius, F.lit(False))


def parse_coord(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a ``lat_lon`` key; null if it is malformed."""
    parts = F.split(key, "_")
    two = F.size(parts) == 2
    return tuple(F.when(two, F.get(parts, i).try_cast("double")) for i in (0, 1))


def in_conus(lat: Column, lon: Column) -> Column:
    return F.coalesce((lon > CONUS_LON[0]) & (lon < CONUS_LON[1]) & (lat > CONUS_LAT[0]) & (lat < CONUS_LAT[1]), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def zip5(text: Column) -> Column:
    """The first five digits, or null if there is none."""
    return F.nullif(F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, 5), F.lit(""))


def address_part(text: Column) -> Column:
    upper = F.replace(F.upper(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" AND "))
    return F.regexp_replace(upper, "[^A-Z0-9]", "")


def address_key(address1: Column, address2: Column, city: Column, state: Column, zipcode: Column) -> Column:
    """Address parts in a form that spelling doesn't change; a missing zip is spelled NA."""
    return F.concat_ws("|", *[address_part(x) for x in (address1, address2, city, state)], F.coalesce(zip5(zipcode), F.lit("NA")))


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def parse_date(text: Column) -> Column:
    """A date in one of three spellings; null if it is none."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")])
