"""Timestamps, privacy, distance, entropy and rounding as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# White space and digits are spelled out: dates with or without hyphens, hours, minutes and seconds with or without colons.
_FORMS = "^([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2}))(?:[^0-9]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+|(?=[Z+-])))?)?)?)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of `values`, each of which is worked out once a row however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


def to_instant(s: Column) -> Column:
    """Timestamp of 'Y-m-d H:M:S' (UTC) or an ISO form: extended or basic, of a date alone or to the hour, minute, second or
    fraction (cut to microseconds), with Z, an offset or none; a form without zone is UTC; else null. Week dates are not read."""
    part = lambda i: F.regexp_extract(s, _FORMS, i)
    two = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("00"))
    zone = F.regexp_replace(part(10), ":", "")
    offset = F.when(F.length(zone) < 3, "Z").otherwise(F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.rpad(F.substring(zone, 4, 2), 2, "0")))
    day = F.concat_ws("-", part(1), F.concat(part(2), part(4)), F.concat(part(3), part(5)))
    whole = F.concat(day, F.lit("T"), two(6), F.lit(":"), two(7), F.lit(":"), two(8), F.lit("."), F.rpad(F.left(part(9), F.lit(6)), 6, "0"), offset)
    return F.when(s.rlike(_ISO), s.try_cast("timestamp")).when(s.rlike(_FORMS), whole.try_cast("timestamp"))


def iso_second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalize_timestamp(s: Column) -> Column:
    return iso_second(to_instant(s))


def pseudonymize(value: Column, salt: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.sha2(F.concat(value, F.lit(salt)), 256))


def laplace_noise(value: Column, sensitivity: float, epsilon: float, seed: int | None = None, clip: tuple[float, float] | None = None) -> Column:
    """value plus Laplace(0, sensitivity / epsilon); unchanged for epsilon <= 0."""
    if epsilon <= 0:
        return value
    u = F.rand(seed) - 0.5
    noisy = value - F.lit(sensitivity / epsilon) * F.signum(u) * F.log(F.greatest(F.lit(1e-300), 1 - 2 * F.abs(u)))
    return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), noisy)) if clip else noisy


def round_timestamp(ts: Column, minutes: int = 60) -> Column:
    """Minutes floored within the hour to a multiple of `minutes`."""
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=(F.floor(F.minute(ts) / minutes) * minutes).cast("int"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def entropy_bits(s: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty string. A character is counted by what taking it out leaves."""
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(s, "")), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def floor_div(a: Column, b: int) -> Column:
    """Floor of a / b for whole numbers, negative ones too."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def url_id(url: Column) -> Column:
    """Base64 for URLs, in one line: Spark breaks its own after 76 signs."""
    return F.rtrim(F.translate(F.base64(url.cast("binary")), "+/\r\n", "-_"), F.lit("="))
