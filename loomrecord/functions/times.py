"""Timestamps of mixed notation as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J

MAX_DATE_MS = 8_640_000_000_000_000
MAX_SAFE = 9_007_199_254_740_991
ISO_8601 = (
    r"^[+-]?\d{4,6}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?$"
)
RFC_3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _valid(ms: Column) -> Column:
    return F.when(F.abs(ms) <= MAX_DATE_MS, ms)


def iso_to_ms(text: Column) -> Column:
    """ISO 8601 / RFC 3339 text to epoch milliseconds (double), else NULL."""
    padded = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    ts = F.try_to_timestamp(padded)
    return F.when(text.rlike(ISO_8601), F.floor(F.unix_micros(ts) / 1000).cast("double"))


def _scaled(number: Column, unit: str) -> Column:
    if unit == "auto":
        size = F.abs(number)
        return (
            F.when(size >= 1e17, number / 1e6).when(size >= 1e14, number / 1e3)
            .when(size >= 1e11, number).otherwise(number * 1e3)
        )
    return {"s": number * 1e3, "ms": number, "us": number / 1e3, "ns": number / 1e6}[unit]


def _scaled_integer(number: Column, unit: str) -> Column:
    """Digit strings divide as whole numbers, truncating towards zero."""
    def div(n: int) -> Column:
        q = F.floor(F.abs(number) / F.lit(n).cast("decimal(38,0)"))
        return F.when(number < 0, -q).otherwise(q)
    if unit == "auto":
        size = F.abs(number)
        out = (
            F.when(size >= F.lit(10**17).cast("decimal(38,0)"), div(10**6))
            .when(size >= F.lit(10**14).cast("decimal(38,0)"), div(10**3))
            .when(size >= F.lit(10**11).cast("decimal(38,0)"), number)
            .otherwise(number * 1000)
        )
    else:
        out = {"s": number * 1000, "ms": number, "us": div(10**3), "ns": div(10**6)}[unit]
    return out.cast("double")


def text_to_ms(text: Column, unit: str = "auto") -> Column:
    """J12 for text: digit strings by magnitude (or a fixed unit), otherwise ISO."""
    if unit == "iso":
        return J.let(F.trim(text), lambda t: _valid(iso_to_ms(t)))

    def convert(body: Column) -> Column:
        whole = J.let(body.try_cast("decimal(38,0)"), lambda n: _scaled_integer(n, unit))
        out = F.when(body.rlike(r"^-?\d{1,35}$"), whole).when(
            body.rlike(r"^-?\d+\.\d+$"), J.let(body.try_cast("double"), lambda n: _scaled(n, unit))
        )
        return out.otherwise(iso_to_ms(body)) if unit == "auto" else out

    return J.let(J.let(F.trim(text), convert), _valid)


def number_to_ms(number: Column, unit: str = "auto") -> Column:
    """J12 for numbers: whole numbers beyond the safe range are unknown."""
    def convert(n: Column) -> Column:
        unsafe = (n % 1 == 0) & (F.abs(n) > MAX_SAFE)
        return F.when(~unsafe & ~F.isnan(n), _scaled(n, unit))

    return J.let(J.let(number, convert), _valid)


def to_epoch_ms(value: Column, unit: str = "auto") -> Column:
    """Variant timestamp to epoch milliseconds; NULL means unknown."""
    def convert(v: Column) -> Column:
        out = F.when(J.is_string(v), text_to_ms(J.as_string(v), unit))
        return out if unit == "iso" else out.when(J.is_numeric(v), number_to_ms(J.as_double(v), unit))

    return J.let(value, convert)


def metadata_time(value: Column) -> Column:
    """Numbers below 1e12 are seconds, others milliseconds; text is ISO. Result in ms."""
    n = J.number_at(value)
    return F.when(n.isNotNull(), F.when(n < 1e12, n * 1000).otherwise(n)).otherwise(iso_to_ms(J.string_at(value)))


def is_rfc3339(text: Column) -> Column:
    """Strict calendar check of an RFC 3339 date-time."""
    day_ok = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    clock = (
        (F.substring(text, 12, 2).try_cast("int") < 24)
        & (F.substring(text, 15, 2).try_cast("int") < 60)
        & (F.substring(text, 18, 2).try_cast("int") < 60)
    )
    offset = F.regexp_extract(text, r"[+-](\d{2}):(\d{2})$", 1)
    minutes = F.regexp_extract(text, r"[+-](\d{2}):(\d{2})$", 2)
    offset_ok = (offset == "") | ((offset.try_cast("int") < 24) & (minutes.try_cast("int") < 60))
    return F.coalesce(text.rlike(RFC_3339) & day_ok & clock & offset_ok, F.lit(False))


def unix_seconds(value: Column) -> Column:
    """Timestamp from non-negative whole seconds, else NULL."""
    n = J.number_at(value)
    ok = (n >= 0) & (n % 1 == 0) & (n <= MAX_DATE_MS / 1000)
    return F.when(ok, F.timestamp_seconds(n.cast("bigint")))


def ms_text(ms: Column) -> Column:
    """Epoch milliseconds as ISO text with a Z suffix."""
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket_start(ms: Column, width_ms: int) -> Column:
    """Start of the half-open bucket that holds a time, also before the epoch."""
    return (F.floor(ms / F.lit(width_ms)) * F.lit(width_ms)).cast("bigint")
