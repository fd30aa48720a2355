"""Conversions and checks of values at the boundary, all inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a day, and one past the largest time of day in each unit.
DAY_MS = 86_400_000
TIME_LIMITS = {"s": 86_400, "ms": 86_400_000, "us": 86_400_000_000, "ns": 86_400_000_000_000}
INT_RANGES = {("int", 8): (-(1 << 7), (1 << 7) - 1), ("int", 16): (-(1 << 15), (1 << 15) - 1), ("uint", 8): (0, (1 << 8) - 1), ("uint", 16): (0, (1 << 16) - 1)}


def time_seconds_to_millis(seconds: Column) -> Column:
    return (seconds * 1000).cast("int")


def timestamp_seconds_to_millis(seconds: Column) -> Column:
    """Milliseconds; an overflow fails the job."""
    return F.when(timestamp_seconds_ok(seconds), seconds.cast("long") * F.lit(1000).cast("long")).otherwise(F.when(seconds.isNotNull(), F.raise_error(F.lit("timestamp overflows in milliseconds"))))


def timestamp_seconds_ok(seconds: Column) -> Column:
    most = (1 << 63) // 1000
    return seconds.isNull() | seconds.between(-most, most - (most * 1000 > (1 << 63) - 1))


def date64_ok(millis: Column) -> Column:
    """Exact days whose number fits 32 bits."""
    days = F.floor(millis / DAY_MS)
    return millis.isNull() | ((F.pmod(millis, F.lit(DAY_MS)) == 0) & days.between(-(1 << 31), (1 << 31) - 1))


def date64_to_day(millis: Column) -> Column:
    return F.date_from_unix_date(F.floor(millis / DAY_MS).cast("int"))


def time_ok(value: Column, unit: str) -> Column:
    return value.isNull() | ((value >= 0) & (value < F.lit(TIME_LIMITS[unit])))


def int_ok(value: Column, width: int, signed: bool) -> Column:
    low, high = INT_RANGES["int" if signed else "uint", width]
    return value.isNull() | value.between(low, high)


def narrow_int(value: Column, width: int, signed: bool) -> Column:
    """The value in the narrowest Spark type; one out of its annotation's range fails the job, as it would be cut silently."""
    kind = {(8, True): "tinyint", (16, True): "smallint", (8, False): "smallint", (16, False): "int"}[width, signed]
    return F.when(int_ok(value, width, signed), value).otherwise(F.raise_error(F.lit(f"a value is outside {width} bits"))).cast(kind)


def unsigned_widen(value: Column, width: int) -> Column:
    """Stored bits of an unsigned integer as a number: 8, 16, 32 bits as long, 64 bits as decimal(20,0)."""
    if width < 64:
        return value.cast("long").bitwiseAND(F.lit((1 << width) - 1))
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def utf8_ok(value: Column) -> Column:
    return value.isNull() | F.is_valid_utf8(value.cast("string"))


def fixed_binary_ok(value: Column, width: int) -> Column:
    return value.isNull() | (F.octet_length(value) == width)


def fixed_list_ok(value: Column, size: int) -> Column:
    return value.isNull() | (F.size(value) == size)


def required_ok(container: Column, child: Column) -> Column:
    """A required child may be missing only where its container is."""
    return container.isNull() | child.isNotNull()


def required_elements_ok(array: Column) -> Column:
    return array.isNull() | F.forall(array, lambda x: x.isNotNull())


def unique_keys(keys: Column) -> Column:
    return keys.isNull() | (F.size(keys) <= 1) | (F.size(keys) == F.size(F.array_distinct(keys)))


def map_ok(value: Column) -> Column:
    """Stored maps may hold repeated or null keys that Spark reads without complaint."""
    return value.isNull() | (unique_keys(F.map_keys(value)) & ~F.exists(F.map_keys(value), lambda k: k.isNull()))


def decimal_physical(precision: Column) -> Column:
    """The physical type for a decimal's precision, as a column."""
    size = F.ceil((precision * F.log2(F.lit(10.0)) + 1) / 8).cast("int")
    return F.when(precision <= 9, "INT32").when(precision <= 18, "INT64").otherwise(F.concat(F.lit("FIXED("), size.cast("string"), F.lit(")")))


def same_float(x: Column, y: Column) -> Column:
    """Any NaN equals any NaN; otherwise signs count, so -0.0 is not 0.0."""
    signed = x.isNull() | (x != 0) | (x.cast("string") == y.cast("string"))  # only zeros have a sign that equality passes over
    return x.eqNullSafe(y) & signed
