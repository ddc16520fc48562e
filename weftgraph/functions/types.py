"""Types of the query language and their Spark counterparts, defaults and interval texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMED = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(),
    "INT32": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT64": T.LongType(), "LONG": T.LongType(), "SERIAL": T.LongType(),
    "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "VARCHAR": T.StringType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "INTERVAL": T.StringType(),
}


class TypeError_(ValueError):
    pass


def spark_type(name: str) -> T.DataType:
    """VARCHAR(n) is STRING; T[] is a list; DECIMAL(p,s) is taken over. Intervals are stored as their text."""
    name = name.strip().upper()
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    base, _, args = name.partition("(")
    if base == "DECIMAL":
        p, _, s = args.rstrip(")").partition(",")
        return T.DecimalType(int(p or 18), int(s or 3))
    if base not in _NAMED:
        raise TypeError_(f"unknown type {name}")
    return _NAMED[base]


def system_default(t: T.DataType) -> Column:
    """What a property holds that is not given: stored properties are never null."""
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.DateType):
        return F.lit("1970-01-01").cast("date")
    if isinstance(t, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    return F.lit(0).cast(t)


_UNITS = {"year": "years", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs", "millisecond": "ms", "microsecond": "us"}
_PART = re.compile(r"([+-]?\d+)\s*(years?|months?|weeks?|days?|hours?|minutes?|seconds?|milliseconds?|microseconds?|ms|us)", re.I)


def interval(text: str) -> Column:
    """An interval from text such as ``1 year 2 months`` or ``3days4hours``."""
    parts = {k: 0 for k in _UNITS.values()}
    rest = _PART.sub("", text).strip()
    found = _PART.findall(text)
    if rest or not found:
        raise TypeError_(f"no interval: {text!r}")
    for n, unit in found:
        unit = unit.lower()
        parts[unit if unit in ("ms", "us") else _UNITS[unit.removesuffix("s")]] += int(n)
    seconds = parts["secs"] + parts["ms"] / 1000 + parts["us"] / 1e6
    if not (parts["years"] or parts["months"]):
        return F.make_dt_interval(F.lit(7 * parts["weeks"] + parts["days"]), F.lit(parts["hours"]), F.lit(parts["mins"]), F.lit(seconds).cast("decimal(18,6)"))
    if not any(parts[k] for k in ("weeks", "days", "hours", "mins")) and not seconds:
        return F.make_ym_interval(F.lit(parts["years"]), F.lit(parts["months"]))
    return F.make_interval(F.lit(parts["years"]), F.lit(parts["months"]), F.lit(parts["weeks"]), F.lit(parts["days"]), F.lit(parts["hours"]), F.lit(parts["mins"]), F.lit(seconds).cast("decimal(18,6)"))


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0


def is_fractional(t: T.DataType) -> bool:
    return isinstance(t, T.FractionalType) and not is_integral(t)


def cast(value: Column, type_name: str, from_type: T.DataType) -> Column:
    """CAST by the language's rules; errors are raised, as in ANSI mode. Timestamps print as in ISO without zone."""
    name = type_name.upper()
    if name == "INTERVAL":
        return value.cast("interval")
    to = spark_type(name)
    if isinstance(from_type, T.StringType) and not isinstance(to, T.StringType):
        value = F.trim(value)
    if name in ("UINT32", "UINT8", "UINT16", "UINT64"):
        cast_ = value.cast(to)
        top = {"UINT8": 2**8, "UINT16": 2**16, "UINT32": 2**32, "UINT64": 2**64}[name]
        return F.when((cast_ < 0) | (cast_ >= F.lit(top).cast("decimal(20,0)")), F.raise_error(F.lit(f"out of range of {name}")).cast(to)).otherwise(cast_)
    return value.cast(to)
