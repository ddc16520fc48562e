"""The scalar functions, as builders of Columns. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_fractional, is_integral

PARTS = ("year", "month", "day", "hour", "minute", "second", "millisecond")


def date_part(unit: str, value: Column) -> Column:
    unit = unit.lower().rstrip("s") if unit.lower().rstrip("s") in PARTS else unit.lower()
    if unit == "millisecond":
        return (F.extract(F.lit("second"), value) * 1000 % 1000).cast("long")
    if unit not in PARTS:
        raise ValueError(f"no date part {unit}")
    return F.extract(F.lit(unit), value).cast("long")


#: Names (with their aliases) of functions that are a Spark function of the same arguments.
PLAIN: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "negate": F.negative, "pow": F.pow, "power": F.pow,
    "lower": F.lower, "tolower": F.lower, "lcase": F.lower, "upper": F.upper, "toupper": F.upper, "ucase": F.upper,
    "contains": F.contains, "starts_with": F.startswith, "prefix": F.startswith, "ends_with": F.endswith, "suffix": F.endswith, "reverse": F.reverse,
    "list_contains": F.array_contains, "list_has": F.array_contains, "list_extract": lambda l, i: F.element_at(l, i + 1), "size": F.size,
    "to_date": F.to_date, "date": F.to_date, "timestamp": F.to_timestamp_ntz, "datetime": F.to_timestamp_ntz,
    # beyond the registered functions, as Spark has them
    "round": lambda x, n=None: F.round(x) if n is None else F.call_function("round", x, n.cast("int")), "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "exp": F.exp, "ln": F.log, "sign": F.signum,
    "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "concat": F.concat, "substring": lambda s, i, n: F.substring(s, i.cast("int"), n.cast("int")), "replace": F.replace,
    "coalesce": F.coalesce, "struct_extract": lambda s, k: s[k],
}


INTERVALS = (T.YearMonthIntervalType, T.DayTimeIntervalType, T.CalendarIntervalType)


def _mixed(ta: T.DataType, tb: T.DataType) -> bool:
    """Whether two intervals are not both of months, nor both of seconds."""
    return isinstance(ta, INTERVALS) and isinstance(tb, INTERVALS) and (type(ta) is not type(tb) or isinstance(ta, T.CalendarIntervalType))


def _months(c: Column) -> Column:
    return F.call_function("div", c, F.expr("INTERVAL '1' MONTH")).cast("int")


def _part(unit: str, c: Column) -> Column:
    return F.extract(F.lit(unit), c)


def calendar(c: Column, t: T.DataType) -> Column:
    """An interval of any kind as one of months, days and seconds."""
    if isinstance(t, T.YearMonthIntervalType):
        return F.make_interval(F.lit(0), _months(c))
    if isinstance(t, T.DayTimeIntervalType):
        return F.make_interval(F.lit(0), F.lit(0), F.lit(0), *[_part(u, c).cast("int") for u in ("day", "hour", "minute")], _part("second", c).cast("decimal(18,6)"))
    return c


def interval_order(c: Column, t: T.DataType) -> Column:
    """Seconds that an interval is compared and sorted by: a month counts 30 days."""
    if isinstance(t, T.YearMonthIntervalType):
        return (_months(c).cast("long") * 30 * 86400).cast("decimal(28,6)")
    days = _part("day", c).cast("long")
    if isinstance(t, T.CalendarIntervalType):
        days = days + 30 * (12 * _part("year", c).cast("long") + _part("month", c).cast("long"))
    return (86400 * days + 3600 * _part("hour", c).cast("long") + 60 * _part("minute", c).cast("long") + _part("second", c).cast("decimal(18,6)")).cast("decimal(28,6)")


def add(a: Column, b: Column, ta: T.DataType, tb: T.DataType, op: str) -> Column:
    """+ - * with the language's promotion: an integer with a FLOAT is a FLOAT; strings and lists are joined by +."""
    if op == "+" and (isinstance(ta, T.StringType) or isinstance(tb, T.StringType)):
        return F.concat(a, b)
    if op in ("+", "-") and _mixed(ta, tb):
        a, b = calendar(a, ta), calendar(b, tb)
    if op == "+" and isinstance(ta, T.ArrayType):
        return F.concat(a, b)
    if isinstance(ta, T.FloatType) and is_integral(tb) or isinstance(tb, T.FloatType) and is_integral(ta):
        a, b = a.cast("float"), b.cast("float")
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def comparable_intervals(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, Column]:
    return (interval_order(a, ta), interval_order(b, tb)) if _mixed(ta, tb) else (a, b)


def divide(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Integers divide to integers and fail on zero; floats divide as in IEEE 754."""
    if is_integral(ta) and is_integral(tb):
        quotient = F.call_function("div", a, b)
        return quotient if isinstance(ta, T.LongType) or isinstance(tb, T.LongType) else quotient.cast("int")
    if isinstance(ta, T.FloatType) and (isinstance(tb, T.FloatType) or is_integral(tb)) or isinstance(tb, T.FloatType) and is_integral(ta):
        a, b, kind = a.cast("float"), b.cast("float"), "float"
    else:
        a, b, kind = a.cast("double"), b.cast("double"), "double"
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, at_zero.cast(kind)).otherwise((a / b).cast(kind))


def modulo(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    if is_fractional(ta) or is_fractional(tb):
        return F.when(b == 0, F.lit(float("nan"))).otherwise(a % b)
    return a % b
