"""Scalar conversions with JavaScript's rules, as Columns: each gives a value, and where it can fail an error text (null if none)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that JavaScript's trim() strips.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def text(c: Column, kind: T.DataType) -> Column:
    """String(v): whole doubles without a fraction, instants in ISO form, objects as JSON."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, STAMP)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def plain(v) -> str | None:
    """String(v) of a value of a specification; None stays None."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e18 else str(v)


def _quoted(c: Column, rest: str) -> Column:
    return F.concat(F.lit('"'), c, F.lit(f'" {rest}'))


def number(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Number(v): blank text is 0, hexadecimal text counts, other text is an error."""
    none = F.lit(None).cast("string")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double"), none
    raw = text(c, kind)
    t = trim(raw)
    endless = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    value = F.when(t == "", F.lit(0.0)).when(t.rlike("^[+-]?Infinity$"), endless).when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double")).when(t.rlike(_DECIMAL), t.try_cast("double"))
    return value, F.when(c.isNotNull() & value.isNull(), _quoted(raw, "is not a number"))


def integer(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    value, error = number(c, kind)
    whole = value == F.floor(value)
    return F.when(whole, value.try_cast("bigint")), F.coalesce(error, F.when(~whole, _quoted(text(c, kind), "is not a whole number")))


def boolean(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    raw = text(c, kind)
    t = F.lower(raw)  # white space around the word makes it another word
    value = F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)
    return value, F.when(c.isNotNull() & value.isNull(), _quoted(raw, "is not true or false"))


def date(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """An instant in ISO form, in UTC with milliseconds; numbers are milliseconds since 1970."""
    if isinstance(kind, T.NumericType):
        moment = F.timestamp_millis(c.cast("bigint"))
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        moment = c.cast("timestamp")
    else:
        moment = F.try_to_timestamp(trim(c))
    return F.date_format(moment, STAMP), F.when(c.isNotNull() & moment.isNull(), _quoted(text(c, kind), "is not a date"))


CONVERSIONS = {"NUMBER": number, "INTEGER": integer, "BOOLEAN": boolean, "DATE": date}
