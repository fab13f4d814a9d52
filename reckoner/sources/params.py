"""Named queries, their parameters and the predicates made from them."""

from __future__ import annotations

import datetime as dt
import re

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|::|:([A-Za-z_][A-Za-z0-9_]*)")


def pick_query(conf: dict, name: str | None = None) -> dict:
    """conf with the fields of one of its "queries" laid over it; an unknown or blank name leaves the fields as they are, and without a name the first query is taken."""
    variants = conf.get("queries") or []
    base = {k: v for k, v in conf.items() if k != "queries"}
    if not variants:
        return base
    chosen = variants[0] if name is None else next((q for q in variants if q.get("name") == name), None)
    return base | {k: v for k, v in chosen.items() if k != "name"} if chosen else base


def placeholders(sql: str) -> list[str]:
    """Names of the `:name` placeholders outside quotes, comments and casts, in order."""
    return list(dict.fromkeys(m[1] for m in _NAME.finditer(sql) if m[1]))


def typed(value):
    """Text as a whole number, a decimal, a date or an instant if it reads as one; other values as they are."""
    if not isinstance(value, str):
        return value
    if re.fullmatch(r"[+-]?\d{1,18}", value):
        return int(value)
    if re.fullmatch(r"[+-]?\d+\.\d+", value):
        return float(value)
    for parse in (dt.date.fromisoformat, lambda x: dt.datetime.fromisoformat(x.replace("Z", "+00:00"))):
        try:
            return parse(value)
        except ValueError:
            pass
    return value


def bind_sql(sql: str, supplied: dict) -> tuple[str, dict]:
    """SQL text and its arguments for spark.sql: lists in `IN (:x)` become one placeholder each. Missing and blank values and empty lists are refused, by name."""
    names = placeholders(sql)
    missing = [n for n in names if supplied.get(n) is None or supplied[n] == "" or supplied[n] == []]
    if missing:
        raise ValueError("no value for " + ", ".join(missing))
    args: dict = {}

    def put(m: re.Match) -> str:
        if not m[1]:
            return m[0]
        value = supplied[m[1]]
        if isinstance(value, (list, tuple)):
            args.update({f"{m[1]}_{k}": typed(x) for k, x in enumerate(value)})
            return ", ".join(f":{m[1]}_{k}" for k in range(len(value)))
        args[m[1]] = typed(value)
        return m[0]

    return _NAME.sub(put, sql), args


def run_sql(spark: SparkSession, sql: str, supplied: dict, row_limit: int | None = None, **frames: DataFrame) -> DataFrame:
    """A user's SQL text over frames (by `{name}`) with named parameters, and at most row_limit rows if the source sets one."""
    text, args = bind_sql(sql, supplied)
    out = spark.sql(text, args=args, **frames)
    return out.limit(row_limit) if row_limit else out


def in_list(df: DataFrame, column: str, values: list, literal: int = 1000) -> DataFrame:
    """Rows whose column is in values: an IN list, or for long lists a semi join."""
    if not values:
        raise ValueError(f"an empty list for {column} would match nothing")
    if len(values) <= literal:
        return df.where(F.col(column).isin(*values))
    return df.join(df.sparkSession.createDataFrame([(v,) for v in set(values)], f"`{column}` {dict(df.dtypes)[column]}"), column, "left_semi")


def substituted(doc, supplied: dict):
    """doc with each string `:name`, at any depth, replaced by its value."""
    if isinstance(doc, dict):
        return {k: substituted(v, supplied) for k, v in doc.items()}
    if isinstance(doc, list):
        return [substituted(v, supplied) for v in doc]
    if isinstance(doc, str) and re.fullmatch(r":[A-Za-z_]\w*", doc):
        if supplied.get(doc[1:]) in (None, "", []):
            raise ValueError(f"no value for {doc[1:]}")
        value = supplied[doc[1:]]
        return [typed(v) for v in value] if isinstance(value, list) else typed(value)
    return doc


def filter_column(doc: dict, supplied: dict | None = None) -> Column:
    """A JSON filter as a predicate: equality, $eq $ne $gt $gte $lt $lte $in $nin $exists, and $and $or $not."""
    compare = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c.isNull() | (c != v), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
        "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: c.isNull() | ~c.isin(*v), "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    }

    def one(d: dict) -> Column:
        parts = []
        for k, v in d.items():
            if k in ("$and", "$or"):
                parts.append(reduce(lambda a, b: a & b if k == "$and" else a | b, map(one, v)))  # noqa: B023
            elif k == "$not":
                parts.append(~F.coalesce(one(v), F.lit(False)))
            elif isinstance(v, dict):
                unknown = [op for op in v if op not in compare]
                if unknown:
                    raise ValueError(f"no filter operator {unknown[0]}")
                parts += [compare[op](F.col(k), x) for op, x in v.items()]
            else:
                parts.append(F.col(k) == v if v is not None else F.col(k).isNull())
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    return one(substituted(doc, supplied or {}))


def period(at: Column, zone: str, unit: str, back: int = 0, length: int = 1) -> tuple[Column, Column]:
    """Start and end of a calendar period in a zone, `back` whole units before the one that holds the instant: days keep their length in the calendar across clock changes; weeks begin on Monday."""
    local = F.date_trunc(unit, F.from_utc_timestamp(at, zone))
    step = {"minute": "mins", "hour": "hours", "day": "days", "week": "weeks", "month": "months", "year": "years"}[unit.lower()]
    moved = lambda n: F.to_utc_timestamp(local + F.make_interval(**{step: F.lit(n)}), zone)
    return moved(-back), moved(length - back)


def day_of_week(at: Column, zone: str) -> Column:
    """1 (Monday) to 7 in a zone."""
    return F.weekday(F.from_utc_timestamp(at, zone)) + 1


def offset_text(at: Column, zone: str) -> Column:
    """An instant (of a session in UTC) as ISO text with the zone's offset at that time."""
    local = F.from_utc_timestamp(at, zone)
    ahead = F.floor((F.unix_seconds(local) - F.unix_seconds(at)) / 60)
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    offset = F.when(ahead == 0, "Z").otherwise(F.concat(F.when(ahead < 0, "-").otherwise("+"), two(F.abs(ahead) / 60), F.lit(":"), two(F.abs(ahead) % 60)))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def window_values(at: Column, zone: str, named: dict[str, tuple[str, int]]) -> dict[str, Column]:
    """Named values of a schedule's window at the instant it fires, as offset text: each the start of the unit that lies so many units back (0: the one under way)."""
    return {name: offset_text(period(at, zone, unit, back)[0], zone) for name, (unit, back) in named.items()}
