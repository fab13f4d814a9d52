"""Values between systems: what columns of databases and documents become as records, and what texts become when written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marker of a document's id as text, and from what length on a text can be a date or an instant.
ID_MARK = "oid:"
DATE_LEAST, INSTANT_LEAST = 8, 20

_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?$"


def instant_text(c: Column, zoned: bool = True) -> Column:
    """A time as an ISO instant in UTC, with as many groups of three decimals as it needs."""
    clock = F.to_utc_timestamp(c, F.current_timezone()) if zoned else c
    micros = F.date_format(clock, "SSSSSS")
    decimals = F.when(micros == "000000", "").when(F.endswith(micros, F.lit("000")), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss"), decimals, F.lit("Z"))


def record_value(c: Column, kind: T.DataType, text_may_be_json: bool = False) -> Column:
    """A database's value as a record holds it: whole numbers long, decimals exact, floats double, dates and instants ISO text, bytes base64; nested values stay. Text that is declared as JSON becomes a variant: parsed where it is an object or array, and text elsewhere."""
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return instant_text(c, isinstance(kind, T.TimestampType))
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.StringType) and text_may_be_json:
        nested = F.ltrim(c).rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull()
        listed = F.to_json(F.array(c))
        return F.when(nested, F.try_parse_json(c)).when(c.isNotNull(), F.parse_json(F.substring(listed, F.lit(2), F.length(listed) - 2)))
    return c


def records(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """df as records: each column by record_value()."""
    return df.select(*(record_value(F.col(f.name), f.dataType, f.name in json_columns).alias(f.name) for f in df.schema.fields))


def document_value(c: Column) -> Column:
    """A record's text as a document stores it: one of object_id (marked and 24 hexadecimal digits), at (an ISO instant that ends in Z, of INSTANT_LEAST characters or more) and text (anything else; a marked text that is no id loses its mark)."""
    rest = F.substring(c, len(ID_MARK) + 1, 1 << 30)
    marked = F.startswith(c, F.lit(ID_MARK))
    is_id = marked & rest.rlike("^[0-9a-fA-F]{24}$")
    at = F.when(~marked & (F.length(c) >= INSTANT_LEAST) & c.rlike(_INSTANT), c.try_cast("timestamp"))
    text = F.when(marked & ~is_id, rest).when(~marked & at.isNull(), c)
    return F.struct(F.when(is_id, rest).alias("object_id"), at.alias("at"), text.alias("text"))


def _is_id(kind: T.DataType) -> bool:
    """Whether a column holds ids of documents: a struct of their hexadecimal digits, as document stores' readers give it."""
    return isinstance(kind, T.StructType) and kind.names in (["oid"], ["$oid"], ["object_id"])


def from_document(c: Column, kind: T.DataType) -> Column:
    """A document's value as a record holds it: ids as marked text, which document_value() turns back; decimals exact, dates and times ISO text, bytes base64, numbers and flags with the width that they have, and all that inside nested documents, lists and maps."""
    if _is_id(kind):
        return F.when(c.isNotNull(), F.concat(F.lit(ID_MARK), F.lower(c.getField(kind.names[0]))))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(from_document(c.getField(f"{f.name}"), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: from_document(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: from_document(v, kind.valueType))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return record_value(c, kind)
    return c.cast("string")


def document_records(df: DataFrame) -> DataFrame:
    """Documents as records: each column by from_document()."""
    return df.select(*(from_document(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def bound_text(c: Column) -> Column:
    """A record's text as it is bound to a statement: one of day (an ISO date), at (an ISO time, in UTC without an offset) and text."""
    long_enough = F.length(c) >= DATE_LEAST
    day = F.when(long_enough & c.rlike(_DATE), c.try_cast("date"))
    full = F.regexp_replace(c, r"(T\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    at = F.when(long_enough & c.rlike(_TIME), F.when(full.rlike(r"(Z|[+-]\d{2}:\d{2})$"), full).otherwise(F.concat(full, F.lit("Z"))).try_cast("timestamp"))
    return F.struct(day.alias("day"), at.alias("at"), F.when(day.isNull() & at.isNull(), c).alias("text"))


# RFC 8288: a link is an address in angle brackets and parameters, whose values are tokens or quoted strings.
_TOKEN, _QUOTED = r"[^\s;,=\x22<>]+", r"\x22(?:[^\x22\\]|\\.)*\x22"
_LINK = rf"<[^>]*>(?:\s*;\s*{_TOKEN}(?:\s*=\s*(?:{_QUOTED}|{_TOKEN}))?)*"
_NEXT = rf"(?i)(?:^|;)\s*rel\s*=\s*(?:\x22(?:[^\x22]*\s)?next(?:\s[^\x22]*)?\x22|next\s*(?:;|$))"


def next_link(header: Column) -> Column:
    """The address of the first link of a Link header whose relations include `next`, or null: addresses may hold commas and semicolons, values may stand without quotes, and the first rel of a link counts."""
    links = F.regexp_extract_all(header, F.lit(_LINK), F.lit(0))

    def wanted(link: Column) -> Column:
        first = F.regexp_extract(F.regexp_replace(link, "^<[^>]*>", ""), rf"(?i)(;\s*rel\s*=\s*(?:{_QUOTED}|{_TOKEN}))", 1)
        return first.rlike(_NEXT)

    return F.regexp_extract(F.get(F.filter(links, wanted), F.lit(0)), "^<([^>]*)>", 1)


def page_numbers(df: DataFrame, total: str, size: int, kind: str) -> DataFrame:
    """df (a row for each source, with its total of records) with the requests that read it: page from 0 and at: the page's number from 1 (PAGE), the records before it (OFFSET), or nothing, in one request (NONE)."""
    kind = kind.upper()
    if kind not in ("PAGE", "OFFSET", "NONE"):
        raise ValueError(f"no numbering {kind!r} without a cursor")
    last = F.greatest(F.ceil(F.col(total) / size) - 1, F.lit(0)) if kind != "NONE" else F.lit(0).cast("long")
    out = df.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.withColumn("at", F.col("page") + 1 if kind == "PAGE" else F.col("page") * size if kind == "OFFSET" else F.lit(None).cast("long"))
