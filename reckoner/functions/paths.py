"""Dotted paths into columns: reads that never fail, writes that build objects, and JSON pointers for redaction."""

from __future__ import annotations

import hashlib
import json
from json.decoder import scanstring

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_decoder = json.JSONDecoder()
#: Of values as JSON: times keep their microseconds, and null fields stay fields.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def read(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The value at a dotted path and its type; below text it is read as JSON; what the schema doesn't have is null."""
    kind: T.DataType = df.schema
    found: Column | None = None
    steps = path.split(".")
    for k, step in enumerate(steps):
        if isinstance(kind, T.StructType) and step in kind.names:
            found = F.col(f"`{step}`") if found is None else found.getField(step)
            kind = kind[step].dataType
        elif isinstance(kind, T.MapType):
            found, kind = F.try_element_at(found, F.lit(step)), kind.valueType
        elif isinstance(kind, T.StringType):
            return F.get_json_object(found, "$" + "".join(f"['{x}']" for x in steps[k:])), T.StringType()
        else:
            return F.lit(None).cast("string"), T.StringType()
    return found, kind


def build(values: dict[str, Column], over: DataFrame | None = None) -> list[Column]:
    """Columns for dotted targets: `a.b` becomes the field b of a struct a, or is laid over the struct a that `over` has; a target that is a value and a parent is a parent."""
    tree: dict = {}
    for path, value in values.items():
        at = tree
        *parents, leaf = path.split(".")
        for p in parents:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        if not isinstance(at.get(leaf), dict):
            at[leaf] = value

    def column(x, found: Column | None, kind: T.DataType | None) -> Column:
        if not isinstance(x, dict):
            return x
        if not isinstance(kind, T.StructType):
            return F.struct(*(column(v, None, None).alias(k) for k, v in x.items()))
        whole = F.coalesce(found, F.from_json(F.lit("{}"), kind))  # fields go into a missing object too
        for k, v in x.items():
            has = k in kind.names
            whole = whole.withField(f"`{k}`", column(v, whole.getField(k) if has else None, kind[k].dataType if has else None))
        return whole

    there = {} if over is None else {f.name: f.dataType for f in over.schema}
    return [column(v, F.col(f"`{k}`") if k in there else None, there.get(k)).alias(k) for k, v in tree.items()]


MODES = ("MASK", "HASH", "DROP")


def _member(text: str, at: int, step: str) -> tuple[int, int, int] | None:
    """Where the member or element `step` of the object or array at text[at] begins (its name included), where its value begins and where it ends."""
    mark, number = text[at], 0
    if mark not in "{[":
        return None
    at = _blank(text, at + 1)
    while text[at] not in "}]":
        begin = at
        if mark == "{":
            name, at = scanstring(text, at + 1)
            at = _blank(text, _blank(text, at) + 1)
        else:
            name, number = str(number), number + 1
        _, end = _decoder.raw_decode(text, at)
        if name == step:
            return begin, at, end
        at = _blank(text, end)
        if text[at] == ",":
            at = _blank(text, at + 1)
    return None


def _blank(text: str, at: int) -> int:
    while text[at] in " \t\n\r":
        at += 1
    return at


def redact_text(text: str | None, steps: list[str], mode: str, inside: bool = False) -> str | None:
    """JSON text with the member at steps masked, hashed or removed, and everything else as it was; text that isn't JSON, or has no such member of an object, stays. Of members of one name the first counts. inside: steps go on in texts that are JSON themselves."""
    if text is None:
        return None
    try:
        json.loads(text)
        at = _blank(text, 0)
        for k, step in enumerate(steps[:-1]):
            found = _member(text, at, step)
            if not found:
                return text
            at = found[1]
            if inside and text[at] == '"':
                own = redact_text(json.loads(text[at : found[2]]), steps[k + 1 :], mode, inside)
                return text[:at] + json.dumps(own, ensure_ascii=False) + text[found[2] :]
        found = _member(text, at, steps[-1]) if text[at] == "{" else None
    except (ValueError, IndexError):
        return text
    if not found:
        return text
    begin, value, end = found
    if mode == "DROP":
        after = _blank(text, end)
        if text[after] == ",":
            return text[:begin] + text[_blank(text, after + 1) :]
        before = text[:begin].rstrip(" \t\n\r")
        return (before[:-1] if before.endswith(",") else before) + text[end:]
    own = json.loads(text[value:end])
    if own is None:
        return text
    shown = own if isinstance(own, str) else text[value:end]
    put = "***" if mode == "MASK" else "sha256:" + hashlib.sha256(shown.encode()).hexdigest()[:16]
    return text[:value] + json.dumps(put) + text[end:]


def _shown(value: Column, mode: str) -> Column:
    text = value.cast("string")
    return F.when(value.isNotNull(), F.lit("***") if mode == "MASK" else F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16)))


def _enters_text(kind: T.DataType, steps: list[str]) -> bool:
    """Whether steps lead into JSON text or a variant."""
    if isinstance(kind, (T.StringType, T.VariantType)):
        return bool(steps)
    if not steps:
        return False
    if isinstance(kind, T.StructType):
        return steps[0] in kind.names and _enters_text(kind[steps[0]].dataType, steps[1:])
    return isinstance(kind, (T.MapType, T.ArrayType)) and _enters_text(kind.valueType if isinstance(kind, T.MapType) else kind.elementType, steps[1:])


def _redacted(value: Column, kind: T.DataType, steps: list[str], mode: str) -> tuple[Column, T.DataType]:
    """value with what steps lead to masked, and its type afterwards."""
    step, *rest = steps
    if isinstance(kind, (T.MapType, T.ArrayType)) and _enters_text(kind, steps):  # Python functions don't go inside Spark's functions on elements
        done = F.pandas_udf(lambda texts: texts.map(lambda t: redact_text(t, steps, mode, inside=True)), "string")
        return F.from_json(done(F.to_json(value, EXACT)), kind, EXACT), kind
    if isinstance(kind, T.StringType):
        done = F.pandas_udf(lambda texts: texts.map(lambda t: redact_text(t, steps, mode)), "string")
        return done(value), kind
    if isinstance(kind, T.VariantType):
        done = F.pandas_udf(lambda texts: texts.map(lambda t: redact_text(t, steps, mode)), "string")
        return F.parse_json(done(F.to_json(value))), kind
    if isinstance(kind, T.StructType) and step in kind.names:
        own = value.getField(step)
        if not rest and mode == "DROP":
            left = [f for f in kind.fields if f.name != step]
            if left:
                return value.dropFields(f"`{step}`"), T.StructType(left)
            return F.when(value.isNotNull(), F.lit("{}")), T.StringType()  # a struct has a field at least
        new, sort = (_shown(own, mode), T.StringType()) if not rest else _redacted(own, kind[step].dataType, rest, mode)
        fields = [T.StructField(f.name, sort, f.nullable) if f.name == step else f for f in kind.fields]
        return value.withField(f"`{step}`", new), T.StructType(fields)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if not rest and mode == "DROP":
            return F.map_filter(value, lambda k, _: k != step), kind
        if not rest:
            return F.transform_values(value, lambda k, v: F.when(k == step, _shown(v, mode)).otherwise(v.cast("string"))), T.MapType(kind.keyType, T.StringType())
        sort = _redacted(F.lit(None).cast(kind.valueType), kind.valueType, rest, mode)[1]
        return F.transform_values(value, lambda k, v: F.when(k == step, _redacted(v, kind.valueType, rest, mode)[0]).otherwise(v.cast(sort))), T.MapType(kind.keyType, sort)
    if isinstance(kind, T.ArrayType) and step.isdigit() and rest:
        # elements have one type: a field that is masked in one is text in all, and one that is dropped is null
        sort = _redacted(F.lit(None).cast(kind.elementType), kind.elementType, rest, "MASK")[1]

        def element(x: Column, at: Column) -> Column:
            if mode != "DROP":
                return F.when(at == int(step), _redacted(x, kind.elementType, rest, mode)[0]).otherwise(x.cast(sort))
            return F.when(at == int(step), _nulled(x, kind.elementType, rest)).otherwise(x)

        return F.transform(value, element), T.ArrayType(kind.elementType if mode == "DROP" else sort)
    return value, kind


def _nulled(value: Column, kind: T.DataType, steps: list[str]) -> Column:
    """value with null in place of the field at steps; JSON text loses the member."""
    step, *rest = steps
    if isinstance(kind, T.StructType) and step in kind.names:
        own = kind[step].dataType
        return value.withField(f"`{step}`", _nulled(value.getField(step), own, rest) if rest else F.lit(None).cast(own))
    if isinstance(kind, (T.StringType, T.VariantType)):
        return _redacted(value, kind, steps, "DROP")[0]
    return value


def redact(df: DataFrame, pointers: dict[str, str]) -> DataFrame:
    """df with the fields at JSON pointers masked: MASK gives `***`, HASH `sha256:` and 16 hex digits, DROP removes; null stays null. The first step is a column; pointers go on through structs, maps, elements of arrays, variants and JSON text, and one that leads nowhere, or to an element of an array itself, changes nothing. In text and variants the rest of the value stays as it is."""
    for pointer, mode in pointers.items():
        if mode.upper() not in MODES:
            raise ValueError(f"no redaction mode {mode!r}")
        top, *rest = (x.replace("~1", "/").replace("~0", "~") for x in pointer.strip("/").split("/"))
        if top not in df.columns:
            continue
        value = F.col(f"`{top}`")
        if not rest:
            df = df.drop(top) if mode.upper() == "DROP" else df.withColumn(top, _shown(value, mode.upper()))
            continue
        df = df.withColumn(top, _redacted(value, df.schema[top].dataType, rest, mode.upper())[0])
    return df


def leaves(df: DataFrame, column: str, keep: list[str], most: int = 100) -> DataFrame:
    """keep, path and value (text) of all scalar leaves of a column of JSON text or variants, by exploding one level after another: path is a JSON pointer; nulls have a null value, empty objects and arrays no leaf, and text that isn't JSON is one leaf. Deeper than `most` levels is an error."""
    from reckoner.sources.scratch import folder

    spark = df.sparkSession
    value = F.col(column) if isinstance(df.schema[column].dataType, T.VariantType) else F.coalesce(F.try_parse_json(column), F.to_variant_object(F.array(column)))
    whole = F.lit(False) if isinstance(df.schema[column].dataType, T.VariantType) else F.try_parse_json(column).isNull()
    level = df.where(F.col(column).isNotNull()).select(*keep, F.lit("").alias("path"), value.alias("_v"), whole.alias("_plain"))
    out = None
    for _ in range(most):
        held = folder(spark, "leaves")
        kind = F.schema_of_variant("_v")
        level.withColumn("_kind", F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").otherwise("LEAF")).write.parquet(held)
        level = spark.read.parquet(held)
        own = level.where("_kind = 'LEAF'").select(*keep, "path", F.try_variant_get("_v", "$", "string").alias("value"))
        out = own if out is None else out.unionByName(own)
        deeper = level.where("_kind <> 'LEAF'")
        if deeper.isEmpty():
            return out
        view = deeper.select(*keep, "path", "_v", "_plain")
        exploded = view.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        name = F.when(F.col("_plain"), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))))
        level = exploded.select(*keep, F.concat("path", name).alias("path"), F.col("value").alias("_v"), F.lit(False).alias("_plain"))
    raise ValueError(f"{column} has more than {most} levels")


def ceiling(payload: Column, key: Column, most: int) -> Column:
    """payload (JSON text), or a marker with its size and key where it has more than `most` bytes; 0: no limit."""
    size = F.octet_length(payload)
    marker = F.to_json(F.struct(F.lit(True).alias("_truncated"), size.alias("_bytes"), key.alias("_id")))
    return F.when(F.lit(most > 0) & (size > most), marker).otherwise(payload)
