"""Declarative mapping and validation, compiled to Columns.

Each step yields data, never an exception: a record that can't be mapped keeps its row and says why in `_error`. Columns
whose names begin with an underscore are the record's envelope and pass through.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.functions import js, paths

STRING = T.StringType()
#: Lines of a lookup table that are broadcast: some MB of text.
SMALL_LOOKUP = 50_000


def _kind(df: DataFrame, c: Column) -> T.DataType:
    """The type of an expression over df; asked of an empty table of the same columns, since analysing a long plan again and again takes time."""
    if not hasattr(df, "_shape"):
        df._shape = df.sparkSession.createDataFrame([], df.schema)
    return df._shape.select(c.alias("c")).schema[0].dataType


def _blank(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def _value(df: DataFrame, m: dict) -> tuple[Column, T.DataType]:
    """Where a mapping's value comes from: fields joined, one field, or a constant; then the default."""
    source, default = m.get("from"), m.get("default")
    if isinstance(source, list) and source:
        parts = [js.text(*paths.read(df, p)) for p in source]
        value, kind = F.nullif(F.concat_ws(m.get("join", " "), *(F.nullif(p, F.lit("")) for p in parts)), F.lit("")), STRING
    elif isinstance(source, str) and source.strip():
        value, kind = paths.read(df, source.strip())
    elif default is not None:
        value = F.lit(default)
        return value, _kind(df, value)
    else:
        raise ValueError(f"the mapping to {m['to']!r} has neither a source nor a default")
    if default is not None:
        other = F.lit(default)
        if type(_kind(df, other)) is not type(kind) and not (isinstance(kind, T.NumericType) and isinstance(default, (int, float, Decimal))):
            value, kind, other = js.text(value, kind), STRING, js.text(other, _kind(df, other))
        value = F.when(_blank(value, kind), other).otherwise(value)
        kind = _kind(df, value)
    return value, kind


def _translated(value: Column, kind: T.DataType, m: dict) -> tuple[Column, T.DataType]:
    table = m["values"]
    if not table:
        raise ValueError(f"the translation of {m['to']!r} is empty")
    key = js.text(value, kind)
    other = F.lit(js.plain(m["otherwise"])).cast("string") if "otherwise" in m else key
    known = F.create_map(*(F.lit(js.plain(x)).cast("string") for pair in table.items() for x in pair))
    found = F.try_element_at(known, key)
    if all(js.plain(x) is not None for x in table.values()):
        return F.when(value.isNotNull(), F.coalesce(found, other)), STRING
    return F.when(value.isNotNull(), F.when(F.map_contains_key(known, key), found).otherwise(other)), STRING


def mapping_columns(df: DataFrame, m: dict) -> tuple[Column, Column]:
    """Value and error of one mapping. The order of steps is fixed: value, default, values, trim, case, prefix, suffix, replace, maxLength, required, type."""
    value, kind = _value(df, m)
    if "values" in m:
        value, kind = _translated(value, kind, m)
    edits = []
    if m.get("trim"):
        edits.append(js.trim)
    if m.get("case"):
        if m["case"].upper() not in ("UPPER", "LOWER"):
            raise ValueError(f"no case {m['case']!r}")
        edits.append(F.upper if m["case"].upper() == "UPPER" else F.lower)
    prefix, suffix = (m.get(k, "").strip() for k in ("prefix", "suffix"))
    if prefix or suffix:
        edits.append(lambda c: F.concat(F.lit(prefix), c, F.lit(suffix)))
    if "replace" in m:
        if not m["replace"].get("find"):
            raise ValueError(f"the replacement in {m['to']!r} has nothing to find")
        edits.append(lambda c: F.replace(c, F.lit(m["replace"]["find"]), F.lit(m["replace"].get("with", ""))))
    if "maxLength" in m:
        edits.append(lambda c: F.substring(c, 1, m["maxLength"]))
    if edits:
        value, kind = reduce(lambda c, f: f(c), edits, js.text(value, kind)), STRING
    error = F.lit(None).cast("string")
    if m.get("required"):
        origin = "joined fields" if isinstance(m.get("from"), list) else m.get("from")
        said = f"{m['to']} is required and had no value" + (f" (from {origin})" if origin and origin != m["to"] else "")
        error = F.when(_blank(value, kind), F.lit(said))
    wanted = m.get("type", "AS_IS").upper()
    if wanted in js.CONVERSIONS:
        value, wrong = js.CONVERSIONS[wanted](value, kind)
        error = F.coalesce(error, wrong)
    elif wanted == "STRING":
        value = js.text(value, kind)
    elif wanted != "AS_IS":
        raise ValueError(f"no type {m['type']!r}")
    return value, error


def apply_mapping(df: DataFrame, spec: dict) -> DataFrame:
    """The targets of spec["mappings"] (all other fields too with keepUnmapped, those beside a nested target included), the envelope and `_error`: the first mapping's error in the order of the spec."""
    if not spec.get("mappings"):
        raise ValueError("a mapper needs mappings")
    if not all(m.get("to") for m in spec["mappings"]):
        raise ValueError("a mapping needs a target")
    made = {m["to"]: mapping_columns(df, m) for m in spec["mappings"]}
    before = [F.col("_error")] if "_error" in df.columns else []
    error = F.coalesce(*before, *(e for _, e in made.values()))
    targets = paths.build({to: F.when(error.isNull(), v) for to, (v, _) in made.items()}, df if spec.get("keepUnmapped") else None)
    names = {to.split(".")[0] for to in made}
    kept = [F.col(f"`{c}`") for c in df.columns if c != "_error" and (c.startswith("_") or spec.get("keepUnmapped") and c not in names)]
    return df.select(*kept, *targets, error.alias("_error"))


def to_record(df: DataFrame, spec: dict) -> Column:
    """JSON text of the mapped fields: missing ones are left out, or explicit nulls where the mapping says onMissing NULL, at any depth; an object without any field is left out."""
    tree: dict = {}
    for m in spec["mappings"]:
        at = tree
        *parents, leaf = m["to"].split(".")
        for p in parents:
            at = at.setdefault(p, {}) if isinstance(at.get(p, {}), dict) else at.update({p: {}}) or at[p]
        if not isinstance(at.get(leaf), dict):
            at[leaf] = m.get("onMissing", "OMIT").upper() == "NULL"

    def name(text: str) -> Column:
        return F.lit(json.dumps(text, ensure_ascii=False) + ":")

    def fields(at: dict, value: Callable[[str], Column]) -> Column:
        """The fields of one object, joined; null if there is none."""
        parts = []
        for k, x in at.items():
            if isinstance(x, dict):
                inner = fields(x, lambda c, k=k: value(k).getField(c))
                parts.append(F.concat(name(k), F.lit("{"), inner, F.lit("}")))
                continue
            text = F.regexp_extract(F.to_json(F.struct(value(k).alias("v")), {"ignoreNullFields": "true"}), r"(?s)^\{(?:\"v\":(.*))?\}$", 1)
            absent = F.concat(name(k), F.lit("null")) if x else F.lit(None).cast("string")
            parts.append(F.when(value(k).isNotNull(), F.concat(name(k), text)).otherwise(absent))
        return F.nullif(F.concat_ws(",", *parts), F.lit(""))

    return F.concat(F.lit("{"), F.coalesce(fields(tree, lambda c: F.col(f"`{c}`")), F.lit("")), F.lit("}"))


def _check(df: DataFrame, rule: dict) -> Column:
    """Whether a record passes one rule; never null."""
    value, kind = paths.read(df, rule["field"])
    text, want, check = js.text(value, kind), rule.get("value"), rule["check"].upper()
    number, wrong = js.number(value, kind)
    numeric = value.isNotNull() & wrong.isNull() & ~_blank(value, kind)
    passed = {
        "REQUIRED": lambda: value.isNotNull(),
        "NOT_BLANK": lambda: value.isNotNull() & (js.trim(text) != ""),
        "IS_NUMBER": lambda: numeric,
        "MIN": lambda: numeric & (number >= float(want)),
        "MAX": lambda: numeric & (number <= float(want)),
        "MAX_LENGTH": lambda: value.isNull() | (F.length(text) <= int(want)),
        "ONE_OF": lambda: text.isin(*(str(x) for x in (want if isinstance(want, list) else str(want).split(",")))),
        "MATCHES": lambda: value.isNotNull() & text.rlike(want),
    }
    if check not in passed:
        raise ValueError(f"no check {rule['check']!r}")
    return F.coalesce(passed[check](), F.lit(False))


def apply_rules(df: DataFrame, spec: dict, most: int = 5) -> DataFrame:
    """df with `_error` (labels of broken rules, at most `most` and how many more) and `_filtered` (records that onFail DROP takes out)."""
    if not spec.get("rules"):
        raise ValueError("a validation needs rules")
    labels = [F.when(~_check(df, r), F.lit(r.get("name") or f"{r['field']} failed {r['check']}")) for r in spec["rules"]]
    if spec.get("report", "ALL").upper() == "FIRST":
        said = F.coalesce(*labels)
    else:
        broken = F.filter(F.array(*labels), lambda x: x.isNotNull())
        more = F.when(F.size(broken) > most, F.concat(F.lit("; and "), (F.size(broken) - most).cast("string"), F.lit(" more"))).otherwise("")
        said = F.when(F.size(broken) > 0, F.concat(F.concat_ws("; ", F.slice(broken, 1, most)), more))
    before = F.col("_error") if "_error" in df.columns else F.lit(None).cast("string")
    drop = spec.get("onFail", "REJECT").upper() == "DROP"
    out = df.withColumn("_filtered", (before.isNull() & said.isNotNull()) if drop else F.lit(False))
    return out.withColumn("_error", before if drop else F.coalesce(before, said))


def translated(df: DataFrame, column: str, lookup: DataFrame, source: str, target: str, name: str, otherwise: Column | None = None) -> DataFrame:
    """df with name: what the lookup table (source, target) says of a column's value, compared as text; of several lines for a value the least target counts. A value that it doesn't list gets `otherwise`, or stays as it is, as text; null is a value that isn't listed.

    A lookup of up to SMALL_LOOKUP lines is broadcast. A larger one is joined by a shuffle, in which rows without a value, or with one that isn't unique to few rows, are dealt out: null keys carry a salt that matches nothing, and frequent values are left to Spark's splitting of skewed partitions.
    """
    lines = lookup.where(F.col(source).isNotNull()).groupBy(F.col(source).cast("string").alias("_look")).agg(F.min(target).alias("_found"), F.lit(True).alias("_listed"))
    small = lines.limit(SMALL_LOOKUP + 1).count() <= SMALL_LOOKUP
    value = F.col(column).cast("string")
    if small:
        joined = df.withColumn("_look", value).join(F.broadcast(lines), "_look", "left")
    else:
        keyed = df.withColumn("_look", value).withColumn("_salt", F.when(F.col("_look").isNull(), F.monotonically_increasing_id() % 1_000).otherwise(F.lit(-1).cast("long")))
        joined = keyed.join(lines.withColumn("_salt", F.lit(-1).cast("long")), ["_look", "_salt"], "left").drop("_salt")
    rest = value if otherwise is None else otherwise
    return joined.withColumn(name, F.when(F.col("_listed"), F.col("_found").cast("string")).otherwise(rest)).drop("_look", "_found", "_listed")
