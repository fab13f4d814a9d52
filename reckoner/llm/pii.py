"""Personal data by weak supervision (operator 1), in DataFrame functions only.

Four patterns give the base spans (email, ip, card, phone), which always stay. Looser patterns give candidates: named
secrets, long numbers that fail the card checksum and phone numbers without a plus sign. Four labelers vote on each base
span and candidate (1 personal, -1 not, 0 no opinion): strict form, gazetteer (domains, issuers, dialling codes, names of
secrets), context (words before) and variety of characters. Spark counts the vote and feature patterns over all documents;
there are PATTERNS of them at most, whatever the input. Expectation-maximisation on these counts estimates how reliable
each labeler is, and its posteriors train the final classifier of spans, naive Bayes over form and surroundings. Candidates
that it gives a probability of ACCEPT or more, and that touch no base span, become spans.

Offsets are code points, ends exclusive. Null texts count as empty. Null and repeated doc_ids are rows like others; no step
joins on doc_id. Other columns stay unless they clash with the columns that are added: spans, base and names that begin
with `_pii`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm.common import running, saved, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number")
ACCEPT = 0.5
#: Kinds x votes of four labelers x features (3 lengths, 3 shares of digits, 4 characters before, 4 after).
PATTERNS = 6 * 81 * 144
ROUNDS = 40

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Matches are those of the plain patterns in the contract; possessive parts keep Java from backtracking, and the look-behinds from trying every tail of a run.
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9]{1,12}_){0,3}+(?i:api_?key|key|token|secret|password|passwd|pwd)(?:_[A-Za-z0-9]{1,12}){0,2}+[\x20]{0,2}[=:][\x20]{0,2}[\x22\x27]?[A-Za-z0-9_+/-]{12,}+[\x22\x27]?",
    "number": r"(?<![+0-9.-])\(?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9.-])",
}
#: A cheap test without which the pattern can't match.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|pay|credit|account",
    "phone": "phone|call|tel|mobile|fax|contact",
    "secret": "aws|export|config|secret|env|auth|bearer",
    "number": "phone|call|tel|mobile|fax|card|account|contact",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds; every second digit from the right counts twice, less 9 if over 9."""

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        return acc + F.when(k % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, digits: Column, before: Column, valid: Column) -> list[Column]:
    value = F.regexp_replace(F.regexp_extract(m, r"[=:][\x20\x22\x27]*([A-Za-z0-9_+/-]+)", 1), "[^A-Za-z0-9]", "")
    strict = {"secret": _vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16), ~value.rlike("[0-9]")), "number": _vote(F.length(digits).between(9, 12), F.length(digits) < 9)}.get(kind, _vote(valid, ~valid))
    gazetteer = {
        "email": _vote(F.lower(m).rlike(r"\.(?:com|org|net|edu|gov|io|info|example|test|de|fr|es|uk|eu|us)$"), m.rlike(r"\.[0-9]+$")),
        "ip": _vote(m.rlike(r"^(?:10|127|172|192)\."), m.rlike(r"^0+\.")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^0")),
        "phone": _vote(m.rlike(r"^\+(?:1|7|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), m.rlike(r"^\+0")),
        "secret": _vote(F.lower(m).rlike("api_?key|secret|token|passw"), F.lit(False)),
        "number": _vote(m.rlike(r"^\([0-9]{3}\)|^0"), F.lit(False)),
    }[kind]
    context = _vote(F.lower(before).rlike(f"(?:{CONTEXT[kind]})[^A-Za-z]*$"), F.lit(False))
    kinds_of = F.size(F.array_distinct(F.split(value if kind == "secret" else digits if kind != "email" else m, "")))
    return [strict, gazetteer, context, _vote(kinds_of >= 5, kinds_of <= 2)]


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}_]"), 2).otherwise(3)


def _matches(kind: str) -> Column:
    """Matches of one pattern that are base spans or candidates, with surroundings, from matches (h), gaps around them (g) and ends (e)."""
    hits, gaps, ends = (F.col(f"_pii_{x}_{kind}") for x in "hge")

    def one(end: Column, at: Column) -> Column:
        m = F.get(hits, at)
        return F.struct(m.alias("m"), end.alias("end"), _digits(m).alias("digits"), F.right(F.get(gaps, at), F.lit(24)).alias("before"), F.substring(F.get(gaps, at + 1), 1, 1).alias("after"), _valid(kind, m).alias("valid"))

    def keep(x: Column) -> Column:
        return x["valid"] | F.lit(kind not in BASE) | (F.lit(kind == "card") & F.length(x["digits"]).between(14, 19))

    return F.filter(F.transform(ends, one), keep)


def _spans(kind: str) -> Column:
    """Kind, place, votes and form of each of the matches (m)."""

    def one(x: Column) -> Column:
        m = x["m"]
        share = F.length(x["digits"]) / F.length(m)
        form = [F.when(F.length(m) < 14, 0).when(F.length(m) < 24, 1).otherwise(2), F.when(share < 0.2, 0).when(share < 0.7, 1).otherwise(2), _class(F.right(x["before"], F.lit(1))), _class(x["after"])]
        name = F.when(x["valid"], kind).otherwise("number") if kind == "card" else F.lit(kind)
        return F.struct(name.alias("kind"), (x["end"] - F.length(m)).alias("start"), x["end"].alias("end"), (x["valid"] & F.lit(kind in BASE)).alias("base"), F.array(*_votes(kind, m, x["digits"], x["before"], x["valid"])).alias("votes"), F.array(*form).alias("form"))

    return F.transform(f"_pii_m_{kind}", one)


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `_pii`: array of (kind, start, end, base, votes, features) of base spans and candidates, by kind and start."""
    df = docs.withColumn("_pii_text", F.coalesce("text", F.lit("")))
    text = F.col("_pii_text")
    hits = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERN.items()}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_pii_h_{k}": F.when(F.contains(text, F.lit(NEEDS[k])), h).otherwise(none) if k in NEEDS else h for k, h in hits.items()})
    df = df.withColumns({f"_pii_g_{k}": F.when(F.size(f"_pii_h_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in PATTERN.items()})
    size = {k: F.zip_with(F.col(f"_pii_h_{k}"), F.slice(f"_pii_g_{k}", F.lit(1), F.size(f"_pii_h_{k}")), lambda h, g: F.length(h) + F.length(g)) for k in KINDS}
    df = df.withColumns({f"_pii_e_{k}": F.when(F.size(f"_pii_h_{k}") > 0, running(size[k])).otherwise(F.array().cast("array<long>")) for k in KINDS})
    df = df.withColumns({f"_pii_m_{k}": F.when(F.size(f"_pii_h_{k}") > 0, _matches(k)) for k in KINDS})
    df = df.withColumns({f"_pii_s_{k}": F.when(F.size(f"_pii_m_{k}") > 0, _spans(k)) for k in KINDS})
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<int>,form:array<int>>>")
    df = df.withColumn("_pii", F.concat(*(F.coalesce(F.col(f"_pii_s_{k}"), empty) for k in KINDS)))
    return df.drop("_pii_text", *(f"_pii_{x}_{k}" for x in "hgems" for k in KINDS))


def fit(found: DataFrame) -> dict:
    """Reliabilities of the labelers and the classifier's log-odds, from counts of patterns over all rows of found (`_pii`); pass a written table, else the candidates are computed twice."""
    rows = found.select(F.explode("_pii").alias("x")).groupBy("x.kind", "x.votes", "x.form").agg(F.count("*").alias("n")).collect()
    rows = sorted((r["kind"], tuple(r["votes"]), tuple(r["form"]), r["n"]) for r in rows)
    share = {k: 0.5 for k in KINDS}
    trust = [{y: {v: (2.0 if v == (1 if y else -1) else 1.0) / 4 for v in (-1, 0, 1)} for y in (0, 1)} for _ in range(4)]
    post: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for kind, votes, _, _ in rows:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(trust, votes, strict=True))
            post[kind, votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for kind in KINDS:
            own = [(post[k, v], n) for k, v, _, n in rows if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for x, t in enumerate(trust):
            for y in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for kind, votes, _, n in rows:
                    mass[votes[x]] += n * (post[kind, votes] if y else 1 - post[kind, votes])
                t[y] = {v: m / sum(mass.values()) for v, m in mass.items()}
        if any(t[1][1] < t[0][1] for t in trust):  # a labeler that says yes rather to what is not personal: keep the sides of the start
            trust = [t if t[1][1] >= t[0][1] else {0: t[1], 1: t[0]} for t in trust]
    values = [(len(KINDS), lambda k, f: KINDS.index(k)), (3, lambda k, f: f[0]), (3, lambda k, f: f[1]), (4, lambda k, f: f[2]), (4, lambda k, f: f[3])]
    tables, total = [], [1.0, 1.0]
    for k, v, _, n in rows:
        total[1] += n * post[k, v]
        total[0] += n * (1 - post[k, v])
    for size, of in values:
        mass = [[1.0] * size, [1.0] * size]
        for k, v, f, n in rows:
            mass[1][of(k, f)] += n * post[k, v]
            mass[0][of(k, f)] += n * (1 - post[k, v])
        tables.append([math.log(mass[1][x] / sum(mass[1])) - math.log(mass[0][x] / sum(mass[0])) for x in range(size)])
    return {"trust": trust, "share": share, "prior": math.log(total[1] / total[0]), "tables": tables}


def classify(found: DataFrame, model: dict) -> DataFrame:
    """found with spans: array of (kind, start, end, base, probability) by start, then kind as in KINDS, instead of `_pii`."""
    kinds, *form = [F.array(*map(F.lit, t)) for t in model["tables"]]

    def scored(x: Column) -> Column:
        number = F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int") - 1
        odds = F.lit(model["prior"]) + F.get(kinds, number) + sum((F.get(t, F.get(x["form"], F.lit(k))) for k, t in enumerate(form)), F.lit(0.0))
        return F.struct(x["start"].alias("start"), number.alias("number"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), (1 / (1 + F.exp(-odds))).alias("probability"))

    df = found.withColumn("_pii_all", F.when(F.size("_pii") > 0, F.transform("_pii", scored)).otherwise(F.array()))
    df = df.withColumn("_pii_all", F.sort_array(F.filter("_pii_all", lambda x: x["base"] | (x["probability"] >= ACCEPT))))
    # in order of starts, a span touches a base span if one that began before ends after its start, or one that begins later does so before its end
    ends, starts = F.transform("_pii_all", lambda x: F.when(x["base"], x["end"])), F.transform("_pii_all", lambda x: F.when(x["base"], x["start"]))
    df = df.withColumns({"_pii_before": running(ends, F.greatest), "_pii_after": F.reverse(running(F.reverse(starts), F.least))})
    told = F.zip_with(F.zip_with("_pii_all", "_pii_before", lambda x, b: F.struct(x.alias("x"), b.alias("before"))), "_pii_after", lambda x, a: F.struct(x["x"].alias("x"), x["before"].alias("before"), a.alias("after")))
    free = F.filter(told, lambda t: t["x"]["base"] | ((F.coalesce(t["before"], t["x"]["start"]) <= t["x"]["start"]) & (F.coalesce(t["after"], t["x"]["end"]) >= t["x"]["end"])))
    spans = F.transform(free, lambda t: F.struct(*(t["x"][c].alias(c) for c in ("kind", "start", "end", "base", "probability"))))
    none = F.slice(F.transform("_pii_all", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "base", "probability")))), F.lit(1), F.lit(0))
    return df.withColumn("spans", F.when(F.size("_pii_all") > 0, spans).otherwise(none)).drop("_pii", "_pii_all", "_pii_before", "_pii_after")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redact(df: DataFrame) -> DataFrame:
    """df (text, spans) with each span in text replaced by its kind in square brackets; of spans that overlap the later one loses its overlap."""
    # texts are cut into blocks first: in a string of many bytes Spark finds a place by counting from its start
    block = 4_096
    df = df.withColumn("_pii_blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))))

    def cut(start: Column, end: Column) -> Column:
        """The text from start to end."""
        first, last = F.floor(start / block), F.floor((end - 1) / block)
        own = F.array_join(F.slice("_pii_blocks", (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
        return F.when(end > start, F.substring(own, (start - first * block + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    df = df.withColumn("_pii_ends", running(F.transform("spans", lambda x: x["end"]), F.greatest))
    df = df.withColumn("_pii_marks", F.zip_with("spans", F.concat(F.array(F.lit(0).cast("long")), "_pii_ends"), lambda x, at: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), at.alias("at"))))
    shown = F.transform(F.filter("_pii_marks", lambda x: x["kind"].isNotNull()), lambda x: F.concat(cut(x["at"], x["start"]), F.when(x["end"] > x["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")))
    rest = cut(F.try_element_at("_pii_ends", F.lit(-1)), F.length("text").cast("long"))
    return df.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(shown, ""), rest)).otherwise(F.col("text"))).drop("_pii_blocks", "_pii_ends", "_pii_marks")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, counts of base spans by kind, base_sha256, spans, and counts of all spans and of those that the method adds."""
    found = saved(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "candidates")
    df = classify(found, fit(found)).withColumn("base", F.filter("spans", lambda x: x["base"]))
    names = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(names, k))).cast("long").alias(f"n_{k}") for k in BASE]
    every = F.transform("spans", lambda x: x["kind"])
    added = [(F.size("spans") - F.size(F.array_remove(every, k))).cast("long").alias(f"n_{k}") for k in KINDS if k not in BASE]
    return df.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *added)
