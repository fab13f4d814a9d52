"""Chat formatting with typed content parts (operator 13), in DataFrame functions only.

A turn holds parts: text, image, audio, document. A visitor with one method for each kind flattens them in order: text is
escaped, every other part becomes a placeholder (`<image>`), and the k-th placeholder of a conversation stands for the
k-th entry of its attachments (turn, kind, alternative text, reference and the tokens that it will take once expanded).
parts_of() finds the parts of plain text, where attachments are Markdown references; sizes may stand in their fragment,
as in `![a map](maps/7.png#w=640&h=480)`, `#t=12.5` (seconds), `#pages=3`.

The template is `<turn ROLE>`, a line break, the parts, `</turn>`, a line break. Every mark begins with `<`, which texts and
roles can't contain after escaping: a backslash becomes `\\e`, `<` becomes `\\l`, and `>` in roles `\\g`. Undone in the other
order, this gives every text back. The loss mask has a span of code points of the formatted text for each turn, empty but
for assistants' texts.

Turns are ordered by turn (null first), then role, then what stands for their parts; null roles, texts and parts count as empty; rows without a conv_id
are one conversation; repeated rows are turns of their own. A part without a kind is text, one of an unknown kind a
placeholder `<attachment>` of no tokens. An empty table gives no conversation; other columns are ignored. A conversation is
one record of the output, and so has to fit one row; partial aggregation does not split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm.common import running, saved, table

#: Suffixes of references by kind of part.
KINDS = {"image": "png|jpe?g|gif|webp|bmp|svg", "audio": "mp3|wav|ogg|flac|m4a", "document": "pdf|docx?|pptx?|xlsx?|html?|csv"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels on a side of the square that takes one token; tokens of a second and of a page; tokens where the size isn't known.
PATCH, SECOND, PAGE = 28, 25, 600
UNKNOWN = {"image": 256, "audio": 30 * SECOND, "document": PAGE}
LEARNT = "assistant"
OPEN, CLOSE = "<turn ", "</turn>\n"


def reference(kind: str) -> str:
    """Pattern of references to parts of one kind (or of several, joined by bars); groups: alternative text, reference."""
    return rf"!\[([^\[\]]*)\]\(([^()#\x00-\x20]+\.(?i:{kind})(?:#[^()\x00-\x20]*)?)\)"


ANY = reference("|".join(KINDS.values()))
_PLACEHOLDER = "<(?:" + "|".join(KINDS) + "|attachment)>"


def _part(kind: Column, text: Column, ref: Column | None = None) -> Column:
    ref = F.lit(None).cast("string") if ref is None else ref

    def number(name: str, pattern: str, kind: str) -> Column:
        return F.regexp_extract(ref, rf"[#&]{name}=({pattern})(?:&|$)", 1).try_cast(kind).alias({"w": "width", "h": "height", "t": "seconds"}.get(name, name))

    return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), number("w", "[0-9]{1,6}", "int"), number("h", "[0-9]{1,6}", "int"), number("t", r"[0-9]{1,7}(?:\.[0-9]{1,6})?", "double"), number("pages", "[0-9]{1,6}", "int"))


def parts_of(text: Column) -> Column:
    """The parts of a text in order; parts of text are never empty."""
    text = F.coalesce(text, F.lit(""))

    def attached(found: Column) -> Column:
        ref = F.regexp_extract(found, ANY, 2)
        plain = F.element_at(F.split(ref, "#"), 1)
        kind = F.lit("document")
        for name in ("audio", "image"):
            kind = F.when(plain.rlike(rf"\.(?i:{KINDS[name]})$"), name).otherwise(kind)
        return _part(kind, F.regexp_extract(found, ANY, 1), ref)

    pairs = F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda gap, found: F.array(F.when(gap != "", _part(F.lit("text"), gap)), F.when(found.isNotNull(), attached(found))))
    plain = F.array(F.when(text != "", _part(F.lit("text"), text)))
    return F.filter(F.when(F.contains(text, F.lit("![")), F.flatten(pairs)).otherwise(plain), lambda p: p.isNotNull())


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """After escape() every backslash is followed by a letter that says what it stands for."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


class Visitor:
    """One method for each kind of part: what stands for it in the formatted text, and how many tokens it takes there."""

    def text(self, part: Column) -> tuple[Column, Column | None]:
        return escape(F.coalesce(part["text"], F.lit(""))), None

    def image(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<image>"), F.coalesce(F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH), F.lit(UNKNOWN["image"]))

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<audio>"), F.coalesce(F.ceil(part["seconds"] * SECOND), F.lit(UNKNOWN["audio"]))

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<document>"), F.coalesce(part["pages"] * PAGE, F.lit(UNKNOWN["document"]))

    def other(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<attachment>"), F.lit(0)

    def _all(self, part: Column, which: int) -> Column:
        kind = F.coalesce(part["kind"], F.lit("text"))
        out = self.other(part)[which]
        for name in KINDS:
            out = F.when(kind == name, getattr(self, name)(part)[which]).otherwise(out)
        own = self.text(part)[which]
        return F.when(kind == "text", own if own is not None else F.lit(None)).otherwise(out)

    def flattened(self, parts: Column) -> Column:
        """What stands for the parts, in order."""
        return F.coalesce(F.array_join(F.transform(parts, lambda p: self._all(p, 0)), ""), F.lit(""))

    def attachments(self, parts: Column) -> Column:
        """kind, text, ref, tokens of the parts that are no text, in order."""
        attached = F.filter(parts, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")
        listed = F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), self._all(p, 1).cast("long").alias("tokens")))
        return F.coalesce(listed, F.array().cast("array<struct<kind:string,text:string,ref:string,tokens:bigint>>"))


def format_chats(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """conv_id, formatted, loss (start and end for each turn), attachments (turn from 0, kind, text, ref, tokens), attached_tokens of each conversation of turns (conv_id, turn, role, parts)."""
    visitor = visitor or Visitor()
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    pieces = turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), visitor.flattened(F.col("parts")).alias("body"), visitor.attachments(F.col("parts")).alias("attached"))
    chats = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "head", "attached"))).alias("t"))
    size = F.transform("t", lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long"))
    chats = chats.withColumn("ends", running(size))

    def span(t: Column, at: Column) -> Column:
        end = F.get("ends", at) - len(CLOSE)
        return F.struct(F.when(t["role"] == LEARNT, end - F.length(t["body"])).otherwise(end).alias("start"), end.alias("end"))

    listed = F.flatten(F.transform("t", lambda t, at: F.transform(t["attached"], lambda a: F.struct(at.alias("turn"), *(a[c].alias(c) for c in ("kind", "text", "ref", "tokens"))))))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    chats = chats.select("conv_id", formatted.alias("formatted"), F.transform("t", span).alias("loss"), listed.alias("attachments"))
    return chats.withColumn("attached_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def _restored(body: Column, attached: Column) -> Column:
    """The text of which body was made: attachments in the place of placeholders, escapes undone."""
    full = F.zip_with(F.split(body, _PLACEHOLDER, -1), attached, lambda gap, a: F.concat(unescape(gap), F.when(a.isNull(), "").otherwise(F.concat(F.lit("!["), F.coalesce(a["text"], F.lit("")), F.lit("]("), F.coalesce(a["ref"], F.lit("")), F.lit(")")))))
    return F.when(F.contains(body, F.lit("<")), F.array_join(full, "")).otherwise(unescape(body))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), learnt (all text under the loss mask) and formatted, parsed from what format_chats() gives."""
    none = F.array().cast("array<long>")
    df = chats.withColumn("pieces", F.slice(F.split("formatted", CLOSE, -1), F.lit(1), F.size(F.split("formatted", CLOSE, -1)) - 1))
    df = df.withColumn("ends", running(F.transform("pieces", lambda p: (F.length(p) + len(CLOSE)).cast("long"))))
    marks = running(F.transform("pieces", lambda p: (F.size(F.split(p, _PLACEHOLDER, -1)) - 1).cast("long")))
    df = df.withColumn("marks", F.when(F.size("attachments") > 0, marks).otherwise(none))

    def own(at: Column) -> Column:
        """Attachments of one turn."""
        before = F.when(at == 0, F.lit(0).cast("long")).otherwise(F.get("marks", at - 1))
        return F.when(F.size("marks") > 0, F.slice("attachments", (before + 1).cast("int"), (F.get("marks", at) - before).cast("int"))).otherwise(F.slice("attachments", F.lit(1), F.lit(0)))

    def turn(piece: Column, at: Column) -> Column:
        head = F.instr(piece, ">")
        role = F.substr(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
        return F.struct(unescape(F.replace(role, F.lit("\\g"), F.lit(">"))).alias("role"), _restored(F.substr(piece, head + 2), own(at)).alias("text"))

    def learnt(piece: Column, at: Column) -> Column:
        span, begin = F.get("loss", at), F.get("ends", at) - F.length(piece) - len(CLOSE)
        masked = F.substr(piece, (span["start"] - begin + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.when(span["end"] > span["start"], _restored(masked, own(at))).otherwise("")

    return df.select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(F.transform("pieces", learnt), "").alias("learnt"), "formatted")


def op13_typed_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with marks in its texts, formatted, written and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    chats = read_chats(saved(format_chats(rows.select("conv_id", "turn", "role", parts_of(F.col("text")).alias("parts"))), "chats"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    counts = [F.length(c).cast("long") for c in ("learnt", "formatted")]
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), counts[0].alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), counts[1].alias("formatted_chars"))
