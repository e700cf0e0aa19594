"""Chat formatting with typed content parts (DataFrame only).

A turn holds parts of type text, image, audio or document. A visitor flattens them
in order: text is escaped, any other part becomes a numbered placeholder, and its
reference and expanded token count are recorded. Escaping is reversible and leaves
no control string inside a text, so the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
TURN, END = "<|turn|>", "<|end|>"
#: Escapes in the order they are applied; undone in reverse.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
#: Tokens a placeholder stands for: base and tokens for each unit (tile, second, page).
EXPANDED = {"image": (85, 170), "audio": (0, 25), "document": (0, 512)}


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as one text part."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))
    return F.array(part)


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, (base, each) in EXPANDED.items():
        out = F.when(part["type"] == kind, F.lit(base) + F.lit(each) * F.coalesce(part["units"], F.lit(0))).otherwise(out)
    return out.cast("long")


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, parts).

    Returns (conv_id, formatted, loss_spans, attachments): ``loss_spans`` are
    (start, length) in code points of the turns of ``loss_roles``, ``attachments``
    are (ordinal, type, ref, tokens) in order. Turns go by turn number, null first;
    ties by role and content, so reruns agree. Null roles, texts and parts count as
    empty; a part of an unknown type is a placeholder of 0 tokens. Rows with a null
    conv_id form one conversation. A conversation is one value, so it is the unit of
    work: it must fit one task, as its consumer's training example must.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("files", F.filter("parts", lambda p: kind(p) != "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("seen", F.coalesce(F.sum(F.size("files")).over(prior), F.lit(0)))

    def visit(p: Column, i: Column) -> Column:
        nth = F.col("seen") + F.size(F.filter(F.slice("parts", F.lit(1), i + 1), lambda q: kind(q) != "text"))
        mark = F.concat(F.lit("<|"), escape(F.replace(kind(p), F.lit("|"), F.lit("/"))), F.lit(":"), nth.cast("string"), F.lit("|>"))
        return F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)

    # the role ends at the line's end: a newline inside it is escaped as well
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", F.array_join(F.transform("parts", visit), ""))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(prior), F.lit(0)) + F.length("head")
    span = F.when(F.col("role").isin(*loss_roles), F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    noted = F.transform(
        "files", lambda p, i: F.struct((F.col("seen") + i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))
    )
    rows = rows.select("conv_id", F.struct("at", "piece", span.alias("span"), noted.alias("files")).alias("one"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("all", lambda x: x["files"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Undo ``format_chat``: adds ``turns`` (array of role and text; placeholders stay
    as they are) and ``loss_text`` (the text under the loss mask, unescaped)."""
    cut = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.replace(F.substring_index(x, "\n", 1), F.lit("&nl;"), F.lit("\n"))
        line = F.instr(x, F.lit("\n"))
        body = F.substr(x, line + 1, F.length(x) - line - F.lit(len(END) + 1))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    masked = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.withColumn("turns", F.transform(cut, turn)).withColumn("loss_text", unescape(F.array_join(masked, "")))
