"""Promises in Markdown: lines as rows, paragraphs by windows over a file's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_markdown
from .deadcode import lines

#: What a promise says, case aside; a changed route; headings over features.
PROMISE = r"(?:\b(?:must|shall|should|required?|always|never|guarantee(?:s|d)?|ensure(?:s|d)?|support(?:s|ed)?|provide(?:s|d)?|expose(?:s|d)?|allow(?:s|ed)?|will|cannot|can't|won't)\b|\b(?:not implemented|unsupported|missing|partial(?:ly)?|deprecated|todo)\b|\b(?:retry|fallback|encrypt|decrypt|authenticat|authoriz|unauthoriz|isolat|rate[- ]?limit|cache|durab|persist|migration|webhook|notification|schedule|worker|queue|background|celery|redis|ready|dependenc|ingest|pars|embedding|retrieval|crisis|audit)\w*\b|\b(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s+/)"
ROUTE_CHANGE = r"^(?:added|cleaned\s+up|made)\b.*(?:\b(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s+/|(?:^|\s)/[a-z0-9])"
FEATURE_HEADING = r"\b(?:capabilit(?:y|ies)|features?|functionality|highlights?|what (?:it|this) (?:does|demonstrates)|user flows?|workflows?|behaviors?|responsibilit(?:y|ies)|architecture|tech stack|backend|frontend)\b"
DIAGRAM = r"^(?:sequenceDiagram\b|Note\s+over\b|.*->>)"
#: Fences whose lines are read as text, the marks of list items, table rules.
TEXT_FENCES = ("", "text", "txt", "plain", "plaintext", "md", "markdown")
LIST_ITEM = r"^(?:(?:[-*+]|\d+[.)])\s+\S|(?:\|--|->|=>|├──|└──|│\s*(?:├──|└──))\s*\S)"
TABLE_RULE = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def whole_sentences(text: Column, most: int) -> Column:
    """The text, or of a longer one the sentences that end within ``most`` characters;
    null where none does, and for no text."""
    head = F.trim(F.regexp_extract(text, rf"(?s)\A(.{{0,{most - 1}}}[.!?])(?=\s|\z)", 1))
    return F.when(F.length(text) <= most, F.when(text != "", text)).otherwise(F.when(head != "", head))


def promise_excerpts(files: DataFrame, most: int = 800, heading_most: int = 160, per_file: int = 80) -> DataFrame:
    """(path, line, heading, text, list_item): paragraphs and list items of Markdown
    ``files`` (path, text; a path once) that promise something, under their headings:
    by their words, as a changed route, or as an item under a heading over features. The
    first ``per_file`` of a file are returned, as excerpts are bounded by definition.

    Fences of code are left out, those of text read. A paragraph ends at an empty line,
    a heading, a fence, a table's rule or a diagram; an item also at the next item and at
    a line that isn't indented by two. Null and empty texts give nothing.
    """
    whole, before = Window.partitionBy("path").orderBy("line"), Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = lines(files).select("path", "line", F.col("text").alias("raw"), trimmed.alias("t"))
    rows = rows.withColumn("fence", F.col("t").rlike("^(?:```|~~~)")).withColumn("fences", F.sum(F.col("fence").cast("int")).over(whole))
    opened = F.when(F.col("fence") & (F.col("fences") % 2 == 1), F.lower(F.regexp_extract("t", r"^(?:```|~~~)\s*([^\s`]*)", 1)))
    rows = rows.withColumn("language", F.last(opened, True).over(whole))
    rows = rows.withColumn("code", ~F.col("fence") & (F.col("fences") % 2 == 1) & ~F.col("language").isin(*TEXT_FENCES))
    is_heading = ~F.col("fence") & ~F.col("code") & ~_says(F.col("t"), DIAGRAM) & F.col("t").rlike(r"^#{1,6}\s+\S")
    title = strip_markdown(F.regexp_replace("t", r"^#{1,6}\s+", ""))
    title = F.when(F.length(title) <= heading_most, title).otherwise(F.concat(F.substring(title, 1, heading_most - 1), F.lit("…")))
    rows = rows.withColumn("heading", F.last(F.when(is_heading, title), True).over(whole))
    ends = F.col("fence") | F.col("code") | _says(F.col("t"), DIAGRAM) | is_heading | (F.col("t") == "") | F.col("t").rlike(TABLE_RULE)
    kind = F.when(ends, "break").when(F.col("t").rlike(LIST_ITEM), "item").when(F.col("raw").rlike(r"^\s{2,}\S"), "indented").otherwise("plain")
    rows = rows.withColumn("kind", kind)
    # an indented line belongs to what stands before it, so it tells nothing of the block
    rows = rows.withColumn("block", F.last(F.when(F.col("kind") != "indented", F.col("kind")), True).over(before)).withColumn("ahead", F.lag("kind").over(whole))
    in_item = F.coalesce(F.col("block") == "item", F.lit(False))
    fresh = F.coalesce(F.col("ahead") == "break", F.lit(True)) | (F.col("kind") == "item") | (in_item & (F.col("kind") == "plain")) | (~in_item & _says(F.col("t"), ROUTE_CHANGE))
    rows = rows.withColumn("part", F.sum((fresh & (F.col("kind") != "break")).cast("int")).over(whole)).filter("kind != 'break'")
    parts = rows.groupBy("path", "part").agg(F.min_by(F.struct("line", "heading", (F.col("kind") == "item").alias("item")), "line").alias("f"), F.sort_array(F.collect_list(F.struct("line", "t"))).alias("all"))
    text = whole_sentences(strip_markdown(F.array_join(F.transform("all", lambda x: x["t"]), " ")), most)
    found = parts.select("path", "f.line", "f.heading", text.alias("text"), F.col("f.item").alias("list_item"))
    found = found.filter(_says(F.col("text"), PROMISE) | _says(F.col("text"), ROUTE_CHANGE) | (F.col("text").isNotNull() & F.col("list_item") & _says(F.col("heading"), FEATURE_HEADING)))
    return found.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= per_file).drop("n")
