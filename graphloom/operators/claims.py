"""Documentation claims that are about no product: what they are known by, and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals of claims that are about no product, as (column, pattern), case aside.
#: ``all`` is heading and text, ``label`` the heading in words.
SIGNALS = (
    ("path", r"(?:^|/)(?:tests?|testing)(?:/|$)"),
    ("path", r"(?:^|/)(?:local[-_ ]?docker[-_ ]?development|[^/]*(?:implementation|fix))\.mdx?$"),
    ("all", r"\b(?:test(?:ed|ing|s)?|test suites?|test coverage|unit tests?|integration tests?|security tests?|date utils tests?|pytest|running tests?|run tests?)\b"),
    ("all", r"\b(?:virtual environments?|virtual env|venv|deactivat(?:e|ion)|activat(?:e|ion)|installation instructions?|setup instructions?|development setup|environment setup|getting started)\b"),
    ("text", r"^\s*(?:(?:fix(?:ed|es|ing)?)(?:\s*[:—-]|\s+(?:the|a|an)\b)|cleaned\s+up\b.*\bresponses?\b)"),
    ("text", r"(?:^|\s)(?:sequenceDiagram\b|Note\s+over\b)|->>"),
    ("text", r"^\s*(?:key methods?|responsibilities)\s*:"),
    ("text", r"^(?:\s*[-*+]\s*)?(?:[A-Za-z][A-Za-z0-9_]*\s*\(\s*\)\s*,\s*)+[A-Za-z][A-Za-z0-9_]*\s*\(\s*\)\s*[.]?$"),
    ("text", r"\b(?:was experiencing|production[- ]ready)\b"),
    ("label", r"^(?:discussion(?:\s*/\s*ask for help)?|ask for help|faq|frequently asked questions|getting help|help and support|support|support channels?|community|contact(?: us)?|contributions?|bug reports?\s*(?:/|and)\s*feature requests?)$"),
    ("text", r"\b(?:github issues?|subreddit|community forums?|support channels?|discussion boards?|join (?:our|the) (?:discord|slack|community)|ask (?:on|in|via) (?:discord|github|reddit|slack|stack overflow|the forums?)|open (?:a|an|new) (?:github )?issue|contact (?:us|me)|send (?:us|me) (?:a |an )?email|finding answers? to (?:your|the) questions?|general or technical questions)\b"),
)
#: Headings of instructions, and what their texts say then.
INSTRUCTIONS = (r"\b(?:setup|installation|instructions?|testing|tests?|development environment)\b", r"\b(?:run|install|configure|create|activate|deactivate|command)\b")


def quarantined(path: Column, heading: Column, text: Column) -> Column:
    """Whether a claim is kept from seeding a feature. Nulls count as empty."""
    heading, text = F.coalesce(heading, F.lit("")), F.coalesce(text, F.lit(""))
    seen = {
        "path": F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"),
        "text": text,
        "all": F.concat(heading, F.lit("\n"), text),
        "label": F.trim(F.regexp_replace(heading, r"[^\p{L}\p{N}/]+", " ")),
    }
    found = heading.rlike("(?i)" + INSTRUCTIONS[0]) & text.rlike("(?i)" + INSTRUCTIONS[1])
    for column, pattern in SIGNALS:
        found = found | seen[column].rlike("(?i)" + pattern)
    return found


def feature_title(title: Column) -> Column:
    """The title without notes of duplicates at its end, however many; null stays null."""
    return F.trim(F.regexp_replace(title, r"(?i)(?:\s*\((?:duplicate|alternate)(?:\s+\d+)?\)\s*)+$", ""))


def unresolved_contracts(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(name, source_id) of the remote procedures that ``sources`` (source_id, text) call
    by a literal name and that no symbol in ``names`` (name) has: once for each source."""
    called = F.regexp_extract_all("text", F.lit(r"""\.rpc\(\s*["']([A-Za-z_][A-Za-z0-9_]*)["']"""), F.lit(1))
    calls = sources.select("source_id", F.explode(F.array_distinct(called)).alias("name")).distinct()
    return calls.join(names.select("name"), "name", "left_anti").select("name", "source_id")
