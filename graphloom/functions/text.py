"""Text functions as columns: search normal form, tokens, stems, slugs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that say nothing about a feature.
GENERIC = ("app", "application", "component", "feature", "file", "function", "handler", "index", "main", "module", "route", "service", "source", "src", "support", "system", "that", "their", "this", "with")


def round6(x: Column) -> Column:
    """Half-up rounding to six places, on doubles."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")


def normal(text: Column) -> Column:
    """Search normal form: camel case apart, lower case, runs of other characters as
    one space. Compatibility forms are left as they are."""
    return F.trim(F.regexp_replace(F.lower(split_camel(text)), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = GENERIC) -> Column:
    """Distinct ASCII tokens of ``least`` characters or more that are no numbers and
    not generic."""
    parts = F.split(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    good = F.filter(parts, lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop))
    return F.array_sort(F.array_distinct(good))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` segments; null where it escapes."""
    step = lambda done, part: (
        F.when(part.isin("", "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1))
        .otherwise(F.concat(done, F.array(part)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


#: What is taken off a Markdown line, in this order, and what stands for it.
MARKDOWN = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?i)<https?://[^>]+>", ""),
    (r"<[^>]+>", " "),
    (r"^(?:\s*>\s*)+", ""),
    (r"^(?:[-*+]\s+|\d+[.)]\s+)", ""),
    (r"^(?:\|--|->|=>|├──|└──|│\s*(?:├──|└──))\s*", ""),
    (r"`([^`]*)`", "$1"),
    (r"[*_~]+", ""),
    (r"\\([\\`*_\[\]{}()#+.!|>-])", "$1"),
    (r"(?i)&(?:amp|#38);", "&"),
    (r"(?i)&(?:lt|#60);", "<"),
    (r"(?i)&(?:gt|#62);", ">"),
    (r"(?i)&(?:quot|#34);", '"'),
    (r"(?i)\bTanStack\s+Query\b", "React Query (TanStack Query)"),
    (r"\s+", " "),
)


def strip_markdown(text: Column) -> Column:
    """Plain text of Markdown: links and images by their label, code by its text, no
    tags, quote, list or tree marks at the start, no emphasis; escapes and entities
    undone. Null stays null."""
    for pattern, put in MARKDOWN:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def normal_route(route: Column) -> Column:
    """A route without query and closing punctuation, ``{x}`` as ``{}``, single slashes,
    none at the end, in lower case."""
    out = F.regexp_replace(route, r"(?s)[?#].*$", "")
    out = F.regexp_replace(out, r"[),.;:!?]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\{[^/{}]+\}", "{}"), "/{2,}", "/")
    return F.lower(F.when(F.length(out) > 1, F.regexp_replace(out, "/+$", "")).otherwise(out))


#: Names of test folders, and patterns of test files.
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "specs", "__snapshots__")
TEST_FILES = (r"\.(?:test|spec)\.[^.]+$", r"^(?:test_.+|.+_test)\.py$", r"^conftest\.py$", r"_test\.go$", r"^(?:test_.+|.+_spec)\.rb$", r"_test\.rs$", r"\.bats$")
TEST_CLASS_FILE = r"(?:Test|Tests|TestCase)\.(?:java|kt|kts|cs|php)$"


def is_test_path(path: Column) -> Column:
    """Whether a path is a test's: by a folder's name or by the file's. A null path is
    no test's."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: s != "")
    name = F.coalesce(F.element_at(parts, -1), F.lit(""))
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.lower(s))
    named = F.lower(name).rlike("|".join(TEST_FILES)) | name.rlike(TEST_CLASS_FILE)
    return F.coalesce(F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | named, F.lit(False))
