"""What a path says of a file, as columns. A null path is none of these (and is no
implementation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of paths, case aside.
GOVERNANCE_FILE = r"^(?:agents?|claude|gemini|copilot[-_]instructions|code[-_]of[-_]conduct|contributing|security|support|governance|maintainers?|authors?|community|funding|pull[-_]request[-_]template)(?:[._-][a-z0-9]+)*\.(?:md|mdx)$"
TEMPLATE_FOLDER = r"(?:^|/)\.(?:github|gitlab)/(?:discussion_template|issue_template|merge_request_templates?|pull_request_template)(?:/|$)"
README = r"(?:^|/)readme(?:\.[a-z0-9_-]+)*\.mdx?$"
DOCS = r"(?:^|/)docs/.*\.(?:md|mdx)$"
CLAIMS_FILE = r"(?:^|/)(?:capabilities|features?|product(?:[-_]claims?)?|requirements?|specification)\.(?:md|mdx)$"
SUMMARY = r"(?:^|/)[^/]*summary\.mdx?$"
PRODUCT_COPY = r"(?:^|/)(?:featurespage|languagecontext)\.[cm]?[jt]sx?$"
DEPENDENCY_MANIFEST = r"(?:^|/)(?:package(?:-lock)?\.json|requirements(?:[-_.][^/]*)?\.txt|pyproject\.toml|poetry\.lock|pdm\.lock|pipfile(?:\.lock)?|composer\.json|cargo\.toml|go\.mod|gemfile(?:\.lock)?|[^/]+\.lock)$"
DOCUMENT = r"(?:^|/)(?:readme|changelog|contributing|license)(?:\.[^/]*)?$|\.(?:md|mdx|rst|adoc)$"
TEST_OR_FIXTURE = r"(?:^|/)(?:tests?|__tests__|fixtures?)(?:/|$)|(?:^|\.)test\.[^/]+$|(?:^|\.)spec\.[^/]+$"
CONFIG_FILE = r"(?:^|/)(?:(?:next|jest|eslint|vite|vitest|webpack|rollup|babel|postcss|tailwind|tsconfig|jsconfig|playwright|cypress|prettier)\.(?:config|setup)|config|settings|env)(?:\.[^/]+)?\.(?:js|ts|mjs|cjs|py|json|ya?ml)$"
SHARED_DOMAIN = r"(?:^|/)(?:models?|schemas?|middleware|repositories|policies|db|database|shared|common|utils?|helpers?|core|services)/"
CONTRACT_FILES = (
    r"(?:^|/)(?:readme|agents)\.md$|(?:^|/)docs/.*\.(?:md|mdx)$",
    r"(?:^|/)data/.*\.(?:json|ya?ml)$",
    r"(?:^|/)(?:package\.json|pyproject\.toml|docker-compose\.ya?ml|dockerfile|tsconfig\.json)$",
    r"(?:^|/)(?:config|configuration)(?:/|$)|(?:^|/)[^./]+\.config\.[^/]+$",
)
#: Languages of code, and folders at the root that hold none of the repository's own.
CODE_LANGUAGES = ("astro", "javascript", "python", "svelte", "typescript", "vue")
FOREIGN_FOLDERS = (".git/", ".next/", "audit-results/", "benchmark-results/", "build/", "dist/", "graphify-out/", "node_modules/")


def _like(path: Column, *patterns: str) -> Column:
    return F.coalesce(path.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def slashed(path: Column) -> Column:
    """The path with forward slashes and without a leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def is_non_product_document(path: Column) -> Column:
    """Instructions to agents, and what governs a community."""
    p = slashed(path)
    return _like(F.element_at(F.split(p, "/"), -1), GOVERNANCE_FILE) | _like(p, TEMPLATE_FOLDER)


def is_product_copy(path: Column) -> Column:
    return _like(slashed(path), PRODUCT_COPY)


def is_summary(path: Column) -> Column:
    return _like(slashed(path), SUMMARY) & ~is_non_product_document(path)


def is_product_document(path: Column) -> Column:
    """Documents that may claim something of the product. A governance file is none,
    whatever folder holds it."""
    return ~is_non_product_document(path) & _like(slashed(path), README, DOCS, CLAIMS_FILE, SUMMARY, PRODUCT_COPY)


def is_primary_document(path: Column) -> Column:
    """Product documents read by paragraphs: neither summaries nor product copy."""
    return is_product_document(path) & ~is_summary(path) & ~is_product_copy(path)


def is_implementation(path: Column) -> Column:
    """Whether a file can show that something is implemented: no manifest, document or test."""
    return path.isNotNull() & ~_like(path, DEPENDENCY_MANIFEST, DOCUMENT, TEST_OR_FIXTURE)


def is_config(path: Column) -> Column:
    return _like(path, CONFIG_FILE)


def is_shared_domain(path: Column) -> Column:
    return _like(path, SHARED_DOMAIN)


def is_contract_bearing(path: Column) -> Column:
    return _like(path, *CONTRACT_FILES)


def is_own_code(path: Column, language: Column) -> Column:
    """Code of the repository itself, by language and root folder."""
    foreign = F.lit(False)
    for folder in FOREIGN_FOLDERS:
        foreign = foreign | slashed(path).startswith(folder)
    return F.coalesce(F.lower(language).isin(*CODE_LANGUAGES) & ~foreign, F.lit(False))


def group_key(path: Column) -> Column:
    """The first two segments of a path, or its only one; ``root`` without any."""
    parts = F.filter(F.split(slashed(path), "/"), lambda s: s != "")
    return F.when(F.size(parts) == 0, "root").otherwise(F.array_join(F.slice(parts, 1, 2), "/"))
