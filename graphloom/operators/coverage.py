"""Contract coverage, its score, and statistics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, stored, stored_counted
from ..functions.text import is_test_path
from ..plans.graph import EvidenceGraph
from .resolve import containing


#: Paths by which coverage tells files apart.
GENERATED_PATH = r"(?i)(?:^|/)(?:dist|build|coverage|vendor|generated|__generated__)(?:/|$)|\.(?:generated|gen)\.[^/]+$"
CONFIG_PATH = r"(?i)(?:^|/)(?:config|configuration)(?:/|$)|(?:^|/)[^./]+\.config\.[^/]+$"
DOCUMENTATION_PATH = r"(?i)(?:^|/)(?:readme|agents)\.md$|(?:^|/)docs/.*\.(?:md|mdx)$"
DATA_PATH = r"(?i)(?:^|/)data/.*\.(?:json|ya?ml)$"
MANIFEST_PATH = r"(?i)(?:^|/)(?:package\.json|pyproject\.toml|docker-compose\.ya?ml|dockerfile|tsconfig\.json)$"
SCRIPT_PATH = r"(?i)(?:^|/)(?:scripts?|tools?|bin|scripts-dev)(?:/|$)"
SYMBOLS = ("function", "class", "variable")


def meaningful(graph: EvidenceGraph, least_degree: int = 3) -> DataFrame:
    """(node_id): what a contract must explain: documentation, data, manifest and
    configuration files; entities; entrypoints that no endpoint stands for; and symbols
    that no entity stands for and that are exported, classes, handlers or of degree
    ``least_degree``."""
    n = graph.nodes
    bearing = "|".join(f"(?:{p})" for p in (DOCUMENTATION_PATH, DATA_PATH, MANIFEST_PATH, CONFIG_PATH))
    files = n.filter((F.col("node_type") == "file") & F.col("line_end").isNotNull() & F.col("path").rlike(bearing)).select("node_id")
    entities = n.filter(~F.col("node_type").isin("file", "entrypoint", *SYMBOLS)).select("node_id")
    opened = n.filter("entrypoint_id is not null").select(F.col("entrypoint_id").alias("node_id"))
    entries = n.filter("node_type = 'entrypoint'").select("node_id").join(opened, "node_id", "left_anti")
    handlers = n.filter("handler_symbol_id is not null").select(F.col("handler_symbol_id").alias("node_id"), F.lit(True).alias("handles")).distinct()
    touched = graph.edges.filter("type not in ('CONTAINS', 'IMPORTS')").select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    rows = n.filter(F.col("node_type").isin(*SYMBOLS)).select("node_id", "node_type", "exported").join(handlers, "node_id", "left").join(touched, "node_id", "left")
    keep = F.coalesce("exported", F.lit(False)) | (F.col("node_type") == "class") | F.col("handles").isNotNull() | (F.coalesce("degree", F.lit(0)) >= least_degree)
    shown = n.filter("symbol_id is not null").select(F.col("symbol_id").alias("node_id"))
    return files.union(entities).union(entries).union(rows.filter(keep).join(shown, "node_id", "left_anti").select("node_id"))


def equivalents(graph: EvidenceGraph) -> DataFrame:
    """(node_id, same_id) besides a node itself: an endpoint's entrypoint and back, an
    entity's symbol and back, an entrypoint's handler, and the symbols whose lines strictly
    contain a symbol's, with their entities."""
    n = graph.nodes
    ends = n.filter("entrypoint_id is not null").select("node_id", F.col("entrypoint_id").alias("same_id"))
    stand = n.filter("symbol_id is not null").select("node_id", F.col("symbol_id").alias("same_id"))
    back = lambda df: df.select(F.col("same_id").alias("node_id"), F.col("node_id").alias("same_id"))
    handled = n.filter("node_type = 'entrypoint' and handler_symbol_id is not null").select("node_id", "handler_symbol_id")
    ranges = n.filter(F.col("node_type").isin(*SYMBOLS) & F.col("line_start").isNotNull()).select("file_id", "node_id", "line_start", "line_end")
    outer = containing(ranges, ranges).select(F.col("inner_id").alias("node_id"), F.col("outer_id").alias("same_id"))
    outside = outer.join(back(stand).toDF("same_id", "entity"), "same_id").select("node_id", F.col("entity").alias("same_id"))
    return ends.union(back(ends)).union(stand).union(back(stand)).union(handled).union(outer).union(outside).distinct()


def contract_coverage(graph: EvidenceGraph, items: DataFrame) -> DataFrame:
    """(contract_id, node_id): the nodes that ``items`` (contract_id, node_id) name, and
    all that those contain."""
    inside = stored(graph.edges.filter("type = 'CONTAINS'").select(F.col("source").alias("node_id"), "target").distinct(), "inside")
    out = stored(items.select("contract_id", "node_id").distinct(), "contract")
    new, n = out, 1
    while n:  # containment is a level or two deep
        step = new.join(inside, "node_id").select("contract_id", F.col("target").alias("node_id")).distinct()
        new, n = stored_counted(step.join(dealt(out), ["contract_id", "node_id"], "left_anti"), "contract")
        out = out.union(new)
    return dealt(out)


def classify(graph: EvidenceGraph, nodes: DataFrame, covered: DataFrame, found: DataFrame) -> DataFrame:
    """(node_id, class, reachability, explained) for ``nodes`` (node_id): explained where
    ``covered`` (node_id) holds it or an equivalent; the class says what else it may be,
    by path, type and how the statuses ``found`` (node_id, status) reach it."""
    same = nodes.select("node_id", F.col("node_id").alias("same_id")).union(nodes.join(equivalents(graph), "node_id"))
    hit = same.join(covered.select(F.col("node_id").alias("same_id")).distinct(), "same_id", "left_semi").select("node_id", F.lit(True).alias("explained")).distinct()
    n = graph.nodes.select("node_id", "node_type", "path", "exposure")
    rows = nodes.join(n, "node_id").join(found.select("node_id", "status"), "node_id", "left").join(hit, "node_id", "left")
    t, p, r = F.col("node_type"), F.coalesce("path", F.lit("")), F.col("status")
    kind = (
        F.when(p.rlike(GENERATED_PATH), "generated/vendor").when((t == "file") & p.rlike(DOCUMENTATION_PATH), "documentation").when(t == "file", "configuration")
        .when((t == "test") | is_test_path(p), "test").when((t == "config") | p.rlike(CONFIG_PATH), "configuration")
        .when((t == "entrypoint") & (F.col("exposure") == "startup"), "infrastructure").when(t.isin("entrypoint", "endpoint", "component", "screen", "schema", "event", "class"), "feature")
        .when(r == "externally_reachable", "feature").when(r == "internally_reachable", "infrastructure").when(t.isin("function", "variable"), "utility").otherwise("unknown")
    )
    return rows.select("node_id", kind.alias("class"), F.coalesce("status", F.lit("unknown")).alias("reachability"), F.coalesce("explained", F.lit(False)).alias("explained"))


def cascade(graph: EvidenceGraph, findings: DataFrame) -> DataFrame:
    """``findings`` of ``classify`` with ``accounted`` and ``pass``: what needs no
    explanation by its class; then documentation, what tests alone reach, utilities of
    script folders, and features in a file with a symbol that is not unexplained."""
    n = graph.nodes.select("node_id", "node_type", "path", F.coalesce("file_id", F.when(F.col("node_type") == "file", F.col("node_id"))).alias("file_id"))
    rows = stored(findings.join(n, "node_id"), "findings")
    open_ = rows.filter(~F.col("explained")).select("node_id")
    told = n.filter(F.col("node_type").isin(*SYMBOLS)).join(open_, "node_id", "left_anti").select("file_id", F.lit(True).alias("told")).distinct()
    rows = rows.join(told, "file_id", "left")
    c, r, p = F.col("class"), F.col("reachability"), F.coalesce("path", F.lit(""))
    support = c.isin("test", "configuration", "generated/vendor") | (c.isin("infrastructure", "utility") & (r != "unknown"))
    step = (
        F.when(F.col("explained"), "explained").when(support, "support").when((F.col("node_type") == "file") & p.rlike(DOCUMENTATION_PATH), "documentation")
        .when((r == "test_only") | is_test_path(p), "test").when((c == "utility") & p.rlike(SCRIPT_PATH), "script")
        .when((c == "feature") & (r == "externally_reachable") & F.col("told").isNotNull() & (F.col("node_type") != "entrypoint"), "same_file")
    )
    rows = rows.withColumn("pass", F.coalesce(step, F.lit("none")))
    return rows.select("node_id", F.when(F.col("pass") == "test", "test").otherwise(c).alias("class"), "reachability", "explained", "pass", (F.col("pass") != "none").alias("accounted"))


def investigated(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """``cascade``'s rows with the classes of ``answers`` (node_id, class) in their place;
    those of a support class are accounted."""
    rows = findings.join(answers.select("node_id", F.col("class").alias("_new")).dropDuplicates(["node_id"]), "node_id", "left")
    support = F.col("_new").isin("infrastructure", "utility", "test", "configuration", "dead/unreachable", "generated/vendor")
    kind = F.when(F.col("explained"), F.col("class")).otherwise(F.coalesce("_new", F.col("class")))
    return rows.select("node_id", kind.alias("class"), "reachability", "explained", "pass", (F.col("accounted") | F.coalesce(support, F.lit(False))).alias("accounted"))


def summary(findings: DataFrame) -> DataFrame:
    """One row of ``cascade``'s counts and the accounted percentage, to two places."""
    n, known = F.count(F.lit(1)), F.count_if("accounted")
    percent = F.when(n > 0, F.floor(known * 10000.0 / n + 0.5) / 100).otherwise(100.0)
    doubtful = ~F.col("accounted") & ((F.col("class") == "unknown") | (F.col("reachability") == "unknown"))
    return findings.agg(n.alias("nodes"), known.alias("accounted"), F.count_if("explained").alias("explained"), F.count_if(doubtful).alias("suspicious"), percent.alias("percent"))


def verification(claims: DataFrame) -> DataFrame:
    """``claims`` (claim_id, review, roles, unresolved, needs_implementation) with the
    ``status`` that their review and the roles of their evidence give."""
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    run, built = F.array_contains(roles, "runtime"), F.array_contains(roles, "implementation")
    status = (
        F.when(F.col("review") == "REFUTED", "CONTRADICTED").when(F.col("review") == "PARTIALLY_TRUE", "PARTIALLY_VERIFIED").when(F.coalesce("review", F.lit("")) != "CONFIRMED", "UNRESOLVED")
        .when(F.col("unresolved"), "PARTIALLY_VERIFIED").when((F.size(roles) > 0) & F.forall(roles, lambda x: x == "documentation"), "DECLARED_ONLY")
        .when(F.col("needs_implementation") & ~built & ~run, "PARTIALLY_VERIFIED").when(run, "RUNTIME_VERIFIED").otherwise("STATIC_VERIFIED")
    )
    return claims.withColumn("status", status)


def acceptance(counts: DataFrame) -> DataFrame:
    """(contract_id, status, failures) of one row of counts for each contract: unparsed,
    diagnostics, converged, unconfirmed, unaccounted, unknown, uncertain, unverified, run."""
    bad = F.filter(F.array(*(F.when(F.col(c) > 0, c) for c in ("unparsed", "diagnostics")), F.when(~F.col("converged"), "converged"), *(F.when(F.col(c) > 0, c) for c in ("unconfirmed", "unaccounted", "unknown", "uncertain", "unverified"))), lambda x: x.isNotNull())
    status = F.when(F.size(bad) > 0, "INCOMPLETE").when(F.col("run") > 0, "RUNTIME_VERIFIED").otherwise("STATICALLY_VERIFIED")
    return counts.select("contract_id", status.alias("status"), F.array_join(bad, "|").alias("failures"))


def score(coverage: Column, verified: Column, contradicted: Column, uncertain: Column, unconfirmed: Column, converged: Column) -> Column:
    """0 to 100: 40 % of the ``coverage`` (0 to 1), 30 % of the share of claims that are
    ``verified`` (0 to 1), 15 % each of certainty and trust. Certainty loses 2 points of
    100 an ``uncertain`` item, 15 at most; trust 4 a ``contradicted`` claim, 20 at most,
    and 2 an ``unconfirmed`` review, 10 at most. 5 points go where it did not converge;
    to one place. Partly verified claims are shown as a deduction but cost nothing here."""
    penalty = lambda n, each, cap: F.least(n * F.lit(float(each)), F.lit(float(cap)))
    certain = 1 - penalty(uncertain, 2, 15) / 100
    trust = F.greatest(F.lit(0.0), 1 - (penalty(contradicted, 4, 20) + penalty(unconfirmed, 2, 10)) / 100)
    raw = 100 * (0.4 * coverage + 0.3 * verified + 0.15 * certain + 0.15 * trust) - F.when(converged, 0.0).otherwise(5.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(raw * 10 + 0.5) / 10))


def deductions(claims: DataFrame, key: str) -> DataFrame:
    """(key, code, points) of what costs a contract points, from a row for each contract
    with its coverage and counts: coverage gap, partly verified (1.5 each, 10 at most),
    contradicted, uncertain, unconfirmed, and not converged."""
    r1 = lambda x: F.floor(x * 10 + 0.5) / 10
    cut = lambda n, each, cap: r1(F.least(F.col(n) * F.lit(float(each)), F.lit(float(cap))))
    rows = F.array(
        F.struct(F.lit("unexplained_coverage").alias("code"), F.when(40 * (1 - F.col("coverage")) > 0.5, r1(40 * (1 - F.col("coverage")))).alias("points")),
        *(F.struct(F.lit(code).alias("code"), F.when(F.col(n) > 0, cut(n, each, cap)).alias("points")) for code, n, each, cap in (("partially_verified_claim", "partial", 1.5, 10), ("contradicted_claim", "contradicted", 4, 20), ("unresolved_uncertainty", "uncertain", 2, 15), ("unconfirmed_review", "unconfirmed", 2, 10))),
        F.struct(F.lit("correction_not_converged").alias("code"), F.when(~F.col("converged"), 5.0).alias("points")),
    )
    return claims.select(key, F.explode(F.filter(rows, lambda d: d["points"].isNotNull())).alias("d")).select(key, "d.code", "d.points")


def grade(points: Column) -> Column:
    return F.when(points >= 90, "A").when(points >= 80, "B").when(points >= 70, "C").when(points >= 60, "D").otherwise("F")


def run_statistics(runs: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, low, high, mean, deviation, spread): population deviation."""
    v = F.col(value).cast("double")
    r = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return runs.groupBy(F.col(label).alias("label")).agg(F.count(v).alias("n"), r(F.min(v)).alias("low"), r(F.max(v)).alias("high"), r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("deviation"), r(F.max(v) - F.min(v)).alias("spread"))


def within_budget(rows: DataFrame, keys: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows in ``order`` while the running sum of ``size`` stays within ``budget``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def canonical_ids(found: DataFrame) -> DataFrame:
    """(cluster_id, feature_id): ids of features by what belongs to them, numbered
    where two have the same members."""
    text = F.array_join(F.array_sort(F.collect_set("node_id")), "\n")
    rows = found.groupBy("cluster_id").agg(F.substring(F.sha2(text, 256), 1, 20).alias("h"))
    again = F.row_number().over(Window.partitionBy("h").orderBy("cluster_id"))
    rows = rows.withColumn("k", again)
    return rows.select("cluster_id", F.concat(F.lit("feature-"), "h", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("feature_id"))
