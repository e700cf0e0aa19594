"""Review of drafts: what sources to read beside a claim, which references a claim may
not make, what a run's own account gets wrong, and which files have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import EvidenceGraph

#: How near an edge brings its other end; types not named come last, at 4.
CONTEXT_PRIORITY = {"HANDLED_BY": 1, "VALIDATED_BY": 1, "TESTED_BY": 1, "CALLS": 2, "RENDERS": 2, "PUBLISHES": 2, "SUBSCRIBES_TO": 2, "REFERENCES": 3, "CONFIGURED_BY": 3}
#: Classes that a dossier of a reachability may cite; one that is unknown may cite all.
ALLOWED_CLASSES = {
    "reachable": ("product_reachable", "dynamic_unknown"),
    "internally_reachable": ("startup_reachable", "dynamic_unknown"),
    "test_only": ("test_only", "dynamic_unknown"),
    "dead_or_unreferenced": ("disconnected_candidate", "public_api_unproven", "dynamic_unknown"),
}
#: The only class that its entrypoints may have.
ENTRY_CLASSES = {"reachable": "product_reachable", "internally_reachable": "startup_reachable"}


def independent_context(graph: EvidenceGraph, candidates: DataFrame, sources: DataFrame, limit: int = 12) -> DataFrame:
    """(target, node_id, priority, place): for each review target's ``candidates`` (target,
    node_id) the ``limit`` nearest other ``sources`` (node_id): 0 the file that owns a
    candidate, else by edge type either way, ties by id. Containment doesn't count, and
    what is a candidate of any target is none here (after the cut, as it takes a place)."""
    names = F.create_map(*(F.lit(x) for kv in CONTEXT_PRIORITY.items() for x in kv))
    near = F.coalesce(F.try_element_at(names, F.col("type")), F.lit(4))
    e = graph.edges.filter("type != 'CONTAINS'").select("source", "target", near.alias("priority"))
    links = e.select(F.col("source").alias("node_id"), F.col("target").alias("other"), "priority").union(e.select("target", "source", "priority"))
    owners = graph.nodes.filter("node_type != 'file' and file_id is not null").select("node_id", F.col("file_id").alias("other"), F.lit(0).alias("priority"))
    links = links.union(owners).groupBy("node_id", "other").agg(F.min("priority").alias("priority"))
    own = candidates.select("target", "node_id").distinct()
    found = own.join(links, "node_id").groupBy("target", "other").agg(F.min("priority").alias("priority")).withColumnRenamed("other", "node_id")
    found = found.join(own, ["target", "node_id"], "left_anti").join(sources.select("node_id").distinct(), "node_id", "left_semi")
    order = Window.partitionBy("target").orderBy("priority", "node_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return best.join(own.select("node_id").distinct(), "node_id", "left_anti").select("target", "node_id", "priority", "place")


def draft_violations(dossiers: DataFrame, references: DataFrame, entries: DataFrame) -> DataFrame:
    """(dossier_id, field, node_id, class): ``references`` (dossier_id, field, node_id) to
    a node whose ledger class (``entries``: node_id, class) the reachability of the
    dossier (``dossiers``: dossier_id, reachability) doesn't allow. Nodes without a class
    are no violation, nor is anything of an unknown reachability."""
    rows = references.join(dossiers, "dossier_id").join(entries.select("node_id", "class"), "node_id")
    allowed = F.col("reachability") == "unknown"
    for kind, classes in ALLOWED_CLASSES.items():
        general = F.col("class").isin(*classes)
        if kind in ENTRY_CLASSES:
            general = F.when(F.col("field") == "entrypoints", F.col("class") == ENTRY_CLASSES[kind]).otherwise(general)
        allowed = allowed | ((F.col("reachability") == kind) & general)
    return rows.filter(~F.coalesce(allowed, F.lit(False))).select("dossier_id", "field", "node_id", "class")


def analysis_violations(totals: DataFrame, unparsed: DataFrame, partial: DataFrame) -> DataFrame:
    """(rule, location) that a run's account breaks: ``totals`` (source_files,
    parsed_files; one row), ``unparsed`` (path) and ``partial`` imports (path, target,
    kind, line). Files must add up, unparsed ones be named once, and partial imports be
    of unparsed files, of a known kind, with a target and a line from 1."""
    names = unparsed.filter("coalesce(path, '') != ''")
    known = names.select("path").distinct()
    found = [
        totals.join(known.agg(F.count(F.lit(1)).alias("n"))).filter("source_files != parsed_files + n or source_files < 0 or parsed_files < 0").select(F.lit("file_count").alias("rule"), F.lit("").alias("location")),
        unparsed.filter("coalesce(path, '') = ''").select(F.lit("unparsed_path"), F.lit("")),
        names.groupBy("path").count().filter("count > 1").select(F.lit("unparsed_repeated"), "path"),
        partial.join(known, "path", "left_anti").select(F.lit("partial_parsed"), F.coalesce("path", F.lit(""))),
        partial.filter("not coalesce(kind in ('recovered-import', 'string-mention'), false)").select(F.lit("partial_kind"), F.coalesce("path", F.lit(""))),
        partial.filter("coalesce(target, '') = ''").select(F.lit("partial_target"), F.coalesce("path", F.lit(""))),
        partial.filter("not coalesce(line >= 1, false)").select(F.lit("partial_line"), F.coalesce("path", F.lit(""))),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def stale_files(indexed: DataFrame, scanned: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(path, change): files that keep a stored graph from being used again, as (path,
    hash) of both differ: ``added``, ``changed`` or ``removed``. ``excluded`` (path) are
    taken out of the scan, so an indexed one counts as removed. A null hash equals null."""
    now = scanned if excluded is None else scanned.join(excluded.select("path"), "path", "left_anti")
    both = indexed.select("path", F.struct(F.col("hash")).alias("was")).join(now.select("path", F.struct(F.col("hash")).alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was.hash").eqNullSafe(F.col("now.hash")), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def coverage_map(recognized: DataFrame, references: DataFrame) -> DataFrame:
    """(id, feature_ids) of every recognized (id): the features of ``references``
    (feature_id, id) that name it, in order, or none; ids that aren't recognized are
    left out. Those with none are the unclassified ones."""
    named = references.groupBy("id").agg(F.array_sort(F.collect_set("feature_id")).alias("feature_ids"))
    return recognized.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("feature_ids", F.array().cast("array<string>")).alias("feature_ids"))


def support_accounted(classification: Column, reachability: Column, investigated: Column) -> Column:
    """Whether a finding of coverage is support code that needs no feature: tests,
    configuration, generated code, and infrastructure and utilities unless their
    reachability is unknown; once investigated, those and dead code whatever theirs.
    A null is no support; a null reachability counts as known, a null flag as not yet."""
    always = classification.isin("test", "configuration", "generated/vendor")
    helping = classification.isin("infrastructure", "utility")
    later = F.coalesce(investigated, F.lit(False)) & (helping | (classification == "dead/unreachable"))
    return F.coalesce(always | later | (helping & F.coalesce(reachability != "unknown", F.lit(True))), F.lit(False))
