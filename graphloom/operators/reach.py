"""Reachability: roots, statuses, and the ledger of product reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..functions.unique import exactly_one
from ..plans.graph import MEANINGFUL, REACHING, EvidenceGraph
from .traverse import bfs

#: Names of startup entrypoints by which React mounts an application.
BOOTSTRAPS = ("React createRoot", "React hydrateRoot", "React render")
LEGACY_RENDER = "React render"
#: The ledger's classes, strongest first.
CLASSES = ("product_reachable", "startup_reachable", "test_only", "dynamic_unknown", "public_api_unproven", "disconnected_candidate")


def roots(graph: EvidenceGraph) -> DataFrame:
    """(kind, node_id): endpoints and files of handler-less external command lines are
    external; startup entrypoints, their handlers, the files of React bootstraps and what
    a legacy render mounts (its file and methods too) are internal; test files are test."""
    n = graph.nodes
    startup = n.filter("node_type = 'entrypoint' and exposure = 'startup'")
    # the component that a legacy render mounts: the only symbol its own line refers to
    mounts = startup.filter(F.col("name") == LEGACY_RENDER).select("file_id", "path", "line_start")
    drawn = graph.edges.filter("type = 'REFERENCES' and ev_extractor = 'tree-sitter'").join(mounts, (F.col("source") == F.col("file_id")) & (F.col("ev_file") == F.col("path")) & (F.col("ev_line") == F.col("line_start")))
    drawn = exactly_one(drawn.select("file_id", "line_start", "target"), ["file_id", "line_start"], "target")
    parts_of = n.filter("node_type in ('function', 'class', 'variable')").select("node_id", "node_type", F.col("file_id").alias("own_file"), "name")
    drawn = drawn.select("target").distinct().join(parts_of, F.col("target") == F.col("node_id"))
    methods = drawn.filter("node_type = 'class'").select("own_file", F.col("name").alias("class_name")).join(parts_of, "own_file").filter(F.col("name").startswith(F.concat("class_name", F.lit("."))))
    parts = [
        n.filter("node_type = 'endpoint'").select(F.lit("external").alias("kind"), "node_id"),
        n.filter("node_type = 'entrypoint' and exposure = 'external' and entry_kind = 'cli' and handler_symbol_id is null").select(F.lit("external"), "file_id"),
        startup.select(F.lit("internal"), "node_id"),
        startup.filter("handler_symbol_id is not null").select(F.lit("internal"), "handler_symbol_id"),
        startup.filter(F.col("name").isin(*BOOTSTRAPS)).select(F.lit("internal"), "file_id"),
        drawn.select(F.lit("internal"), "node_id"),
        drawn.select(F.lit("internal"), "own_file"),
        methods.select(F.lit("internal"), "node_id"),
        n.filter((F.col("node_type") == "file") & is_test_path(F.col("path"))).select(F.lit("test"), "node_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def reach_edges(edges: DataFrame) -> DataFrame:
    """(kind, source, target): imports carry external roots alone."""
    kinds = F.when(F.col("type") == "IMPORTS", F.array(F.lit("external"))).otherwise(F.array(*map(F.lit, ("external", "internal", "test"))))
    return edges.filter(F.col("type").isin(*REACHING, "IMPORTS")).select(F.explode(kinds).alias("kind"), "source", "target").distinct()


def levels(graph: EvidenceGraph, max_depth: int = 20) -> DataFrame:
    return bfs(roots(graph), reach_edges(graph.edges), max_depth)


def equivalent(graph: EvidenceGraph) -> DataFrame:
    """(node_id, same_id): each node with itself, its symbol's entities or its
    entrypoint's endpoints, both ways."""
    n = graph.nodes
    twin = n.filter("symbol_id is not null").select("node_id", F.col("symbol_id").alias("same_id")).union(n.filter("entrypoint_id is not null").select("node_id", "entrypoint_id"))
    return n.select("node_id", F.col("node_id").alias("same_id")).union(twin).union(twin.select("same_id", "node_id")).distinct()


def statuses(graph: EvidenceGraph, found: DataFrame) -> DataFrame:
    """(node_id, status, depth) by least depths over equivalent nodes, in the order
    external, internal, test; else unknown."""
    same = equivalent(graph).join(found.withColumnRenamed("node_id", "same_id"), "same_id")
    least = same.groupBy("node_id").agg(*(F.min(F.when(F.col("kind") == k, F.col("depth"))).alias(k) for k in ("external", "internal", "test")))
    out = graph.nodes.select("node_id").join(least, "node_id", "left")
    status = F.when(F.col("external").isNotNull(), "externally_reachable").when(F.col("internal").isNotNull(), "internally_reachable").when(F.col("test").isNotNull(), "test_only").otherwise("unknown")
    return out.select("node_id", status.alias("status"), F.coalesce("external", "internal", "test").alias("depth"))


def degrees(graph: EvidenceGraph) -> DataFrame:
    """(node_id, degree): meaningful edges at a node; an edge to itself counts twice."""
    e = graph.edges.filter(F.col("type").isin(*MEANINGFUL))
    return e.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def ledger(graph: EvidenceGraph, found: DataFrame, diagnostics: DataFrame | None = None, partial: DataFrame | None = None) -> DataFrame:
    """(node_id, file_id, class) of every owned node. In order: in a test file; reached
    by product roots; by startup; by tests; in a file with diagnostics or target of a
    partial import; has meaningful edges; exported while nothing external exists;
    disconnected. ``diagnostics`` has (file_id), ``partial`` has (target_id)."""
    n = graph.nodes.filter("file_id is not null").select("node_id", "file_id", "path", "exported")
    outside = graph.nodes.filter("node_type = 'entrypoint' and exposure = 'external'").limit(1).count() > 0
    rows = n.join(statuses(graph, found), "node_id").join(degrees(graph), "node_id", "left")
    unsure = F.lit(False)
    if diagnostics is not None:
        rows = rows.join(diagnostics.select("file_id", F.lit(True).alias("_bad")).distinct(), "file_id", "left")
        unsure = unsure | F.col("_bad").isNotNull()
    if partial is not None:
        rows = rows.join(partial.select(F.col("target_id").alias("file_id"), F.lit(True).alias("_part")).distinct(), "file_id", "left")
        unsure = unsure | F.col("_part").isNotNull()
    kind = (
        F.when(is_test_path(F.col("path")), "test_only")
        .when(F.col("status") == "externally_reachable", "product_reachable")
        .when(F.col("status") == "internally_reachable", "startup_reachable")
        .when(F.col("status") == "test_only", "test_only")
        .when(unsure | (F.coalesce("degree", F.lit(0)) > 0), "dynamic_unknown")
        .when(F.coalesce("exported", F.lit(False)) & F.lit(not outside), "public_api_unproven")
        .otherwise("disconnected_candidate")
    )
    return rows.select("node_id", "file_id", kind.alias("class"))


def file_rollup(entries: DataFrame) -> DataFrame:
    """(file_id, class, node_id): the strongest class in a file, ties by node id."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    best = entries.groupBy("file_id").agg(F.min(F.struct(place.alias("p"), "node_id", "class")).alias("b"))
    return best.select("file_id", "b.class", "b.node_id")


def whole_ledger(entries: DataFrame) -> DataFrame:
    """(node_id, class) of owned nodes and of the files that own any."""
    return entries.select("node_id", "class").unionByName(file_rollup(entries).select(F.col("file_id").alias("node_id"), "class"))


def class_counts(entries: DataFrame) -> DataFrame:
    """(class, n) with a row for every class."""
    spark = entries.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    return every.join(entries.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
