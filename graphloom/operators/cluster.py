"""Feature clusters: what each external entrypoint brings with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, stored
from ..functions.text import basename, round6, slug, tokens
from ..functions.unique import numbered
from ..plans.graph import EDGE_WEIGHTS, EvidenceGraph
from .reach import whole_ledger
from .traverse import components, propagate


def weighted_edges(graph: EvidenceGraph, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, target, weight, step): edges by type, events back to their subscribers,
    methods with their class and its only constructor, and equivalent nodes."""
    e, n, w = graph.edges, graph.nodes, EDGE_WEIGHTS | (weights or {})
    table = F.create_map(*(F.lit(x) for pair in w.items() for x in pair))
    out = e.select("source", "target", F.coalesce(table[F.col("type")], F.lit(0.0)).alias("weight"), F.col("type").alias("step")).filter("weight > 0")
    back = e.filter("type = 'SUBSCRIBES_TO'").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(min(0.82, w["SUBSCRIBES_TO"])), F.lit("EVENT_CONSUMED_BY"))
    twins = n.filter("symbol_id is not null").select("node_id", "symbol_id").union(n.filter("entrypoint_id is not null").select("node_id", "entrypoint_id")).toDF("a", "b")
    same = twins.union(twins.select("b", "a")).select("a", "b", F.lit(1.0), F.lit("EQUIVALENT_TO"))
    methods = n.filter("node_type = 'function' and name like '%.%'").select(F.col("node_id").alias("m"), "file_id", F.substring_index("name", ".", 1).alias("class"), F.substring_index("name", ".", -1).alias("own"))
    classes = n.filter("node_type = 'class'").select(F.col("node_id").alias("c"), "file_id", F.col("name").alias("class"))
    member = methods.join(classes, ["file_id", "class"]).select("m", "c", F.lit(0.72), F.lit("MEMBER_OF"))
    made = methods.filter(F.col("own").isin("__init__", "constructor")).groupBy("file_id", "class").agg(F.min("m").alias("k"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    init = methods.join(made, ["file_id", "class"]).filter("m != k").select("m", "k", F.lit(0.78), F.lit("INITIALIZED_BY"))
    return out.union(back).union(same).union(member).union(init)


def seeds(graph: EvidenceGraph) -> DataFrame:
    """(cluster_id, node_id, score): external entrypoints with handlers and endpoints."""
    n = graph.nodes
    entry = n.filter("node_type = 'entrypoint' and exposure = 'external'")
    own = entry.select(F.col("node_id").alias("cluster_id"), "node_id")
    handler = entry.filter("handler_symbol_id is not null").select("node_id", "handler_symbol_id")
    ends = n.filter("entrypoint_id is not null").join(entry.select(F.col("node_id").alias("id")), F.col("entrypoint_id") == F.col("id"), "left_semi").select("entrypoint_id", "node_id")
    return own.union(handler).union(ends).toDF("cluster_id", "node_id").withColumn("score", F.lit(1.0))


def paths(graph: EvidenceGraph, threshold: float = 0.28, max_depth: int = 12, weights: dict[str, float] | None = None, factor: float = 0.72) -> DataFrame:
    """(cluster_id, node_id, score, kin) by best products of weights; then the members'
    files, and what those or other members are configured by, once and not onward."""
    best = F.max(F.struct("score", (~F.col("kin")).alias("plain"))).alias("b")
    keep = lambda df: df.groupBy("cluster_id", "node_id").agg(best).select("cluster_id", "node_id", "b.score", (~F.col("b.plain")).alias("kin"))
    near = F.col("score") + 1e-9 >= threshold
    found = stored(propagate(seeds(graph), weighted_edges(graph, weights), threshold, max_depth).select("cluster_id", "node_id", "score", "kin"), "members")
    own = graph.nodes.filter("file_id is not null").select("node_id", "file_id")
    files = found.join(own, "node_id").select("cluster_id", F.col("file_id").alias("node_id"), (F.col("score") * factor).alias("score"), "kin").filter(near)
    both = stored(keep(found.unionByName(files)), "with-files")
    set_by = graph.edges.filter("type = 'CONFIGURED_BY'").select(F.col("source").alias("node_id"), "target").distinct()
    weight = (EDGE_WEIGHTS | (weights or {}))["CONFIGURED_BY"]
    config = both.join(set_by, "node_id").select("cluster_id", F.col("target").alias("node_id"), (F.col("score") * weight).alias("score"), "kin").filter(near)
    return keep(both.unionByName(config))


def roles(graph: EvidenceGraph) -> DataFrame:
    """(node_id, role): what a node is to a feature."""
    handlers = graph.nodes.filter("handler_symbol_id is not null").select(F.col("handler_symbol_id").alias("node_id"), F.lit(True).alias("handles")).distinct()
    kind = F.col("node_type")
    role = F.when(kind.isin("entrypoint", "endpoint"), "entrypoint").when(kind.isin("component", "screen"), "ui").when(kind.isin("schema", "event", "test", "config", "file"), kind).when(F.col("handles"), "handler").otherwise("service")
    return graph.nodes.select("node_id", "node_type").join(handlers, "node_id", "left").select("node_id", role.alias("role"))


def members(graph: EvidenceGraph, entries: DataFrame, threshold: float = 0.28, max_depth: int = 12, weights: dict[str, float] | None = None) -> DataFrame:
    """(cluster_id, node_id, role, score, class) of what belongs to each external
    entrypoint: of its ``paths``, what product code reaches by the ledger ``entries``
    (node_id, file_id, class), tests in a test's role, and unproven nodes that a class
    context brought in."""
    entries = stored(entries.select("node_id", "file_id", "class"), "ledger")  # read twice; one plan with all joins has the driver compile and hold too much at once
    rows = paths(graph, threshold, max_depth, weights).join(roles(graph), "node_id").join(dealt(whole_ledger(entries)), "node_id", "left")
    rows = rows.withColumn("class", F.coalesce("class", F.lit("dynamic_unknown")))
    ok = (F.col("class") == "product_reachable") | ((F.col("class") == "test_only") & (F.col("role") == "test")) | (F.col("class").isin("dynamic_unknown", "disconnected_candidate") & F.col("kin"))
    return rows.filter(ok).select("cluster_id", "node_id", "role", round6(F.col("score")).alias("score"), "class")


def violations(found: DataFrame) -> DataFrame:
    """Members that the ledger doesn't let into a feature: a right clustering has none.
    Startup and public-API nodes never belong, test-only ones only as tests."""
    return found.filter("class in ('startup_reachable', 'public_api_unproven') or (class = 'test_only' and role != 'test')").select("cluster_id", "node_id", "class")


def owning_files(found: DataFrame) -> DataFrame:
    """(cluster_id, node_id, score): the files among the members."""
    return found.filter("role = 'file'").select("cluster_id", "node_id", "score")


def shared_nodes(found: DataFrame, least: float = 0.4) -> DataFrame:
    """(node_id, clusters): members that two clusters or more hold at ``least``, other
    than entrypoints, handlers, tests and files."""
    rows = found.filter(~F.col("role").isin("entrypoint", "handler", "test", "file") & (F.col("score") + 1e-9 >= least))
    return rows.groupBy("node_id").agg(F.countDistinct("cluster_id").alias("clusters")).filter("clusters >= 2")


def subsystems(graph: EvidenceGraph, shared: DataFrame) -> DataFrame:
    """(node_id, component): shared nodes joined by edges between them or by a file;
    a file's nodes are joined as a star to its least node."""
    ids = shared.select("node_id")
    e = graph.edges.filter("type not in ('CONTAINS', 'IMPORTS')").select("source", "target")
    e = e.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    own = dealt(graph.nodes.filter("file_id is not null").select("node_id", "file_id").join(ids, "node_id", "left_semi"))
    hub = own.groupBy("file_id").agg(F.min("node_id").alias("hub"))
    star = own.join(hub, "file_id").select(F.col("node_id").alias("source"), F.col("hub").alias("target"))
    joined = components(e.unionByName(star))
    return ids.join(joined, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def subsystem_members(graph: EvidenceGraph, joined: DataFrame) -> DataFrame:
    """(component, node_id): ``subsystems`` with their files and all symbols and entities
    of those files."""
    own = graph.nodes.filter("file_id is not null")
    files = joined.join(own.select("node_id", "file_id"), "node_id").select("component", "file_id").distinct()
    inside = files.join(own.filter("node_type != 'entrypoint'").select("node_id", "file_id"), "file_id").select("component", "node_id")
    return joined.select("component", "node_id").union(files.select("component", F.col("file_id"))).union(inside).distinct()


def subsystem_labels(graph: EvidenceGraph, joined: DataFrame) -> DataFrame:
    """(component, id, label): the token with most votes of a component's nodes, one for
    each node's name and two for its file's; ties to the longer and then the first."""
    stem = F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", "")
    n = graph.nodes.select("node_id", F.explode(F.concat(F.transform(tokens(F.coalesce("name", F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(1).alias("votes"))), F.when(F.col("file_id").isNotNull(), F.transform(tokens(stem), lambda t: F.struct(t.alias("term"), F.lit(2).alias("votes")))).otherwise(F.array().cast("array<struct<term:string,votes:int>>")))).alias("t"))
    votes = joined.join(n, "node_id").groupBy("component", "t.term").agg(F.sum("t.votes").alias("votes"))
    best = votes.groupBy("component").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.length("term")).alias("l"), "term")).alias("b"))
    named = joined.select("component").distinct().join(best, "component", "left").withColumn("label", F.concat(F.initcap(F.coalesce("b.term", F.lit("shared"))), F.lit(" subsystem")))
    named = numbered(named.select("component", "label"), ["component"])
    return named.select("component", F.concat(F.lit("subsystem:"), slug(F.col("label")), F.lit(":"), F.col("place").cast("string")).alias("id"), "label")


def unassigned(graph: EvidenceGraph, found: DataFrame, joined: DataFrame) -> DataFrame:
    """(node_id, reason): symbols and entities of no cluster and no subsystem, isolated
    where no edge but containment and import touches them. Endpoints, tests, configs,
    symbols that stand for a config or test, and files with a test are left out."""
    n = graph.nodes.filter("node_type not in ('file', 'entrypoint', 'endpoint', 'test', 'config')").select("node_id", "file_id")
    support = graph.nodes.filter("node_type in ('config', 'test') and symbol_id is not null").select(F.col("symbol_id").alias("node_id"))
    tests = graph.nodes.filter("node_type = 'test'").select("file_id")
    taken = found.select("node_id").union(subsystem_members(graph, joined).select("node_id")).union(support)
    touched = graph.edges.filter("type not in ('CONTAINS', 'IMPORTS')").select(F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("hit", F.lit(True))
    rows = n.join(taken, "node_id", "left_anti").join(tests, "file_id", "left_anti").join(touched, "node_id", "left")
    return rows.select("node_id", F.when(F.col("hit"), "disconnected").otherwise("isolated").alias("reason"))


def statistics(graph: EvidenceGraph, found: DataFrame, loose: DataFrame) -> DataFrame:
    """One row: external entrypoints, nodes in clusters, nodes in more than one, and
    ``unassigned`` nodes."""
    held = found.groupBy("node_id").agg(F.countDistinct("cluster_id").alias("n")).agg(F.count(F.lit(1)).alias("clustered_nodes"), F.count_if(F.col("n") > 1).alias("overlapping_nodes"))
    entries = graph.nodes.agg(F.count_if((F.col("node_type") == "entrypoint") & (F.col("exposure") == "external")).alias("external_entrypoints"))
    return entries.crossJoin(held).crossJoin(loose.agg(F.count(F.lit(1)).alias("unassigned_nodes")))  # one row each


def impact(found: DataFrame) -> DataFrame:
    """(node_id, clusters, cluster_ids): the blast radius of every member."""
    return found.groupBy("node_id").agg(F.countDistinct("cluster_id").alias("clusters"), F.array_join(F.array_sort(F.collect_set("cluster_id")), "|").alias("cluster_ids"))


def match_documents(claims: DataFrame, targets: DataFrame, least: float = 0.12, near_best: float = 0.8) -> DataFrame:
    """(claim_id, target_id, score): targets by the overlap of tokens weighed by inverse
    document frequency over ``targets`` (target_id, text), as a share of the claim's own
    weight; those under ``least`` or under ``near_best`` of the claim's best go."""
    t = targets.select("target_id", F.explode(tokens(F.col("text"))).alias("token"))
    n = targets.count()
    weigh = t.groupBy("token").agg((F.log((F.lit(n) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("w"))
    c = claims.select("claim_id", F.explode(tokens(F.col("text"))).alias("token")).join(weigh, "token", "left").withColumn("w", F.coalesce("w", F.lit(0.0) + F.log(F.lit(n) + 1.0) + 1))
    total = c.groupBy("claim_id").agg(F.sum("w").alias("all_w"))
    hits = c.join(t, "token").groupBy("claim_id", "target_id").agg(F.sum("w").alias("w")).join(total, "claim_id")
    hits = hits.withColumn("score", F.col("w") / F.col("all_w")).withColumn("best", F.max("score").over(Window.partitionBy("claim_id")))
    return hits.filter((F.col("score") >= least) & (F.col("score") >= F.col("best") * near_best)).select("claim_id", "target_id", round6(F.col("score")).alias("score"))
