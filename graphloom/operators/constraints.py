"""Integrity constraints as queries for violations: (rule, location, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import EDGE_WEIGHTS, EvidenceGraph

SYMBOLS = ("function", "class", "variable")
ENTITIES = ("endpoint", "component", "screen", "schema", "config", "test", "event")
#: Which kinds of nodes each type of edge may join.
ALLOWED = {
    "CONTAINS": [(("file",), (*SYMBOLS, *ENTITIES, "entrypoint"))],
    "IMPORTS": [(("file",), ("file",))],
    "CALLS": [(("function",), ("function",))],
    "REFERENCES": [(("file", "function"), (*SYMBOLS, *ENTITIES))],
    "HANDLED_BY": [(("endpoint",), ("function",))],
    "VALIDATED_BY": [(("function",), ("schema",))],
    "TESTED_BY": [(SYMBOLS, ("test",))],
    "RENDERS": [(("function",), ("function",)), (("component", "screen"), ("component", "screen"))],
    "PUBLISHES": [(("function",), ("event",))],
    "SUBSCRIBES_TO": [(("function",), ("event",))],
    "CONFIGURED_BY": [(("file",), ("config",))],
}


def _found(df: DataFrame, rule: str, location: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), location.alias("location"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def graph_violations(graph: EvidenceGraph) -> DataFrame:
    """Every violation at once: keys, references, kinds, line ranges, entrypoints, edge
    kinds, evidence owners and repeated edges."""
    n, e, c = graph.nodes, graph.edges, F.col
    ids = n.select(c("node_id").alias("id"), c("node_type").alias("kind"), F.coalesce("file_id", "node_id").alias("owner"))
    files = n.filter("node_type = 'file'").select(c("node_id").alias("id"))
    out = [
        _found(n.groupBy("node_id").count().filter("count > 1"), "node_key", c("node_id"), c("count")),
        _found(n.filter("node_type != 'file'").join(files, c("file_id") == c("id"), "left_anti"), "file_reference", c("node_id"), c("file_id")),
        _found(n.filter("handler_symbol_id is not null").join(ids, c("handler_symbol_id") == c("id"), "left_anti"), "handler_reference", c("node_id"), c("handler_symbol_id")),
        _found(n.filter("entrypoint_id is not null").join(ids, c("entrypoint_id") == c("id"), "left_anti"), "entrypoint_reference", c("node_id"), c("entrypoint_id")),
        _found(n.filter(~c("node_type").isin("file", "entrypoint", *SYMBOLS, *ENTITIES)), "node_kind", c("node_id"), c("node_type")),
        _found(n.filter("line_start < 1 or line_end < line_start"), "line_range", c("node_id"), c("line_start")),
        _found(n.filter("node_type = 'entrypoint' and not coalesce(exposure in ('external', 'startup'), false)"), "exposure", c("node_id"), c("exposure")),
        _found(n.filter("node_type = 'entrypoint' and entry_kind in ('http', 'websocket') and http_method is null"), "http_method", c("node_id"), c("entry_kind")),
        _found(e.filter(~c("type").isin(*EDGE_WEIGHTS)), "edge_type", c("source"), c("type")),
    ]
    for end in ("source", "target"):
        out.append(_found(e.join(ids, c(end) == c("id"), "left_anti"), f"edge_{end}", c(end), c("type")))
    ends = e.join(ids.select(c("id").alias("source"), c("kind").alias("sk"), c("owner").alias("so")), "source").join(ids.select(c("id").alias("target"), c("kind").alias("tk"), c("owner").alias("to")), "target")
    good = F.lit(False)
    for kind, pairs in ALLOWED.items():
        for left, right in pairs:
            good = good | ((c("type") == kind) & c("sk").isin(*left) & c("tk").isin(*right))
    out.append(_found(ends.filter(~good & c("type").isin(*EDGE_WEIGHTS)), "edge_kinds", c("source"), F.concat_ws(" ", "sk", "type", "tk")))
    owner = F.when(c("type") == "TESTED_BY", c("to")).otherwise(c("so"))
    out.append(_found(ends.filter(c("ev_file").isNotNull() & (F.concat(F.lit("file:"), c("ev_file")) != owner)), "evidence_owner", c("source"), c("ev_file")))
    again = e.groupBy("source", "target", "type", "ev_file", "ev_line", "ev_extractor").count().filter("count > 1")
    out.append(_found(again, "edge_repeated", c("source"), c("target")))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total
