"""Symbol navigation: definitions, callers, callees, importers, consumers, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import EvidenceGraph

SYMBOLS = ("function", "class", "variable")


def definitions(graph: EvidenceGraph, wanted: DataFrame) -> DataFrame:
    """(wanted, node_id, confidence, ambiguous) for names in ``wanted`` (wanted): symbols
    of just that name, else those named so after their last dot, else either of the two
    without case. Confidence is 1, 0.95 or 0.85. Each tier is an equi-join on a key of
    the symbol; a name with no definition gives no row."""
    n = graph.nodes.filter(F.col("node_type").isin(*SYMBOLS)).select("node_id", "name")
    last = F.substring_index("name", ".", -1)
    keys = [(1, F.col("name")), (2, last), (3, F.lower("name")), (3, F.lower(last))]
    keyed = n.select("node_id", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in keys))).alias("k"))
    asked = [(1, F.col("wanted")), (2, F.col("wanted")), (3, F.lower("wanted"))]
    asked = wanted.select("wanted").distinct().select("wanted", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in asked))).alias("k"))
    hits = asked.join(keyed, "k").groupBy("wanted", "node_id").agg(F.min("k.tier").alias("tier"))
    first = hits.join(hits.groupBy("wanted").agg(F.min("tier").alias("tier")), ["wanted", "tier"])
    many = first.groupBy("wanted").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    confidence = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.95).otherwise(0.85)
    return first.join(many, "wanted").select("wanted", "node_id", confidence.alias("confidence"), "ambiguous")


def related(graph: EvidenceGraph, types: tuple[str, ...], direction: str = "in") -> DataFrame:
    """(node_id, other_id, type): neighbours over edges of ``types``, in or out."""
    at, other = ("target", "source") if direction == "in" else ("source", "target")
    e = graph.edges.filter(F.col("type").isin(*types))
    return e.select(F.col(at).alias("node_id"), F.col(other).alias("other_id"), "type").distinct()


def consumers(graph: EvidenceGraph, most: int = 100) -> DataFrame:
    """(node_id, other_id, total): who calls or refers to a symbol, and entrypoints it
    handles; the first ``most`` by id, with the total."""
    uses = related(graph, ("CALLS", "REFERENCES")).select("node_id", "other_id")
    entries = graph.nodes.filter("handler_symbol_id is not null").select(F.col("handler_symbol_id").alias("node_id"), F.col("node_id").alias("other_id"))
    rows = uses.union(entries).distinct()
    totals = rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("node_id").orderBy("other_id")
    rows = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return rows.join(totals, "node_id").select("node_id", "other_id", "total")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``, with the total and the next
    offset (null at the end)."""
    total = df.count()
    more = F.lit(offset + limit if offset + limit < total else None).cast("long")
    return df.orderBy(*order).offset(offset).limit(limit).withColumns({"total": F.lit(total).cast("long"), "next_offset": more})
