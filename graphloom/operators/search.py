"""Ranked lexical search and the neighbourhood of its seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal
from ..plans.graph import EvidenceGraph


def field_score(field: Column, query: Column, priority: Column) -> Column:
    """Exact 1000, prefix 850, within 750, all tokens 650, each plus the field's
    priority; null where nothing matches. Both sides in normal form."""
    every = F.size(F.array_except(F.split(query, " "), F.split(field, " "))) == 0
    base = F.when(field == query, 1000).when(field.startswith(query), 850).when(field.contains(query), 750).when(every, 650)
    return F.when((query != "") & (field != ""), base) + priority


def scores(graph: EvidenceGraph, query: str) -> DataFrame:
    """(node_id, score) of every node that matches: the best field's score, or 500
    where the tokens are found across fields."""
    n, q = graph.nodes, normal(F.lit(query))
    is_file = F.col("node_type") == "file"
    fields = {
        "node_id": F.lit(5),
        "node_type": F.lit(10),
        "entry_kind": F.lit(25),
        "path": F.when(is_file, 50).otherwise(20),
        "language": F.lit(15),
        "name": F.lit(50),
    }
    texts = {f: normal(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    best = F.greatest(*(F.coalesce(field_score(texts[f], q, p), F.lit(0)) for f, p in fields.items()))
    across = F.size(F.array_except(F.split(q, " "), F.split(F.concat_ws(" ", *texts.values()), " "))) == 0
    score = F.when(best > 0, best).when(across & (q != ""), 500)
    return n.select("node_id", score.cast("long").alias("score")).filter("score is not null")


def seeds(found: DataFrame, most: int = 5) -> DataFrame:
    return found.orderBy(F.col("score").desc(), "node_id").limit(most)


def neighbourhood(graph: EvidenceGraph, start: DataFrame, max_depth: int = 2, max_nodes: int = 50) -> DataFrame:
    """(place, node_id, depth, truncated) around ``start`` (node_id, score), edges both ways, in the
    order of a queue: seeds by score and id; then each node's own neighbours by how they
    are linked (handler 0, call 1, import 2, other 3) and id. The first ``max_nodes``
    stay; ``truncated`` says whether some node next to them was left out. A round's
    frontier has ``max_nodes`` rows at most, whatever the graph."""
    e, spark = graph.edges, start.sparkSession
    how = F.when(F.col("type") == "CALLS", 1).when(F.col("type") == "IMPORTS", 2).otherwise(3)
    handled = graph.nodes.filter("node_type = 'entrypoint' and handler_symbol_id is not null").select("node_id", "handler_symbol_id", F.lit(0))
    both = e.select("source", "target", how.alias("p")).union(handled)
    links = both.union(both.select("target", "source", "p")).toDF("source", "target", "p")
    picked = [(i, r["node_id"], 0) for i, r in enumerate(start.orderBy(F.col("score").desc(), "node_id").limit(max_nodes).collect())]
    schema = "place int, node_id string, depth int"
    front = picked
    for depth in range(1, max_depth + 1):
        room = max_nodes - len(picked)
        if not front or not room:
            break
        seen = F.broadcast(spark.createDataFrame(picked, schema).select(F.col("node_id").alias("target")))
        step = links.join(F.broadcast(spark.createDataFrame(front, schema).select("place", F.col("node_id").alias("source"))), "source").join(seen, "target", "left_anti")
        step = step.groupBy("target").agg(F.min(F.struct("place", "p")).alias("by")).orderBy("by.place", "by.p", "target").limit(room).collect()
        front = [(len(picked) + i, r["target"], depth) for i, r in enumerate(step)]
        picked += front
    out = spark.createDataFrame(picked, schema)
    inside = F.broadcast(out.select(F.col("node_id").alias("source")))
    left = links.join(inside, "source", "left_semi").join(F.broadcast(out.select(F.col("node_id").alias("target"))), "target", "left_anti").limit(1).count() > 0
    return out.withColumn("truncated", F.lit(left))


def induced_edges(graph: EvidenceGraph, nodes: DataFrame, most: int = 100) -> DataFrame:
    """Edges with both ends in ``nodes`` (node_id, depth), nearest first: by the larger
    depth, by kind (call, import, other), by ends, type and evidence; the first ``most``."""
    a = nodes.select(F.col("node_id").alias("source"), F.col("depth").alias("ds"))
    b = nodes.select(F.col("node_id").alias("target"), F.col("depth").alias("dt"))
    e = graph.edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target")
    how = F.when(F.col("type") == "CALLS", 1).when(F.col("type") == "IMPORTS", 2).otherwise(3)
    rows = e.select("source", "target", "type", F.greatest("ds", "dt").alias("depth"), how.alias("p"), F.coalesce("ev_file", F.lit("")).alias("f"), F.coalesce("ev_line", F.lit(0)).alias("l"), "ev_extractor")
    return rows.orderBy("depth", "p", "source", "target", "type", "f", "l", "ev_extractor").limit(most).select("source", "target", "type", "depth")


def symbol_scores(graph: EvidenceGraph, query: str, most: int = 50) -> DataFrame:
    """(node_id, score): symbols that hold every token of ``query`` in name, type, path
    or id: by exact name 1000, with the query in the name 800, in the path 600, in the
    id 500, else 400; the first ``most`` by score and id."""
    n = graph.nodes.filter(F.col("node_type").isin("function", "class", "variable"))
    q, name, path, own = normal(F.lit(query)), normal(F.col("name")), normal(F.coalesce("path", F.lit(""))), normal(F.col("node_id"))
    every = F.concat_ws(" ", name, F.col("node_type"), path, own)
    score = F.when(name == q, 1000).when(name.contains(q), 800).when(path.contains(q), 600).when(own.contains(q), 500).otherwise(400)
    rows = n.filter((q != "") & F.forall(F.split(q, " "), lambda t: F.contains(every, t)))
    return rows.select("node_id", score.cast("long").alias("score")).orderBy(F.col("score").desc(), "node_id").limit(most)


def rank_within(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("r") <= most).drop("r")
