"""Iterative graph algorithms as rounds of joins. Each round's new rows are written to
the shared folder, so lineage stays short and a lost executor costs one round. Rounds
carry their number in the rows, not in the plan, so they share their compiled code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dealt, shared_path, stored, stored_counted


def bfs(roots: DataFrame, edges: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """(kind, node_id, depth) for every node that ``roots`` (kind, node_id) reach over
    ``edges`` (kind, source, target) within ``max_depth``; None for no limit. All kinds
    travel in one table; the visited set is the levels written so far. Edges are stored
    once and each round is one job, which counts what it writes. Null ids reach
    nothing; without roots or edges only the roots come back."""
    spark, base = roots.sparkSession, shared_path(roots.sparkSession, "bfs")
    schema = "kind string, node_id string, depth int"
    links = stored(edges.select("kind", "source", "target").distinct(), "links").withColumnRenamed("source", "node_id")
    level = roots.select(F.col("kind").cast("string"), "node_id", F.lit(0).alias("depth")).filter("node_id is not null").distinct()
    depth = 0
    while True:
        frontier, n = stored_counted(level, "bfs", f"{base}/level={depth}")
        if not n or depth == max_depth:
            break
        depth += 1
        step = spark.read.schema(schema).parquet(f"{base}/level={depth - 1}").join(links, ["kind", "node_id"])
        step = step.select("kind", F.col("target").alias("node_id"), (F.col("depth") + 1).alias("depth")).distinct()
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base).select("kind", "node_id")
        level = step.join(dealt(seen), ["kind", "node_id"], "left_anti")
    return dealt(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base))


def shortest_path_counts(roots: DataFrame, edges: DataFrame, max_depth: int | None = 20, limit: float = 2.0**53 - 1) -> DataFrame:
    """(node_id, depth, paths) of what ``roots`` (node_id) reach over ``edges`` (source,
    target, ...): paths of least length, parallel edges apart. Counts are summed in the
    rounds that find the nodes, never listed, and stop at ``limit``."""
    spark, base = roots.sparkSession, shared_path(roots.sparkSession, "paths")
    schema = "node_id string, depth int, paths double"
    links = stored(edges.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("n")), "links").withColumnRenamed("source", "node_id")
    level = roots.select("node_id").filter("node_id is not null").distinct().select("node_id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths"))
    depth = 0
    while True:
        _, n = stored_counted(level, "paths", f"{base}/level={depth}")
        if not n or depth == max_depth:
            break
        depth += 1
        step = spark.read.schema(schema).parquet(f"{base}/level={depth - 1}").join(links, "node_id")
        step = step.groupBy(F.col("target").alias("node_id"), (F.col("depth") + 1).alias("depth")).agg(F.least(F.sum(F.col("paths") * F.col("n")), F.lit(limit)).alias("paths"))
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base).select("node_id")
        level = step.join(dealt(seen), "node_id", "left_anti").select("node_id", "depth", "paths")
    return dealt(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base))


def best_shortest_paths(levels: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` shortest paths to each node (node_id, depth, path), in the order of
    their joined ids. Only the best ``k`` of a node go on, which is exact: a path's
    order is its prefix's order first."""
    from pyspark.sql import Window

    done = stored(levels.filter("depth = 0").select("node_id", "depth", F.array("node_id").alias("path")), "kpaths-0")
    out = done
    deepest = levels.agg(F.max("depth")).first()[0] or 0
    order = Window.partitionBy("node_id").orderBy(F.array_join("path", "\x00"))
    links = edges.select("source", "target").distinct()
    for depth in range(1, deepest + 1):
        now = levels.filter(F.col("depth") == depth).select("node_id")
        step = done.join(links, done["node_id"] == links["source"]).select(F.col("target").alias("node_id"), F.concat("path", F.array("target")).alias("path"))
        step = step.join(now, "node_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
        done = stored(step.select("node_id", F.lit(depth).alias("depth"), "path"), f"kpaths-{depth}")
        out = out.unionByName(done)
    return out


def propagate(seeds: DataFrame, edges: DataFrame, threshold: float = 0.28, max_depth: int = 12) -> DataFrame:
    """Best products of weights from ``seeds`` (cluster_id, node_id, score) over ``edges``
    (source, target, weight, step): (cluster_id, node_id, score, depth, kin), ``kin``
    where the best path has a step of a class context. Rounds append a row only where it
    improves on the best so far by over 1e-9; all clusters travel in one table, and each
    round is one job. Scores under ``threshold`` and steps beyond ``max_depth`` are not
    taken; of equal scores the shorter path stays, then one without such a step."""
    spark, base = seeds.sparkSession, shared_path(seeds.sparkSession, "spread")
    schema = "cluster_id string, node_id string, score double, depth int, kin boolean"
    kin = F.col("step").isin("MEMBER_OF", "INITIALIZED_BY") if "step" in edges.columns else F.lit(False)
    links = edges.filter("weight > 0").groupBy("source", "target").agg(F.max(F.struct("weight", (~kin).alias("plain"))).alias("w"))
    links = stored(links.select(F.col("source").alias("node_id"), "target", "w.weight", (~F.col("w.plain")).alias("via")), "links")
    front = seeds.groupBy("cluster_id", "node_id").agg(F.max("score").alias("score")).select("cluster_id", "node_id", "score", F.lit(0).alias("depth"), F.lit(False).alias("kin"))
    every = spark.read.schema(schema).option("recursiveFileLookup", "true")
    best = F.max(F.struct("score", (-F.col("depth")).alias("depth"), (~F.col("kin")).alias("plain"))).alias("b")
    for depth in range(max_depth + 1):
        _, n = stored_counted(front, "spread", f"{base}/round={depth}")
        if not n or depth == max_depth:
            break
        step = spark.read.schema(schema).parquet(f"{base}/round={depth}").join(links, "node_id")
        step = step.select("cluster_id", F.col("target").alias("node_id"), (F.col("score") * F.col("weight")).alias("score"), (F.col("depth") + 1).alias("depth"), (F.col("kin") | F.col("via")).alias("kin"))
        step = step.filter(F.col("score") + 1e-9 >= threshold).groupBy("cluster_id", "node_id").agg(best)
        had = every.parquet(base).groupBy("cluster_id", "node_id").agg(F.max("score").alias("had"))
        step = step.join(dealt(had), ["cluster_id", "node_id"], "left").filter("had is null or b.score > had + 1e-9")
        front = step.select("cluster_id", "node_id", "b.score", (-F.col("b.depth")).alias("depth"), (~F.col("b.plain")).alias("kin"))
    found = every.parquet(base).groupBy("cluster_id", "node_id").agg(best)
    return found.select("cluster_id", "node_id", "b.score", (-F.col("b.depth")).alias("depth"), (~F.col("b.plain")).alias("kin"))


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least id that each endpoint of the undirected
    ``edges`` (source, target) is joined to. Large-star and small-star rounds, whose
    number grows with the logarithm of the longest chain."""
    edges = stored(edges.select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b")).filter("a != b").distinct(), "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        down = dealt(both.filter("b > a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = dealt(down.groupBy("a").agg(F.min("b").alias("low")))
        flat = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        edges, n = stored_counted(flat.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "cc")
        # stars remain: each member points once, at a root that points at nothing
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
        ends = ends.groupBy("e.v").agg(F.sum("e.out").alias("out"), F.sum("e.into").alias("into"))
        if not n or ends.filter("out > 1 or (out > 0 and into > 0)").isEmpty():
            break
    return edges.select(F.col("a").alias("node_id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node_id"), F.col("b").alias("component")).distinct())
