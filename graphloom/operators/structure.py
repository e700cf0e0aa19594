"""Structural components: files by what joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import group_key, slashed
from ..functions.storage import stored
from ..functions.text import directory
from ..plans.graph import EvidenceGraph


def file_edges(graph: EvidenceGraph) -> DataFrame:
    """(a, b, weight): edges between nodes as undirected edges between their files."""
    own = graph.nodes.select("node_id", F.coalesce("file_id", "node_id").alias("file"))
    e = graph.edges.filter("type != 'CONTAINS'").join(own.select(F.col("node_id").alias("source"), F.col("file").alias("x")), "source").join(own.select(F.col("node_id").alias("target"), F.col("file").alias("y")), "target").filter("x != y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def communities(edges: DataFrame) -> DataFrame:
    """(file, community) by weighted label propagation: a file takes the label with most
    weight around it (its own label counts once more), ties to the least label, until no
    file has a better one. No two neighbours move in one round, so each move adds to the
    weight inside communities and it settles. The same for any order of the input."""
    both = stored(edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")).union(edges.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1).cast("long"))).toDF("a", "b", "weight"), "community-edges")
    labels = stored(both.select(F.col("a").alias("file")).distinct().withColumn("community", F.col("file")), "labels")
    r = 0
    while True:
        votes = both.join(labels.withColumnRenamed("file", "b"), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("a").alias("file")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("v")).select("file", F.col("v.community").alias("next"))
        turn = F.struct(F.xxhash64("file", F.lit(r)).alias("h"), "file").alias("turn")
        wish = stored(labels.join(best, "file").filter("next != community").select("file", "next", turn), "wishes")
        if wish.isEmpty():
            return labels
        # a file waits while a neighbour that would move too has a later turn
        rivals = both.join(wish.select(F.col("file").alias("a"), F.col("turn").alias("mine")), "a").join(wish.select(F.col("file").alias("b"), F.col("turn").alias("theirs")), "b")
        moves = wish.join(rivals.filter("theirs > mine").select(F.col("a").alias("file")).distinct(), "file", "left_anti").select("file", "next")
        labels = stored(labels.join(moves, "file", "left").select("file", F.coalesce("next", "community").alias("community")), "labels")
        r += 1


def modal_directories(files: DataFrame) -> DataFrame:
    """(community, directory, n): the most frequent directory of each community's files
    (file, community), ties to the least name."""
    d = files.groupBy("community", directory(F.regexp_replace("file", "^file:", "")).alias("directory")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("community").orderBy(F.col("n").desc(), "directory")
    return d.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def cross_weights(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(x, y, weight): weights of file edges summed by the communities of ``of`` (file,
    community); x = y is a community's inner weight."""
    e = edges.join(of.select(F.col("file").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("file").alias("b"), F.col("community").alias("cb")), "b")
    return e.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.sum("weight").alias("weight"))


def test_and_config_edges(edges: DataFrame, files: DataFrame, tests: DataFrame, configs: DataFrame) -> DataFrame:
    """Edges that references of files imply: TESTED_BY from the target to the test of
    a test file (``tests``: node_id, path), CONFIGURED_BY from the file to the config
    that stands for the target (``configs``: node_id, symbol_id). Evidence is carried."""
    evidence = ["ev_file", "ev_line", "ev_extractor"]
    refs = edges.filter("type = 'REFERENCES'").join(files.select(F.col("node_id").alias("source"), "path"), "source")
    tested = refs.join(tests.select(F.col("node_id").alias("test_id"), "path"), "path").select(F.col("target").alias("source"), F.col("test_id").alias("target"), F.lit("TESTED_BY").alias("type"), *evidence)
    configured = refs.join(configs.select(F.col("node_id").alias("config_id"), F.col("symbol_id").alias("target")), "target").select("source", F.col("config_id").alias("target"), F.lit("CONFIGURED_BY").alias("type"), *evidence)
    return tested.unionByName(configured)


def attach_isolated(members: DataFrame, isolated: DataFrame) -> DataFrame:
    """(path, community) of ``isolated`` files (path): the community of ``members``
    (path, community) whose most frequent two-segment folder lies deepest above the
    file, ties to the least community; else a new one, ``directory:`` and the file's own
    two segments. Each file meets its own folders by equality, so nothing is compared
    with all communities. Repeated files count once; without members all are new."""
    counts = members.distinct().groupBy("community", group_key(F.col("path")).alias("home")).agg(F.count(F.lit(1)).alias("n"))
    home = counts.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "home")).alias("b")).select("community", "b.home")
    home = home.groupBy("home").agg(F.min("community").alias("community"))
    parts = F.split(slashed(F.col("path")), "/")
    above = F.array_compact(F.array(*(F.when(F.size(parts) > k, F.struct(F.lit(k).alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("home"))) for k in (1, 2))))
    tries = isolated.select("path").distinct().select("path", F.explode_outer(above).alias("a")).select("path", "a.depth", "a.home")
    found = tries.join(home, "home", "left").groupBy("path").agg(F.max(F.when(F.col("community").isNotNull(), F.struct("depth", "community"))).alias("b"))
    return found.select("path", F.coalesce("b.community", F.concat(F.lit("directory:"), group_key(F.col("path")))).alias("community"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Each edge once for its ends, type and evidence, by source, target, type, file and
    line; an edge without a line comes as from line 0."""
    key = ["source", "target", "type", "ev_file", "ev_line", "ev_extractor"]
    once = edges.dropDuplicates(key)
    return once.orderBy("source", "target", "type", "ev_file", F.coalesce("ev_line", F.lit(0)))
