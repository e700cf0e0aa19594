"""Claims, derived edges and exports on small hand-made inputs."""

from pyspark.sql import functions as F

from graphloom.operators import claims, deadcode, structure
from graphloom.plans.graph import NODE_COLUMNS, EvidenceGraph

EDGE = "source string, target string, type string, ev_file string, ev_line int, ev_extractor string"


def test_quarantine(spark):
    rows = [
        (1, "README.md", None, "Rooms can be booked.", False),
        (2, "a/testing/x.md", "", "Rooms can be booked.", True),
        (3, "a/contest.md", "Contact us", "x", True),
        (4, "a.md", "Contact us today", "x", False),
        (5, "a.md", "Setup", "Install it", True),
        (6, "a.md", "Setup", "It is fast", False),
        (7, "a.md", "", "open(), close().", True),
        (8, "a.md", "", "It closes; Fix: the lock", False),
        (9, "a.md", "", "fixed the lock", True),
        (10, None, None, None, False),
        (11, "docs\\Tests\\a.md", "", "x", True),
    ]
    df = spark.createDataFrame(rows, "id int, path string, heading string, text string, want boolean")
    got = df.select("id", "want", claims.quarantined(F.col("path"), F.col("heading"), F.col("text")).alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.want) for r in got]


def test_feature_titles(spark):
    rows = [("A (duplicate)", "A"), (" A (Alternate 2) (duplicate) ", "A"), ("A (duplicate) b", "A (duplicate) b"), (None, None), ("(duplicate)", "")]
    df = spark.createDataFrame(rows, "title string, want string")
    assert all(r.want == r.got for r in df.select("want", claims.feature_title(F.col("title")).alias("got")).collect())


def test_unresolved_contracts(spark):
    sources = spark.createDataFrame([("s1", "a.rpc('x'); b.rpc( \"y\"); a.rpc('x')"), ("s1", "c.rpc('x')"), ("s2", "rpc('x') d.rpc('1z') e.rpc(x)"), ("s3", None)], "source_id string, text string")
    names = spark.createDataFrame([("y",), (None,)], "name string")
    assert claims.unresolved_contracts(sources, names).collect() == [("x", "s1")]


def test_derived_edges_and_never_imported(spark):
    rows = [
        {"node_id": "file:t", "node_type": "file", "path": "tests/t"}, {"node_id": "file:a", "node_type": "file", "path": "a"},
        {"node_id": "f", "node_type": "function", "file_id": "file:a", "path": "a"}, {"node_id": "g", "node_type": "function", "file_id": "file:a", "path": "a"},
    ]
    nodes = spark.createDataFrame([tuple(r.get(c) for c in NODE_COLUMNS) for r in rows], ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items()))
    edges = spark.createDataFrame([("file:t", "f", "REFERENCES", "file:t", 3, "x"), ("file:a", "g", "REFERENCES", None, None, "x"), ("g", "f", "CALLS", None, None, "x")], EDGE)
    tests = spark.createDataFrame([("test:t", "tests/t")], "node_id string, path string")
    configs = spark.createDataFrame([("config:g", "g")], "node_id string, symbol_id string")
    got = structure.test_and_config_edges(edges, nodes.filter("node_type = 'file'"), tests, configs).collect()
    assert sorted(map(tuple, got), key=str) == [("f", "test:t", "TESTED_BY", "file:t", 3, "x"), ("file:a", "config:g", "CONFIGURED_BY", None, None, "x")]
    exports = spark.createDataFrame([("f", "export const f = 1"), ("g", " export default g"), ("g", "export function g() {}"), ("g", "export constant")], "node_id string, statement string")
    assert [r.statement for r in deadcode.never_imported(EvidenceGraph(nodes, edges), exports).collect()] == [" export default g"]
