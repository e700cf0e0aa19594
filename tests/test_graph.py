"""Graph operators on small hand-made graphs, and the adapter's known counts."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.unique import exactly_one, first_tier
from graphloom.operators import cluster, constraints, deadcode, featuremap, navigate, reach, search, structure, traverse
from graphloom.plans.graph import NODE_COLUMNS, EvidenceGraph, commerce_graph


def graph(spark, nodes, edges):
    rows = [tuple(n.get(c) for c in NODE_COLUMNS) for n in nodes]
    schema = ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items())
    e = spark.createDataFrame([(*x, None, None, "resolver") for x in edges], "source string, target string, type string, ev_file string, ev_line int, ev_extractor string")
    return EvidenceGraph(spark.createDataFrame(rows, schema), e)


def fn(name, path="src/a.ts", **more):
    return {"node_id": f"function:{name}", "node_type": "function", "name": name, "file_id": f"file:{path}", "path": path, "exported": False} | more


def file(path):
    return {"node_id": f"file:{path}", "node_type": "file", "name": path, "path": path, "language": "typescript"}


def entry(name, handler, exposure="external"):
    return {"node_id": f"entrypoint:{name}", "node_type": "entrypoint", "name": name, "file_id": "file:src/a.ts", "path": "src/a.ts", "entry_kind": "http", "exposure": exposure, "http_method": "GET", "handler_symbol_id": f"function:{handler}"}


def endpoint(name):
    return {"node_id": f"endpoint:{name}", "node_type": "endpoint", "name": name, "file_id": "file:src/a.ts", "path": "src/a.ts", "entrypoint_id": f"entrypoint:{name}"}


def test_adapter_has_the_known_ledger(spark):
    g = commerce_graph(spark, "/root/testdata/sf0.001").stored()
    assert g.edges.count() == 196
    found = reach.ledger(g, reach.levels(g)).filter("node_id like 'function:%'").groupBy("class").count()
    assert {r["class"]: r["count"] for r in found.collect()} == {"disconnected_candidate": 117, "dynamic_unknown": 115, "product_reachable": 44, "startup_reachable": 36, "test_only": 48}
    assert constraints.graph_violations(g).count() == 0


def test_diamond_counts_paths_without_listing_them(spark):
    layers = [[f"a{i}", f"b{i}"] for i in range(10)]
    edges = [("r", x, "CALLS") for x in layers[0]]
    for up, down in zip(layers, layers[1:]):
        edges += [(x, y, "CALLS") for x in up for y in down]
    edges += [(x, "leaf", "CALLS") for x in layers[-1]]
    e = spark.createDataFrame(edges, "source string, target string, type string")
    roots = spark.createDataFrame([("k", "r")], "kind string, node_id string")
    levels = traverse.bfs(roots, e.select(F.lit("k").alias("kind"), "source", "target")).select("node_id", "depth")
    paths = {r["node_id"]: r["paths"] for r in traverse.shortest_path_counts(roots, e).collect()}
    assert paths["leaf"] == 1024
    assert traverse.best_shortest_paths(levels, e, 3).filter("node_id = 'leaf'").count() == 3


def test_chain_stops_at_twelve_steps(spark):
    names = [f"f{i}" for i in range(16)]
    nodes = [file("src/a.ts"), entry("e", "f0"), endpoint("e"), *(fn(n) for n in names)]
    edges = [("endpoint:e", "function:f0", "HANDLED_BY"), *((f"function:{a}", f"function:{b}", "CALLS") for a, b in zip(names, names[1:]))]
    g = graph(spark, nodes, edges)
    got = {r["node_id"]: r["score"] for r in cluster.members(g, reach.ledger(g, reach.levels(g))).collect()}
    assert "function:f12" in got and "function:f13" not in got
    assert got["function:f3"] == pytest.approx(0.92**3, abs=1e-6)


def test_ledger_order_of_classes(spark):
    nodes = [file("src/a.ts"), file("tests/t.ts"), entry("e", "h"), endpoint("e"), fn("h"), fn("t", "tests/t.ts"), fn("u"), fn("v"), fn("w", exported=True)]
    edges = [("endpoint:e", "function:h", "HANDLED_BY"), ("function:h", "function:t", "CALLS"), ("function:u", "function:v", "CALLS")]
    g = graph(spark, nodes, edges)
    got = {r["node_id"]: r["class"] for r in reach.ledger(g, reach.levels(g)).collect()}
    assert got["function:t"] == "test_only"  # its file is a test's, though product code reaches it
    assert got["function:h"] == "product_reachable"
    assert got["function:u"] == got["function:v"] == "dynamic_unknown"
    assert got["function:w"] == "disconnected_candidate"  # public API only where nothing is external


def test_rollup_of_a_file_prefers_what_may_be_used(spark):
    entries = spark.createDataFrame([("a", "f", "public_api_unproven"), ("b", "f", "dynamic_unknown"), ("c", "f", "disconnected_candidate")], "node_id string, file_id string, class string")
    assert [tuple(r) for r in reach.file_rollup(entries).collect()] == [("f", "dynamic_unknown", "b")]


def test_definitions_by_tier(spark):
    nodes = [fn("run"), fn("A.run", "src/b.ts"), fn("B.Run", "src/c.ts"), fn("Only.one", "src/d.ts"), fn("LOUD", "src/e.ts")]
    wanted = spark.createDataFrame([("run",), ("one",), ("B.run",), ("loud",), ("ONE",), ("none",)], "wanted string")
    got = {(r.wanted, r.node_id, r.confidence, r.ambiguous) for r in navigate.definitions(graph(spark, nodes, [("x", "y", "CALLS")]), wanted).collect()}
    assert got == {("run", "function:run", 1.0, False), ("one", "function:Only.one", 0.95, False), ("B.run", "function:B.Run", 0.85, False), ("loud", "function:LOUD", 0.85, False), ("ONE", "function:Only.one", 0.85, False)}


def test_neighbourhood_follows_the_queue_and_stops(spark):
    nodes = [fn(n) for n in "sabcdef"]
    edges = [("function:s", f"function:{x}", t) for x, t in (("b", "REFERENCES"), ("a", "REFERENCES"), ("c", "CALLS"))] + [("function:c", "function:f", "CALLS"), ("function:b", "function:d", "CALLS"), ("function:a", "function:e", "CALLS")]
    start = spark.createDataFrame([("function:s", 9)], "node_id string, score int")
    g = graph(spark, nodes, edges)
    around = lambda **k: [(r.node_id[-1], r.depth, r.truncated) for r in search.neighbourhood(g, start, **k).orderBy("place").collect()]
    assert around() == [(x, d, False) for x, d in zip("scabfed", (0, 1, 1, 1, 2, 2, 2))]
    assert around(max_nodes=5) == [(x, d, True) for x, d in zip("scabf", (0, 1, 1, 1, 2))]
    assert around(max_depth=1)[-1] == ("b", 1, True)
    found = search.induced_edges(g, search.neighbourhood(g, start), 4).collect()
    assert [(r.source[-1], r.target[-1]) for r in found] == [("s", "c"), ("s", "a"), ("s", "b"), ("a", "e")]


def test_shop_clusters_share_what_both_use(spark):
    f = lambda n, p, **k: fn(n, f"src/{p}.ts", **k)
    ends = [entry("post", "checkout"), endpoint("post"), entry("get", "orders"), endpoint("get")]
    nodes = [*(file(f"src/{p}.ts") for p in ("a", "checkout", "orders", "database", "email", "unused")), *ends, f("checkout", "checkout"), f("persistOrder", "checkout"), f("orders", "orders"), f("readOrders", "orders")]
    nodes += [f("beginTransaction", "database", exported=True), f("databaseQuery", "database", exported=True), f("sendReceipt", "email", exported=True), f("unusedCouponFormatter", "unused")]
    calls = [("checkout", "persistOrder"), ("persistOrder", "beginTransaction"), ("beginTransaction", "databaseQuery"), ("checkout", "sendReceipt"), ("orders", "readOrders"), ("readOrders", "databaseQuery")]
    edges = [("endpoint:post", "function:checkout", "HANDLED_BY"), ("endpoint:get", "function:orders", "HANDLED_BY"), *((f"function:{a}", f"function:{b}", "CALLS") for a, b in calls)]
    g = graph(spark, nodes, edges).stored()
    m = cluster.members(g, reach.ledger(g, reach.levels(g)))
    got = {(r.cluster_id[11:], r.node_id): (r.score, r.role) for r in m.collect()}
    assert got["post", "function:persistOrder"] == (0.92, "service") and got["post", "function:beginTransaction"][0] == 0.8464 and got["post", "function:databaseQuery"][0] == 0.778688
    assert got["get", "function:databaseQuery"][0] == 0.8464 and got["get", "file:src/database.ts"] == (0.609408, "file") and got["post", "file:src/database.ts"][0] == 0.609408
    assert got["post", "function:checkout"] == (1.0, "handler") and ("get", "function:sendReceipt") not in got
    shared = cluster.shared_nodes(m)
    assert [r.node_id for r in shared.collect()] == ["function:databaseQuery"]
    sub = cluster.subsystems(g, shared)
    assert {r.node_id for r in cluster.subsystem_members(g, sub).collect()} == {"function:databaseQuery", "function:beginTransaction", "file:src/database.ts"}
    assert [tuple(r)[1:] for r in cluster.subsystem_labels(g, sub).collect()] == [("subsystem:database-subsystem:1", "Database subsystem")]
    assert [tuple(r) for r in cluster.unassigned(g, m, sub).collect()] == [("function:unusedCouponFormatter", "isolated")]
    assert cluster.violations(m).count() == 0
    fm = featuremap.feature_map(g, m.select(F.col("cluster_id").alias("feature_id"), "node_id"))
    impact = {r.feature_id[11:]: (r.freed_files, r.orphaned_blocks, r.degraded_blocks) for r in fm.impact.collect()}
    assert impact == {"post": (2, 0, 1), "get": (1, 0, 1)} and featuremap.map_violations(fm).count() == 0


def test_class_context_and_the_ledger_decide_membership(spark):
    nodes = [file("src/a.ts"), file("tests/t.py"), entry("e", "h"), endpoint("e"), fn("h"), fn("Service.run"), fn("Service.__init__"), fn("Service.unused"), fn("query"), fn("helper", "tests/t.py")]
    nodes += [{"node_id": "class:Service", "node_type": "class", "name": "Service", "file_id": "file:src/a.ts", "path": "src/a.ts", "exported": True}, {"node_id": "config:c", "node_type": "config", "name": "c", "file_id": "file:src/a.ts", "path": "src/a.ts", "symbol_id": "function:x"}]
    edges = [("endpoint:e", "function:h", "HANDLED_BY"), ("function:h", "function:Service.run", "CALLS"), ("function:h", "function:helper", "CALLS"), ("function:Service.__init__", "function:query", "CALLS"), ("file:src/a.ts", "config:c", "CONFIGURED_BY")]
    g = graph(spark, nodes, edges).stored()
    got = {r.node_id: r.role for r in cluster.members(g, reach.ledger(g, reach.levels(g))).collect()}
    assert {"class:Service", "function:Service.__init__", "function:query"} <= set(got) and "function:Service.unused" not in got
    assert "function:helper" not in got  # product code calls it, but its file is a test's


def test_legacy_render_roots(spark):
    mount = {"node_id": "entrypoint:m", "node_type": "entrypoint", "name": "React render", "file_id": "file:src/main.tsx", "path": "src/main.tsx", "entry_kind": "startup", "exposure": "startup", "line_start": 3}
    app = {"node_id": "class:App", "node_type": "class", "name": "App", "file_id": "file:src/app.tsx", "path": "src/app.tsx", "exported": True}
    g = graph(spark, [file("src/main.tsx"), file("src/app.tsx"), mount, app, fn("App.draw", "src/app.tsx"), fn("Apple.draw", "src/app.tsx")], [("x", "y", "CALLS")])
    e = spark.createDataFrame([("file:src/main.tsx", "class:App", "REFERENCES", "src/main.tsx", 3, "tree-sitter")], g.edges.schema)
    got = {r.node_id for r in reach.roots(EvidenceGraph(g.nodes, e)).collect()}
    assert got == {"entrypoint:m", "file:src/main.tsx", "class:App", "file:src/app.tsx", "function:App.draw"}


def test_dead_code_verdicts(spark):
    nodes = [file("src/a.ts"), file("tests/t.ts"), fn("lost", exported=True), fn("tried", exported=True), fn("used", exported=True), fn("inner"), fn("Card", exported=True), fn("spec", "tests/t.ts", exported=True), entry("e", "h"), endpoint("e"), fn("h")]
    nodes += [{"node_id": "component:Card", "node_type": "component", "name": "Card", "file_id": "file:src/a.ts", "path": "src/a.ts", "symbol_id": "function:Card"}]
    edges = [("file:tests/t.ts", "function:tried", "REFERENCES"), ("function:inner", "function:used", "CALLS"), ("endpoint:e", "function:h", "HANDLED_BY")]
    g = graph(spark, nodes, edges).stored()
    got = {r.name: (r.node_ids, r.status, r.verdict) for r in deadcode.candidates(g, reach.ledger(g, reach.levels(g))).collect()}
    assert got == {
        "lost": ("function:lost", "disconnected_candidate", "VALIDATION_REQUIRED"), "tried": ("function:tried", "test_only", "VALIDATION_REQUIRED"),
        "used": ("function:used", "dynamic_unknown", "UNKNOWN_DYNAMIC_USAGE"), "Card": ("component:Card|function:Card", "disconnected_candidate", "VALIDATION_REQUIRED"),
    }


def test_broken_graphs_show_each_rule(spark):
    bad = [file("src/a.ts"), fn("a"), fn("a"), fn("b", "src/none.ts"), {"node_id": "x", "node_type": "thing", "file_id": "file:src/a.ts"}, fn("c", line_start=5, line_end=2), entry("e", "none")]
    g = graph(spark, bad, [("function:a", "function:zz", "CALLS"), ("file:src/a.ts", "function:b", "CALLS"), ("function:b", "function:c", "KNOWS")])
    rules = {r["rule"] for r in constraints.graph_violations(g).select("rule").collect()}
    assert {"node_key", "file_reference", "node_kind", "line_range", "handler_reference", "edge_target", "edge_kinds", "edge_type"} <= rules


def test_components_of_a_long_chain_and_empty_input(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)] + [("x", "y"), ("z", "z")], "source string, target string")
    got = {r["node_id"]: r["component"] for r in traverse.components(e).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["y"] == "x" and "z" not in got
    assert traverse.components(e.limit(0)).count() == 0


def test_communities_do_not_depend_on_order(spark):
    e = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("x", "y", 5), ("y", "z", 5), ("x", "z", 5), ("c", "x", 1)], "a string, b string, weight long")
    one = {r["file"]: r["community"] for r in structure.communities(e).collect()}
    two = {r["file"]: r["community"] for r in structure.communities(e.orderBy(F.desc("b"))).collect()}
    assert one == two and len({one[k] for k in "abc"}) == 1 and one["a"] != one["z"]


def test_one_candidate_or_none(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "c"), ("m", 2, "d"), ("m", 2, "d")], "k string, tier int, v string")
    assert exactly_one(df, ["k"], "v").collect() == [("m", "d")]
    assert [tuple(r) for r in first_tier(df, ["k"], "tier", "v").collect()] == [("m", 2, "d")]  # k's first tier is ambiguous


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.normal(F.lit("parseHTTPFile_v2")).alias("n"), tx.slug(F.lit(" A b--C! ")).alias("s"), tx.normal_path(F.lit("a/./b/../c")).alias("p"), tx.normal_path(F.lit("../x")).alias("q"),
        tx.normal_route(F.lit("/Users//{id}/:slug/)?x=1")).alias("r"), tx.strip_markdown(F.lit("> - **Big** [name](url) `x_y` \\# <https://a.b> &amp; &lt;b")).alias("m"),
    ).first()
    assert (row.n, row.s, row.p, row.q, row.r, row.m) == ("parse httpfile v2", "a-b-c", "a/c", None, "/users/{}/:slug", "Big name xy # & <b")
    assert spark.range(1).select(tx.is_test_path(F.lit("src/tests/a.py")).alias("a"), tx.is_test_path(F.lit("src/a.test.ts")).alias("b"), tx.is_test_path(F.lit("src/latest/a.ts")).alias("c")).first() == (True, True, False)
