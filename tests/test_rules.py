"""Paths, mechanical dead code, reality checks and review on small hand-made inputs:
nulls, repeats, ties and empty tables among them."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import deadcode, excerpts, reality, resolve, review, structure
from graphloom.plans.graph import NODE_COLUMNS, EvidenceGraph
from graphloom.sources import manifests

EDGE = "source string, target string, type string, ev_file string, ev_line int, ev_extractor string"
FILE = "path string, language string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_paths(spark):
    df = spark.createDataFrame([("README.md",), ("docs/security.md",), ("x/summary.mdx",), ("a\\docs\\b.md",), (None,), ("",), ("src/a.spec.ts",), ("db/x.py",)], "p string")
    p = F.col("p")
    got = df.select(p, paths.is_product_document(p), paths.is_primary_document(p), paths.is_implementation(p), paths.is_shared_domain(p), paths.group_key(p)).collect()
    assert [tuple(r) for r in got] == [
        ("README.md", True, True, False, False, "README.md"),
        ("docs/security.md", False, False, False, False, "docs/security.md"),
        ("x/summary.mdx", True, False, False, False, "x/summary.mdx"),
        ("a\\docs\\b.md", True, True, False, False, "a/docs"),
        (None, False, False, False, False, None),
        ("", False, False, True, False, "root"),
        ("src/a.spec.ts", False, False, False, False, "src/a.spec.ts"),
        ("db/x.py", False, False, True, True, "db/x.py"),
    ]
    code = spark.createDataFrame([("src/a.ts", "TypeScript"), ("./dist/a.ts", "typescript"), ("a.md", "markdown"), (None, None)], "p string, l string")
    assert [r[0] for r in code.select(paths.is_own_code(p, F.col("l"))).collect()] == [True, False, False, False]


def test_isolated_files(spark):
    members = spark.createDataFrame([("a/b/1.ts", "y"), ("a/b/2.ts", "y"), ("a/c/1.ts", "y"), ("a/b/3.ts", "x"), ("a/b/3.ts", "x"), ("q", "z")], "path string, community string")
    loose = spark.createDataFrame([("a/b/d/9.ts",), ("a/b/d/9.ts",), ("a/c/9.ts",), ("q/9.ts",), ("b.ts",), ("a/b",)], "path string")
    assert rows(structure.attach_isolated(members, loose)) == [("a/b", "directory:a/b"), ("a/b/d/9.ts", "x"), ("a/c/9.ts", "directory:a/c"), ("b.ts", "directory:b.ts"), ("q/9.ts", "z")]
    assert rows(structure.attach_isolated(members.limit(0), loose.filter("path = 'b.ts'"))) == [("b.ts", "directory:b.ts")]


def test_ordered_edges(spark):
    e = spark.createDataFrame([("b", "a", "CALLS", "f", 2, "x"), ("a", "b", "CALLS", "f", 3, "x"), ("a", "b", "CALLS", "f", None, "x"), ("a", "b", "CALLS", "f", 3, "x")], EDGE)
    assert [(r.source, r.ev_line) for r in structure.ordered_edges(e).collect()] == [("a", None), ("a", 3), ("b", 2)]


def test_api_methods(spark):
    text = "// x\nexport const api = {\n  get: (x) => x,\n\n  put: async (y) => y,\n  del: (z) => z,\n};\nexport const api = {\n  get: (x) => x,\n};\nexport const idx = {\n  a: () => 1,\n};\nexport const none = {\n};\n"
    use = "root.api\n  .put();\napi.delete();\nidx [k];\nmyapi.get(); api.get2()"
    files = spark.createDataFrame([("a.ts", "typescript", text), ("b.py", "python", use), ("tests/c.ts", "typescript", "export const t = {\n  a: () => 1,\n};\n"), ("n.ts", "typescript", None)], FILE)
    assert rows(deadcode.unused_api_methods(files)) == [("a.ts", "api.del", 6), ("a.ts", "api.get", 2), ("a.ts", "api.get", 8)]


def test_aliases_helpers_modules(spark):
    files = spark.createDataFrame(
        [
            ("a.ts", "typescript", "type A = 1\nexport type B = A\r\ntype C = 2"),
            ("b.py", "python", "Id = TypeVar('x')\n  Ko = Literal[1]\nUsed = Union[int]\nx: Used"),
            ("tests/t.ts", "typescript", "type A = 1"),
            ("m.mjs", "javascript", "export const f = 1\nf\nexport const g = 1\nexport { g }"),
        ],
        FILE,
    )
    assert rows(deadcode.unused_type_aliases(files)) == [("a.ts", "B", 2), ("a.ts", "C", 3), ("b.py", "Id", 1)]
    symbols = spark.createDataFrame([("m.mjs", "f", "function", None, 1, 2), ("m.mjs", "g", "function", False, 3, 3), ("a.ts", "a b", "function", False, 1, 1)], "path string, name string, node_type string, exported boolean, line_start int, line_end int")
    assert [(r.path, r.name) for r in deadcode.unused_helpers(files, symbols).collect()] == [("m.mjs", "f")]
    named = spark.createDataFrame([("m.mjs", "f"), ("m.mjs", "g"), ("a.ts", "A"), ("m.mjs", "h")], "path string, name string")
    ranges = spark.createDataFrame([("m.mjs", "f", 1, 1), ("m.mjs", "g", 3, 3), ("m.mjs", "g", 4, 4)], "path string, name string, line_start int, line_end int")
    assert rows(deadcode.withhold_used_modules(named, files, ranges)) == [("a.ts", "A"), ("m.mjs", "g"), ("m.mjs", "h")]


def test_latest(spark):
    df = spark.createDataFrame([("i", 1, "z", "n"), ("i", 2, "b", "m"), ("i", None, "q", "m"), ("j", 1, "a", None)], "id string, arrival long, file string, name string")
    assert [(r.id, r.file, r.name) for r in deadcode.latest(df).collect()] == [("j", "a", None), ("i", "b", "m")]


def test_phantom_dependencies(spark):
    manifests = spark.createDataFrame([("a/package.json", '{"dependencies": {"react-markdown": "1", "Left-Pad": "2"}}'), ("package.json", "no json"), ("requirements.txt", "# c\nPillow>=1 # why\n-e .\nhttps://x\nPillow\nflask[x]"), ("x.txt", "y"), ("b/package.json", None)], "path string, text string")
    declared = reality.declared_dependencies(manifests)
    assert rows(declared.select("scope", "name")) == [("", "#"), ("", "Pillow"), ("", "flask"), ("a", "Left-Pad"), ("a", "react-markdown")]
    imports = spark.createDataFrame([("b/x.ts", "left-pad"), ("a/x.ts", "left-padding"), ("A/y.ts", "react-markdown/z"), ("deep/x.py", "PIL.Image"), ("x.py", None), (None, "flask")], "path string, source string")
    left = reality.never_imported_dependencies(declared, imports)
    assert rows(left.select("name")) == [("#",), ("Left-Pad",), ("flask",)]
    said = spark.createDataFrame([("p1", "Left pad", None), ("p2", "Uses flask here", "Our stack"), ("p3", "flask too", "Other"), ("p4", None, None), ("p5", "markdown", None)], "promise_id string, text string, heading string")
    assert rows(reality.phantom_dependencies(declared, imports, said)) == [("a/package.json", "Left-Pad", "p1"), ("requirements.txt", "flask", "p2")]
    assert rows(reality.phantom_dependencies(declared.limit(0), imports, said)) == []


def test_starters(spark):
    sources = spark.createDataFrame([("p", "To get started, edit the page.tsx /next.svg"), ("q", "/next.svg"), ("r", None)], "path string, text string")
    places = [("f", "entrypoint", "p"), ("f", "entrypoint", None), ("g", "entrypoint", "p"), ("g", "implementation", None), ("h", "implementation", "p"), ("i", "entrypoint", "p"), ("i", "implementation", "q"), ("j", "entrypoint", "r")]
    assert rows(reality.starter_features(spark.createDataFrame(places, "feature_id string, role string, path string"), sources)) == [("f",)]
    said = spark.createDataFrame([("b", "An AI-tutor"), ("a", "the ai tutor"), ("c", "tutor"), ("d", None)], "promise_id string, text string")
    assert rows(reality.application_promise(said)) == [("a", 4)]
    assert rows(reality.application_promise(said.filter("promise_id > 'b'"))) == []


@pytest.mark.parametrize("limit, want", [(12, [("t", "b", 2, 1), ("t", "d", 4, 3), ("u", "d", 4, 2)]), (1, [("t", "b", 2, 1)])])
def test_independent_context(spark, limit, want):
    nodes = spark.createDataFrame([(i,) for i in "abcde"], "node_id string")
    nodes = nodes.select(*(F.col("node_id") if k == "node_id" else F.lit("function").alias(k) if k == "node_type" else F.lit(None).cast(t).alias(k) for k, t in NODE_COLUMNS.items()))
    edges = [("a", "b", "CALLS"), ("b", "a", "REFERENCES"), ("a", "d", "IMPORTS"), ("c", "a", "CONTAINS"), ("e", "a", "REFERENCES"), ("e", "d", "ODD")]
    g = EvidenceGraph(nodes, spark.createDataFrame([(*x, None, None, None) for x in edges], EDGE))
    targets = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "e")], "target string, node_id string")
    assert rows(review.independent_context(g, targets, nodes, limit)) == want


def test_drafts_and_account(spark):
    dossiers = spark.createDataFrame([("d", "reachable"), ("e", "unknown"), ("f", None)], "dossier_id string, reachability string")
    refs = spark.createDataFrame([("d", "entrypoints", "x"), ("d", "handlers", "x"), ("d", "handlers", "y"), ("d", "handlers", "gone"), ("e", "handlers", "y"), ("f", "handlers", "x")], "dossier_id string, field string, node_id string")
    classes = spark.createDataFrame([("x", "dynamic_unknown"), ("y", "test_only")], "node_id string, class string")
    assert rows(review.draft_violations(dossiers, refs, classes)) == [("d", "entrypoints", "x", "dynamic_unknown"), ("d", "handlers", "y", "test_only"), ("f", "handlers", "x", "dynamic_unknown")]
    totals = spark.createDataFrame([(3, 2)], "source_files long, parsed_files long")
    unparsed = spark.createDataFrame([("u",)], "path string")
    partial = spark.createDataFrame([("u", "t", "recovered-import", 1)], "path string, target string, kind string, line int")
    assert rows(review.analysis_violations(totals, unparsed, partial)) == []
    bad = spark.createDataFrame([("u", None, None, None), (None, "t", "string-mention", 0)], partial.schema)
    got = rows(review.analysis_violations(totals, unparsed.union(unparsed).union(spark.createDataFrame([(None,)], "path string")), bad))
    assert got == [("partial_kind", "u"), ("partial_line", ""), ("partial_line", "u"), ("partial_parsed", ""), ("partial_target", "u"), ("unparsed_path", ""), ("unparsed_repeated", "u")]


def test_stale_files_and_coverage(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1"), ("d", "1")], "path string, hash string")
    assert rows(review.stale_files(was, now)) == [("b", "changed"), ("e", "added")]
    assert rows(review.stale_files(was, now, now.filter("path in ('d', 'e')").select("path"))) == [("b", "changed"), ("d", "removed")]
    ids = spark.createDataFrame([("x",), ("x",), ("y",)], "id string")
    refs = spark.createDataFrame([("f2", "x"), ("f1", "x"), ("f1", "x"), ("f1", "z")], "feature_id string, id string")
    assert rows(review.coverage_map(ids, refs)) == [("x", ["f1", "f2"]), ("y", [])]


def test_promise_excerpts(spark):
    text = "\n".join(
        [
            "# Guide",
            "It should work", "on two lines", "|---|---|", "Added GET /x",
            "added /y here", "- one must", "  goes on", "- two", "    added /z",
            "not indented will", "sequenceDiagram must", "```js", "must not be read", "# nor this", "```", "~~~ md", "it must be", "## Features", "* three",
            "~~~", "* four", "#no heading must",
        ]
    )
    long = "Must " + "x" * 20 + ". Then " + "y" * 20
    files = spark.createDataFrame([("a.md", text), ("b.md", long), ("c.md", None), ("d.md", ""), ("e.md", "must" * 300)], "path string, text string")
    got = rows(excerpts.promise_excerpts(files.filter("path = 'a.md'")).select("line", "heading", "text", "list_item"))
    assert sorted(got) == [
        (2, "Guide", "It should work on two lines", False),
        (5, "Guide", "Added GET /x", False),
        (6, "Guide", "added /y here", False),
        (7, "Guide", "one must goes on", True),
        (11, "Guide", "not indented will", False),
        (18, "Guide", "it must be", False),
        (20, "Features", "three", True),
        (22, "Features", "four", True),
        (23, "Features", "#no heading must", False),
    ]
    assert rows(excerpts.promise_excerpts(files.filter("path != 'a.md'"), most=40).select("path", "text")) == [("b.md", "Must " + "x" * 20 + ".")]
    assert [r.line for r in excerpts.promise_excerpts(files, per_file=1).filter("path = 'a.md'").collect()] == [2]
    assert rows(excerpts.promise_excerpts(files.limit(0))) == []


def test_manifests(spark):
    config = '{// "x"\n"compilerOptions": {"baseUrl": "", "paths": {"u//x/*": ["a/*", ""], "e": []}, /* , } */ "s": "a,}",},}'
    files = [("tsconfig.json", config), ("a/JSCONFIG.json", '{"compilerOptions": {"baseUrl": "s"}}'), ("b/tsconfig.json", "{}"), ("c/tsconfig.json", "{"), ("d/tsconfig.json", None), ("xtsconfig.json", config)]
    got = rows(manifests.module_aliases(spark.createDataFrame(files, "path string, text string")))
    assert got == [("a/JSCONFIG.json", "a", "s", None, None, None), ("tsconfig.json", "", ".", "u//x/*", 0, "a/*")]
    scripts = '{"scripts": {"a": "node \'x y.js\' || A=1 node ./b.js", "b": "echo \'; node b.js", "c": "node --x b.js; node", "d": "cross-env; X=1", "e": "node /b.js; node b.js/; node b.js"}}'
    manifest = spark.createDataFrame([("package.json", scripts), ("q/package.json", '{"scripts": {"up": "node ../b.js && node ../../b.js"}}'), ("r/package.json", None), ("s/package.json", "[")], "path string, text string")
    known = spark.createDataFrame([("x y.js",), ("b.js",)], "path string")
    assert rows(manifests.script_entrypoints(manifest, known)) == [("b.js", "npm script a"), ("b.js", "npm script e"), ("b.js", "npm script q:up"), ("x y.js", "npm script a")]


def test_partial_imports(spark):
    sources = spark.createDataFrame([("m/a.py", "from .pkg.mod import x\nimport os\ns = 'lib/pkg'"), ("b.ts", "'./a b'; `m/a`\n\"m/a.py\""), ("ok.ts", "'m/a'"), ("n.ts", None)], "path string, text string")
    found = spark.createDataFrame([("m/a.py", 2, 3), ("b.ts", 9, 9), ("b.ts", 9, 9), ("n.ts", 1, 1)], "path string, line_start int, line_end int")
    imports = spark.createDataFrame([("b.ts", "./c", 1, 8), ("b.ts", "./c", 7, 7), ("b.ts", "./d", 8, 9), ("ok.ts", "./c", 1, 1)], "path string, source string, line_start int, line_end int")
    files = spark.createDataFrame([(x,) for x in ("m/a.py", "m/pkg/mod.py", "lib/pkg/__init__.py", "b.ts", "c.ts", "d.ts", "index.ts")], "path string")
    assert rows(resolve.partial_imports(sources, found, imports, files)) == [
        ("b.ts", "c.ts", "recovered-import", 1),
        ("b.ts", "m/a.py", "string-mention", 1),
        ("m/a.py", "lib/pkg/__init__.py", "string-mention", 3),
        ("m/a.py", "m/pkg/mod.py", "string-mention", 1),
    ]


def test_alias_imports(spark):
    aliases = spark.createDataFrame(
        [
            ("a/tsconfig.json", "a", "src", "@x/*", "one/*", 0), ("a/tsconfig.json", "a", "src", "@x/*", "two/*", 1), ("a/tsconfig.json", "a", "src", "exact", "one/b.ts", 0), ("a/tsconfig.json", "a", "src", "p/*.ok", "one/*", 0),
            ("a/tsconfig.json", "a", "src", "*/*", "one/b.ts", 0), ("jsconfig.json", "", ".", None, None, None), ("jsconfig.json", "", ".", "@y/*", "../*", 0),
        ],
        "path string, directory string, base_url string, pattern string, substitution string, pos int",
    )
    files = spark.createDataFrame([(x,) for x in ("a/src/one/b.ts", "a/src/one/c.ts", "a/src/two/c.ts", "a/src/d/index.ts", "e.ts", "b.ts")], "path string")
    sources = ["@x/b", "@x/c", "@x/none", "exact", "p/b.ok", "d", "e", "@y/e", "./e", "x/y", None, ""]
    asked = spark.createDataFrame([("a/z/q.ts", s) for s in sources] + [("b.ts", "e"), ("b.ts", "exact"), ("a/q.py", "e"), ("ab/q.ts", "@x/b")], "path string, source string")
    q = "a/z/q.ts"
    assert rows(resolve.alias_targets(asked, files, aliases)) == [(q, "@x/b", "a/src/one/b.ts"), (q, "d", "a/src/d/index.ts"), (q, "e", "e.ts"), (q, "exact", "a/src/one/b.ts"), (q, "p/b.ok", "a/src/one/b.ts"), ("b.ts", "e", "e.ts")]
    assert rows(resolve.alias_targets(asked, files, aliases.limit(0))) == []


def test_support_accounted(spark):
    df = spark.createDataFrame([("utility", None, None, True), ("utility", "unknown", None, False), ("utility", "unknown", True, True), ("dead/unreachable", "x", False, False), ("dead/unreachable", None, True, True), (None, "x", True, False), ("test", "unknown", False, True), ("feature", "x", True, False)], "k string, r string, i boolean, want boolean")
    got = df.select("want", review.support_accounted(F.col("k"), F.col("r"), F.col("i")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
