"""Repository scan, Python facts, resolvers, file routes and promise matches."""

import math
import re

from pyspark.sql import functions as F

from graphloom.functions.routes import file_route
from graphloom.operators import audit, python_source, resolve
from graphloom.sources import repository

FILES = {
    "pkg/__init__.py": "",
    "pkg/base.py": "def run(x):\n    return x\n\ndef _hidden():\n    return run(1)\n",
    "pkg/use.py": "from .base import run as go\nimport pkg.base\n\nclass A:\n    def f(self):\n        return self.g(go(1))\n\n    def g(self, run):\n        return run(2)\n\nVALUE = 3\n",
    "pkg/bad.py": "def broken(:\n",
    "other/base.py": "x = 1\n",
    "node_modules/a.js": "no",
    ".env.local": "no",
    "package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2", "a": "3"}}',
    "README.md": "# é\n",
}


def write(root):
    for path, text in FILES.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


def test_scan_lists_all_kept_files(spark, tmp_path):
    got = {r["path"]: r for r in repository.scan(spark, write(tmp_path)).collect()}
    assert set(got) == {p for p in FILES if p not in ("node_modules/a.js", ".env.local")}
    assert got["pkg/base.py"]["lines"] == 6 and got["pkg/__init__.py"]["lines"] == 1
    assert got["README.md"]["language"] == "markdown" and got["README.md"]["bytes"] == 5
    assert got["pkg/use.py"]["text"] == FILES["pkg/use.py"]


def test_manifest_dependencies(spark):
    files = spark.createDataFrame([(p, FILES[p]) for p in ("package.json", "README.md")] + [("x/package.json", "{"), ("y/package.json", None)], "path string, text string")
    assert sorted((r["directory"], r["package"]) for r in repository.manifest_dependencies(files).collect()) == [("", "a"), ("", "b")]


def facts(spark):
    rows = [(p, t) for p, t in FILES.items() if p.endswith(".py")] + [("null.py", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    return files, python_source.python_facts(files)


def test_python_facts(spark):
    _, found = facts(spark)
    rows = [r.asDict() for r in found.collect()]
    symbols = {(r["path"], r["kind"], r["name"], r["exported"]) for r in rows if r["fact"] == "symbol"}
    assert symbols == {
        ("pkg/base.py", "function", "run", True), ("pkg/base.py", "function", "_hidden", False), ("pkg/use.py", "class", "A", True), ("pkg/use.py", "function", "A.f", False),
        ("pkg/use.py", "function", "A.g", False), ("pkg/use.py", "variable", "VALUE", True), ("other/base.py", "variable", "x", True),
    }
    calls = {(r["name"], r["caller"], r["root"], r["target"]) for r in rows if r["fact"] == "call"}
    assert calls == {("run", "_hidden", None, "run"), ("self.g", "A.f", None, None), ("go", "A.f", "go", None), ("run", "A.g", None, None)}
    assert [(r["path"], r["fact"]) for r in rows if r["fact"] == "error"] == [("pkg/bad.py", "error")]
    assert python_source.python_facts(spark.createDataFrame([], "path string, text string")).count() == 0


def test_a_parameter_hides_a_function():
    found = python_source.facts_of("def run():\n    pass\n\ndef a(run):\n    run()\n\ndef b():\n    run()\n\ndef c():\n    run = 1\n    run()\n")
    assert {f["caller"]: f["target"] for f in found if f["fact"] == "call"} == {"a": None, "b": "run", "c": None}


def test_imports_and_calls_become_edges(spark):
    files, found = facts(spark)
    imports = found.filter("fact = 'import'")
    edges = {(r["source"], r["target"], r["ev_line"]) for r in resolve.import_edges(imports, files).collect()}
    assert edges == {("file:pkg/use.py", "file:pkg/base.py", 1), ("file:pkg/use.py", "file:pkg/base.py", 2)}
    symbols = found.filter("fact = 'symbol'")
    bound = resolve.imported_symbols(imports, files, symbols)
    assert [tuple(r) for r in bound.collect()] == [("pkg/use.py", "go", "pkg/base.py", "run")]
    calls = found.filter("fact = 'call'").withColumn("local", F.col("target"))
    got = {tuple(r)[:4] for r in resolve.call_edges(calls, bound, symbols).collect()}
    assert got == {("pkg/base.py", "_hidden", "pkg/base.py", "run"), ("pkg/use.py", "A.f", "pkg/use.py", "A.g"), ("pkg/use.py", "A.f", "pkg/base.py", "run")}


def test_script_imports_stop_at_the_first_ambiguous_tier(spark):
    paths = ["src/a.ts", "src/b.ts", "src/b.js", "src/c/index.ts", "src/d.tsx", "src/d/index.ts", "src/e.vue", "src/f.service.ts", "top.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    sources = ["./b", "./b.js", "./c", "./c/", "./d", "./d.js", "./e.vue", "./f.service", "../top", "../../top", "lib"]
    imports = spark.createDataFrame([("src/a.ts", s) for s in sources], "path string, source string")
    assert {r["source"]: r["target"] for r in resolve.script_targets(imports, files).collect()} == {"./c": "src/c/index.ts", "./d": "src/d.tsx", "./d.js": "src/d.tsx", "./e.vue": "src/e.vue", "../top": "top.ts"}


def test_python_imports_climb_and_match_suffixes(spark):
    paths = ["a/b/c.py", "a/b/__init__.py", "a/x.py", "r.py", "z/c.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    imports = spark.createDataFrame([("a/b/c.py", s) for s in (".", "..x", "....r", "c", "b.c", "x", "a.b", "none")], "path string, source string")
    assert {r["source"]: r["target"] for r in resolve.python_targets(imports, files).collect()} == {".": "a/b/__init__.py", "..x": "a/x.py", "....r": "r.py", "b.c": "a/b/c.py", "x": "a/x.py", "a.b": "a/b/__init__.py"}


def test_file_routes(spark):
    cases = {"app/page.tsx": ("page", "/"), "app/(x)/a/[id]/route.ts": ("http", "/a/:id"), "pages/api/u/[...p].ts": ("http", "/api/u/*p"), "app/routes/_index.tsx": ("http", "/"), "app/routes/a.$b.tsx": ("http", "/a/:b"), "src/pages/index.vue": ("page", "/"), "lib/a.ts": None}
    got = spark.createDataFrame([(p,) for p in cases], "path string").withColumn("r", file_route(F.col("path"))).collect()
    assert {r["path"]: tuple(r["r"]) if r["r"] else None for r in got} == cases


def plain_tokens(text):
    def stem(t):
        if len(t) > 6 and t.endswith("ing"):
            return {"pars": "parse"}.get(t[:-3], t[:-3])
        return t[:-2] if len(t) > 5 and t.endswith("ed") else t[:-1] if len(t) > 3 and t.endswith("s") else t

    kept = {t for t in map(stem, re.findall("[a-z0-9]+", text.lower())) if len(t) >= 3 and t not in audit.STOPWORDS}
    return kept | {audit.SYNONYMS[t] for t in kept if t in audit.SYNONYMS} | ({"other"} if re.search(r"\bnon[-\s]", text, re.I) else set())


def test_best_promise(spark):
    promises = {1: "Customers export invoices as documents", 2: "Parsing uploaded invoices and reports", 3: "Non-admin users rent vehicles", 4: "Customers export invoices as documents", 5: None}
    gaps = {1: "uploaded invoices exist; parsing of reports is missing", 2: "customers export documents", 3: "clients rent cars", 4: "nothing here", 5: None}
    tokens = {p: plain_tokens(t or "") for p, t in promises.items()}
    df = {t: sum(t in s for s in tokens.values()) for s in tokens.values() for t in s}
    want = {}
    for g, text in gaps.items():
        mine, focus = plain_tokens(text or ""), plain_tokens((text or "").rsplit(";")[-1])
        ranked = []
        for p, of in tokens.items():
            both = mine & of
            if len(both) >= 2:
                ranked.append((-(sum(math.log(6 / (df[t] + 1)) + 1 for t in both) + 2 * len(both) / len(of) + 4 * len(both & focus)), p))
        ranked.sort()
        if ranked and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= 0.05):
            want[g] = (ranked[0][1], round(-ranked[0][0], 5))
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    got = audit.best_promise(frame(gaps, "gap_id"), frame(promises, "promise_id")).collect()
    assert {r["gap_id"]: (r["promise_id"], round(r["score"], 5)) for r in got} == want and 1 in want and 2 not in want
