"""Facts of Python source files: imports, symbols and calls, one Arrow stage by file.

The standard parser gives no tree of a file with a syntax error: such a file gives one
``error`` fact and nothing else. Null text gives no facts.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame

#: One row a fact. ``name`` is the local name, the symbol or the callee; ``kind`` its
#: kind; ``root`` an imported name that a call starts from; ``target`` a local function.
SCHEMA = "path string, fact string, name string, kind string, source string, imported string, caller string, root string, target string, exported boolean, line_start int, line_end int"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[c.split()[1]] for c in SCHEMA.split(", ")]
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _fact(fact: str, node, **more) -> dict:
    return {"fact": fact, "line_start": node.lineno, "line_end": node.end_lineno} | more


def _imports(tree: ast.Module):
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                yield _fact("import", a, kind="namespace", source=a.name, imported="*", name=a.asname or a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            module = "." * node.level + (node.module or "")
            for a in node.names:
                if a.name == "*":
                    yield _fact("import", a, kind="namespace", source=module, imported="*", name="*")
                elif module == ".":  # a sibling module
                    yield _fact("import", a, kind="namespace", source="." + a.name, imported="*", name=a.asname or a.name)
                else:
                    yield _fact("import", a, kind="named", source=module, imported=a.name, name=a.asname or a.name)


def _symbols(tree: ast.Module):
    for node in tree.body:
        if isinstance(node, _FUNCTIONS):
            yield _fact("symbol", node, kind="function", name=node.name, exported=not node.name.startswith("_"))
        elif isinstance(node, ast.ClassDef):
            yield _fact("symbol", node, kind="class", name=node.name, exported=not node.name.startswith("_"))
            for m in node.body:
                if isinstance(m, _FUNCTIONS):
                    yield _fact("symbol", m, kind="function", name=f"{node.name}.{m.name}", exported=False)
        else:
            left = node.targets[0] if isinstance(node, ast.Assign) else node.target if isinstance(node, ast.AnnAssign) else None
            if isinstance(left, ast.Name):
                yield _fact("symbol", node, kind="variable", name=left.id, exported=not left.id.startswith("_"))


def _mentions(node, name: str) -> bool:
    return any(name in (getattr(n, "id", None), getattr(n, "attr", None), getattr(n, "arg", None)) for n in ast.walk(node))


def _binds(body: list, name: str) -> bool:
    """Whether statements bind ``name``, other than inside functions and classes."""
    stack = list(body)
    while stack:
        node = stack.pop()
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            if node.name == name:
                return True
            continue
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign, ast.NamedExpr, ast.For, ast.AsyncFor)) else []
        if any(_mentions(t, name) for t in targets) or (isinstance(node, (ast.Global, ast.Nonlocal)) and name in node.names):
            return True
        stack.extend(ast.iter_child_nodes(node))
    return False


def _root(node) -> str | None:
    while not isinstance(node, ast.Name):
        node = node.func if isinstance(node, ast.Call) else getattr(node, "value", None) if isinstance(node, (ast.Attribute, ast.Subscript)) else None
        if node is None:
            return None
    return node.id


def _calls(tree: ast.Module, text: str, imported: set[str], functions: set[str]):
    rows = [line.encode() for line in text.split("\n")]

    def source_of(node) -> str:
        cut = rows[node.lineno - 1 : node.end_lineno]
        cut[-1] = cut[-1][: node.end_col_offset]
        cut[0] = cut[0][node.col_offset :]
        return b"\n".join(cut).decode()

    def shadowed(scopes: tuple, name: str) -> bool:
        for scope in reversed(scopes):
            if scope.name == name:
                return False
            if _mentions(scope.args, name) or _binds(scope.body, name):
                return True
        return False

    stack = [(tree, (), None, None)]
    while stack:
        node, scopes, caller, owner = stack.pop()
        if isinstance(node, ast.Call):
            callee, root = source_of(node.func), _root(node.func)
            plain = isinstance(node.func, ast.Name)
            kind = "identifier" if plain else "member" if isinstance(node.func, (ast.Attribute, ast.Subscript)) else "other"
            local = callee if plain and callee in functions and not shadowed(scopes, callee) else None
            yield _fact("call", node, kind=kind, name=callee, caller=caller, root=root if root in imported else None, target=local)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _FUNCTIONS):
                stack.append((child, (*scopes, child), f"{owner}.{child.name}" if owner else child.name, owner))
            elif isinstance(child, ast.ClassDef):
                stack.append((child, scopes, caller, child.name))
            else:
                stack.append((child, scopes, caller, owner))


def facts_of(text: str) -> list[dict]:
    """All facts of one file, by line."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        tree = ast.parse(text)
        imports, symbols = list(_imports(tree)), list(_symbols(tree))
        seen = [s["name"] for s in symbols if "." not in s["name"]]
        functions = {s["name"] for s in symbols if s["kind"] == "function" and seen.count(s["name"]) == 1}
        calls = list(_calls(tree, text, {i["name"] for i in imports}, functions))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = getattr(e, "lineno", None) or 1
        return [{"fact": "error", "kind": type(e).__name__, "name": str(e)[:200], "line_start": line, "line_end": getattr(e, "end_lineno", None) or line}]
    return sorted(imports + symbols + calls, key=lambda f: (f["line_start"], f["line_end"], f["fact"], f["name"]))


def python_facts(files: DataFrame) -> DataFrame:
    """Facts (SCHEMA) of ``files`` (path, text; others are ignored): imports and symbols
    of the top level, methods one class deep, and every call with its caller."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                facts = [f | {"path": path} for f in facts_of(text)]
                for i in range(0, len(facts), 10_000):
                    some = facts[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f.get(n) for f in some], t) for n, t in zip(_NAMES, _TYPES)], names=_NAMES)

    return files.select("path", "text").mapInArrow(run, SCHEMA)
