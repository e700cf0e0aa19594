"""From facts of files to edges between them. Candidates are joined on equal paths, in
tiers; ambiguity gives no edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, directory, normal_path
from ..functions.unique import exactly_one, first_tier

#: What a script module's name may be continued by.
MODULE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".d.mts", ".d.cts", ".json", ".astro", ".svelte", ".vue")
#: What an extension that is written may stand for.
SUBSTITUTIONS = {
    ".js": (".ts", ".tsx", ".d.ts", ".js", ".jsx"),
    ".jsx": (".tsx", ".d.ts", ".jsx"),
    ".mjs": (".mts", ".d.mts", ".mjs"),
    ".cjs": (".cts", ".d.cts", ".cjs"),
}
PYTHON_ENDINGS = (".py", ".pyi", "/__init__.py", "/__init__.pyi")


def _tier(base: Column, endings: tuple[str, ...], tier: int) -> Column:
    return F.transform(F.array(*map(F.lit, endings)), lambda e: F.struct(F.lit(tier).alias("tier"), F.concat(base, e).alias("target")))


def _is_python(path: Column) -> Column:
    return path.rlike(r"(?i)\.pyi?$")


def script_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, target): relative imports (path, source) of scripts resolved among
    ``files`` (path). Without extension the name itself comes first, then the files
    that continue it, then those of a directory's index."""
    base = normal_path(F.concat_ws("/", directory(F.col("path")), F.col("source")))
    wanted = imports.filter(F.col("source").rlike(r"^\.\.?/") & ~F.col("source").endswith("/") & ~_is_python(F.col("path"))).select("path", "source").distinct()
    return _script_files(wanted.withColumn("base", base), ["path", "source"], files)


def _script_files(wanted: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """``keys`` and the target that their ``base`` path stands for among ``files``."""
    wanted = wanted.filter("base != ''").withColumn("extension", F.regexp_extract(basename(F.col("base")), r"^.+(\.[^.]*)$", 1))
    b, plain = F.col("base"), F.concat(_tier(F.col("base"), ("",), 0), _tier(F.col("base"), MODULE_EXTENSIONS, 1), _tier(F.concat("base", F.lit("/index")), MODULE_EXTENSIONS, 2))
    found = F.when(F.col("extension") == "", plain)
    for extension, put in SUBSTITUTIONS.items():
        found = found.when(F.lower("extension") == extension, _tier(F.substring(b, F.lit(1), F.length(b) - len(extension)), put, 0))
    rows = wanted.select(*keys, F.inline(found.otherwise(_tier(b, ("",), 0))))
    rows = rows.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return first_tier(rows, keys, "tier", "target").select(*keys, "target")


def alias_targets(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, source, target): imports of scripts that aren't relative, by the module
    configurations (``aliases``: path, directory, base_url, pattern, substitution, pos)
    in the folders above, deepest first. A configuration with a pattern that fits decides,
    if just one of its substitutions is a file; without one its base decides where that
    leads to a file. A configuration's patterns travel as one list, so only those that
    fit become rows; importers meet configurations by equal folders."""
    key = ["path", "source", "config"]
    wanted = imports.filter(~F.col("source").rlike(r"^\.\.?/|^$") & ~_is_python(F.col("path"))).select("path", "source").distinct()
    parts = F.split(directory(F.col("path")), "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))))
    listed = F.collect_list(F.when(F.col("substitution").isNotNull(), F.struct("pattern", "pos", "substitution")))
    configs = aliases.groupBy(F.col("path").alias("config"), "directory", "base_url").agg(listed.alias("patterns"))
    pairs = wanted.withColumn("directory", F.explode(above)).join(configs, "directory")
    source = F.col("source")

    def fits(p):
        pattern = p["pattern"]
        one = source.startswith(F.substring_index(pattern, "*", 1)) & source.endswith(F.substring_index(pattern, "*", -1))
        return F.when(F.instr(pattern, "*") == 0, pattern == source).otherwise((F.size(F.split(pattern, r"\*")) == 2) & one)

    def put(p):
        head, tail = F.length(F.substring_index(p["pattern"], "*", 1)), F.length(F.substring_index(p["pattern"], "*", -1))
        wild = F.when(F.instr(p["pattern"], "*") == 0, "").otherwise(F.substring(source, head + 1, F.greatest(F.length(source) - head - tail, F.lit(0))))
        return F.replace(p["substitution"], F.lit("*"), wild)

    pairs = pairs.withColumn("puts", F.transform(F.filter("patterns", fits), put))
    path_of = lambda c: normal_path(F.concat_ws("/", "directory", "base_url", c))
    mapped = pairs.select(*key, F.posexplode("puts").alias("n", "put"), "directory", "base_url")
    mapped = _script_files(mapped.select(*key, "n", path_of("put").alias("base")), [*key, "n"], files)
    mapped = mapped.groupBy(*key).agg(F.when(F.count(F.lit(1)) == 1, F.min("target")).alias("target"))
    plain = _script_files(pairs.filter("size(puts) = 0").select(*key, path_of("source").alias("base")), key, files)
    decided = pairs.select(*key, F.length("directory").alias("depth"), (F.size("puts") > 0).alias("fit")).join(mapped.union(plain), key, "left").filter("fit or target is not null")
    best = decided.groupBy("path", "source").agg(F.min_by("target", F.struct(-F.col("depth"), "config")).alias("target"))
    return best.filter("target is not null")


def python_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, target): module imports (path, source) of Python files. Leading
    dots climb from the importer's directory, and stop at the root. Other names match
    the end of any file's path: files are joined by their suffixes, one row a segment."""
    level = F.length(F.regexp_extract("source", r"^\.*", 0))
    parts = F.filter(F.split(F.substring(F.col("source"), level + 1, F.length("source")), r"\."), lambda s: s != "")
    above = F.filter(F.split(directory(F.col("path")), "/"), lambda s: s != "")
    above = F.slice(above, F.lit(1), F.greatest(F.size(above) - level + 1, F.lit(0)))
    wanted = imports.filter(_is_python(F.col("path"))).select("path", "source").distinct()
    wanted = wanted.withColumn("relative", level > 0).withColumn("base", F.array_join(F.when(level > 0, F.concat(above, parts)).otherwise(parts), "/")).filter("base != ''")
    wanted = wanted.select("path", "source", "relative", F.inline(_tier(F.col("base"), PYTHON_ENDINGS, 0))).drop("tier").withColumnRenamed("target", "ending")
    python = files.filter(_is_python(F.col("path"))).select(F.col("path").alias("target")).distinct()
    segments = F.split("target", "/")
    ends = python.select("target", F.posexplode(F.transform(segments, lambda s, i: F.array_join(F.slice(segments, i + 1, F.size(segments)), "/"))).alias("at", "ending"))
    rows = wanted.join(ends, "ending").filter(~F.col("relative") | (F.col("at") == 0))
    return exactly_one(rows, ["path", "source"], "target").select("path", "source", "target")


def import_edges(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """IMPORTS edges of imports and re-exports (path, source, line_start) between files,
    with those by ``aliases`` of module configurations."""
    targets = script_targets(imports, files).unionByName(python_targets(imports, files))
    if aliases is not None:
        targets = targets.unionByName(alias_targets(imports, files, aliases))
    rows = imports.select("path", "source", "line_start").join(targets, ["path", "source"])
    named = lambda c: F.concat(F.lit("file:"), F.col(c))
    return rows.select(
        named("path").alias("source"), named("target").alias("target"), F.lit("IMPORTS").alias("type"),
        F.col("path").alias("ev_file"), F.col("line_start").alias("ev_line"), F.lit("resolver").alias("ev_extractor"),
    ).distinct()


def imported_symbols(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, target, symbol): named imports (path, source, name, imported) of a
    symbol (path, name, exported) that its file exports under that name just once."""
    targets = script_targets(imports, files).unionByName(python_targets(imports, files))
    exported = symbols.filter("exported").groupBy("path", "name").count().filter("count = 1").select(F.col("path").alias("target"), F.col("name").alias("symbol"))
    rows = imports.filter("imported != '*'").select("path", "source", "name", F.col("imported").alias("symbol")).join(targets, ["path", "source"])
    return rows.join(exported, ["target", "symbol"]).select("path", "name", "target", "symbol").distinct()


def call_edges(calls: DataFrame, bound: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_path, caller, target_path, target, line_start): calls (path, name, caller,
    root, local, line_start) of a local function, else of a method through ``self`` or
    ``cls``, else of an imported symbol (``bound`` by imported_symbols). Caller and
    target must be the only function of their name in their file; no call of itself."""
    one = symbols.filter("kind = 'function'").groupBy("path", "name").count().filter("count = 1").select("path", "name")
    own = F.regexp_extract("name", r"^(?:self|cls)\.(\w+)$", 1)
    owner = F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1)
    c = calls.filter("caller is not null").withColumn("within", F.coalesce("local", F.when((own != "") & (owner != ""), F.concat(owner, F.lit("."), own))))
    inside = c.filter("within is not null").select("path", "caller", F.col("path").alias("target_path"), F.col("within").alias("target"), "line_start")
    b = bound.groupBy("path", "name").agg(F.min(F.struct("target", "symbol")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    across = c.filter("within is null and root is not null and root = name").join(b, ["path", "name"])
    across = across.select("path", "caller", F.col("b.target").alias("target_path"), F.col("b.symbol").alias("target"), "line_start")
    rows = inside.unionByName(across).join(one.select("path", F.col("name").alias("caller")), ["path", "caller"], "left_semi")
    rows = rows.join(one.select(F.col("path").alias("target_path"), F.col("name").alias("target")), ["target_path", "target"], "left_semi")
    rows = rows.filter("path != target_path or caller != target")
    return rows.select(F.col("path").alias("caller_path"), "caller", "target_path", "target", "line_start").distinct()


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(file_id, inner_id, outer_id): ranges (file_id, node_id, line_start, line_end) of
    ``inner`` that lie strictly inside one of ``outer`` in the same file."""
    i = inner.select("file_id", F.col("node_id").alias("inner_id"), F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    o = outer.select("file_id", F.col("node_id").alias("outer_id"), F.col("line_start").alias("os"), F.col("line_end").alias("oe"))
    rows = i.join(o, "file_id").filter("os <= s and oe >= e and (os < s or oe > e)")
    return rows.select("file_id", "inner_id", "outer_id")


def module_stem(path: Column) -> Column:
    """A module's name: the last segment up to its first dot, or for an index the folder's."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", ""), "/")
    base = F.regexp_replace(F.element_at(parts, -1), r"^([^.]+)\..*$", "$1")
    return F.when(base.isin("index", "__init__") & (F.size(parts) > 1), F.get(parts, F.size(parts) - 2)).otherwise(base)


def partial_imports(sources: DataFrame, diagnostics: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, kind, line): what ``sources`` (path, text) with ``diagnostics`` (path,
    line_start, line_end) may import of ``files`` (path), at its least line.
    ``recovered-import``: ``imports`` (path, source, line_start, line_end) that touch no
    diagnostic. ``string-mention``: strings without white space, and Python import lines,
    that resolve to a file or have a file's stem. Files without diagnostics give nothing."""
    broken = diagnostics.select("path").distinct()
    d = diagnostics.select(F.col("path").alias("p"), F.col("line_start").alias("low"), F.col("line_end").alias("high"))
    sound = imports.join(broken, "path", "left_semi").join(d, (F.col("path") == F.col("p")) & (F.col("low") <= F.col("line_end")) & (F.col("line_start") <= F.col("high")), "left_anti")
    rows = sources.join(broken, "path", "left_semi").select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "row"))
    strings = F.filter(F.regexp_extract_all("row", F.lit(r"""(["'`])((?:(?!\1)[^\\\r\n]|\\.){1,300})\1"""), F.lit(2)), lambda s: (F.length(s) <= 300) & ~s.rlike(r"\s"))
    module = F.regexp_extract("row", r"^\s*(?:from\s+(?:\.*([A-Za-z_][\w.]*)|\.+)\s+import\b|import\s+([A-Za-z_][\w.]*))", 0)
    module = F.translate(F.regexp_replace(F.regexp_extract(module, r"^\s*(?:from|import)\s+(\S+)", 1), r"^\.+", ""), ".", "/")
    said = rows.select("path", (F.col("at") + 1).alias("line"), F.explode(F.when(module != "", F.array_append(strings, module)).otherwise(strings)).alias("source"))
    asked = sound.select("path", "source").union(said.select("path", "source")).distinct()
    found = script_targets(asked, files).unionByName(python_targets(asked, files))
    stems = files.select(F.col("path").alias("target"), module_stem(F.col("path")).alias("stem")).distinct().filter("stem != ''")
    near = said.withColumn("stem", module_stem(F.col("source"))).join(stems, "stem")
    kinds = [
        sound.join(found, ["path", "source"]).select("path", "target", F.lit("recovered-import").alias("kind"), F.col("line_start").alias("line")),
        said.join(found, ["path", "source"]).select("path", "target", F.lit("string-mention"), "line"),
        near.select("path", "target", F.lit("string-mention"), "line"),
    ]
    both = kinds[0].union(kinds[1]).union(kinds[2]).filter("path != target")
    return both.groupBy("path", "target", "kind").agg(F.min("line").alias("line"))
