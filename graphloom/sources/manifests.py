"""Package manifests and module configurations among a repository's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory, normal_path

_STRING = r'("(?:[^"\\]++|\\[\s\S])*+")'


def module_aliases(files: DataFrame) -> DataFrame:
    """(path, directory, base_url, pattern, substitution, pos) of the tsconfig.json and
    jsconfig.json among ``files`` (path, text), comments and trailing commas aside. A
    configuration with a base alone has one row without pattern; one with neither, or
    whose text can't be read, has none. Empty substitutions don't count."""
    own = files.filter(F.col("path").rlike(r"(?i)(?:^|/)(?:tsconfig|jsconfig)\.json$"))
    text = F.regexp_replace("text", _STRING + r"|//[^\r\n]*+|/\*[\s\S]*?(?:\*/|\z)", "$1")
    text = F.regexp_replace(text, _STRING + r"|,(?=\s*[}\]])", "$1")
    o = F.from_json(text, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    rows = own.select("path", o["baseUrl"].alias("base"), F.map_filter(F.transform_values(F.coalesce(o["paths"], F.create_map().cast("map<string,array<string>>")), lambda k, v: F.filter(v, lambda s: s != "")), lambda k, v: F.size(v) > 0).alias("paths"))
    rows = rows.filter("base is not null or size(paths) > 0").select("path", directory(F.col("path")).alias("directory"), F.coalesce(F.when(F.col("base") != "", F.col("base")), F.lit(".")).alias("base_url"), F.explode_outer("paths").alias("pattern", "list"))
    return rows.select("path", "directory", "base_url", "pattern", F.posexplode_outer("list").alias("pos", "substitution"))


def script_entrypoints(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name): command-line entrypoints that ``scripts`` of package.json among
    ``manifests`` (path, text) make of ``files`` (path): what ``node`` is called with,
    after assignments and cross-env, in each command of a script. Options, patterns and
    paths that leave the repository are none; quotes are taken off."""
    own = manifests.filter(F.lower(F.substring_index("path", "/", -1)) == "package.json")
    rows = own.select(directory(F.col("path")).alias("folder"), F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("script", "command"))
    quoted = r"""'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)"""
    rows = rows.withColumn("segment", F.explode(F.regexp_extract_all("command", F.lit(rf"""(?:[^;&|'"]|{quoted})+"""), F.lit(0))))
    tokens = F.filter(F.transform(F.regexp_extract_all("segment", F.lit(rf"""(?:[^\s'"]|{quoted})+"""), F.lit(0)), lambda t: F.regexp_replace(t, "['\"]", "")), lambda t: t != "")
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    rows = rows.withColumn("w", tokens).withColumn("w", F.when(F.get("w", F.lit(0)).isin("cross-env", "cross-env-shell"), rest(F.col("w"))).otherwise(F.col("w")))
    at = F.array_position(F.transform("w", lambda t: ~t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=\S+$")), True)
    rows = rows.withColumn("at", at.cast("int")).filter("at > 0").select("folder", "script", F.get("w", F.col("at") - 1).alias("program"), F.get("w", F.col("at")).alias("target"))
    rows = rows.filter(F.lower("program").isin("node", "node.exe") & F.col("target").isNotNull() & ~F.col("target").rlike(r"^[-/\\]|[*?$<>]|[/\\]$"))
    path = normal_path(F.concat_ws("/", "folder", F.translate("target", "\\", "/")))
    name = F.concat(F.lit("npm script "), F.when(F.col("folder") == "", F.col("script")).otherwise(F.concat_ws(":", "folder", "script")))
    return rows.select(path.alias("path"), name.alias("name")).distinct().join(files.select("path"), "path", "left_semi")
