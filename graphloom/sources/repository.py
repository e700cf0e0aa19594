"""Repository files as a table: a Python data source, and columns over paths.

Spark's own file readers leave out names that begin with ``_`` or ``.`` (and so every
``__init__.py``); this source lists by directory instead, and executors open the files.
"""

from __future__ import annotations

import os
import subprocess

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import basename, is_test_path

#: Names of files and directories that are no part of a repository.
EXCLUDED = (
    ".expo", ".git", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".venv",
    "__pycache__", "build", "coverage", "dist", "node_modules", "venv", "web-build",
)
#: Languages and their extensions.
EXTENSIONS = {
    "javascript": ("cjs", "js", "jsx", "mjs"),
    "typescript": ("cts", "mts", "ts", "tsx"),
    "python": ("py", "pyi", "pyw"),
    "jupyter": ("ipynb",),
    "json": ("json",),
    "markdown": ("md", "mdx"),
    "yaml": ("yaml", "yml"),
    "astro": ("astro",),
    "svelte": ("svelte",),
    "vue": ("vue",),
}


def language(path: Column) -> Column:
    """The language of a path by its extension, or ``unknown``."""
    extension = F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, known in EXTENSIONS.items():
        out = out.when(extension.isin(*known), name)
    return out.otherwise("unknown")


def is_kept(path: Column) -> Column:
    """Whether no segment of a path is excluded or an environment file."""
    return ~F.exists(F.split(path, "/"), lambda s: s.isin(*EXCLUDED) | s.startswith(".env"))


def _kept_name(name: str) -> bool:
    return name not in EXCLUDED and not name.startswith(".env")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.git = options.get("git", "false").lower() == "true"
        self.per_task = int(options.get("filesPerTask", "256"))

    def _git_paths(self, root: str) -> list[str]:
        """What version control lists; empty where there is none."""
        command = ["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"]
        try:
            done = subprocess.run(command, capture_output=True, check=False)
        except FileNotFoundError:
            return []
        listed = sorted(set(filter(None, done.stdout.decode("utf-8", "surrogateescape").split("\0")))) if done.returncode == 0 else []
        full = [f"{root}/{p}" for p in listed if all(map(_kept_name, p.split("/")))]
        return [p for p in full if os.path.isfile(p) and not os.path.islink(p)]

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + os.path.abspath(self.root))
        local = isinstance(system, fs.LocalFileSystem)
        paths = self._git_paths(root) if self.git and local else []
        open_ = [] if paths else [root]
        while open_:
            for info in system.get_file_info(fs.FileSelector(open_.pop())):
                if not _kept_name(info.base_name) or (local and os.path.islink(info.path)):
                    continue
                if info.type == fs.FileType.Directory:
                    open_.append(info.path)
                elif info.type == fs.FileType.File:
                    paths.append(info.path)
        paths.sort()
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)]

    def read(self, partition):
        system, root = fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + os.path.abspath(self.root))
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([path[len(root) :].lstrip("/")]), pa.array([content], pa.binary())], names=["path", "content"])


class RepositorySource(DataSource):
    """``spark.read.format("repository").load(root)``: (path, content). Options: ``git``
    (list by version control where there is any), ``filesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, git: bool = False) -> DataFrame:
    """(path, language, is_test, bytes, sha256, lines, text) of every kept file under
    ``root``; links are not followed. ``lines`` is one more than the line feeds."""
    spark.dataSource.register(RepositorySource)
    files = spark.read.format("repository").option("git", str(git).lower()).load(root)
    text = F.col("content").cast("string")
    return files.select(
        "path", language(F.col("path")).alias("language"), is_test_path(F.col("path")).alias("is_test"), F.octet_length("content").cast("long").alias("bytes"),
        F.sha2("content", 256).alias("sha256"), (F.octet_length("content") - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), text.alias("text"),
    )


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(path, directory, package) declared by the package manifests among ``files``
    (path, text), from all four dependency fields; text that is no JSON declares none."""
    fields = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    known = ", ".join(f"{f} map<string,string>" for f in fields)
    parsed = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.from_json("text", known).alias("m"))
    names = F.array_distinct(F.concat(*(F.coalesce(F.map_keys(f"m.{f}"), F.array().cast("array<string>")) for f in fields)))
    return parsed.select("path", F.regexp_replace("path", "/?package\\.json$", "").alias("directory"), F.explode(names).alias("package"))
