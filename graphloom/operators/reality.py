"""What a repository declares and documents, held against what its files really do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import slashed

#: What an untouched starter page says, and what promises of an application say, by points.
STARTER_MARKERS = ("To get started, edit the page.tsx", "/next.svg")
APPLICATION_PHRASES = {"ai tutor": 4, "learning assistant": 3, "dashboard chat interface": 5, "next js": 2}
#: Import names of Python packages, and phrases that packages are known by.
IMPORT_NAMES = {
    "beautifulsoup4": ("bs4",), "opencv_python": ("cv2",), "pillow": ("pil",), "psycopg2_binary": ("psycopg2",), "pymupdf": ("pymupdf", "fitz"),
    "pyjwt": ("jwt",), "python_dotenv": ("dotenv",), "python_multipart": ("multipart",), "scikit_learn": ("sklearn",),
}
KNOWN_PHRASES = {"@tanstack/react-query": ("react query", "tanstack query"), "react-dropzone": ("react dropzone", "dropzone"), "react-markdown": ("react markdown", "markdown")}
STACK_HEADING = r"(?i)\b(?:architecture|backend|dependencies|frontend|requirements|stack)\b"


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _lookup(values: dict[str, tuple[str, ...]], key: Column, other: Column) -> Column:
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, key), other)


def folder(path: Column) -> Column:
    """The folder in lower case, empty at the root."""
    return F.regexp_extract(F.lower(slashed(path)), r"^(.*)/[^/]*$", 1)


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """(ecosystem, manifest, scope, name), once each, of ``manifests`` (path, text): the
    ``dependencies`` of package.json, and the lines of requirement files but for options,
    addresses and comments. Text that can't be read declares none."""
    base = F.element_at(F.split(F.lower(slashed(F.col("path"))), "/"), -1)
    npm = manifests.filter(base == "package.json").select("path", F.lit("npm").alias("ecosystem"), F.explode(F.map_keys(F.from_json("text", "dependencies map<string,string>")["dependencies"])).alias("name"))
    line = F.trim(F.regexp_replace("line", r"\s+#.*$", ""))
    python = manifests.filter(base == "requirements.txt").select("path", F.explode(F.split("text", "\r?\n")).alias("line")).select("path", F.lit("python").alias("ecosystem"), line.alias("line"))
    python = python.filter((F.col("line") != "") & ~F.col("line").rlike(r"^-|(?i)^(?:git\+|https?:)")).select("path", "ecosystem", F.regexp_extract("line", r"^[^\s<>=!~;\[]*", 0).alias("name"))
    both = npm.unionByName(python).filter("name != ''").distinct()
    return both.select("ecosystem", F.col("path").alias("manifest"), folder(F.col("path")).alias("scope"), "name")


def never_imported_dependencies(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """``dependencies`` that no file under their manifest's folder imports, itself or a
    part of it. ``imports`` (path, source) are met by equality: each stands for its file's
    folders above and for its own prefixes that end at a slash or dot."""
    plain = F.replace(F.lower("name"), F.lit("-"), F.lit("_"))
    names = F.when(F.col("ecosystem") == "npm", F.array(F.lower("name"))).otherwise(_lookup(IMPORT_NAMES, plain, F.array(plain)))
    wanted = dependencies.withColumn("import_name", F.explode(names))
    source, path = F.lower("source"), F.lower(slashed(F.col("path")))
    ends = lambda text, signs: F.filter(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(F.substring(text, i, F.lit(1)).isin(*signs), F.substring(text, F.lit(1), i - 1))), lambda s: s.isNotNull())
    seen = imports.filter("source != '' and path != ''").select(path.alias("path"), source.alias("source")).distinct()
    parts = seen.select("path", F.explode(F.array_append(ends(F.col("source"), "/."), F.col("source"))).alias("import_name")).distinct()
    roots = parts.select("import_name", F.explode(F.array_append(ends(F.col("path"), "/"), F.lit(""))).alias("scope")).distinct()
    used = wanted.join(roots, ["scope", "import_name"]).select("manifest", "ecosystem", "name").distinct()
    return dependencies.join(used, ["manifest", "ecosystem", "name"], "left_anti")


def documented_dependencies(dependencies: DataFrame, promises: DataFrame) -> DataFrame:
    """(manifest, name, promise_id): promises (promise_id, text, heading) that name a
    dependency. A package known by phrases needs one of them; any other its own words
    as the whole text, or in it under a heading on the stack. Phrases meet the runs of as
    many words in a text, by equality."""
    own = words(F.regexp_replace("name", "^@[^/]+/", ""))
    known = F.lower("name").isin(*KNOWN_PHRASES)
    phrases = dependencies.select("manifest", "name", known.alias("known"), F.explode(_lookup(KNOWN_PHRASES, F.lower("name"), F.array(own))).alias("phrase")).filter("phrase != ''")
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    said = promises.select("promise_id", F.coalesce("heading", F.lit("")).rlike(STACK_HEADING).alias("stack"), words(F.col("text")).alias("said"))
    runs = said.withColumn("w", F.split("said", " ")).select("promise_id", "stack", "said", "w", F.posexplode("w").alias("at", "_"))
    runs = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max(longest, 1))))).filter("at + k <= size(w)")
    runs = runs.select("promise_id", "stack", "said", F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ").alias("phrase")).distinct()
    hit = phrases.join(runs, "phrase").filter(F.col("known") | F.col("stack") | (F.col("said") == F.col("phrase")))
    return hit.select("manifest", "name", "promise_id").distinct()


def phantom_dependencies(dependencies: DataFrame, imports: DataFrame, promises: DataFrame) -> DataFrame:
    """(manifest, name, promise_id): declared, documented, and imported nowhere below
    the manifest. ``promises`` leaves out those already known to be missing."""
    return documented_dependencies(never_imported_dependencies(dependencies, imports), promises)


def starter_features(feature_paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(feature_id) of features whose every place is an untouched starter page.
    ``feature_paths`` (feature_id, role, path) has a row for each entrypoint or
    implementation node; one without a path keeps the feature out, unless it is an
    entrypoint's. A feature without entrypoints is none. ``sources``: (path, text)."""
    marked = F.lit(True)
    for marker in STARTER_MARKERS:
        marked = marked & F.col("text").contains(marker)
    starters = sources.filter(marked).select("path", F.lit(True).alias("starter")).distinct()
    rows = feature_paths.filter("role != 'entrypoint' or path is not null").join(starters, "path", "left")
    all_of = rows.groupBy("feature_id").agg(F.count_if(F.col("role") == "entrypoint").alias("n"), F.every(F.coalesce("starter", F.lit(False))).alias("all"))
    return all_of.filter("n > 0 and all").select("feature_id")


def application_promise(promises: DataFrame) -> DataFrame:
    """(promise_id, score): the promise (promise_id, text) that most speaks of an
    application, ties to the least id; no row if none does."""
    said = words(F.col("text"))
    score = F.when(said.contains("dashboard") & said.contains("chat"), 3).otherwise(0)
    for phrase, points in APPLICATION_PHRASES.items():
        score = score + F.when(F.concat(F.lit(" "), said, F.lit(" ")).contains(f" {phrase} "), points).otherwise(0)
    return promises.select("promise_id", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "promise_id").limit(1)
