"""Secret scans: patterns find candidates, and a random forest over their length,
character transitions, dictionary coverage, path and neighbouring words removes the
false positives (DataFrame only).

The forest is grown here from labelled findings by histograms: each level is one
grouped aggregation over all trees, and only the chosen splits (bounded by trees and
depth) come to the driver. It is scored as one CASE expression.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_table

#: Words that go with secrets, words that go with examples, and
#: frequent syllables of written language.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "auth", "bearer", "credential", "private_key", "access_key")
EXAMPLE_WORDS = ("example", "sample", "dummy", "test", "fake", "placeholder", "xxxx", "changeme", "checksum", "sha256", "sha1", "md5", "commit", "uuid", "digest", "hash")
SYLLABLES = ("the", "ing", "and", "ion", "ent", "ter", "est", "ers", "ati", "hat", "con", "tion", "ment", "que", "les", "eur", "ung", "ein", "sch", "der", "ado", "ción", "par", "for")

#: A candidate: 16 or more key characters, or what is assigned to a name with a secret
#: word or quoted after it, from 6 characters of any kind. A text is cut into words at all
#: other ASCII characters; up to three words before a candidate and two after it are read
#: with it, and a name before "=" in its own word.
CANDIDATE = r"[A-Za-z0-9_+/=.-]{16,}"
_BREAKS = r"\x00-\x2A\x2C\x3A-\x3C\x3E-\x40\x5B-\x5E\x60\x7B-\x7F"
BREAK = f"[{_BREAKS}]+"
_QUOTED = r"""\x22[^\x22\r\n]{6,}\x22|\x27[^\x27\r\n]{6,}\x27|\x60[^\x60\r\n]{6,}\x60"""
_BARE = r"""[^\s\x22\x27\x60]{5,}[^\s\x22\x27\x60,;)\]}]"""
#: A word, or a secret word's name up to its value (group 1, not consumed).
WORD_OR_NAME = (
    f"(?i:[^{_BREAKS}]*?(?:{'|'.join(SECRET_WORDS)}))[^{_BREAKS}=]*+[\\x22\\x27\\x60)\\]]*+\\s*+"
    f"(?:(?:=>|:=|[:=]++)\\s*+)?+(?=((?:{_QUOTED})|(?<=[:=>]\\s{{0,8}})(?:{_BARE})))|[^{_BREAKS}]++"
)
NAMED = r"^([A-Za-z_.-]*)=+(?=[A-Za-z0-9_+/=.-]{16})"
FEATURES = ("length", "digits", "transitions", "distinct", "coverage", "hexadecimal", "secret_word", "example_word", "bad_path", "symbols", "template", "upper", "vowels")
_STEPS = 16


def with_features(found: DataFrame) -> DataFrame:
    """Adds the forest's inputs to rows of value, before, after and path."""
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    around = F.lower(F.concat_ws(" ", "before", "after"))
    has = lambda text, words: F.coalesce(text.rlike("(?i)(" + "|".join(words) + ")"), F.lit(False)).cast("double")
    syllables = F.length(v) - F.length(F.regexp_replace(F.lower(v), "(" + "|".join(SYLLABLES) + ")", ""))
    distinct = F.size(F.array_distinct(F.split(v, "")))
    return found.select(
        "*",
        F.least(n, F.lit(200.0)).alias("length"),
        (count("[0-9]") / n).alias("digits"),
        (count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n).alias("transitions"),
        (distinct / F.least(n, F.lit(64.0))).alias("distinct"),
        (syllables / n).alias("coverage"),
        (count("[0-9a-fA-F]") / n).alias("hexadecimal"),
        has(F.lower(F.col("before")), SECRET_WORDS).alias("secret_word"),
        has(F.concat(around, F.lit(" "), F.lower(v)), EXAMPLE_WORDS).alias("example_word"),
        has(F.coalesce("path", F.lit("")), ("test", "example", "fixture", "docs", "sample")).alias("bad_path"),
        (count("[^A-Za-z0-9]") / n).alias("symbols"),
        v.rlike(r"^[<$%{\[*(]|[>}\]*)]$|^(.)\1+$").cast("double").alias("template"),
        (count("[A-Z]") / n).alias("upper"),
        (count("[aeiouAEIOU]") / n).alias("vowels"),
    )


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Findings with known labels, drawn by rule from hashes of row numbers: random
    keys beside secret words or in source paths, keys without a digit and short
    passwords with symbols are secrets; repeated characters, words, numbers, dotted
    names, checksums, examples, templates and words beside secret words are not."""
    rows = spark.range(n).select("id", *(F.sha2(F.concat(F.lit(s), F.col("id").cast("string")), 512).alias(s) for s in "abc"))
    pick = lambda column, size: F.conv(F.substring(column, 1, 6), 16, 10).cast("long") % size
    length = (F.lit(20) + pick("c", 45)).cast("int")
    hexa = F.substr(F.col("a"), F.lit(1), length)
    base = F.substr(F.translate(F.base64(F.unhex(F.concat("a", "b"))), "\r\n", ""), F.lit(1), length)
    syllables = F.array(*map(F.lit, SYLLABLES))
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.element_at(syllables, (F.conv(F.substr(F.col("b"), i * 3, F.lit(3)), 16, 10).cast("int") % len(SYLLABLES) + 1).cast("int"))), "")
    kind = pick("b", 20)
    letters = F.substr(F.translate(F.upper(base), "0123456789+/=", "QWXZKJVYHGMBN"), F.lit(1), F.lit(20))
    sign = F.substr(F.lit("!@#$%^&*?~"), (pick("a", 10) + 1).cast("int"), F.lit(1))
    part = F.substr(word, F.lit(1), (pick("c", 6) + 3).cast("int"))
    password = F.when(pick("a", 3) == 0, F.concat(F.initcap(part), pick("c", 1000).cast("string"), sign)).when(pick("a", 3) == 1, F.concat(F.initcap(part), sign, F.substr(base, F.lit(1), F.lit(4)))).otherwise(F.substr(F.translate(base, "/+", "!#"), F.lit(1), (pick("c", 9) + 6).cast("int")))
    template = F.element_at(F.array(*map(F.lit, ("<your-value>", "${VALUE}", "********", "changeme", "{{ value }}", "placeholder", "process.env.VALUE"))), (pick("c", 7) + 1).cast("int"))
    between = F.element_at(F.array(*map(F.lit, ("-", "_", "/", ".", ""))), (pick("a", 5) + 1).cast("int"))
    # long words of no known syllable, as prose of any language has them, some with a number
    prose = F.substr(F.translate(hexa, "0123456789abcdef", "aeiouaentrslhdcg"), F.lit(1), (pick("b", 11) + 16).cast("int"))
    prose = F.when(pick("a", 5) == 0, F.initcap(prose)).when(pick("a", 5) == 1, F.concat(prose, pick("a", 2000).cast("string"))).when(pick("a", 5) == 2, F.concat(prose, F.lit("."))).when(pick("a", 5) == 3, F.upper(prose)).otherwise(prose)
    joined = F.concat(word, between, F.substr(word, F.lit(3), F.lit(7)), between, part)
    value = (
        F.when(kind < 2, hexa)
        .when(kind < 4, base)
        .when(kind == 4, hexa)
        .when(kind == 5, F.concat(word, pick("a", 100).cast("string")))
        .when(kind == 6, F.repeat(F.substr(F.col("c"), F.lit(9), F.lit(2)), 12))
        .when(kind == 7, F.concat(F.translate(hexa, "abcdef", "012345")))
        .when(kind == 8, F.concat_ws(".", word, pick("c", 90).cast("string"), F.substr(word, F.lit(1), F.lit(9))))
        .when(kind == 9, base)
        .when(kind == 10, letters)
        .when(kind < 13, F.rpad(password, F.greatest(F.length(password), F.lit(6)), "7"))
        .when(kind == 13, F.substr(word, F.lit(1), (pick("c", 10) + 6).cast("int")))
        .when(kind == 14, joined)
        .when(kind == 15, template)
        .otherwise(prose)
    )
    good = (kind < 4) | kind.isin(10, 11, 12)
    known, shown = F.array(*map(F.lit, SECRET_WORDS)), F.array(*map(F.lit, EXAMPLE_WORDS))
    secret_word = F.element_at(known, (pick("a", len(SECRET_WORDS)) + 1).cast("int"))
    example = F.element_at(shown, (pick("a", len(EXAMPLE_WORDS)) + 1).cast("int"))
    plain = F.substr(word, F.lit(1), F.lit(7))
    before = F.when(kind.isin(11, 12, 13, 15), secret_word).when(good, F.when(pick("c", 8) == 0, plain).otherwise(secret_word)).when(kind.isin(4, 9), example).when(pick("c", 8) == 0, secret_word).otherwise(plain)
    path = F.when(pick("c", 5) == 0, F.when(good, F.lit("src/app.cfg")).otherwise(F.lit("tests/example.txt"))).otherwise(F.lit(""))
    return rows.select("id", value.alias("value"), before.alias("before"), plain.alias("after"), path.alias("path"), good.cast("int").alias("label"))


def grow_forest(findings: DataFrame, trees: int = 16, depth: int = 5, seed: int = 11) -> list[dict]:
    """Trees as maps of node number to (feature, threshold) or to a leaf's chance.
    Thresholds are at equal-frequency steps; each tree draws its rows (about 63 %,
    weighed) and each node its features by hashes, so reruns agree."""
    spark = findings.sparkSession
    data = with_features(findings).select("id", "label", *FEATURES)
    steps = data.agg(*(F.percentile_approx(f, [i / _STEPS for i in range(1, _STEPS)], 1000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(steps[f] or [])) for f in FEATURES}
    for f in FEATURES:
        data = data.withColumn(f, sum(((F.col(f) > F.lit(float(c))).cast("int") for c in cuts[f]), F.lit(0)))
    bins = F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*FEATURES))
    data = data.select("id", "label", bins.alias("bins")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1000))
    data = data.withColumn("w", F.when(draw < 368, 0).when(draw < 736, 1).when(draw < 920, 2).otherwise(3)).filter("w > 0")
    data = data.withColumn("node", F.lit(1)).cache()
    forest: list[dict] = [{} for _ in range(trees)]
    node_of = data
    for level in range(depth + 1):
        totals = node_of.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("y")).collect()
        for r in totals:
            forest[r["tree"]][r["node"]] = r["y"] / r["n"]
        open_nodes = [(r["tree"], r["node"]) for r in totals if 0 < r["y"] < r["n"] and r["n"] >= 20]
        if level == depth or not open_nodes:
            break
        table = local_table(spark, pa.table({"tree": pa.array([t for t, _ in open_nodes], pa.int32()), "node": pa.array([n for _, n in open_nodes], pa.int32())}))
        long = node_of.join(F.broadcast(table), ["tree", "node"]).select("tree", "node", "label", "w", F.explode("bins").alias("feature", "bin"))
        long = long.filter(F.pmod(F.xxhash64("tree", "node", "feature", F.lit(seed)), F.lit(5)) < 3)
        hist = long.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("y"))
        whole = Window.partitionBy("tree", "node", "feature")
        left = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        split = hist.select("tree", "node", "feature", "bin", *(F.sum(c).over(w).alias(a) for c, w, a in (("n", left, "nl"), ("y", left, "yl"), ("n", whole, "n"), ("y", whole, "y"))))
        split = split.filter("nl < n")
        # the weighed Gini purity after the split; larger is better
        good = F.expr("(yl * yl + (nl - yl) * (nl - yl)) / nl + ((y - yl) * (y - yl) + (n - nl - y + yl) * (n - nl - y + yl)) / (n - nl)")
        chosen = split.withColumn("good", good).groupBy("tree", "node").agg(F.max(F.struct("good", "feature", "bin")).alias("best")).collect()
        if not chosen:
            break
        for r in chosen:
            forest[r["tree"]][r["node"]] = (r["best"]["feature"], float(cuts[r["best"]["feature"]][r["best"]["bin"]]))
        picks = pa.table({"tree": pa.array([r["tree"] for r in chosen], pa.int32()), "node": pa.array([r["node"] for r in chosen], pa.int32()), "f": pa.array([r["best"]["feature"] for r in chosen]), "b": pa.array([r["best"]["bin"] for r in chosen], pa.int32())})
        node_of = node_of.join(F.broadcast(local_table(spark, picks)), ["tree", "node"])
        node_of = node_of.select("id", "label", "bins", "tree", "w", (F.col("node") * 2 + (F.element_at("bins", F.col("f")) > F.col("b")).cast("int")).alias("node"))
    data.unpersist()
    return forest


def forest_score(forest: list[dict]) -> Column:
    """The mean of the trees' chances, as one expression over the feature columns."""

    def tree(nodes: dict, at: int) -> Column:
        here = nodes[at]
        if not isinstance(here, tuple):
            return F.lit(float(here))
        both = [tree(nodes, c) if c in nodes else F.lit(0.0) for c in (2 * at, 2 * at + 1)]
        return F.when(F.col(here[0]) <= F.lit(here[1]), both[0]).otherwise(both[1])

    total = F.lit(0.0)
    for nodes in forest:
        total = total + tree(nodes, 1)
    return total / F.lit(float(len(forest)))


def scan(docs: DataFrame, forest: list[dict], threshold: float = 0.5, path: Column | None = None) -> DataFrame:
    """Every candidate in the whole texts of ``docs`` (doc_id, text; others ignored).

    Returns (doc_id, ordinal, value_sha256, length, before, score, is_secret): the
    value itself is given as a digest only. ``path`` names the text's place where
    there is one. Null and empty texts have no candidates; a text of any length is read
    whole; repeated rows repeat their findings; an empty table gives no rows. ``ordinal``
    rises with a finding's place in the text and is its own within a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", (path if path is not None else F.lit("")).alias("path"), text.alias("text"))
    # texts without a secret word are cut at once; in others each name shows its value
    found = found.withColumn("named", F.lower("text").rlike("|".join(SECRET_WORDS)))
    words = F.when(F.col("named"), F.regexp_extract_all("text", F.lit(WORD_OR_NAME), F.lit(0))).otherwise(F.split("text", BREAK))
    given = F.when(F.col("named"), F.regexp_extract_all("text", F.lit(WORD_OR_NAME), F.lit(1)))
    found = found.select("doc_id", "path", words.alias("words"), given.alias("given"))
    # short words are passed over before any pattern is tried
    seen = """filter(transform(words, (w, i) -> if(length(w) >= 16 or coalesce(given[i], '') != '',
        struct(i, slice(words, greatest(i - 2, 1), least(i, 3)) as before, w as word, coalesce(given[i], '') as given, slice(words, i + 2, 2) as after), null)), x -> x is not null)"""
    found = found.select("doc_id", "path", F.explode(F.expr(seen)).alias("m"))
    word = F.regexp_extract("m.word", f"^[^{_BREAKS}]+", 0)
    name = F.when(F.col("m.given") != "", F.regexp_replace(word, "=+$", "")).otherwise(F.regexp_extract("m.word", NAMED, 1))
    runs = F.regexp_extract_all(F.when(F.col("m.given") != "", F.regexp_replace(word, "=+$", "")).otherwise(F.regexp_replace("m.word", NAMED, "")), F.lit(CANDIDATE), F.lit(0))
    own = F.regexp_replace("m.given", r"^([\x22\x27\x60])(.*)\1$", "$2")
    # a value that is one run is found as the next word, the name before it
    alone = (own == "") | own.rlike(r"^[A-Za-z0-9_+/.-]{16,}=*$")
    values = F.concat(F.transform(runs, lambda v: F.struct(v.alias("value"), F.lit("").alias("name"))), F.when(alone, F.array().cast("array<struct<value:string,name:string>>")).otherwise(F.array(F.struct(own.alias("value"), name.alias("name")))))
    given_name = F.when(F.col("m.given") == "", name).otherwise(F.lit(""))
    clean = lambda ws: F.transform(ws, lambda w: F.regexp_replace(w, f"[{_BREAKS}]+$|(?<=[A-Za-z_.-])=+[{_BREAKS}]*$", ""))
    found = found.select("doc_id", "path", F.col("m.i").alias("i"), clean(F.col("m.before")).alias("b"), given_name.alias("n"), F.array_join(clean(F.col("m.after")), " ").alias("after"), F.posexplode(values).alias("j", "v"))
    # a text's words come in order from one row, so a place is (word, run) in one number: a
    # word of a text has under 2**27 runs of 16 characters, and a text under 2**31 words
    found = found.select("doc_id", "path", (F.shiftleft(F.col("i").cast("long"), 27) + F.col("j")).alias("ordinal"), F.concat_ws(" ", F.array_join("b", " "), "n", "v.name").alias("before"), F.col("v.value").alias("value"), "after")
    scored = with_features(found).withColumn("score", forest_score(forest))
    return scored.select("doc_id", "ordinal", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), F.trim("before").alias("before"), "score", (F.col("score") >= threshold).alias("is_secret"))
