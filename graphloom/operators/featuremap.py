"""The feature map: capabilities, owners of nodes and files, blocks, their connections,
and what removing one would do. Features are tables: ``members`` (feature_id, node_id).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, stored
from ..functions.text import directory
from ..plans.graph import EvidenceGraph

#: Edge types by which one block depends on another.
DEPENDENCIES = ("IMPORTS", "CALLS", "REFERENCES", "HANDLED_BY", "VALIDATED_BY", "RENDERS", "PUBLISHES", "SUBSCRIBES_TO", "CONFIGURED_BY")
#: Patterns of configuration files, shared folders, and tests, and languages of no code.
CONFIG_FILE = r"(?i)(?:^|/)(?:(?:next|jest|eslint|vite|vitest|webpack|rollup|babel|postcss|tailwind|tsconfig|jsconfig|playwright|cypress|prettier)\.(?:config|setup)|config|settings|env)(?:\.[^/]+)?\.(?:js|ts|mjs|cjs|py|json|ya?ml)$"
SHARED_FOLDER = r"(?i)(?:^|/)(?:models?|schemas?|middleware|repositories|policies|db|database|shared|common|utils?|helpers?|core|services)/"
TEST_FILE = r"(?i)(?:^|/)(?:tests?|__tests__)/|\.(?:test|spec)\.[^/]+$"
NO_CODE = ("markdown", "json", "yaml", "unknown")
#: Verdicts on orphans, strongest first.
VERDICTS = ("VALIDATED_SAFE_TO_DELETE", "CANDIDATE", "VALIDATION_REQUIRED", "UNKNOWN_DYNAMIC_USAGE")
DATABASE_FOLDER = r"(?i)(?:^|/)(?:models?|db|database|migrations?|seeds?)/"


def capability_key(kind: Column, path: Column, route: Column, name: Column) -> Column:
    """What groups an entrypoint's feature with others: the file and the route's first
    word, a command line's file or database folder, a page's first two words."""
    parts = lambda text, drop: F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "/"), lambda s: (s != "") & ~s.rlike(drop))
    served = parts(route, r"^[:{]|^api$|^[vV]\d+$")
    shown = F.transform(parts(F.regexp_replace(F.coalesce(route, name), r"(?i)^PAGE\s+", ""), r"^[:\[]"), lambda s: F.lower(s))
    folder = directory(path)
    return (
        F.when(kind.isin("http", "graphql", "websocket"), F.concat_ws(":", F.lit("http"), path, F.lower(F.coalesce(F.get(served, F.lit(0)), F.lit("root")))))
        .when((kind == "cli") & path.rlike(DATABASE_FOLDER), F.concat_ws(":", F.lit("cli"), F.when(folder == "", "db").otherwise(folder), F.lit("db-lifecycle")))
        .when(kind == "cli", F.concat_ws(":", F.lit("cli"), path))
        .when((kind == "application") & (F.size(shown) >= 1), F.concat(F.lit("ui:"), F.array_join(F.slice(shown, 1, 2), "-")))
        .when(kind == "application", F.concat_ws(":", F.lit("ui"), path))
        .otherwise(F.concat_ws(":", kind, path))
    )


def capabilities(graph: EvidenceGraph, entries: DataFrame) -> DataFrame:
    """(feature_id, key) for features with their entrypoints ``entries`` (feature_id,
    entrypoint_id): by the first of them."""
    first = entries.groupBy("feature_id").agg(F.min("entrypoint_id").alias("node_id"))
    n = graph.nodes.filter("node_type = 'entrypoint'").select("node_id", capability_key(F.col("entry_kind"), F.col("path"), F.col("route"), F.col("name")).alias("key"))
    return first.join(n, "node_id", "left").select("feature_id", F.coalesce("key", F.concat(F.lit("feature:"), "feature_id")).alias("key"))


def capability_blocks(keyed: DataFrame, features: DataFrame) -> DataFrame:
    """(key, block_id, features, status, confidence, kind) of ``features`` (feature_id,
    canonical_id, status, confidence, kind): those of one key are one block, named by the
    hash of their canonical ids; a single one keeps its own. Its status, confidence and
    kind are the first of a fixed order that any of them has."""
    first = lambda column, order: F.coalesce(*(F.max(F.when(F.col(column) == v, v)) for v in order), F.min(column))
    rows = keyed.join(dealt(features), "feature_id").groupBy("key").agg(
        F.array_sort(F.collect_list("canonical_id")).alias("ids"), F.count(F.lit(1)).alias("features"),
        first("status", ("PARTIALLY_IMPLEMENTED", "IMPLEMENTED_DOCUMENTED", "IMPLEMENTED_UNDOCUMENTED", "AMBIGUOUS")).alias("status"),
        first("confidence", ("HIGH", "MEDIUM", "LOW")).alias("confidence"), first("kind", ("functional", "infrastructure")).alias("kind"),
    )
    own = F.when(F.col("features") == 1, F.element_at("ids", 1)).otherwise(F.concat(F.lit("feature-"), F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 16)))
    return rows.select("key", own.alias("block_id"), "features", "status", "confidence", "kind")


def owners(found: DataFrame) -> DataFrame:
    """(node_id, owners, only): how many features own a node, and which if just one."""
    return found.groupBy("node_id").agg(F.countDistinct("feature_id").alias("owners"), F.min("feature_id").alias("low"), F.max("feature_id").alias("high")).select("node_id", "owners", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))


def node_files(graph: EvidenceGraph) -> DataFrame:
    """(node_id, file_id): every node's file, a file's own being itself."""
    return graph.nodes.select("node_id", F.coalesce("file_id", F.when(F.col("node_type") == "file", F.col("node_id"))).alias("file_id")).filter("file_id is not null")


def file_owners(graph: EvidenceGraph, found: DataFrame) -> DataFrame:
    """(file_id, feature_id) of the files whose nodes a feature has."""
    return found.join(node_files(graph), "node_id").select("file_id", "feature_id").distinct()


def consumers(graph: EvidenceGraph, owned: DataFrame) -> DataFrame:
    """(file_id, feature_id): owners of a file, and those of files with a dependency on it."""
    own = node_files(graph)
    e = graph.edges.filter(F.col("type").isin(*DEPENDENCIES)).select("source", "target").distinct()
    e = e.join(own.select(F.col("node_id").alias("source"), F.col("file_id").alias("a")), "source").join(own.select(F.col("node_id").alias("target"), F.col("file_id").alias("b")), "target")
    steps = e.filter("a != b").select(F.col("a").alias("file_id"), "b").distinct()
    return owned.union(owned.join(steps, "file_id").select(F.col("b"), "feature_id")).distinct()


def baseplate(graph: EvidenceGraph, owned: DataFrame) -> DataFrame:
    """(file_id) of the infrastructure: files of configs, configuration files, and files
    of startup entrypoints that no feature owns."""
    n = graph.nodes
    started = n.filter("node_type = 'entrypoint' and exposure = 'startup'").select("file_id").distinct().join(owned, "file_id", "left_anti")
    named = n.filter((F.col("node_type") == "file") & F.col("path").rlike(CONFIG_FILE)).select(F.col("node_id").alias("file_id"))
    return n.filter("node_type = 'config'").select("file_id").union(started).union(named).distinct()


def shared_files(graph: EvidenceGraph, owned: DataFrame, used: DataFrame, base: DataFrame) -> DataFrame:
    """(file_id, consumers): code files outside the baseplate that several features own
    or use, or that one uses from a shared folder."""
    code = graph.nodes.filter((F.col("node_type") == "file") & ~F.coalesce("language", F.lit("unknown")).isin(*NO_CODE) & ~F.col("path").rlike(TEST_FILE))
    code = dealt(code.select(F.col("node_id").alias("file_id"), F.col("path").rlike(SHARED_FOLDER).alias("common")).join(base, "file_id", "left_anti"))
    opened = graph.nodes.filter("node_type = 'entrypoint' and exposure = 'external'").select("file_id", F.lit(True).alias("opens")).distinct()
    direct = owned.groupBy("file_id").agg(F.count(F.lit(1)).alias("owners"))
    rows = code.join(used.groupBy("file_id").agg(F.count(F.lit(1)).alias("consumers")), "file_id").join(direct, "file_id", "left").join(opened, "file_id", "left")
    own, closed = F.coalesce("owners", F.lit(0)), F.col("opens").isNull()
    rule = (closed & (own >= 2)) | ((own == 0) & (F.col("consumers") >= 2)) | ((own == 0) & F.col("common")) | (closed & (F.col("consumers") >= 2) & F.col("common"))
    return rows.filter(rule).select("file_id", "consumers")


class FeatureMap:
    """``infrastructure`` and ``shared`` (node_id, block_id) partition what no feature
    owns alone; ``membership`` (feature_id, node_id, exclusive); ``connections``
    (from_block, to_block, kind, confidence, label, evidence); ``impact`` (feature_id,
    freed_nodes, freed_files, freed_lines, orphaned_blocks, degraded_blocks); ``sizes``
    (block_id, kind, files, lines). The last four are made when first asked for."""

    def __init__(self, graph: EvidenceGraph, found: DataFrame):
        short = lambda text: F.substring(F.sha2(text, 256), 1, 16)
        self.graph = graph
        own = self.own = node_files(graph)
        self.found = found = stored(found.select("feature_id", "node_id").distinct(), "map-members")
        self.owned = owned = stored(file_owners(graph, found), "map-files")
        used = consumers(graph, owned)
        base = stored(baseplate(graph, owned), "map-base")
        common = stored(shared_files(graph, owned, used, base), "map-shared")
        paths = self.paths = graph.nodes.filter("node_type = 'file'").select(F.col("node_id").alias("file_id"), "path", F.greatest(F.lit(0), F.coalesce(F.col("line_end") - F.col("line_start") + 1, F.lit(0))).cast("long").alias("lines"))

        started = graph.nodes.filter("(node_type = 'entrypoint' and exposure = 'startup') or node_type = 'config'").select("node_id", "file_id").join(common.select("file_id"), "file_id", "left_anti")
        infra_nodes = own.join(base, "file_id", "left_semi").select("node_id").union(started.select("node_id")).distinct()
        infra_files = infra_nodes.join(own, "node_id").select("file_id").distinct()
        plate = infra_files.join(paths, "file_id").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("p")).select(F.concat(F.lit("infra-"), short(F.col("p"))).alias("block_id"))
        self.infrastructure = stored(infra_nodes.crossJoin(F.broadcast(plate)), "map-infra")  # one row
        self.shared = stored(own.join(common, "file_id", "left_semi").join(paths, "file_id").select("node_id", F.concat(F.lit("shared-"), short(F.col("path"))).alias("block_id")), "map-blocks")
        self.plate_files = infra_files.crossJoin(F.broadcast(plate)).select("file_id", "block_id")

    @cached_property
    def placed(self) -> DataFrame:
        """(node_id, block_id): a node's block, shared or baseplate, by itself or by its file."""
        placed = dealt(self.shared.union(self.infrastructure.join(self.shared, "node_id", "left_anti")))
        by_file = self.own.join(self.plate_files, "file_id").select("node_id", "block_id").join(placed, "node_id", "left_anti")
        return stored(placed.union(by_file), "map-placed")

    @cached_property
    def membership(self) -> DataFrame:
        count = owners(self.found)
        rows = self.found.join(count, "node_id").join(self.placed.select("node_id", F.lit(True).alias("placed")), "node_id", "left")
        return stored(rows.select("feature_id", "node_id", ((F.col("owners") == 1) & F.col("placed").isNull()).alias("exclusive")), "map-membership")

    @cached_property
    def connections(self) -> DataFrame:
        graph, own, found, placed = self.graph, self.own, self.found, self.placed
        # a node without a block goes by its owners
        unplaced = own.join(placed, "node_id", "left_anti").join(found.select("node_id"), "node_id", "left_anti")  # before files' owners multiply it
        free = found.select("node_id", "feature_id").join(placed, "node_id", "left_anti").union(unplaced.join(self.owned, "file_id").select("node_id", "feature_id"))
        many = free.groupBy("node_id").agg(F.count(F.lit(1)).alias("m"))
        where = placed.select("node_id", "block_id", F.lit(True).alias("proven")).union(free.join(many, "node_id").select("node_id", "feature_id", F.col("m") == 1))
        where = stored(where, "map-where")
        kinds = graph.nodes.select(F.col("node_id").alias("target"), "node_type", F.coalesce("name", "path").alias("label"))
        a, b = (where.toDF(*names) for names in (("source", "from_block", "pa"), ("target", "to_block", "pb")))
        e = graph.edges.filter(F.col("type").isin(*DEPENDENCIES)).join(kinds, "target").join(a, "source").join(b, "target").filter("from_block != to_block")
        t, n = F.col("type"), F.col("node_type")
        kind = (
            F.when(t.isin("PUBLISHES", "SUBSCRIBES_TO") | (n == "event"), "event").when((t == "VALIDATED_BY") | (n == "schema"), "shared_data").when(n.isin("endpoint", "entrypoint"), "http")
            .when(F.col("to_block").rlike("^(shared|infra)-") | t.isin("CONFIGURED_BY", "IMPORTS"), "rests_on").otherwise("calls")
        )
        links = e.select("from_block", "to_block", kind.alias("kind"), (F.col("pa") & F.col("pb")).alias("proven"), F.concat_ws(" ", t, "label").alias("label"), F.concat_ws(":", F.coalesce("ev_file", F.lit("")), F.coalesce("ev_line", F.lit(1)).cast("string")).alias("evidence"))
        rests = self.membership.filter("not exclusive").join(self.shared.union(self.infrastructure), "node_id").join(own, "node_id").join(self.paths, "file_id").join(graph.nodes.select("node_id", "line_start"), "node_id")
        rests = rests.select(F.col("feature_id").alias("from_block"), F.col("block_id").alias("to_block"), F.lit("rests_on").alias("kind"), F.lit(True).alias("proven"), F.concat(F.lit("Uses "), "block_id").alias("label"), F.concat_ws(":", "path", F.coalesce("line_start", F.lit(1)).cast("string")).alias("evidence"))
        every, pair = links.union(rests), ["from_block", "to_block", "kind"]
        total = every.groupBy(*pair).agg(F.max("proven").alias("p"), F.countDistinct("evidence").alias("evidence"))
        # the first three labels by rank: no task holds all labels of two blocks
        place = F.row_number().over(Window.partitionBy(*pair).orderBy("label"))
        labels = every.select(*pair, "label").distinct().withColumn("place", place).filter("place <= 3")
        both = total.withColumn("label", F.lit(None).cast("string")).union(labels.select(*pair, F.lit(None).cast("boolean"), F.lit(None).cast("long"), "label"))
        joined = both.groupBy(*pair).agg(F.max("p").alias("p"), F.array_sort(F.collect_list("label")).alias("labels"), F.max("evidence").alias("evidence"))
        return stored(joined.select(*pair, F.when(F.col("p"), "PROVEN").otherwise("POSSIBLE").alias("confidence"), F.array_join("labels", "; ").alias("label"), "evidence"), "map-connections")

    @cached_property
    def shown(self) -> DataFrame:
        return self.membership.groupBy("feature_id").agg(F.count_if("exclusive").alias("freed_nodes"))

    @cached_property
    def picked(self) -> DataFrame:
        """(feature_id, file_id): files of a feature's own nodes, of all where it has none."""
        return self.membership.join(self.shown, "feature_id").filter("exclusive or freed_nodes = 0").join(self.own, "node_id").select("feature_id", "file_id").distinct()

    @cached_property
    def impact(self) -> DataFrame:
        """What goes with a feature: its own nodes, files it alone owns, blocks it alone uses."""
        features = self.found.select("feature_id").distinct()
        alone = self.owned.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("file_id")
        freed = self.picked.join(alone, "file_id", "left_semi").join(self.paths, "file_id").groupBy("feature_id").agg(F.count(F.lit(1)).alias("freed_files"), F.sum("lines").alias("freed_lines"))
        uses = self.connections.join(features.select(F.col("feature_id").alias("from_block")), "from_block", "left_semi").filter(F.col("to_block").rlike("^(shared|infra)-")).select("from_block", "to_block").distinct()
        left = dealt(uses).join(uses.groupBy("to_block").agg(F.count(F.lit(1)).alias("users")), "to_block")
        lost = left.groupBy(F.col("from_block").alias("feature_id")).agg(F.count_if(F.col("users") == 1).alias("orphaned_blocks"), F.count_if((F.col("users") == 2) & F.col("to_block").startswith("shared-")).alias("degraded_blocks"))
        return self.shown.join(dealt(freed), "feature_id", "left").join(dealt(lost), "feature_id", "left").na.fill(0).select("feature_id", "freed_nodes", "freed_files", "freed_lines", "orphaned_blocks", "degraded_blocks")

    @cached_property
    def sizes(self) -> DataFrame:
        sized = self.picked.select(F.col("feature_id").alias("block_id"), F.lit("feature").alias("kind"), "file_id")
        sized = sized.union(self.shared.join(self.own, "node_id").select("block_id", F.lit("shared_subsystem"), "file_id")).union(self.plate_files.select("block_id", F.lit("infrastructure"), "file_id")).distinct()
        return sized.join(self.paths, "file_id").groupBy("block_id", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


def feature_map(graph: EvidenceGraph, found: DataFrame) -> FeatureMap:
    """The map of features by their members ``found`` (feature_id, node_id). A table of
    no members gives only the baseplate."""
    return FeatureMap(graph, found)


def orphans(graph: EvidenceGraph, candidates: DataFrame) -> DataFrame:
    """(file_id, block_id, verdict, confidence, nodes, lines): dead-code ``candidates``
    (file_id, node_id, verdict) by file, with the strongest verdict of each."""
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    n = graph.nodes.select("node_id", F.greatest(F.lit(1), F.coalesce(F.col("line_end") - F.col("line_start") + 1, F.lit(1))).cast("long").alias("lines"))
    paths = graph.nodes.filter("node_type = 'file'").select(F.col("node_id").alias("file_id"), "path")
    rows = candidates.join(n, "node_id", "left").groupBy("file_id").agg(F.min(place).alias("v"), F.countDistinct("node_id").alias("nodes"), F.sum("lines").alias("lines")).join(paths, "file_id")
    verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("v").cast("int"))
    confidence = F.when(F.col("v") == 1, "HIGH").when(F.col("v") == 4, "LOW").otherwise("MEDIUM")
    return rows.select("file_id", F.concat(F.lit("orphan-"), F.substring(F.sha2("path", 256), 1, 16)).alias("block_id"), verdict.alias("verdict"), confidence.alias("confidence"), "nodes", "lines")


def ports(graph: EvidenceGraph, found: DataFrame) -> DataFrame:
    """(feature_id, node_id, kind, label): how a feature is entered: its entrypoints, else
    its screens and components, else its exported functions and classes."""
    n, kind = graph.nodes, F.col("node_type")
    opened = (F.col("node_type").isin("function", "class")) & F.col("exported") & ~F.contains("name", F.lit("."))
    tier = F.when(kind == "entrypoint", 1).when(kind.isin("screen", "component"), 2).when(opened, 3)
    label = F.when((kind == "entrypoint") & F.col("route").isNotNull(), F.concat_ws(" ", F.coalesce("http_method", F.upper("entry_kind")), "route")).otherwise(F.col("name"))
    rows = found.join(n.select("node_id", tier.alias("tier"), F.when(kind == "entrypoint", F.col("entry_kind")).when(kind.isin("screen", "component"), kind).otherwise("component").alias("kind"), label.alias("label")).filter("tier is not null"), "node_id")
    first = rows.groupBy("feature_id").agg(F.min("tier").alias("tier"))
    return rows.join(first, ["feature_id", "tier"]).select("feature_id", "node_id", "kind", "label").distinct()


def map_violations(fm: FeatureMap) -> DataFrame:
    """(rule, location): nodes both exclusive and shared, connections to unknown blocks
    or without evidence. A right map has none."""
    known = fm.membership.select(F.col("feature_id").alias("block_id")).union(fm.shared.select("block_id")).union(fm.infrastructure.select("block_id")).distinct()
    both = fm.membership.groupBy("feature_id", "node_id").agg(F.countDistinct("exclusive").alias("n")).filter("n > 1").select(F.lit("overlap").alias("rule"), F.concat_ws(" ", "feature_id", "node_id").alias("location"))
    c = fm.connections
    ends = [c.join(known, c[end] == known["block_id"], "left_anti").select(F.lit(end), F.col(end)) for end in ("from_block", "to_block")]
    bare = c.filter("evidence = 0").select(F.lit("evidence"), F.concat_ws(" ", "from_block", "to_block"))
    return both.union(ends[0]).union(ends[1]).union(bare)


def exclusive_and_shared(fm: FeatureMap) -> DataFrame:
    """(feature_id, exclusive, shared): counts of a feature's nodes."""
    return fm.membership.groupBy("feature_id").agg(F.count_if("exclusive").alias("exclusive"), F.count_if(~F.col("exclusive")).alias("shared"))
