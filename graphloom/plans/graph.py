"""The evidence graph: two tables, and an adapter that makes one of a star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import dealt, stored
from ..functions.text import is_test_path

#: Edge types and how features weigh them.
EDGE_WEIGHTS = {
    "CALLS": 0.92, "REFERENCES": 0.64, "HANDLED_BY": 1.0, "VALIDATED_BY": 0.86, "TESTED_BY": 0.72, "RENDERS": 0.88,
    "PUBLISHES": 0.86, "SUBSCRIBES_TO": 0.84, "CONFIGURED_BY": 0.72, "CONTAINS": 0.0, "IMPORTS": 0.0,
}
#: Edge types that product code is reached by; imports count from external roots alone.
REACHING = ("CALLS", "REFERENCES", "HANDLED_BY", "VALIDATED_BY", "RENDERS", "PUBLISHES", "SUBSCRIBES_TO", "CONFIGURED_BY")
#: Edge types that show a node is in use.
MEANINGFUL = (*REACHING, "TESTED_BY")

NODE_COLUMNS = {
    "node_id": "string", "node_type": "string", "name": "string", "file_id": "string", "path": "string", "language": "string",
    "line_start": "int", "line_end": "int", "exported": "boolean", "entry_kind": "string", "exposure": "string", "http_method": "string",
    "route": "string", "handler_symbol_id": "string", "symbol_id": "string", "entrypoint_id": "string",
}


@dataclass
class EvidenceGraph:
    """``nodes`` by NODE_COLUMNS and ``edges`` (source, target, type, ev_file, ev_line,
    ev_extractor): a directed multigraph with provenance."""

    nodes: DataFrame
    edges: DataFrame

    def stored(self) -> EvidenceGraph:
        return EvidenceGraph(stored(self.nodes, "nodes"), stored(self.edges, "edges"))


def node_rows(df: DataFrame, **columns) -> DataFrame:
    """``df`` as node rows; columns that are not given are null."""
    return df.select(*((columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()))


def commerce_graph(spark: SparkSession, sf_dir: str) -> EvidenceGraph:
    """An evidence graph of the star schema: nations and brands are files, suppliers,
    customers and parts are functions, finished orders are entrypoints, line items
    are calls and test references. All from scans, joins on keys and one distinct."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    c = F.col
    nation_path = lambda key: F.concat(F.lit("src/nation/"), key.cast("string"), F.lit(".ts"))
    brand = F.substring("p_brand", 7, 9).cast("int")
    brand_path = F.when(brand % 5 == 0, F.concat(F.lit("tests/brand_"), brand.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/brand/"), brand.cast("string"), F.lit(".py")))
    named = lambda kind, key: F.concat(F.lit(f"function:{kind}:"), key.cast("string"))

    paths = read("nation").select(nation_path(c("n_nationkey")).alias("path"), (c("n_nationkey") + 100).alias("lines")).unionByName(read("part").select(brand_path.alias("path"), (brand + 200).alias("lines")).distinct())
    files = node_rows(
        paths, node_id=F.concat(F.lit("file:"), c("path")), node_type=F.lit("file"), name=c("path"), path=c("path"), line_start=F.lit(1), line_end=c("lines"),
        language=F.when(c("path").endswith(".ts"), "typescript").otherwise("python"),
    )
    symbols = (
        read("supplier").select(named("supplier", c("s_suppkey")).alias("id"), c("s_name").alias("name"), nation_path(c("s_nationkey")).alias("path"), (c("s_acctbal") > 0).alias("exported"))
        .unionByName(read("customer").select(named("customer", c("c_custkey")).alias("id"), c("c_name").alias("name"), nation_path(c("c_nationkey")).alias("path"), (c("c_acctbal") > 0).alias("exported")))
        .unionByName(read("part").select(named("part", c("p_partkey")).alias("id"), c("p_name").alias("name"), brand_path.alias("path"), (c("p_size") % 2 == 0).alias("exported")))
    )
    functions = node_rows(symbols, node_id=c("id"), node_type=F.lit("function"), name=c("name"), file_id=F.concat(F.lit("file:"), c("path")), path=c("path"), exported=c("exported"))

    external = (c("o_orderpriority") == "1-URGENT") & (c("o_orderkey") % 4 == 0)
    startup = (c("o_orderpriority") == "2-HIGH") & (c("o_orderkey") % 4 == 1)
    orders = read("orders").filter((c("o_orderstatus") == "F") & (external | startup))
    orders = orders.join(dealt(read("customer")), c("o_custkey") == c("c_custkey")).select(
        F.concat(F.lit("entrypoint:http:order:"), c("o_orderkey").cast("string")).alias("id"), named("customer", c("o_custkey")).alias("handler"),
        nation_path(c("c_nationkey")).alias("path"), F.when(external, "external").otherwise("startup").alias("exposure"), F.concat(F.lit("/orders/"), c("o_orderkey").cast("string")).alias("route"),
    )
    entrypoints = node_rows(
        orders, node_id=c("id"), node_type=F.lit("entrypoint"), name=c("route"), file_id=F.concat(F.lit("file:"), c("path")), path=c("path"),
        entry_kind=F.lit("http"), exposure=c("exposure"), http_method=F.lit("GET"), route=c("route"), handler_symbol_id=c("handler"),
    )
    opened = orders.filter("exposure = 'external'")
    endpoints = node_rows(
        opened, node_id=F.concat(F.lit("endpoint:"), c("id")), node_type=F.lit("endpoint"), name=c("route"), file_id=F.concat(F.lit("file:"), c("path")), path=c("path"), entrypoint_id=c("id"),
    )

    line = dealt(read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"))
    low = read("orders").filter(c("o_orderpriority") == "5-LOW").select("o_orderkey", "o_custkey")
    part = read("part").select("p_partkey", brand_path.alias("path"))
    parts = part.count()
    pairs = lambda df, s, t, kind: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"))
    bought = line.filter("l_returnflag = 'R' and l_quantity >= 48").join(read("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    supplied = line.filter("l_returnflag = 'A' and l_quantity >= 50")
    back = line.filter("l_returnflag = 'N' and l_quantity = 50").join(low, c("l_orderkey") == c("o_orderkey"))
    tried = line.filter("l_returnflag = 'N' and l_quantity = 49").withColumn("by", c("l_partkey") * 7 % parts).join(part, c("by") == c("p_partkey")).filter(is_test_path(c("path")))
    edges = (
        pairs(opened, F.concat(F.lit("endpoint:"), c("id")), c("handler"), "HANDLED_BY")
        .unionByName(pairs(bought, named("customer", c("o_custkey")), named("part", c("l_partkey")), "CALLS"))
        .unionByName(pairs(supplied, named("part", c("l_partkey")), named("supplier", c("l_suppkey")), "CALLS"))
        .unionByName(pairs(back, named("supplier", c("l_suppkey")), named("customer", c("o_custkey")), "CALLS"))
        .unionByName(pairs(tried, F.concat(F.lit("file:"), c("path")), named("part", c("l_partkey")), "REFERENCES"))
        .distinct()
    )
    edges = edges.withColumns({"ev_file": F.lit(None).cast("string"), "ev_line": F.lit(None).cast("int"), "ev_extractor": F.lit("resolver")})
    return EvidenceGraph(files.unionByName(functions).unionByName(entrypoints).unionByName(endpoints), edges)
