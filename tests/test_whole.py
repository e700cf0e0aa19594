"""Registered queries return all rows: compared with their SQL."""

import duckdb

from graphloom.operators import structure
from graphloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def oracle(name):
    sql = catalogue.oracle_sql()[name]
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def rows(spark, name):
    return sorted(tuple(r) for r in catalogue.queries()[name](spark, SF).collect())


def test_definitions_of_all_names(spark):
    got = rows(spark, "find_definition")
    assert got == oracle("find_definition")
    names = {r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()} | {r.c_name.upper() for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_name").collect()}
    assert {r[0] for r in got} == names


def test_neighbours_and_distances_of_all_nodes(spark):
    got = rows(spark, "get_neighbors")
    assert got == oracle("get_neighbors")
    assert {r[0].split(":")[0] for r in got} == {"file", "function", "endpoint"}
    got = rows(spark, "paths_to_external_behavior")
    assert got == oracle("paths_to_external_behavior")
    assert any(r[0].startswith("endpoint:") for r in got) and any(r[0].startswith("function:supplier:") for r in got)


def test_communities_settle_on_a_long_chain(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}", 1 + i % 7) for i in range(150)]
    label = {r["file"]: r["community"] for r in structure.communities(spark.createDataFrame(edges, "a string, b string, weight long")).collect()}
    votes = {f: {c: 1} for f, c in label.items()}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            votes[x][label[y]] = votes[x].get(label[y], 0) + w
    assert [f for f, v in votes.items() if min(v, key=lambda c: (-v[c], c)) != label[f]] == []
