"""Large results are made in parts, so that the driver never plans all joins at once, and
parts that a query doesn't return are not made."""

import pytest

from graphloom.operators import cluster, featuremap, reach
from graphloom.plans import catalogue, graph

SF = "/root/testdata/sf0.001"


def test_members_read_a_stored_ledger(spark):
    g = graph.commerce_graph(spark, SF).stored()
    found = cluster.members(g, reach.ledger(g, reach.levels(g)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4 and found.count() > 0


@pytest.fixture(scope="module")
def found(spark):
    return catalogue._capabilities(spark, SF)


@pytest.mark.parametrize(("part", "made", "left"), [
    ("shared", "map-blocks", {"map-placed", "map-membership", "map-where", "map-connections"}),
    ("membership", "map-membership", {"map-where", "map-connections"}),
    ("sizes", "map-membership", {"map-where", "map-connections"}),
    ("connections", "map-connections", set()),
])
def test_map_makes_only_what_is_asked_for(found, monkeypatch, part, made, left):
    names, keep = set(), featuremap.stored
    monkeypatch.setattr(featuremap, "stored", lambda df, name: (names.add(name), keep(df, name))[1])
    fm = featuremap.feature_map(found[0], found[3])
    assert getattr(fm, part).count() > 0
    assert made in names and not names & left
