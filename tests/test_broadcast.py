"""Tables that grow with the input are never broadcast on the guess of a file's size."""

import pytest

from graphloom.plans import catalogue, rules  # noqa: F401  rules adds its queries

SF = "/root/testdata/sf0.001"
#: Over the guess for any one of the stored tables here, under that for a join of two.
THRESHOLD = "256k"


@pytest.fixture(scope="module")
def planned(spark):
    """Runs a query; the lines of its initial plans. Queries share the clusters and the feature map,
    whose plans belong to the first that asks for them."""
    shared, made = {k: getattr(catalogue, k) for k in ("_members", "_subsystems", "_map")}, {}

    def once(name):
        def build(session, d):
            if name not in made:
                made[name] = shared[name](session, d)
            return made[name]

        return build

    def run(name):
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        catalogue.queries()[name](spark, SF).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        plans, rows = [], store.executionsList(int(before), 100_000)
        for i in range(rows.size()):
            text = rows.apply(i).physicalPlanDescription()
            plans += text.split("== Physical Plan ==")[-1].split("== Initial Plan ==")[-1].splitlines()
        return plans

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", THRESHOLD)
    spark.conf.set("spark.sql.ui.explainMode", "extended")
    for k in shared:
        setattr(catalogue, k, once(k))
    yield run
    for k, f in shared.items():
        setattr(catalogue, k, f)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.ui.explainMode")


def hashed(plans):
    """Hash joins by broadcast, but for the one of a table that ``numbered`` makes."""
    return [p for p in plans if "BroadcastHashJoin" in p and "_part" not in p]


@pytest.mark.parametrize("name", ["cluster_members", "block_connections", "canonical_feature_id", "capability_blocks", "cluster_owning_files", "coverage_summary", "exclusive_vs_shared", "feature_file_consumers", "feature_file_owners", "map_violations", "shared_subsystems", "subsystem_labels", "unassigned_code", "unused_type_aliases", "block_sizes", "cluster_statistics", "feature_impact", "feature_ports", "removal_impact", "shared_and_baseplate_blocks", "shared_subsystem_nodes"])
def test_no_broadcast_by_file_size(planned, name):
    plans = planned(name)
    assert plans and hashed(plans) == []


def test_ledger_rounds_are_not_broadcast(planned):
    """What every query of clusters runs first, and where they ran out of the driver's memory."""
    plans = planned("bfs_levels")
    assert any("Join" in p for p in plans) and hashed(plans) == []
