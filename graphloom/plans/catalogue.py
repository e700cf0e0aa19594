"""Queries over the evidence graph of the star schema, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routes, text as tx
from ..functions.storage import stored
from ..functions.unique import exactly_one, first_tier
from ..operators import audit, claims, cluster, constraints, coverage, deadcode, featuremap, navigate, python_source, reach, resolve, search, structure, traverse
from .graph import EvidenceGraph, commerce_graph
from .oracle import over_graph, over_map, tokens

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(spark: SparkSession, sf_dir: str) -> EvidenceGraph:
    return commerce_graph(spark, sf_dir).stored()


def _ledger(g: EvidenceGraph) -> DataFrame:
    return reach.ledger(g, reach.levels(g))


# ---- reachability -----------------------------------------------------------


@query(over_graph("select class, count(l.node_id) as n from (values ('product_reachable'), ('startup_reachable'), ('test_only'), ('public_api_unproven'), ('dynamic_unknown'), ('disconnected_candidate')) c(class) left join ledger l using (class) group by class"))
def ledger_counts(spark, d):
    return reach.class_counts(_ledger(_graph(spark, d)))


@query(over_graph("select node_id, file_id, class from ledger"))
def reachability_ledger(spark, d):
    return _ledger(_graph(spark, d))


@query(over_graph("select class, count(*) as n from ledger where node_id like 'function:%' group by class"))
def symbol_ledger_counts(spark, d):
    return _ledger(_graph(spark, d)).filter("node_id like 'function:%'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(over_graph("select file_id, arg_min(class, (p, node_id)) as class, arg_min(node_id, (p, node_id)) as node_id from (select *, list_position(['product_reachable','startup_reachable','test_only','dynamic_unknown','public_api_unproven','disconnected_candidate'], class) as p from ledger) group by file_id"))
def ledger_file_rollup(spark, d):
    return reach.file_rollup(_ledger(_graph(spark, d)))


@query(over_graph("select kind, node_id, depth from levels"))
def bfs_levels(spark, d):
    return reach.levels(_graph(spark, d))


@query(over_graph("select node_id, status, depth from statuses"))
def reachability_status(spark, d):
    g = _graph(spark, d)
    return reach.statuses(g, reach.levels(g))


@query(over_graph(", x as (select n.node_id, case when n.path like 'tests/%' then 'test_only' when i.node_id is not null then 'startup_reachable' when t.node_id is not null then 'test_only' when coalesce(degree, 0) > 0 then 'dynamic_unknown' when exported then 'public_api_unproven' else 'disconnected_candidate' end as class from nodes n left join (select node_id from levels where kind = 'internal') i using (node_id) left join (select node_id from levels where kind = 'test') t using (node_id) left join (select node_id, count(*) as degree from (select source as node_id from edges where type <> 'HANDLED_BY' union all select target from edges where type <> 'HANDLED_BY') group by node_id) using (node_id) where n.node_type = 'function') select class, count(*) as n from x group by class"))
def public_api_variant(spark, d):
    """The graph without anything external: exported, untouched symbols are public API."""
    g = commerce_graph(spark, d)
    inner = EvidenceGraph(g.nodes.filter("node_type != 'endpoint' and coalesce(exposure, '') != 'external'"), g.edges.filter("type != 'HANDLED_BY'")).stored()
    return _ledger(inner).filter("node_id like 'function:%'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(over_graph(", lv as (select node_id, depth from levels where kind = 'external'), w(node_id, depth) as (select node_id, 0 from lv where depth = 0 union all select target, w.depth + 1 from w join edges on source = w.node_id join lv on lv.node_id = target and lv.depth = w.depth + 1) select node_id, depth, count(*)::double as paths from w group by all"))
def shortest_path_counts(spark, d):
    g = _graph(spark, d)
    e = g.edges.filter("type in ('CALLS', 'REFERENCES', 'HANDLED_BY')").select("source", "target", "type")
    return traverse.shortest_path_counts(reach.roots(g).filter("kind = 'external'"), e)


@query(over_graph(", lv as (select node_id, depth from levels where kind = 'external'), w(node_id, depth, path) as (select node_id, 0, node_id from lv where depth = 0 union all select target, w.depth + 1, w.path || ' ' || target from w join (select distinct source, target from edges) on source = w.node_id join lv on lv.node_id = target and lv.depth = w.depth + 1) select node_id, depth, path from (select *, row_number() over (partition by node_id order by path) as r from w) where r <= 3"))
def bounded_paths_topk(spark, d):
    g = _graph(spark, d)
    e = g.edges.filter("type in ('CALLS', 'REFERENCES', 'HANDLED_BY')")
    lv = reach.levels(g).filter("kind = 'external'").select("node_id", "depth")
    return traverse.best_shortest_paths(lv, e, 3).select("node_id", "depth", F.array_join("path", " ").alias("path"))


@query(over_graph(", back(node_id, depth) as (select node_id, 0 from nodes where node_type = 'endpoint' union select target, depth + 1 from back join edges on source = node_id where depth < 20) select node_id, min(depth) as depth from back group by node_id"))
def paths_to_external_behavior(spark, d):
    """Least steps from each node to an endpoint, against the edges."""
    g = _graph(spark, d)
    e = g.edges.filter("type in ('CALLS', 'REFERENCES', 'HANDLED_BY')").select(F.lit("out").alias("kind"), "source", "target").distinct()
    ends = g.nodes.filter("node_type = 'endpoint'").select(F.lit("out").alias("kind"), "node_id")
    return traverse.bfs(ends, e).select("node_id", "depth")


@query(over_graph(", c(node_id) as (select handler from entries union select target from c join edges on source = node_id where type in ('CALLS', 'REFERENCES')) select node_id from c"))
def liveness_closure(spark, d):
    g = _graph(spark, d)
    return deadcode.live(g, g.nodes.filter("handler_symbol_id is not null").select(F.col("handler_symbol_id").alias("node_id")))


@query(over_graph(", two as (select source as a, target as b from edges union select target, source from edges), cc(node_id, component) as (select a, a from two union select b, component from cc join two on a = node_id) select node_id, min(component) as component from cc group by node_id"))
def connected_components(spark, d):
    return traverse.components(commerce_graph(spark, d).edges)


# ---- counts and constraints -------------------------------------------------


@query(over_graph("select node_type, count(*) as n from nodes group by node_type"))
def nodes_by_kind(spark, d):
    return commerce_graph(spark, d).nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(over_graph("select type, count(*) as n from edges group by type"))
def edges_by_type(spark, d):
    return commerce_graph(spark, d).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(over_graph("select node_id, degree from degrees"))
def incident_degree(spark, d):
    return reach.degrees(commerce_graph(spark, d))


@query("select ''::varchar as rule, ''::varchar as location, ''::varchar as detail where false")
def constraint_violations(spark, d):
    """All integrity rules over the graph: it must have no violations."""
    return constraints.graph_violations(_graph(spark, d))


@query(over_graph("select 'edge_target' as rule, count(*) as n from edges where target like 'function:supplier:%' having count(*) > 0 union all select 'handler_reference', count(*) from entries where handler like 'function:customer:%7' having count(*) > 0 union all select 'edge_source', count(*) from edges where source like 'function:supplier:%' having count(*) > 0 union all select 'edge_target', count(*) from edges where target like 'function:customer:%7' and 1 = 0 having count(*) > 0"))
def constraint_broken_graph(spark, d):
    """The same rules over a graph whose suppliers and some handlers are missing."""
    g = commerce_graph(spark, d)
    gone = F.col("node_id").like("function:supplier:%")
    nodes = g.nodes.filter(~gone).withColumn("handler_symbol_id", F.when(F.col("handler_symbol_id").like("%7"), F.concat("handler_symbol_id", F.lit("?"))).otherwise(F.col("handler_symbol_id")))
    found = constraints.graph_violations(EvidenceGraph(nodes, g.edges).stored())
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# ---- navigation and search --------------------------------------------------


@query(over_graph(", a as (select p_name as wanted from part union select upper(c_name) from customer), h as (select wanted, node_id, 1.0::double as confidence from a join symbols on name = wanted union all select wanted, node_id, 0.95 from a join symbols on regexp_extract(name, '[^.]*$') = wanted where wanted not in (select name from symbols)), l as (select wanted, node_id, 0.85::double as confidence from a join symbols on lower(name) = lower(wanted) where wanted not in (select wanted from h) union select wanted, node_id, 0.85 from a join symbols on lower(regexp_extract(name, '[^.]*$')) = lower(wanted) where wanted not in (select wanted from h)), b as (select * from h union all select * from l) select wanted, node_id, confidence, count(*) over (partition by wanted) > 1 as ambiguous from b"))
def find_definition(spark, d):
    wanted = _read(spark, d, "part").select(F.col("p_name").alias("wanted")).union(_read(spark, d, "customer").select(F.upper("c_name"))).distinct()
    return navigate.definitions(commerce_graph(spark, d), wanted)


@query(over_graph("select distinct target as node_id, source as other_id, type from edges where type = 'CALLS'"))
def find_callers(spark, d):
    return navigate.related(commerce_graph(spark, d), ("CALLS",), "in")


@query(over_graph("select distinct source as node_id, target as other_id, type from edges where type = 'CALLS'"))
def find_callees(spark, d):
    return navigate.related(commerce_graph(spark, d), ("CALLS",), "out")


@query(over_graph(", u as (select target as node_id, source as other_id from edges where type in ('CALLS', 'REFERENCES') union select handler, node_id from entries), t as (select *, row_number() over (partition by node_id order by other_id) as r, count(*) over (partition by node_id) as total from u) select node_id, other_id, total from t where r <= 100"))
def find_consumers(spark, d):
    return navigate.consumers(commerce_graph(spark, d))


@query(over_graph("select node_id, other_id, type from (select source as node_id, target as other_id, type from edges union select target, source, type from edges)"))
def get_neighbors(spark, d):
    g = commerce_graph(spark, d)
    kinds = ("CALLS", "REFERENCES", "HANDLED_BY")
    return navigate.related(g, kinds, "in").union(navigate.related(g, kinds, "out")).distinct()


@query(over_graph("select node_id, route, (select count(*) from entries where exposure = 'external') as total, case when 30 < (select count(*) from entries where exposure = 'external') then 30::bigint end as next_offset from (select node_id, route from entries where exposure = 'external' order by node_id limit 20 offset 10)"))
def list_endpoints_page(spark, d):
    n = commerce_graph(spark, d).nodes.filter("node_type = 'entrypoint' and exposure = 'external'").select("node_id", "route")
    return navigate.page(n, ["node_id"], 10, 20)


@query(over_graph(", t as (select node_id, s(name) as n, s(path) as p, s(node_id) as i, 'function' as k from symbols) select node_id, (case when n = 'nation 7' then 1000 when contains(n, 'nation 7') then 800 when contains(p, 'nation 7') then 600 when contains(i, 'nation 7') then 500 else 400 end)::bigint as score from t where contains(n || ' ' || k || ' ' || p || ' ' || i, 'nation') and contains(n || ' ' || k || ' ' || p || ' ' || i, '7') order by 2 desc, 1 limit 50".replace("s(name)", "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))").replace("s(path)", "trim(regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g'))").replace("s(node_id)", "trim(regexp_replace(lower(node_id), '[^a-z0-9]+', ' ', 'g'))")))
def search_symbols(spark, d):
    return search.symbol_scores(commerce_graph(spark, d), "Nation/7")


_SCORES = """, f as (
  select node_id, trim(regexp_replace(lower(node_id), '[^a-z0-9]+', ' ', 'g')) as i, node_type as k, trim(regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g')) as p,
         trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as n, case when node_type = 'file' then 50 else 20 end as pp from nodes),
m as (
  select node_id, list_max([s(i) + 5, s(k) + 10, s(p) + pp, s(n) + 50]) as score, i || ' ' || k || ' ' || p || ' ' || n as every from f),
hits as (select node_id, coalesce(score, case when len(list_filter(['nation', '7'], lambda x: not list_contains(string_split(every, ' '), x))) = 0 then 500 end)::bigint as score from m)"""


def _inline(sql: str) -> str:
    import re

    q = "nation 7"
    return re.sub(r"s\((\w)\)", lambda m: f"(case when {m[1]} = '{q}' then 1000 when starts_with({m[1]}, '{q}') then 850 when contains({m[1]}, '{q}') then 750 when len(list_filter(['nation', '7'], lambda x: not list_contains(string_split({m[1]}, ' '), x))) = 0 then 650 end)", sql)


@query(over_graph(_inline(_SCORES) + " select node_id, score from hits where score is not null"))
def search_scores(spark, d):
    return search.scores(commerce_graph(spark, d), "nation/7")


@query(over_graph(_inline(_SCORES) + """, one as (select source, target, case type when 'CALLS' then 1 when 'IMPORTS' then 2 else 3 end as p from edges union all select node_id, handler, 0 from entries),
both_ways as (select source, target, p from one union all select target, source, p from one),
st as (select node_id, (row_number() over (order by score desc, node_id) - 1)::int as place from hits where score is not null order by score desc, node_id limit 5),
d1 as (select node_id, (4 + row_number() over (order by f, node_id))::int as place from (select target as node_id, min((place, p)) as f from st join both_ways on source = node_id where target not in (select node_id from st) group by target) qualify place < 50),
d2 as (select node_id, ((select count(*) from st) + (select count(*) from d1) - 1 + row_number() over (order by f, node_id))::int as place from (select target as node_id, min((place, p)) as f from d1 join both_ways on source = node_id where target not in (select node_id from st) and target not in (select node_id from d1) group by target) qualify place < 50),
picked as (select node_id, place, 0 as depth from st union all select node_id, place, 1 from d1 union all select node_id, place, 2 from d2)
select place, node_id, depth, exists (select 1 from both_ways where source in (select node_id from picked) and target not in (select node_id from picked)) as truncated from picked"""))
def search_neighborhood(spark, d):
    g = _graph(spark, d)
    return search.neighbourhood(g, search.seeds(search.scores(g, "nation/7")))


# ---- clusters and the feature map -------------------------------------------


def _members(spark, d):
    g = _graph(spark, d)
    return g, stored(cluster.members(g, _ledger(g)), "members")


@query(over_graph("select cluster_id, node_id, role, floor(score * 1e6 + 0.5) / 1e6 as score from members"))
def cluster_members(spark, d):
    return _members(spark, d)[1].select("cluster_id", "node_id", "role", "score")


@query(over_graph("select cluster_id, node_id, floor(score * 1e6 + 0.5) / 1e6 as score from members where role = 'file'"))
def cluster_owning_files(spark, d):
    return cluster.owning_files(_members(spark, d)[1])


@query(over_graph("select node_id, count(distinct cluster_id) as clusters from members where node_id in (select node_id from shared_fn) and score >= 0.4 - 1e-9 group by node_id"))
def shared_subsystem_nodes(spark, d):
    return cluster.shared_nodes(_members(spark, d)[1])


_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')"
_SUBSYSTEMS = ", sh as (select node_id, file_id from shared_fn join nodes using (node_id)), pr as (select a.node_id as a, b.node_id as b from sh a join sh b using (file_id) union select source, target from edges where source in (select node_id from sh) and target in (select node_id from sh) union select target, source from edges where source in (select node_id from sh) and target in (select node_id from sh)), cc(node_id, component) as (select node_id, node_id from sh union select b, component from cc join pr on a = node_id), sub as (select node_id, min(component) as component from cc group by node_id), sub_files as (select distinct component, file_id from sub join nodes using (node_id)), sub_all as (select component, node_id from sub union select component, file_id from sub_files union select component, node_id from sub_files join nodes using (file_id) where node_type <> 'entrypoint')"


def _subsystems(spark, d):
    g, m = _members(spark, d)
    return g, m, stored(cluster.subsystems(g, cluster.shared_nodes(m)), "subsystems")


@query(over_graph(_SUBSYSTEMS + "select node_id, component from sub"))
def shared_subsystems(spark, d):
    return _subsystems(spark, d)[2]


@query(over_graph(_SUBSYSTEMS + f", words as (select component, node_id, unnest({tokens('name')}) as term, 1 as votes from sub join nodes using (node_id) union all select component, node_id, unnest({tokens(_STEM)}), 2 from sub join nodes using (node_id)), tally as (select component, term, sum(votes) as votes from words group by all), top as (select component, arg_min(term, (-votes, -length(term), term)) as term from tally group by component), lab as (select component, upper(coalesce(term, 'shared')[1]) || coalesce(term, 'shared')[2:] || ' subsystem' as label, row_number() over (order by component) as place, (select count(*) from sub_all a where a.component = c.component) as nodes, (select count(distinct cluster_id) from sub_all a join members using (node_id) where a.component = c.component) as clusters from (select distinct component from sub) c left join top using (component)) select component, 'subsystem:' || regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || ':' || place as id, label, nodes, clusters from lab"))
def subsystem_labels(spark, d):
    g, m, sub = _subsystems(spark, d)
    inside = cluster.subsystem_members(g, sub)
    size = inside.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    users = inside.join(m.select("node_id", "cluster_id"), "node_id").groupBy("component").agg(F.countDistinct("cluster_id").alias("clusters"))
    return cluster.subsystem_labels(g, sub).join(size, "component").join(users, "component")


_LOOSE = _SUBSYSTEMS + ", loose as (select n.node_id, case when g.node_id is null then 'isolated' else 'disconnected' end as reason from nodes n left join degrees g using (node_id) where n.node_type = 'function' and n.node_id not in (select node_id from members) and n.node_id not in (select node_id from sub_all))"


@query(over_graph(_LOOSE + "select node_id, reason from loose"))
def unassigned_code(spark, d):
    return cluster.unassigned(*_subsystems(spark, d))


@query(over_graph(_LOOSE + "select (select count(*) from entries where exposure = 'external') as external_entrypoints, (select count(distinct node_id) from members) as clustered_nodes, (select count(*) from owners where owners > 1) as overlapping_nodes, (select count(*) from loose) as unassigned_nodes"))
def cluster_statistics(spark, d):
    g, m, sub = _subsystems(spark, d)
    return cluster.statistics(g, m, cluster.unassigned(g, m, sub))


@query(over_graph("select node_id, count(distinct cluster_id) as clusters, array_to_string(list_sort(list(distinct cluster_id)), '|') as cluster_ids from members group by node_id"))
def feature_impact(spark, d):
    return cluster.impact(_members(spark, d)[1])


def _capabilities(spark, d):
    g, m = _members(spark, d)
    entries = m.filter(F.col("node_id") == F.col("cluster_id")).select(F.col("cluster_id").alias("feature_id"), F.col("node_id").alias("entrypoint_id"))
    keyed = featuremap.capabilities(g, entries)
    return g, m, keyed, m.join(keyed, F.col("cluster_id") == F.col("feature_id")).select(F.col("key").alias("feature_id"), "node_id")


@query(over_graph(", h as (select cluster_id, substr(sha256(array_to_string(list_sort(list(distinct node_id)), chr(10))), 1, 20) as h from members group by cluster_id), k as (select *, row_number() over (partition by h order by cluster_id) as k from h), c as (select cluster_id, 'feature-' || h || case when k > 1 then '-' || k else '' end as id from k), f as (select 'http:' || path || ':orders' as key, c.id, case when o.route like '%4' then 'IMPLEMENTED_UNDOCUMENTED' when o.route like '%8' then 'PARTIALLY_IMPLEMENTED' else 'IMPLEMENTED_DOCUMENTED' end as status, case when o.route like '%2' then 'HIGH' else 'LOW' end as confidence from c join entries o on o.node_id = cluster_id) select key, case when count(*) = 1 then min(id) else 'feature-' || substr(sha256(array_to_string(list_sort(list(id)), '|')), 1, 16) end as block_id, count(*) as features, case when bool_or(status = 'PARTIALLY_IMPLEMENTED') then 'PARTIALLY_IMPLEMENTED' when bool_or(status = 'IMPLEMENTED_DOCUMENTED') then 'IMPLEMENTED_DOCUMENTED' else 'IMPLEMENTED_UNDOCUMENTED' end as status, case when bool_or(confidence = 'HIGH') then 'HIGH' else 'LOW' end as confidence, 'functional' as kind from f group by key"))
def capability_blocks(spark, d):
    """Features of made-up statuses by the last digit of their order."""
    g, m, keyed, _ = _capabilities(spark, d)
    route = g.nodes.filter("node_type = 'entrypoint'").select(F.col("node_id").alias("cluster_id"), "route")
    status = F.when(F.col("route").endswith("4"), "IMPLEMENTED_UNDOCUMENTED").when(F.col("route").endswith("8"), "PARTIALLY_IMPLEMENTED").otherwise("IMPLEMENTED_DOCUMENTED")
    f = coverage.canonical_ids(m).join(route, "cluster_id").select(F.col("cluster_id").alias("feature_id"), F.col("feature_id").alias("canonical_id"), status.alias("status"), F.when(F.col("route").endswith("2"), "HIGH").otherwise("LOW").alias("confidence"), F.lit("functional").alias("kind"))
    return featuremap.capability_blocks(keyed, f)


def _map(spark, d):
    g, _, _, found = _capabilities(spark, d)
    return g, found, featuremap.feature_map(g, found)


@query(over_map("select feature_id, count(*) filter (where exclusive) as exclusive, count(*) filter (where not exclusive) as shared from membership group by feature_id"))
def exclusive_vs_shared(spark, d):
    return featuremap.exclusive_and_shared(_map(spark, d)[2])


@query(over_map("select file_id, feature_id from fo"))
def feature_file_owners(spark, d):
    g, _, _, found = _capabilities(spark, d)
    return featuremap.file_owners(g, found)


@query(over_map("select file_id, feature_id from used"))
def feature_file_consumers(spark, d):
    g, _, _, found = _capabilities(spark, d)
    return featuremap.consumers(g, featuremap.file_owners(g, found))


@query(over_map("select node_id, block_id from in_shared union all select node_id, block_id from infra_nodes, plate"))
def shared_and_baseplate_blocks(spark, d):
    fm = _map(spark, d)[2]
    return fm.shared.union(fm.infrastructure)


@query(over_map("select from_block, to_block, kind, confidence, label, evidence from conns"))
def block_connections(spark, d):
    return _map(spark, d)[2].connections


@query(over_map(", shown as (select feature_id, count(*) filter (where exclusive) as freed_nodes from membership group by feature_id), picked as (select distinct feature_id, file_id from membership join shown using (feature_id) join nf using (node_id) where exclusive or freed_nodes = 0), freed as (select feature_id, count(*) as files, sum(lines)::bigint as lines from picked join files on 'file:' || path = file_id where file_id in (select file_id from fo group by file_id having count(*) = 1) group by feature_id), uses as (select distinct from_block, to_block from conns where from_block in (select feature_id from shown) and (to_block like 'shared-%' or to_block like 'infra-%')), n as (select *, count(*) over (partition by to_block) as users from uses), lost as (select from_block as feature_id, count(*) filter (where users = 1) as o, count(*) filter (where users = 2 and to_block like 'shared-%') as g from n group by all) select feature_id, freed_nodes, coalesce(files, 0) as freed_files, coalesce(lines, 0) as freed_lines, coalesce(o, 0) as orphaned_blocks, coalesce(g, 0) as degraded_blocks from shown left join freed using (feature_id) left join lost using (feature_id)"))
def removal_impact(spark, d):
    return _map(spark, d)[2].impact


@query(over_map(", shown as (select feature_id, count(*) filter (where exclusive) as e from membership group by feature_id), s as (select distinct feature_id as block_id, 'feature' as kind, file_id from membership join shown using (feature_id) join nf using (node_id) where exclusive or e = 0 union select block_id, 'shared_subsystem', file_id from in_shared join nf using (node_id) union select block_id, 'infrastructure', file_id from infra_files, plate) select block_id, kind, count(*) as files, sum(lines)::bigint as lines from s join files on 'file:' || path = file_id group by all"))
def block_sizes(spark, d):
    return _map(spark, d)[2].sizes


@query("select ''::varchar as rule, ''::varchar as location where false")
def map_violations(spark, d):
    """Rules of a feature map over the one that is built: it must break none."""
    return featuremap.map_violations(_map(spark, d)[2])


@query(over_graph("select cluster_id as feature_id, m.node_id, 'http' as kind, 'GET ' || route as label from members m join entries e on e.node_id = m.node_id"))
def feature_ports(spark, d):
    g, m = _members(spark, d)
    return featuremap.ports(g, m.select(F.col("cluster_id").alias("feature_id"), "node_id"))


@query(over_graph(", h as (select cluster_id, substr(sha256(array_to_string(list_sort(list(distinct node_id)), chr(10))), 1, 20) as h from members group by cluster_id), k as (select *, row_number() over (partition by h order by cluster_id) as k from h) select cluster_id, 'feature-' || h || case when k > 1 then '-' || k else '' end as feature_id from k"))
def canonical_feature_id(spark, d):
    return coverage.canonical_ids(_members(spark, d)[1])


# ---- structure --------------------------------------------------------------


@query(over_graph("select a, b, weight from file_edges"))
def file_edge_collapse(spark, d):
    return structure.file_edges(commerce_graph(spark, d))


@query()
def structural_communities(spark, d):
    """Own deterministic communities: no SQL form; tests hold their invariants."""
    return structure.communities(structure.file_edges(commerce_graph(spark, d)))


_GROUPS = ", gr as (select distinct 'file:' || path as file, regexp_extract(path, '^[^/]*') || case when path like 'src/%' then length(path) % 3 else 0 end as community from files)"


def _grouped(g: EvidenceGraph) -> DataFrame:
    f = g.nodes.filter("node_type = 'file'")
    return f.select(F.col("node_id").alias("file"), F.concat(F.substring_index("path", "/", 1), F.when(F.col("path").like("src/%"), (F.length("path") % 3).cast("string")).otherwise("0")).alias("community"))


@query(over_graph(_GROUPS + ", dd as (select community, regexp_replace(replace(file, 'file:', ''), '/?[^/]*$', '') as directory, count(*) as n from gr group by all) select community, directory, n from (select *, row_number() over (partition by community order by n desc, directory) as r from dd) where r = 1"))
def modal_directory(spark, d):
    return structure.modal_directories(_grouped(commerce_graph(spark, d)))


@query(over_graph(_GROUPS + "select least(x.community, y.community) as x, greatest(x.community, y.community) as y, sum(weight)::bigint as weight from file_edges join gr x on a = x.file join gr y on b = y.file group by all"))
def cross_component_weights(spark, d):
    g = commerce_graph(spark, d)
    return structure.cross_weights(structure.file_edges(g), _grouped(g))


# ---- dead code, coverage, score ---------------------------------------------


_DEAD = ", c as (select l.file_id, name, l.node_id, class, case class when 'disconnected_candidate' then 0 when 'public_api_unproven' then 1 else 2 end as o from ledger l join nodes n on n.node_id = l.node_id and n.node_type = 'function' and exported where path not like 'tests/%' and class in ('disconnected_candidate', 'public_api_unproven', 'dynamic_unknown', 'test_only')), dead as (select file_id, name, arg_min(node_id, (o, node_id)) as node_id, array_to_string(list_sort(list(node_id)), '|') as node_ids, arg_min(class, (o, node_id)) as status, case when arg_min(class, (o, node_id)) in ('disconnected_candidate', 'test_only') then 'VALIDATION_REQUIRED' else 'UNKNOWN_DYNAMIC_USAGE' end as verdict from c group by file_id, name)"


@query(over_graph(_DEAD + "select * from dead"))
def dead_code_candidates(spark, d):
    g = _graph(spark, d)
    return deadcode.candidates(g, _ledger(g))


@query(over_graph(_DEAD + "select file_id, 'orphan-' || substr(sha256(substr(file_id, 6)), 1, 16) as block_id, case when bool_or(verdict = 'VALIDATION_REQUIRED') then 'VALIDATION_REQUIRED' else 'UNKNOWN_DYNAMIC_USAGE' end as verdict, case when bool_or(verdict = 'VALIDATION_REQUIRED') then 'MEDIUM' else 'LOW' end as confidence, count(distinct node_id) as nodes, count(*) as lines from dead group by file_id"))
def orphan_blocks(spark, d):
    g = _graph(spark, d)
    return featuremap.orphans(g, deadcode.candidates(g, _ledger(g)))


_CLASSES = ", deg as (select node_id, count(*) as degree from (select source as node_id from edges union all select target from edges) group by node_id), me as (select n.node_id, node_type, path, exposure from nodes n left join deg using (node_id) where node_type = 'endpoint' or (node_type = 'entrypoint' and exposure = 'startup') or (node_type = 'function' and (exported or node_id in (select handler from entries) or coalesce(degree, 0) >= 3))), cov as (select node_id from entries where exposure = 'external' and route like '%4' union select handler from entries where exposure = 'external' and route like '%4'), cl as (select me.node_id, node_type, path, case when path like 'tests/%' then 'test' when node_type = 'entrypoint' then 'infrastructure' when node_type = 'endpoint' or status = 'externally_reachable' then 'feature' when status = 'internally_reachable' then 'infrastructure' else 'utility' end as class, status as reachability, me.node_id in (select node_id from cov) or (node_type = 'endpoint' and substr(me.node_id, 10) in (select node_id from cov)) or (node_type = 'entrypoint' and (select handler from entries e where e.node_id = me.node_id) in (select node_id from cov)) as explained from me join statuses using (node_id)), told as (select distinct path from nodes where node_type = 'function' and node_id not in (select node_id from cl where not explained)), casc as (select node_id, class, reachability, explained, case when explained then 'explained' when class = 'test' or (class in ('infrastructure', 'utility') and reachability <> 'unknown') then 'support' when reachability = 'test_only' then 'test' when class = 'feature' and reachability = 'externally_reachable' and node_type <> 'entrypoint' and path in (select path from told) then 'same_file' else 'none' end as pass from cl)"


def _classified(spark, d):
    """A contract of the entrypoints whose orders end in 4, with their handlers."""
    g = _graph(spark, d)
    named = g.nodes.filter("node_type = 'entrypoint' and exposure = 'external' and route like '%4'")
    items = named.select(F.lit("c").alias("contract_id"), F.explode(F.array("node_id", "handler_symbol_id")).alias("node_id"))
    found = coverage.classify(g, coverage.meaningful(g), coverage.contract_coverage(g, items), reach.statuses(g, reach.levels(g)))
    return coverage.cascade(g, found)


@query(over_graph(_CLASSES + " select node_id, case when pass = 'test' then 'test' else class end as class, reachability, explained, pass, pass <> 'none' as accounted from casc"))
def coverage_classification(spark, d):
    return _classified(spark, d)


@query(over_graph(_CLASSES + " select count(*) as nodes, count(*) filter (where pass <> 'none') as accounted, count(*) filter (where explained) as explained, count(*) filter (where pass = 'none' and reachability = 'unknown') as suspicious, floor(count(*) filter (where pass <> 'none') * 10000.0::double / count(*) + 0.5) / 100 as percent from casc"))
def coverage_summary(spark, d):
    return coverage.summary(_classified(spark, d))


_PARTS = "with p as (select c_nationkey as contract, avg(case when c_acctbal > 0 then 1.0::double else 0.0::double end) as coverage, avg(case when c_mktsegment = 'BUILDING' then 0.0::double else 1.0::double end) as verified, count(*) filter (where c_acctbal < -900) as contradicted, count(*) filter (where c_acctbal > 9000) as uncertain, count(*) filter (where c_acctbal between -800 and -600) as unconfirmed, count(*) filter (where c_acctbal between 0 and 400) as partial, c_nationkey % 2 = 0 as converged from customer group by c_nationkey)"


def _contracts(spark, d):
    """Nations as contracts, with counts of their customers by balance as claims."""
    b = F.col("c_acctbal")
    return _read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("contract")).agg(
        F.avg((b > 0).cast("double")).alias("coverage"), F.avg((F.col("c_mktsegment") != "BUILDING").cast("double")).alias("verified"), F.count_if(b < -900).alias("contradicted"),
        F.count_if(b > 9000).alias("uncertain"), F.count_if(b.between(-800, -600)).alias("unconfirmed"), F.count_if(b.between(0, 400)).alias("partial"), F.max(F.col("c_nationkey") % 2 == 0).alias("converged"),
    )


@query(_PARTS + ", s as (select contract, greatest(0.0::double, least(100.0::double, floor((100 * (0.4::double * coverage + 0.3::double * verified + 0.15::double * (1 - least(uncertain * 2.0::double, 15.0::double) / 100) + 0.15::double * greatest(0.0::double, 1 - (least(contradicted * 4.0::double, 20.0::double) + least(unconfirmed * 2.0::double, 10.0::double)) / 100)) - case when converged then 0.0::double else 5.0::double end) * 10 + 0.5) / 10)) as points from p) select contract, points, case when points >= 90 then 'A' when points >= 80 then 'B' when points >= 70 then 'C' when points >= 60 then 'D' else 'F' end as grade from s")
def contract_score(spark, d):
    """The score's arithmetic over nations as contracts."""
    points = coverage.score(*(F.col(c) for c in ("coverage", "verified", "contradicted", "uncertain", "unconfirmed", "converged")))
    return _contracts(spark, d).withColumn("points", points).select("contract", "points", coverage.grade(F.col("points")).alias("grade"))


@query(_PARTS + ", x as (select contract, 'unexplained_coverage' as code, case when 40 * (1 - coverage) > 0.5 then floor(40 * (1 - coverage) * 10 + 0.5) / 10 end as points from p union all select contract, 'partially_verified_claim', case when partial > 0 then floor(least(partial * 1.5::double, 10.0::double) * 10 + 0.5) / 10 end from p union all select contract, 'contradicted_claim', case when contradicted > 0 then least(contradicted * 4.0::double, 20.0::double) end from p union all select contract, 'unresolved_uncertainty', case when uncertain > 0 then least(uncertain * 2.0::double, 15.0::double) end from p union all select contract, 'unconfirmed_review', case when unconfirmed > 0 then least(unconfirmed * 2.0::double, 10.0::double) end from p union all select contract, 'correction_not_converged', case when not converged then 5.0::double end from p) select * from x where points is not null")
def contract_deductions(spark, d):
    return coverage.deductions(_contracts(spark, d), "contract")


@query("select event_type as label, count(value) as n, floor(min(value) * 1e6 + 0.5) / 1e6 as low, floor(max(value) * 1e6 + 0.5) / 1e6 as high, floor(avg(value) * 1e6 + 0.5) / 1e6 as mean, floor(stddev_pop(value) * 1e6 + 0.5) / 1e6 as deviation, floor((max(value) - min(value)) * 1e6 + 0.5) / 1e6 as spread from events group by event_type")
def run_statistics(spark, d):
    return coverage.run_statistics(_read(spark, d, "events"), "event_type", "value")


@query("select doc_id, used from (select doc_id, lang, sum(n_chars) over (partition by lang order by doc_id rows unbounded preceding)::bigint as used from documents) where used <= 160000")
def running_budget(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return coverage.within_budget(docs, ["lang"], ["doc_id"], "n_chars", 160000).select("doc_id", "used")


# ---- documentation and text -------------------------------------------------


@query(
    f"with t as (select doc_id as target_id, unnest({tokens('text')}) as token from documents), n as (select count(*) as n from documents), wt as (select token, ln((n + 1)::double / (count(*) + 1)) + 1 as w from t, n group by token, n),"
    f" c as (select item_id as claim_id, unnest({tokens('text')}) as token from benchmark), cw as (select claim_id, token, coalesce(w, ln(n + 1.0::double) + 1) as w from c left join wt using (token), n), tot as (select claim_id, sum(w) as all_w from cw group by claim_id),"
    " h as (select claim_id, target_id, sum(w) / any_value(all_w) as score from cw join t using (token) join tot using (claim_id) group by all), b as (select *, max(score) over (partition by claim_id) as best from h) select claim_id, target_id, floor(score * 1e6 + 0.5) / 1e6 as score from b where score >= 0.12 and score >= best * 0.8"
)
def doc_mapping_idf(spark, d):
    claims = _read(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    targets = _read(spark, d, "documents").select(F.col("doc_id").alias("target_id"), "text")
    return cluster.match_documents(claims, targets)


@query(r"with r as (select page_id, url, regexp_replace(url, '[0-9]+', '{x}', 'g') || '//' as r from pages), q as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '(?s)[?#].*$', ''), '[),.;:!?]+$', ''), '\{[^/{}]+\}', '{}', 'g'), '/{2,}', '/', 'g') as r from r) select page_id, url, lower(case when length(r) > 1 then regexp_replace(r, '/+$', '') else r end) as route from q")
def route_normalize(spark, d):
    """Addresses with numbers as parameters and two slashes at the end."""
    route = F.concat(F.regexp_replace("url", "[0-9]+", "{x}"), F.lit("//"))
    return _read(spark, d, "pages").select("page_id", "url", tx.normal_route(route).alias("route"))


_MARKDOWN = "text"
for _pattern, _put, _flags in (
    (r"!\[([^\]]*)\]\([^)]*\)", r"\1", "g"), (r"\[([^\]]+)\]\([^)]*\)", r"\1", "g"), (r"<https?://[^>]+>", "", "gi"), ("<[^>]+>", " ", "g"), (r"^(\s*>\s*)+", "", ""), (r"^([-*+]\s+|[0-9]+[.)]\s+)", "", ""),
    (r"^(\|--|->|=>|├──|└──|│\s*(├──|└──))\s*", "", ""), ("`([^`]*)`", r"\1", "g"), ("[*_~]+", "", "g"), (r"\\([\\`*_\[\]{}()#+.!|>-])", r"\1", "g"), ("&(amp|#38);", "&", "gi"), ("&(lt|#60);", "<", "gi"),
    ("&(gt|#62);", ">", "gi"), ("&(quot|#34);", '"', "gi"), (r"\bTanStack\s+Query\b", "React Query (TanStack Query)", "gi"), (r"\s+", " ", "g"),
):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_put}', '{_flags}')"


@query(f"select doc_id, sha256(trim({_MARKDOWN})) as stripped from documents union all select -page_id, sha256(trim({_MARKDOWN.replace('text', 'html', 1)})) from pages")
def markdown_strip(spark, d):
    """Digests of the plain text of all documents and pages."""
    rows = _read(spark, d, "documents").select("doc_id", "text").union(_read(spark, d, "pages").select(-F.col("page_id"), "html"))
    return rows.select("doc_id", F.sha2(tx.strip_markdown(F.col("text")), 256).alias("stripped"))


@query(r"select page_id, (unnest(range(1, len(s) + 1)) - 1)::int as pos, unnest(s) as script from (select page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) as s from pages)")
def script_extract(spark, d):
    s = F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    return _read(spark, d, "pages").select("page_id", F.posexplode(s).alias("pos", "script"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as slice, len(string_split(text, chr(10))) as lines from documents")
def source_slice(spark, d):
    parts = F.split("text", "\n")
    return _read(spark, d, "documents").select("doc_id", F.array_join(F.slice(parts, 2, 3), "\n").alias("slice"), F.size(parts).cast("long").alias("lines"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents), w as (select distinct doc_id, line, unnest(regexp_extract_all(t, '[A-Za-z_$][A-Za-z0-9_$]*')) as name from l), f as (select doc_id, name, min(line) as line, count(distinct line) as n from w group by all) select doc_id::varchar as path, name, line::int as line_start from f where n = 1")
def word_boundary_unused(spark, d):
    """Words that stand on one line of a text alone: names whose every use is there."""
    files = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    words = deadcode.lines(files).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name"))
    names = words.groupBy("path", "name").agg(F.min("line").alias("line_start")).withColumn("line_end", F.col("line_start"))
    return deadcode.unused_names(files, names).select("path", "name", F.col("line_start").cast("int").alias("line_start"))


@query("with f as (select c_custkey as id, c_nationkey as k, floor(c_acctbal / 500)::int as v from customer) select k, v, min(id) as id from f group by k, v having count(distinct id) = 1")
def unique_or_nothing(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 500).cast("int").alias("v"), F.col("c_custkey").alias("id"))
    return exactly_one(c, ["k", "v"], "id")


@query("with c as (select l_orderkey as k, case when l_quantity >= 40 then 1 when l_quantity >= 20 then 2 else 3 end as tier, l_partkey as v from lineitem), b as (select k, tier, min(v) as lo, max(v) as hi from c group by all), f as (select k, min(tier) as tier from b group by k) select k, tier, lo as v from b join f using (k, tier) where lo = hi")
def tiered_resolution(spark, d):
    """Candidates in tiers: the first tier that has any decides, if it has just one."""
    tier = F.when(F.col("l_quantity") >= 40, 1).when(F.col("l_quantity") >= 20, 2).otherwise(3)
    c = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), tier.alias("tier"), F.col("l_partkey").alias("v"))
    return first_tier(c, ["k"], "tier", "v")


_TEST_PATHS = (
    "src/nation/{}.ts", "tests/brand_{}.py", "a\\Spec\\{}.ts", "x/{}.test.tsx", "x/{}.spec.js", "test_{}.py", "{}_test.py", "test_{}.ts", "a_test_{}.js", "conftest.py", "conftest.json", "p/{}_test.go", "test_{}.rb", "{}_spec.rb",
    "q/{}Test.java", "q/{}Tests.kt", "q/{}TestCase.php", "q/{}test.java", "{}_test.rs", "z/{}.bats", "contest{}/latest.ts", "__snapshots__/{}", "tests", "src/specs/{}.md",
)


@query("with p as (select replace(unnest([" + ", ".join(f"'{x}'" for x in _TEST_PATHS) + r"]), '{}', 'n' || n_nationkey) as path from nation), q as (select path, list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x <> '') as s from p) select path, len(list_filter(s[:-2], lambda x: lower(x) in ('test', 'tests', '__tests__', 'spec', 'specs', '__snapshots__'))) > 0 or regexp_matches(lower(s[-1]), '[.](test|spec)[.][^.]+$|^(test_.+|.+_test)[.]py$|^conftest[.]py$|_test[.]go$|^(test_.+|.+_spec)[.]rb$|_test[.]rs$|[.]bats$') or regexp_matches(s[-1], '(Test|Tests|TestCase)[.](java|kt|kts|cs|php)$') as test from q")
def test_path_predicate(spark, d):
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    paths = _read(spark, d, "nation").select(F.explode(F.array(*(F.replace(F.lit(p), F.lit("{}"), name) for p in _TEST_PATHS))).alias("path"))
    return paths.select("path", tx.is_test_path(F.col("path")).alias("test"))


# ---- frontends, resolvers and the audit -------------------------------------


@query(r"with f as (select 'src/m' || p_partkey as base, ['.ts', '.tsx', '.js', '/index.ts', '/index.js'][p_size % 5 + 1] as ending from part union select 'src/m' || s_suppkey, '.ts' from supplier), i as (select distinct 'src/c' || l_suppkey || '.ts' as path, './m' || l_partkey || case when l_linenumber = 1 then '.js' else '' end as source from lineitem), c as (select path, source, base || ending as target, case when ending like '/%' then 2 else 1 end as tier from i join f on base = 'src/' || regexp_replace(source[3:], '\.js$', '') where not (source like '%.js' and ending like '/%')), b as (select path, source, tier, min(target) as lo, max(target) as hi from c group by all), t as (select path, source, min(tier) as tier from b group by all) select path, source, lo as target from b join t using (path, source, tier) where lo = hi")
def import_candidate_resolution(spark, d):
    """Relative script imports among files made of part and supplier keys."""
    ending = F.element_at(F.array(*map(F.lit, (".ts", ".tsx", ".js", "/index.ts", "/index.js"))), F.col("p_size") % 5 + 1)
    files = _read(spark, d, "part").select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), ending).alias("path"))
    files = files.union(_read(spark, d, "supplier").select(F.concat(F.lit("src/m"), F.col("s_suppkey").cast("string"), F.lit(".ts")))).distinct()
    source = F.concat(F.lit("./m"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") == 1, ".js").otherwise(""))
    imports = _read(spark, d, "lineitem").select(F.concat(F.lit("src/c"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("path"), source.alias("source"))
    return resolve.script_targets(imports, files)


@query("with f as (select 'pkg_' || c_nationkey || '/mod_' || c_custkey || '.py' as path, c_custkey as k from customer union select 'pkg_' || s_nationkey || '/mod_' || s_suppkey || '.py', s_suppkey from supplier), o as (select k, min(path) as target from f group by k having count(*) = 1) select 'app/main_' || p_size || '.py' as path, 'mod_' || p_partkey as source, target from part join o on k = p_partkey")
def unique_suffix_resolution(spark, d):
    """Absolute module imports, by the only file whose path ends so."""
    named = lambda nation, key: F.concat(F.lit("pkg_"), F.col(nation).cast("string"), F.lit("/mod_"), F.col(key).cast("string"), F.lit(".py")).alias("path")
    files = _read(spark, d, "customer").select(named("c_nationkey", "c_custkey")).union(_read(spark, d, "supplier").select(named("s_nationkey", "s_suppkey"))).distinct()
    imports = _read(spark, d, "part").select(F.concat(F.lit("app/main_"), F.col("p_size").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("mod_"), F.col("p_partkey").cast("string")).alias("source"))
    return resolve.python_targets(imports, files)


@query("select a.l_orderkey as file_id, a.l_linenumber::bigint as inner_id, b.l_linenumber::bigint as outer_id from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where b.l_partkey <= a.l_partkey and b.l_partkey + b.l_suppkey >= a.l_partkey + a.l_suppkey and (b.l_partkey < a.l_partkey or b.l_partkey + b.l_suppkey > a.l_partkey + a.l_suppkey)")
def interval_containment(spark, d):
    """Ranges of an order's items that lie strictly inside another's."""
    r = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("node_id"), F.col("l_partkey").alias("line_start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("line_end"))
    return resolve.containing(r, r)


_LAYOUTS = {
    "app/(shop)/{}/[id]/page.tsx": ("page", "/{}/:id"), "src/app/{}/[...rest]/route.ts": ("http", "/{}/*rest"), "pages/api/{}/[id].js": ("http", "/api/{}/:id"),
    "src/routes/{}/+server.ts": ("http", "/{}"), "src/routes/{}/[slug]/+page.svelte": ("page", "/{}/:slug"), "app/routes/{}.$id.tsx": ("http", "/{}/:id"),
    "app/{}/_layout.tsx": ("page", "/{}"), "src/pages/{}/index.astro": ("page", "/{}"), "lib/{}.ts": (None, None),
}


@query(" union all ".join("select replace('{}', '{{}}', 'n' || n_nationkey) as path, {} as kind, {} as route from nation".format(p, f"'{k}'" if k else "null::varchar", f"replace('{r}', '{{}}', 'n' || n_nationkey)" if r else "null::varchar") for p, (k, r) in _LAYOUTS.items()))
def file_routes(spark, d):
    """Routes that files declare by their place, over every layout."""
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    paths = _read(spark, d, "nation").select(F.explode(F.array(*(F.replace(F.lit(p), F.lit("{}"), name) for p in _LAYOUTS))).alias("path"))
    return paths.withColumn("r", routes.file_route(F.col("path"))).select("path", "r.kind", "r.route")


@query("with s as (select ['IMPLEMENTED_DOCUMENTED','IMPLEMENTED_UNDOCUMENTED','DOCUMENTED_NOT_IMPLEMENTED','PARTIALLY_IMPLEMENTED','AMBIGUOUS'][o_orderpriority[1]::int] as status from orders), v as (select case l_returnflag when 'R' then 'VALIDATION_REQUIRED' when 'A' then 'VALIDATED_SAFE_TO_DELETE' end as verdict from lineitem) select (select count(*) from s where status = 'IMPLEMENTED_DOCUMENTED') as implemented_documented, (select count(*) from s where status = 'IMPLEMENTED_UNDOCUMENTED') as implemented_undocumented, (select count(*) from s where status = 'DOCUMENTED_NOT_IMPLEMENTED') as documented_not_implemented, (select count(*) from s where status = 'PARTIALLY_IMPLEMENTED') as partially_implemented, (select count(*) from s where status = 'AMBIGUOUS') as ambiguous, (select count(*) from v) as dead_code_candidates, (select count(*) from v where verdict = 'VALIDATION_REQUIRED') as ready_for_delete_validation, (select count(*) from v where verdict = 'VALIDATED_SAFE_TO_DELETE') as validated_safe_to_delete")
def audit_summary_pivot(spark, d):
    status = F.element_at(F.array(*map(F.lit, audit.STATUSES)), F.substring("o_orderpriority", 1, 1).cast("int"))
    verdict = F.when(F.col("l_returnflag") == "R", "VALIDATION_REQUIRED").when(F.col("l_returnflag") == "A", "VALIDATED_SAFE_TO_DELETE")
    return audit.summary(_read(spark, d, "orders").select(status.alias("status")), _read(spark, d, "lineitem").select(verdict.alias("verdict")))


@query()
def best_promise_match(spark, d):
    """No SQL form here: tests hold it against a plain version."""
    gaps = _read(spark, d, "benchmark").select(F.col("item_id").alias("gap_id"), "text")
    return audit.best_promise(gaps, _read(spark, d, "documents").select(F.col("doc_id").alias("promise_id"), "text"))


@query()
def python_frontend_facts(spark, d):
    """Facts of one made-up module a nation: parsing has no SQL form."""
    code = "import os\nfrom .base import run as go\n\nclass Nation:\n    def load(self):\n        return self.store(go(%s))\n    def store(self, x):\n        return os.fspath(x)\n"
    files = _read(spark, d, "nation").select(F.concat(F.lit("n/m"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.format_string(code, F.col("n_nationkey").cast("string")).alias("text"))
    return python_source.python_facts(files)


_PATHS = ("README.md", "docs/guide.md", "tests/readme.md", "docs/login-fix.md", "docs/usage.md", "docs\\testing\\a.md", "docs/contest.md")
_HEADINGS = ("", "Features", "Installation", "FAQ!", "Getting Help")
_ENDS = (" is kept", " needs a venv", " is tested", " Fix: the lock", " ->> store", " run it", " production-ready", " Note over a", " contact us", " latest", " create one")
_PROMISES = "select p_partkey, {}[p_partkey % 7 + 1] as path, {}[p_partkey % 5 + 1] as heading, p_name || {}[p_partkey % 11 + 1] as text from part".format(*("[" + ", ".join(f"'{x}'" for x in values) + "]" for values in (_PATHS, _HEADINGS, _ENDS)))


def _signals_sql() -> str:
    seen = {"path": r"replace(path, '\', '/')", "text": "text", "all": "heading || chr(10) || text", "label": r"trim(regexp_replace(heading, '[^\p{L}\p{N}/]+', ' ', 'g'))"}
    hits = [f"regexp_matches({seen[c]}, '{p}', 'i')" for c, p in claims.SIGNALS]
    return " or ".join([*hits, f"(regexp_matches(heading, '{claims.INSTRUCTIONS[0]}', 'i') and regexp_matches(text, '{claims.INSTRUCTIONS[1]}', 'i'))"])


@query(f"select p_partkey, {_signals_sql()} as quarantined from ({_PROMISES})")
def quarantined_claims(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    text = F.concat("p_name", pick(_ENDS, 11))
    return _read(spark, d, "part").select("p_partkey", claims.quarantined(pick(_PATHS, 7), pick(_HEADINGS, 5), text).alias("quarantined"))


@query("select p_partkey, p_name as title from part")
def feature_titles(spark, d):
    """Titles with up to two notes of duplicates, which go."""
    notes = F.element_at(F.array(*map(F.lit, ("", " (duplicate)", " (Alternate 2)", "(duplicate 3) (alternate) "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _read(spark, d, "part").select("p_partkey", claims.feature_title(F.concat("p_name", notes)).alias("title"))


@query("select distinct 'f_' || c_nationkey as name, s_suppkey as source_id from supplier join (select distinct c_nationkey from customer) on c_nationkey in (s_nationkey, s_suppkey % 25) where c_nationkey not in (select distinct s_nationkey from supplier where s_acctbal > 5000)")
def unresolved_contracts(spark, d):
    """Procedures called by suppliers' made-up code; well-off suppliers' nations define theirs."""
    s = _read(spark, d, "supplier")
    code = F.format_string("db.rpc('f_%s'); db.rpc( \"f_%s\", {}); rpc('no')", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 25).cast("string"))
    names = s.filter("s_acctbal > 5000").select(F.concat(F.lit("f_"), F.col("s_nationkey").cast("string")).alias("name"))
    return claims.unresolved_contracts(s.select(F.col("s_suppkey").alias("source_id"), code.alias("text")), names)


@query(over_graph("select target as source, 'test:' || n.path as target, 'TESTED_BY' as type from edges join nodes n on n.node_id = source where type = 'REFERENCES' and n.node_type = 'file' and n.path like 'tests/%' union all select source, 'config:' || target, 'CONFIGURED_BY' from edges join nodes n on n.node_id = source join nodes t on t.node_id = target where type = 'REFERENCES' and n.node_type = 'file' and t.exported"))
def test_and_config_edges(spark, d):
    """Tests stand for test files, configs for exported symbols."""
    g = _graph(spark, d)
    files = g.nodes.filter("node_type = 'file'")
    tests = files.filter(tx.is_test_path(F.col("path"))).select(F.concat(F.lit("test:"), "path").alias("node_id"), "path")
    configs = g.nodes.filter("exported").select(F.concat(F.lit("config:"), "node_id").alias("node_id"), F.col("node_id").alias("symbol_id"))
    return structure.test_and_config_edges(g.edges, files, tests, configs).select("source", "target", "type")


@query(over_graph("select node_id, path from nodes where node_type = 'function' and exported and length(name) % 2 = 0 and node_id not in (select target from edges join nodes s on s.node_id = source join nodes t on t.node_id = target where type = 'REFERENCES' and coalesce(s.file_id, s.node_id) <> t.file_id)"))
def never_imported_exports(spark, d):
    """Exports whose names have an even length have a const statement, others a function's."""
    g = _graph(spark, d)
    statement = F.when(F.length("name") % 2 == 0, "  export const x = 1").otherwise("export function x() {}")
    exports = g.nodes.filter("node_type = 'function' and exported").select("node_id", "path", statement.alias("statement"))
    return deadcode.never_imported(g, exports).select("node_id", "path")


@query("with t as (select doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: case when length(x) > 6 and x like '%ing' then case when x = 'parsing' then 'parse' else x[:-4] end when length(x) > 5 and x like '%ed' then x[:-3] when length(x) > 3 and x like '%s' then x[:-2] else x end) as w, regexp_matches(text, '(?i)\\bnon[-\\s]') as other from documents), k as (select doc_id, other, list_filter(w, lambda x: length(x) >= 3 and x not in (" + ", ".join(f"'{w}'" for w in audit.STOPWORDS) + ")) as w from t) select doc_id, array_to_string(list_sort(list_distinct(list_concat(w, case when other then ['other'] else [] end, " + ", ".join(f"case when list_contains(w, '{a}') then ['{b}'] else [] end" for a, b in audit.SYNONYMS.items()) + "))), ' ') as tokens from k")
def claim_tokens(spark, d):
    tokens = F.array_join(F.array_sort(audit.claim_tokens(F.col("text"))), " ")
    return _read(spark, d, "documents").select("doc_id", tokens.alias("tokens"))
