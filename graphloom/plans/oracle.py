"""The graph adapter and shared tables in SQL, for comparing results."""

GRAPH = r"""
with recursive
brands as (select distinct cast(substr(p_brand, 7) as int) as b from part),
part_file as (select p_partkey, p_name, p_size, case when cast(substr(p_brand, 7) as int) % 5 = 0 then 'tests/brand_' || cast(substr(p_brand, 7) as int) || '.py' else 'src/brand/' || cast(substr(p_brand, 7) as int) || '.py' end as path from part),
files as (
  select 'src/nation/' || n_nationkey || '.ts' as path, n_nationkey + 100 as lines from nation
  union all select case when b % 5 = 0 then 'tests/brand_' || b || '.py' else 'src/brand/' || b || '.py' end, b + 200 from brands),
symbols as (
  select 'function:supplier:' || s_suppkey as node_id, s_name as name, 'src/nation/' || s_nationkey || '.ts' as path, s_acctbal > 0 as exported from supplier
  union all select 'function:customer:' || c_custkey, c_name, 'src/nation/' || c_nationkey || '.ts', c_acctbal > 0 from customer
  union all select 'function:part:' || p_partkey, p_name, path, p_size % 2 = 0 from part_file),
entries as (
  select 'entrypoint:http:order:' || o_orderkey as node_id, '/orders/' || o_orderkey as route, 'function:customer:' || o_custkey as handler, 'src/nation/' || c_nationkey || '.ts' as path,
         case when o_orderpriority = '1-URGENT' then 'external' else 'startup' end as exposure
  from orders join customer on o_custkey = c_custkey
  where o_orderstatus = 'F' and ((o_orderpriority = '1-URGENT' and o_orderkey % 4 = 0) or (o_orderpriority = '2-HIGH' and o_orderkey % 4 = 1))),
nodes as (
  select 'file:' || path as node_id, 'file' as node_type, path as name, null::varchar as file_id, path, null::boolean as exported, null::varchar as handler, null::varchar as entrypoint_id, null::varchar as exposure from files
  union all select node_id, 'function', name, 'file:' || path, path, exported, null, null, null from symbols
  union all select node_id, 'entrypoint', route, 'file:' || path, path, null, handler, null, exposure from entries
  union all select 'endpoint:' || node_id, 'endpoint', route, 'file:' || path, path, null, null, node_id, null from entries where exposure = 'external'),
edges as (
  select distinct source, target, type from (
    select 'endpoint:' || node_id as source, handler as target, 'HANDLED_BY' as type from entries where exposure = 'external'
    union all select 'function:customer:' || o_custkey, 'function:part:' || l_partkey, 'CALLS' from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and l_quantity >= 48
    union all select 'function:part:' || l_partkey, 'function:supplier:' || l_suppkey, 'CALLS' from lineitem where l_returnflag = 'A' and l_quantity >= 50
    union all select 'function:supplier:' || l_suppkey, 'function:customer:' || o_custkey, 'CALLS' from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'N' and l_quantity = 50 and o_orderpriority = '5-LOW'
    union all select 'file:' || path, 'function:part:' || l_partkey, 'REFERENCES' from lineitem join part_file on p_partkey = (l_partkey * 7) % (select count(*) from part)
      where l_returnflag = 'N' and l_quantity = 49 and path like 'tests/%')),
roots as (
  select 'external' as kind, node_id from nodes where node_type = 'endpoint'
  union select 'internal', node_id from nodes where exposure = 'startup'
  union select 'internal', handler from nodes where exposure = 'startup'
  union select 'test', node_id from nodes where node_type = 'file' and path like 'tests/%'),
walk(kind, node_id, depth) as (
  select kind, node_id, 0 from roots
  union select kind, target, depth + 1 from walk join edges on source = node_id where depth < 20),
levels as (select kind, node_id, min(depth) as depth from walk group by all),
same as (
  select node_id, node_id as same_id from nodes
  union select node_id, entrypoint_id from nodes where entrypoint_id is not null
  union select entrypoint_id, node_id from nodes where entrypoint_id is not null),
least_depths as (
  select s.node_id, min(depth) filter (where kind = 'external') as ext, min(depth) filter (where kind = 'internal') as inl, min(depth) filter (where kind = 'test') as tst
  from same s join levels l on l.node_id = s.same_id group by s.node_id),
statuses as (
  select n.node_id, case when ext is not null then 'externally_reachable' when inl is not null then 'internally_reachable' when tst is not null then 'test_only' else 'unknown' end as status,
         coalesce(ext, inl, tst) as depth
  from nodes n left join least_depths using (node_id)),
degrees as (select node_id, count(*) as degree from (select source as node_id from edges union all select target from edges) group by node_id),
ledger as (
  select n.node_id, n.file_id,
    case when n.path like 'tests/%' then 'test_only' when status = 'externally_reachable' then 'product_reachable' when status = 'internally_reachable' then 'startup_reachable'
         when status = 'test_only' then 'test_only' when coalesce(degree, 0) > 0 then 'dynamic_unknown' else 'disconnected_candidate' end as class
  from nodes n join statuses using (node_id) left join degrees using (node_id) where n.file_id is not null),
weights(type, w) as (values ('CALLS', 0.92::double), ('REFERENCES', 0.64::double), ('HANDLED_BY', 1.0::double)),
links as (
  select source, target, w from edges join weights using (type)
  union select node_id, entrypoint_id, 1.0 from nodes where entrypoint_id is not null
  union select entrypoint_id, node_id, 1.0 from nodes where entrypoint_id is not null),
seeds as (
  select node_id as cluster_id, node_id from entries where exposure = 'external'
  union select node_id, handler from entries where exposure = 'external'
  union select node_id, 'endpoint:' || node_id from entries where exposure = 'external'),
spread(cluster_id, node_id, score, depth) as (
  select cluster_id, node_id, 1.0::double, 0 from seeds
  union select cluster_id, target, score * w, depth + 1 from spread join links on source = node_id where depth < 12 and score * w >= 0.28),
rollup as (
  select file_id, arg_min(class, (p, node_id)) as class, arg_min(node_id, (p, node_id)) as node_id
  from (select *, case class when 'product_reachable' then 0 when 'startup_reachable' then 1 when 'test_only' then 2 when 'dynamic_unknown' then 3 when 'public_api_unproven' then 4 else 5 end as p from ledger) group by file_id),
best as (select cluster_id, node_id, max(score) as score from spread group by all),
in_files as (select cluster_id, file_id as node_id, max(score) * 0.72 as score from best join nodes using (node_id) where file_id is not null group by all),
members as (
  select cluster_id, node_id, score,
         case when node_type in ('entrypoint', 'endpoint') then 'entrypoint' when node_type = 'file' then 'file' when node_id in (select handler from entries) then 'handler' else 'service' end as role
  from (select * from best union all select * from in_files where score >= 0.28 - 1e-9) join nodes using (node_id)
  where node_id in (select node_id from ledger where class = 'product_reachable' union all select file_id from rollup where class = 'product_reachable')),
owners as (select node_id, count(distinct cluster_id) as owners, min(cluster_id) as lo, max(cluster_id) as hi from members group by node_id),
shared_fn as (select node_id from members where score >= 0.4 - 1e-9 and role = 'service' group by node_id having count(distinct cluster_id) >= 2),
file_edges as (
  select least(x, y) as a, greatest(x, y) as b, count(*) as weight
  from (select coalesce(s.file_id, s.node_id) as x, coalesce(t.file_id, t.node_id) as y from edges join nodes s on source = s.node_id join nodes t on target = t.node_id)
  where x <> y group by all)
"""


#: The feature map of capabilities: members, files, blocks and who uses them.
MAP = r"""
, mem as (select distinct 'http:' || e.path || ':orders' as feature_id, m.node_id from members m join entries e on e.node_id = m.cluster_id),
nf as (select node_id, coalesce(file_id, node_id) as file_id from nodes),
fo as (select distinct file_id, feature_id from mem join nf using (node_id)),
steps as (select distinct a.file_id as file_id, b.file_id as b from edges join nf a on a.node_id = source join nf b on b.node_id = target where a.file_id <> b.file_id),
used as (select file_id, feature_id from fo union select b, feature_id from fo join steps using (file_id)),
base as (select distinct 'file:' || path as file_id from entries where exposure = 'startup' and 'file:' || path not in (select file_id from fo)),
use_count as (select file_id, count(*) as consumers from used group by file_id),
own_count as (select file_id, count(*) as n from fo group by file_id),
common as (
  select 'file:' || path as file_id, path, consumers
  from files join use_count on use_count.file_id = 'file:' || path left join own_count on own_count.file_id = 'file:' || path
  where 'file:' || path not in (select file_id from base) and path not like 'tests/%'
    and ((path not in (select path from entries where exposure = 'external') and coalesce(own_count.n, 0) >= 2) or (own_count.n is null and consumers >= 2))),
infra_nodes as (
  select node_id from nf where file_id in (select file_id from base)
  union select node_id from entries where exposure = 'startup' and 'file:' || path not in (select file_id from common)),
infra_files as (select distinct file_id from infra_nodes join nf using (node_id)),
plate as (select 'infra-' || substr(sha256(array_to_string(list_sort(list(distinct substr(file_id, 6))), '|')), 1, 16) as block_id from infra_files),
in_shared as (select node_id, 'shared-' || substr(sha256(path), 1, 16) as block_id from nf join common using (file_id)),
placed as (
  select node_id, block_id from in_shared
  union select node_id, block_id from (select node_id from infra_nodes union select node_id from nf where file_id in (select file_id from infra_files)), plate where node_id not in (select node_id from in_shared)),
mem_owners as (select node_id, count(*) as owners from mem group by node_id),
membership as (select feature_id, node_id, owners = 1 and node_id not in (select node_id from placed) as exclusive from mem join mem_owners using (node_id)),
free as (
  select node_id, feature_id from mem where node_id not in (select node_id from placed)
  union all select node_id, feature_id from nf join fo using (file_id) where node_id not in (select node_id from mem) and node_id not in (select node_id from placed)),
sited as (select node_id, block_id, true as sure from placed union all select node_id, feature_id, count(*) over (partition by node_id) = 1 from free),
conn_rows as (
  select a.block_id as from_block, b.block_id as to_block,
         case when n.node_type in ('endpoint', 'entrypoint') then 'http' when b.block_id like 'shared-%' or b.block_id like 'infra-%' then 'rests_on' else 'calls' end as kind,
         a.sure and b.sure as sure, type || ' ' || n.name as label, ':1' as evidence
  from edges join sited a on a.node_id = source join sited b on b.node_id = target join nodes n on n.node_id = target where a.block_id <> b.block_id
  union all
  select feature_id, block_id, 'rests_on', true, 'Uses ' || block_id, substr(file_id, 6) || ':1'
  from membership join (select * from in_shared union all select node_id, block_id from infra_nodes, plate) using (node_id) join nf using (node_id) where not exclusive),
conns as (
  select from_block, to_block, kind, case when bool_or(sure) then 'PROVEN' else 'POSSIBLE' end as confidence,
         array_to_string(list_sort(list(distinct label))[1:3], '; ') as label, count(distinct evidence) as evidence
  from conn_rows group by all)
"""


def over_graph(query: str) -> str:
    return GRAPH + query


def over_map(query: str) -> str:
    return GRAPH + MAP + query


#: Tokens of a text column t in DuckDB: distinct, three characters or more, no numbers,
#: none of the generic ones.
def tokens(text: str) -> str:
    stop = "'app', 'application', 'component', 'feature', 'file', 'function', 'handler', 'index', 'main', 'module', 'route', 'service', 'source', 'src', 'support', 'system', 'that', 'their', 'this', 'with'"
    split = f"regexp_split_to_array(lower(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')"
    return f"list_distinct(list_filter({split}, lambda x: length(x) >= 3 and not regexp_full_match(x, '[0-9]+') and x not in ({stop})))"
