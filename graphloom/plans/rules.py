"""More queries of the catalogue: paths, mechanical dead code, reality checks, review.
Their inputs are made of the star schema; each query's SQL states what must come out
without the operators' patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import deadcode, excerpts, reality, resolve, review, structure
from ..sources import manifests
from .catalogue import _graph, _ledger, _read, query
from .oracle import over_graph

c = F.col


def _text(pattern: str, *columns):
    return F.format_string(pattern, *(F.expr(x).cast("string") for x in columns))


# ---- paths ------------------------------------------------------------------

_FOLDERS = ("", "docs/", "a/docs/b/", "tests/", "src/services/", ".github/ISSUE_TEMPLATE/", "docs\\guides\\", "./docs/", "Config/", "app/data/", "node_modules/x/")
_FILES = (
    "README.md", "readme.de.mdx", "CONTRIBUTING.md", "security.policy.md", "Features.md", "release_summary.md", "FeaturesPage.tsx", "app.ts", "app.test.ts", "go.mod",
    "yarn.lock", "requirements-dev.txt", "vite.config.ts", "settings.py", "menu.json", "package.json", "notes.rst", "tsconfig.json", "LICENSE",
)
_PATHS_SQL = """
with f(i, folder, docs, github, test, shared, config_dir, data, windows, foreign_) as (values (0, '', false, false, false, false, false, false, false, false), (1, 'docs/', true, false, false, false, false, false, false, false), (2, 'a/docs/b/', true, false, false, false, false, false, false, false), (3, 'tests/', false, false, true, false, false, false, false, false), (4, 'src/services/', false, false, false, true, false, false, false, false), (5, '.github/ISSUE_TEMPLATE/', false, true, false, false, false, false, false, false), (6, 'docs\\guides\\', true, false, false, false, false, false, true, false), (7, './docs/', true, false, false, false, false, false, false, false), (8, 'Config/', false, false, false, false, true, false, false, false), (9, 'app/data/', false, false, false, false, false, true, false, false), (10, 'node_modules/x/', false, false, false, false, false, false, false, true)),
n(i, name, kind) as (values (0, 'README.md', 'readme'), (1, 'readme.de.mdx', 'readme'), (2, 'CONTRIBUTING.md', 'governance'), (3, 'security.policy.md', 'governance'), (4, 'Features.md', 'claims'), (5, 'release_summary.md', 'summary'), (6, 'FeaturesPage.tsx', 'copy'), (7, 'app.ts', 'code'), (8, 'app.test.ts', 'test'), (9, 'go.mod', 'manifest'), (10, 'yarn.lock', 'manifest'), (11, 'requirements-dev.txt', 'manifest'), (12, 'vite.config.ts', 'tool'), (13, 'settings.py', 'settings'), (14, 'menu.json', 'data'), (15, 'package.json', 'manifest'), (16, 'notes.rst', 'note'), (17, 'tsconfig.json', 'tsconfig'), (18, 'LICENSE', 'license')),
p as (select p_partkey, f.*, name, kind, name like '%.md' or name like '%.mdx' as md, kind = 'governance' or github as off from part join f on f.i = p_partkey % 11 join n on n.i = p_partkey // 11 % 19),
w as (select *, not off and (kind in ('readme', 'claims', 'summary', 'copy') or (docs and md)) as product from p)
select p_partkey, product, product and kind not in ('summary', 'copy') as prime,
 not (md or test or kind in ('test', 'note') or name = 'yarn.lock' or (kind in ('manifest', 'license') and not windows)) as implementation,
 (kind in ('tool', 'settings') and not windows) as config, shared as shared_domain,
 config_dir or name = 'vite.config.ts' or (not windows and (name = 'README.md' or (docs and md) or (data and name like '%.json') or name in ('package.json', 'tsconfig.json'))) as contract_bearing,
 name in ('FeaturesPage.tsx', 'app.ts', 'app.test.ts', 'vite.config.ts', 'settings.py') and not foreign_ as own_code,
 case when folder in ('docs/', './docs/') then 'docs/' || name when windows then 'docs/guides' when folder = '' then name when folder = 'a/docs/b/' then 'a/docs' when folder = 'src/services/' then 'src/services' when folder = '.github/ISSUE_TEMPLATE/' then '.github/ISSUE_TEMPLATE' when folder = 'app/data/' then 'app/data' when folder = 'node_modules/x/' then 'node_modules/x' else folder || name end as group_key
from w"""


@query(_PATHS_SQL)
def path_classes(spark, d):
    """What paths made of folders and file names say."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    name = pick(_FILES, F.expr("p_partkey div 11") % len(_FILES))
    path = F.concat(pick(_FOLDERS, c("p_partkey") % len(_FOLDERS)), name)
    language = F.when(name.rlike(r"\.tsx?$"), "TypeScript").when(name.endswith(".py"), "python").otherwise("markdown")
    return _read(spark, d, "part").select(
        "p_partkey", paths.is_product_document(path).alias("product"), paths.is_primary_document(path).alias("prime"), paths.is_implementation(path).alias("implementation"),
        paths.is_config(path).alias("config"), paths.is_shared_domain(path).alias("shared_domain"), paths.is_contract_bearing(path).alias("contract_bearing"),
        paths.is_own_code(path, language).alias("own_code"), paths.group_key(path).alias("group_key"),
    )


@query("with m as (select 'src/n' || s_nationkey as home, 'c' || s_suppkey % 40 as community, count(*) as n from supplier group by all), h as (select community, arg_min(home, (-n, home)) as home from m group by community), o as (select home, min(community) as community from h group by home), i as (select c_nationkey as k, 'n' || c_nationkey || '/c' || c_custkey || '.ts' as rest, c_custkey % 3 as r, c_custkey from customer) select case r when 0 then 'src/' || rest when 1 then 'lib/' || rest else 'top' || c_custkey || '.ts' end as path, coalesce(case when r = 0 then community end, case r when 0 then 'directory:src/n' || k when 1 then 'directory:lib/n' || k else 'directory:top' || c_custkey || '.ts' end) as community from i left join o on r = 0 and home = 'src/n' || k")
def attach_isolated_files(spark, d):
    """Customers as loose files beside communities of suppliers."""
    members = _read(spark, d, "supplier").select(_text("src/n%s/s%s.ts", "s_nationkey", "s_suppkey").alias("path"), _text("c%s", "s_suppkey % 40").alias("community"))
    path = F.when(c("c_custkey") % 3 == 0, _text("src/n%s/c%s.ts", "c_nationkey", "c_custkey")).when(c("c_custkey") % 3 == 1, _text("lib/n%s/c%s.ts", "c_nationkey", "c_custkey")).otherwise(_text("top%s.ts", "c_custkey"))
    return structure.attach_isolated(members, _read(spark, d, "customer").select(path.alias("path")))


@query(over_graph("select distinct source, target, type from edges"))
def ordered_edges(spark, d):
    e = _graph(spark, d).edges
    return structure.ordered_edges(e.union(e)).select("source", "target", "type")


# ---- mechanical dead code ---------------------------------------------------

_PART_PATH = "case when p_partkey % 10 = 0 then 'tests/p' || p_partkey || '.ts' else 'src/p' || p_partkey || '.ts' end"


@query(f"select {_PART_PATH} as path, 'helper' as name from part where p_size % 2 = 1 and p_partkey % 7 <> 0 and p_partkey % 10 <> 0")
def unused_local_helpers(spark, d):
    """A helper in each part's file; parts of an even size call it, every seventh exports it."""
    use = F.when(c("p_size") % 2 == 0, "helper()").otherwise("helper2()")
    p = _read(spark, d, "part").select(F.expr(_PART_PATH).alias("path"), F.concat(F.lit("function helper() {\n  helper();\n}\nconst k = "), use).alias("text"), (c("p_partkey") % 7 == 0).alias("exported"))
    symbols = p.select("path", F.lit("helper").alias("name"), F.lit("function").alias("node_type"), "exported", F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    return deadcode.unused_helpers(p, symbols).select("path", "name")


@query(f"select {_PART_PATH} as path, 'A' || p_size as name, 1 as line_start from part where p_size <> p_partkey % 60 and p_partkey % 10 <> 0 union all select {_PART_PATH}, 'B', 3 from part where p_partkey % 10 <> 0")
def unused_type_aliases(spark, d):
    text = _text("export type A%s = string;\nlet x: A%s;\n  type B = number\n", "p_size", "p_partkey % 60")
    return deadcode.unused_type_aliases(_read(spark, d, "part").select(F.expr(_PART_PATH).alias("path"), F.lit("typescript").alias("language"), text.alias("text"))).select("path", "name", c("line_start").cast("int").alias("line_start"))


@query("with s as (select 'src/s' || s_suppkey || '.ts' as path, s_nationkey as k from supplier where s_nationkey not in (select s_nationkey from supplier where s_suppkey % 8 = 0)) select path, 'api' || k || '.put' as name, 3 as line_start from s union all select path, 'api' || k || '.get', 1 from s where k not in (select s_suppkey % 40 from supplier)")
def unused_api_methods(spark, d):
    """Every supplier's file holds its nation's object of two methods, one of which it may call."""
    text = F.concat(_text("export const api%s = {\n  get: (x) => x,\n\n  put: async (y) => y,\n};\nroot.api%s .get();\n", "s_nationkey", "s_suppkey % 40"), F.when(c("s_suppkey") % 8 == 0, _text("api%s [k]", "s_nationkey")).otherwise(""))
    return deadcode.unused_api_methods(_read(spark, d, "supplier").select(_text("src/s%s.ts", "s_suppkey").alias("path"), F.lit("typescript").alias("language"), text.alias("text"))).select("path", "name", c("line_start").cast("int").alias("line_start"))


@query("select 'm' || p_partkey || case when p_partkey % 2 = 0 then '.mjs' else '.js' end as path, 'run' as name from part where p_partkey % 2 = 1 or p_size % 3 <> 0")
def withheld_module_exports(spark, d):
    ext = F.when(c("p_partkey") % 2 == 0, ".mjs").otherwise(".js")
    p = _read(spark, d, "part").select(F.concat(_text("m%s", "p_partkey"), ext).alias("path"), F.concat(F.lit("export function run() {\n}\n"), F.when(c("p_size") % 3 == 0, "x.run()").otherwise("x.ran()")).alias("text"))
    named = p.select("path", F.lit("run").alias("name"))
    return deadcode.withhold_used_modules(named, p, named.withColumns({"line_start": F.lit(1), "line_end": F.lit(2)}))


@query("select l_partkey as id, arg_max(l_linestatus, l_orderkey * 10 + l_linenumber) as file, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) as name from lineitem group by l_partkey")
def latest_candidates(spark, d):
    rows = _read(spark, d, "lineitem").select(c("l_partkey").alias("id"), c("l_linestatus").alias("file"), c("l_returnflag").alias("name"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("arrival"))
    return deadcode.latest(rows).select("id", "file", "name")


# ---- reality checks ---------------------------------------------------------


@query("""with d as (select 'n' || n_nationkey || '/package.json' as manifest, 'pkg-' || n_nationkey as name, n_nationkey as k, 'pkg' as t from nation union all select 'n' || n_nationkey || '/package.json', '@x/lib-' || n_nationkey % 5, n_nationkey, 'lib' from nation union all select 'py' || n_nationkey || '/requirements.txt', 'Pillow', n_nationkey, 'pil' from nation union all select 'py' || n_nationkey || '/requirements.txt', 'mod-' || n_nationkey, n_nationkey, 'mod' from nation),
f as (select * from d where not ((t = 'pkg' and exists (select 1 from supplier where s_nationkey = k and s_suppkey % 2 = 0)) or (t = 'lib' and exists (select 1 from supplier where s_nationkey = k and s_suppkey % 2 = 1 and s_suppkey % 5 = k % 5)) or (t = 'pil' and exists (select 1 from customer where c_nationkey = k and c_custkey % 9 = 0)) or (t = 'mod' and exists (select 1 from customer where c_nationkey = k and c_custkey % 9 <> 0 and c_custkey % 25 = k))))
select manifest, name, n_nationkey + case t when 'pkg' then 0 when 'lib' then 100 else 300 end as promise_id from f join nation on case t when 'pil' then true when 'lib' then n_nationkey % 5 = k % 5 else n_nationkey = k end""")
def phantom_dependencies(spark, d):
    """Manifests of nations, imports by suppliers and customers, promises about all."""
    n = _read(spark, d, "nation")
    manifests = n.select(_text("n%s/package.json", "n_nationkey").alias("path"), _text('{"dependencies": {"pkg-%s": "1", "@x/lib-%s": "2"}}', "n_nationkey", "n_nationkey % 5").alias("text"))
    manifests = manifests.union(n.select(_text("py%s/requirements.txt", "n_nationkey"), _text("-r x\nPillow>=1\r\nmod-%s[a]==2  # kept\n", "n_nationkey")))
    scripts = _read(spark, d, "supplier").select(_text("./n%s/src/s%s.ts", "s_nationkey", "s_suppkey").alias("path"), F.when(c("s_suppkey") % 2 == 0, _text("pkg-%s/sub", "s_nationkey")).otherwise(_text("@x/lib-%s", "s_suppkey % 5")).alias("source"))
    modules = _read(spark, d, "customer").select(_text("py%s/c%s.py", "c_nationkey", "c_custkey"), F.when(c("c_custkey") % 9 == 0, "PIL.Image").otherwise(_text("mod_%s.x", "c_custkey % 25")))
    k = c("n_nationkey").cast("long")
    said = n.select(k.alias("promise_id"), _text("Uses pkg-%s for x", "n_nationkey").alias("text"), F.lit("The stack").alias("heading"))
    said = said.union(n.select(k + 100, _text("Lib %s!", "n_nationkey % 5"), F.lit(None).cast("string"))).union(n.select(k + 200, F.lit("We like Pillow"), F.lit("Overview"))).union(n.select(k + 300, _text("mod %s and Pillow", "n_nationkey"), F.lit("Backend")))
    declared = reality.declared_dependencies(manifests)
    return reality.phantom_dependencies(declared, scripts.union(modules), said).select("manifest", "name", c("promise_id").cast("int").alias("promise_id"))


@query("select c_custkey as feature_id from customer where c_custkey % 10 % 2 = 0 and c_custkey % 15 % 2 = 0")
def starter_features(spark, d):
    """Two places a customer, on fifteen pages of which every second is untouched."""
    f = _read(spark, d, "customer")
    places = f.select(c("c_custkey").alias("feature_id"), F.lit("entrypoint").alias("role"), _text("p%s", "c_custkey % 10").alias("path")).union(f.select("c_custkey", F.lit("implementation"), _text("p%s", "c_custkey % 15")))
    i = spark.range(15).select(_text("p%s", "id").alias("path"), F.when(c("id") % 2 == 0, "x To get started, edit the page.tsx file /next.svg").otherwise("/next.svg").alias("text"))
    return reality.starter_features(places, i)


@query("select 'p' || p_partkey as promise_id, (case p_partkey % 4 when 0 then 4 when 1 then 3 else 2 end)::int as score from part where p_partkey % 4 <> 3 order by score desc, promise_id limit 1")
def application_promise(spark, d):
    notes = F.element_at(F.array(*map(F.lit, (" AI-Tutor", " chat, Dashboard", " Next.js", " tutors"))), (c("p_partkey") % 4 + 1).cast("int"))
    return reality.application_promise(_read(spark, d, "part").select(_text("p%s", "p_partkey").alias("promise_id"), F.concat("p_name", notes).alias("text")))


# ---- review -----------------------------------------------------------------


@query(over_graph(", k as (select 't' || s_suppkey % 7 as target, 'function:supplier:' || s_suppkey as node_id from supplier), l as (select source as a, target as b, case type when 'HANDLED_BY' then 1 when 'CALLS' then 2 else 3 end as p from edges union all select target, source, case type when 'HANDLED_BY' then 1 when 'CALLS' then 2 else 3 end from edges union all select node_id, file_id, 0 from nodes where node_type <> 'file'), f as (select k.target, b as node_id, min(p)::int as priority from k join l on a = k.node_id where not exists (select 1 from k z where z.target = k.target and z.node_id = b) and b not like '%3' group by all), r as (select *, row_number() over (partition by target order by priority, node_id)::int as place from f) select target, node_id, priority, place from r where place <= 12 and node_id not in (select node_id from k)"))
def independent_context(spark, d):
    """Seven targets of suppliers; nodes that end in 3 have no source to read."""
    g = _graph(spark, d)
    k = _read(spark, d, "supplier").select(_text("t%s", "s_suppkey % 7").alias("target"), _text("function:supplier:%s", "s_suppkey").alias("node_id"))
    return review.independent_context(g, k, g.nodes.filter("node_id not like '%3'"))


_REACH = ("reachable", "internally_reachable", "test_only", "dead_or_unreferenced", "unknown")


@query(over_graph(", r as (select l.node_id, class, 'd' || length(l.node_id) % 5 as dossier_id, length(l.node_id) % 5 as k, case when length(name) % 2 = 0 then 'entrypoints' else 'handlers' end as field from ledger l join nodes n on n.node_id = l.node_id where node_type = 'function') select dossier_id, field, node_id, class from r where case when k = 4 then false when k = 0 and field = 'entrypoints' then class <> 'product_reachable' when k = 1 and field = 'entrypoints' then class <> 'startup_reachable' when class = 'dynamic_unknown' then false when k = 0 then class <> 'product_reachable' when k = 1 then class <> 'startup_reachable' when k = 2 then class <> 'test_only' else class not in ('disconnected_candidate', 'public_api_unproven') end"))
def draft_violations(spark, d):
    """Five dossiers, one of each reachability, over all functions."""
    g = _graph(spark, d)
    of = F.length("node_id") % 5
    refs = g.nodes.filter("node_type = 'function'").select(F.concat(F.lit("d"), of.cast("string")).alias("dossier_id"), F.when(F.length("name") % 2 == 0, "entrypoints").otherwise("handlers").alias("field"), "node_id")
    dossiers = spark.range(5).select(_text("d%s", "id").alias("dossier_id"), F.element_at(F.array(*map(F.lit, _REACH)), (c("id") + 1).cast("int")).alias("reachability"))
    return review.draft_violations(dossiers, refs, _ledger(g))


@query("with q as (select p_partkey as k, 'p' || p_partkey as path, p_size from part) select 'file_count' as rule, '' as location union all select 'unparsed_repeated', path from q where p_size = 1 and k % 2 = 0 union all select 'partial_parsed', path from q where p_size = 2 union all select 'partial_kind', path from q where p_size in (1, 2) and k % 4 = 0 union all select 'partial_target', path from q where p_size in (1, 2) and k % 3 = 0 union all select 'partial_line', path from q where p_size in (1, 2) and k % 5 = 0")
def analysis_violations(spark, d):
    p = _read(spark, d, "part").withColumn("path", _text("p%s", "p_partkey"))
    totals = p.agg((F.count(F.lit(1)) + 1).alias("source_files"), F.count_if(c("p_size") != 1).alias("parsed_files"))
    ones = p.filter("p_size = 1").select("path", "p_partkey")
    partial = p.filter("p_size in (1, 2)").select("path", F.when(c("p_partkey") % 3 == 0, "").otherwise("x").alias("target"), F.when(c("p_partkey") % 4 == 0, "guess").otherwise("string-mention").alias("kind"), (c("p_partkey") % 5).alias("line"))
    return review.analysis_violations(totals, ones.union(ones.filter("p_partkey % 2 = 0")).select("path"), partial)


@query("with c as (select c_custkey as k, 'c' || c_custkey as path from customer) select path, case when k % 10 = 1 or k % 11 = 0 then 'removed' when k % 10 = 0 then 'added' else 'changed' end as change from c where case when k % 10 = 0 then k % 11 <> 0 when k % 10 = 1 or k % 11 = 0 then true else k % 7 = 0 end")
def stale_files(spark, d):
    f = _read(spark, d, "customer").select("c_custkey", _text("c%s", "c_custkey").alias("path"), c("c_nationkey").alias("hash"))
    scanned = f.filter("c_custkey % 10 != 1").select("path", F.when(c("c_custkey") % 7 == 0, c("hash") + 1).otherwise(c("hash")).alias("hash"))
    return review.stale_files(f.filter("c_custkey % 10 != 0"), scanned, f.filter("c_custkey % 11 = 0"))


@query("select p_partkey as id, coalesce(string_agg(distinct 'f' || l_suppkey, ' ' order by 'f' || l_suppkey), '') as feature_ids from part left join lineitem on l_partkey = p_partkey group by p_partkey")
def coverage_map(spark, d):
    refs = _read(spark, d, "lineitem").select(_text("f%s", "l_suppkey").alias("feature_id"), c("l_partkey").alias("id"))
    return review.coverage_map(_read(spark, d, "part").select(c("p_partkey").alias("id")), refs).select("id", F.array_join("feature_ids", " ").alias("feature_ids"))


# ---- sources and excerpts ---------------------------------------------------


@query("with p as (select 'd' || p_partkey || '/README.md' as path, p_partkey % 4 as k, p_name as n from part) select path, 3 as line, 'Key Features' as heading, n || ' list' as text, true as list_item from p union all select path, 5, 'Key Features', 'plain words It supports ' || n, false from p union all select path, 8, 'Key Features', 'Must ' || n, true from p where k = 0 union all select path, 11, 'Key Features', 'We will ship', false from p where k in (0, 1)")
def promise_excerpts(spark, d):
    """A page for each part: items, a paragraph, a fence whose language its key chooses, prose."""
    fence = F.element_at(F.array(*map(F.lit, ("", "js", "mermaid", "py"))), (c("p_partkey") % 4 + 1).cast("int"))
    last = F.when(c("p_partkey") % 4 < 2, "We will ship").otherwise("We shipped")
    text = F.concat(
        F.lit("Hello\n## Key *Features* \n- **"), "p_name", F.lit("**\n  list\nplain words\nIt supports `"), "p_name", F.lit("`\n"),
        F.lit("```"), fence, F.lit("\n* Must "), "p_name", F.lit("\n\n~~~\n"), last,
    )
    return excerpts.promise_excerpts(_read(spark, d, "part").select(_text("d%s/README.md", "p_partkey").alias("path"), text.alias("text")))


@query("with p as (select p_partkey as k, 'a' || p_partkey as dir from part) select dir || '/tsconfig.json' as path, dir as directory, case when k % 2 = 0 then 'src' else '.' end as base_url, '@a/*' as pattern, u.s as substitution, u.pos::int as pos from p cross join (values ('x//y/*', 0), ('z/*', 1)) u(s, pos) where k % 3 <> 2 union all select dir || '/tsconfig.json', dir, 'src', null, null, null from p where k % 3 = 2 and k % 2 = 0")
def module_aliases(spark, d):
    """A configuration for each part: with a base, with paths, with both or neither."""
    base = F.when(c("p_partkey") % 2 == 0, '"baseUrl": "src", // base\n').otherwise("")
    listed = F.when(c("p_partkey") % 3 != 2, '"paths": {"@a/*": ["x//y/*", "", "z/*",], /* no, */ "@b": [""],},').otherwise('"strict": true,')
    text = F.concat(F.lit('{ /* "a": 1 */ "compilerOptions": {'), base, listed, F.lit("},\n}"))
    return manifests.module_aliases(_read(spark, d, "part").select(_text("a%s/tsconfig.json", "p_partkey").alias("path"), text.alias("text")))


@query("with p as (select p_partkey as k, 'a' || p_partkey as dir from part) select dir || '/run.js' as path, 'npm script ' || dir || ':start' as name from p where k % 3 = 0 union all select 'lib/b.js', 'npm script ' || dir || ':start' from p where k % 4 = 0")
def script_entrypoints(spark, d):
    first = F.when(c("p_partkey") % 3 == 0, "cross-env A=1 B=2 node './run.js' --x").when(c("p_partkey") % 3 == 1, "node -e 1; node ../../out.js").otherwise("echo 'a; node ./run.js'")
    second = F.when(c("p_partkey") % 4 == 0, " && NODE.exe ..\\\\lib/b.js | node gone.js").otherwise(" || node lib/*.js")
    p = _read(spark, d, "part").select(_text("a%s", "p_partkey").alias("dir"), F.concat(F.lit('{"scripts": {"start": "'), first, second, F.lit('"}}')).alias("text"))
    files = p.select(F.concat("dir", F.lit("/run.js")).alias("path")).union(spark.range(1).select(F.lit("lib/b.js")))
    return manifests.script_entrypoints(p.select(F.concat("dir", F.lit("/package.json")).alias("path"), "text"), files)


@query("with p as (select p_partkey as k, p_size, 'src/p' || p_partkey || '.ts' as path from part), m as (select a.path, b.path as target, 'recovered-import' as kind, 1 as line from p a join p b on b.k = a.k + 1 where a.k % 5 = 0 and a.k % 10 <> 0 union all select a.path, b.path, 'string-mention', 1 from p a join p b on b.k = a.k + 1 where a.k % 5 = 0 union all select a.path, b.path, 'string-mention', 2 from p a join p b on b.k = a.p_size where a.k % 5 = 0 and a.k <> b.k) select path, target, kind, min(line)::int as line from m group by all")
def partial_imports(spark, d):
    """Every fifth part's file has a diagnostic, every tenth on the line of its import."""
    p = _read(spark, d, "part").withColumn("path", _text("src/p%s.ts", "p_partkey"))
    text = _text("import x from \"./p%s\"\nconst a = 'p%s.js', b = 'p 1';", "p_partkey + 1", "p_size")
    line = F.when(c("p_partkey") % 10 == 0, 1).otherwise(9)
    found = p.filter("p_partkey % 5 = 0").select("path", line.alias("line_start"), line.alias("line_end"))
    imports = p.select("path", _text("./p%s", "p_partkey + 1").alias("source"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    return resolve.partial_imports(p.select("path", text.alias("text")), found, imports, p.select("path")).select("path", "target", "kind", c("line").cast("int").alias("line"))


@query("with p as (select p_partkey as k, 'a' || p_partkey % 7 || '/src/m' || p_partkey || '.ts' as path from part) select p.path, '@/m' || (p.k + 7) as source, q.path as target from p join p q on q.k = p.k + 7 where p.k % 7 not in (5, 6) union all select p.path, 'src/m' || (p.k + 7), q.path from p join p q on q.k = p.k + 7 where p.k % 7 = 5 union all select p.path, 'a0/src/m' || (p.k // 7 * 7), q.path from p join p q on q.k = p.k // 7 * 7 where p.k % 7 = 6")
def alias_imports(spark, d):
    """Seven packages: patterns in five, a base alone in the sixth, only the root's in the last."""
    k = c("p_partkey")
    p = _read(spark, d, "part").select(k, _text("a%s/src/m%s.ts", "p_partkey % 7", "p_partkey").alias("path"))
    source = F.when(k % 7 == 5, _text("src/m%s", "p_partkey + 7")).when(k % 7 == 6, _text("a0/src/m%s", "p_partkey div 7 * 7")).otherwise(_text("@/m%s", "p_partkey + 7"))
    text = F.when(c("id") < 5, '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lost/*", "src/*"]}}}').otherwise('{"compilerOptions": {"baseUrl": "."}}')
    configs = spark.range(6).select(_text("a%s/tsconfig.json", "id").alias("path"), text.alias("text")).union(spark.range(1).select(F.lit("tsconfig.json"), F.lit('{"compilerOptions": {"baseUrl": "./"}}')))
    return resolve.alias_targets(p.select("path", source.alias("source")), p.select("path"), manifests.module_aliases(configs))


_KINDS = ("feature", "infrastructure", "utility", "test", "configuration", "documentation", "dead/unreachable", "generated/vendor", "unknown")


@query("select p_partkey, case p_partkey % 9 when 3 then true when 4 then true when 7 then true when 6 then p_size % 2 = 0 when 1 then p_size % 2 = 0 or p_size % 3 <> 0 when 2 then p_size % 2 = 0 or p_size % 3 <> 0 else false end as accounted from part")
def support_accounted(spark, d):
    """Nine classes in turn; even sizes are investigated, every third reachability unknown."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (c("p_partkey") % 9 + 1).cast("int"))
    reach = F.when(c("p_size") % 3 == 0, "unknown").otherwise("test_only")
    return _read(spark, d, "part").select("p_partkey", review.support_accounted(kind, reach, c("p_size") % 2 == 0).alias("accounted"))
