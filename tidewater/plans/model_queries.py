"""Queries over models of services: shortened names, references to entities, extended services, compact graphs.

Parts stand in for definitions, line items for references and observations, customers for services.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import compact, extensions, names
from tidewater.plans.registry import query
from tidewater.session import Scratch, table


def _text(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


FACTS = """with d as (select case when p_partkey % 9 = 0 then 'Thing' || p_partkey % 400 || '.N' || p_partkey else 'lib' || p_partkey || '.m' || p_partkey % 3 || '.Thing' || p_partkey % 400 end as name,
  case when p_partkey % 4 > 0 then 'pk' || p_partkey % 7 end package, case when p_partkey % 2 = 0 then 'type' else 'entity' end kind from part
  union all select 'Thing' || p_partkey, 'pk0', 'type' from part where p_partkey % 31 = 0),
l as (select l_orderkey * 8 + l_linenumber id, 'src.E' || l_suppkey source, 'f' || l_linenumber field, case l_linenumber % 3 when 0 then 'association' when 1 then 'type' else 'projection' end kind,
  case l_orderkey % 4 when 0 then 'm' || l_suppkey % 4 || '.Thing' || l_partkey % 400 when 1 then 'N' || l_partkey when 2 then 'Thing' || l_partkey % 450 else 'cds.String' end target,
  case when l_linenumber % 2 = 0 then 'pk' || l_suppkey % 5 end package from lineitem),
u as (select distinct target from l),
m as (select target, name, package, kind, name = target exact from u join d on name = target or ends_with(name, '.' || target)),
a as (select target, count(*) filter (exact) e, count(*) n, min(name) filter (exact) en, min(name) fn from m group by 1),
o as (select target, package, count(*) k, min(name) kn from m where package is not null group by 1, 2),
r as (select l.*, case when a.n is null then 'missing' when e = 1 or n = 1 or k = 1 then 'resolved' else 'ambiguous' end status, case when e = 1 then 'exact' when n = 1 then 'suffix' when k = 1 then 'package' end tier,
  case when e = 1 then en when n = 1 then fn when k = 1 then kn end found from l left join a using (target) left join o on l.target = o.target and l.package = o.package)
"""


def _model(spark, sf_dir):
    p, s, n = F.col("p_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    part = table(spark, sf_dir, "part")
    name = F.when(p % 9 == 0, _text("Thing", p % 400, ".N", p)).otherwise(_text("lib", p, ".m", p % 3, ".Thing", p % 400))
    defs = part.select(name.alias("name"), F.when(p % 4 > 0, _text("pk", p % 7)).alias("package"), F.when(p % 2 == 0, "type").otherwise("entity").alias("kind"))
    defs = defs.union(part.where(p % 31 == 0).select(_text("Thing", p), F.lit("pk0"), F.lit("type")))
    order, of = F.col("l_orderkey") % 4, F.col("l_partkey")
    target = F.when(order == 0, _text("m", s % 4, ".Thing", of % 400)).when(order == 1, _text("N", of)).when(order == 2, _text("Thing", of % 450)).otherwise("cds.String")
    refs = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + n).alias("id"), _text("src.E", s).alias("source"), _text("f", n).alias("field"), F.when(n % 3 == 0, "association").when(n % 3 == 1, "type").otherwise("projection").alias("kind"),
        target.alias("target"), F.when(n % 2 == 0, _text("pk", s % 5)).alias("package"),
    )
    return refs, defs


@query("j_suffix", FACTS + "select id, found as found_name from r where tier in ('exact', 'suffix')")
def j_suffix(spark, sf_dir):
    """References whose name alone says which definition they mean."""
    return names.resolve(*_model(spark, sf_dir)).where("tier in ('exact', 'suffix')").select("id", "found_name")


@query("j_fallback_unique", FACTS + "select id, status, tier, found as found_name from r")
def j_fallback_unique(spark, sf_dir):
    """Every reference, with the tier of the reference's own package."""
    return names.resolve(*_model(spark, sf_dir)).select("id", "status", "tier", "found_name")


@query("g_incoming_refs", FACTS + """, w as (select distinct 'Thing' || p_partkey % 450 entity from part union all select 'm2.Thing' || p_partkey from part where p_partkey < 400),
f as (select entity, name, name = entity exact from w join d on name = entity or ends_with(name, '.' || entity)),
g as (select entity, name from f qualify exact or not contains(entity, '.') or not bool_or(exact) over (partition by entity)),
t as (select r.*, d.kind found_kind from r join d on found = name where status = 'resolved')
select distinct entity, source, case when kind = 'projection' then '(projection)' else field end field, kind = 'type' via_type, 'reference' status from g join t on name = found where kind <> 'type' or found_kind = 'type' and target not like 'cds.%'
union all select entity, null, null, null, 'unknown_entity' from w where entity not in (select entity from f)""")
def g_incoming_refs(spark, sf_dir):
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    entities = part.select(_text("Thing", p % 450).alias("entity")).union(part.where(p < 400).select(_text("m2.Thing", p)))
    return names.incoming(*_model(spark, sf_dir), entities)


SERVICES = """with c as (select c_custkey k, c_custkey // 10 repo, 'Svc' || c_custkey % 4 svc, c_custkey % 10 in (0, 5, 7) ext, case when c_custkey % 3 = 0 then 'lib/sub/f' else 'srv/f' end || c_custkey % 2 || case when c_custkey % 5 = 2 then '' else '.cds' end file from customer),
s as (select *, case when repo % 2 = 0 then '@org/p' || repo else 'p' || repo end pkg, case when k % 6 = 1 then 'org.' || svc else svc end qualified, case when k % 20 < 10 then svc else 'org.' || svc end symbol from c),
e as (select k, repo, symbol, case when k % 7 < 2 then 'relative' when k % 7 < 4 then 'package' else 'same' end how,
  case when k % 7 = 0 then 'srv/f' || k % 2 when k % 7 = 1 then 'lib/sub/f' || k % 2 when k % 7 = 3 then 'srv/f' || k % 2 end path, case when repo % 2 = 1 then '@org/p' || (repo - 1) else 'p' || (repo - 1) end pkg from s where ext),
m as (select e.k, s.k base from e join s on not s.ext and e.symbol in (s.svc, s.qualified) and case how when 'package' then s.pkg = e.pkg else s.repo = e.repo end and (path is null or s.file in (path, path || '.cds'))),
n as (select k, count(*) n, min(base) base from m group by 1),
b as (select e.k, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end status, case when n = 1 then base end base from e left join n using (k)),
o as (select k * 10 + j id, k, 'op' || (k + j) % 5 as name, '/p' || j % 2 path, 'type' || j kind from s, unnest(range(4)) r(j)),
i as (select k * 10 + 5 + j id, k, 'op' || (k - 4 + j) % 5 as name, '/p' || j % 2 path, 'type' || (case when repo % 3 = 0 then 9 else j end) kind, (k - 4) * 10 + j base_id from s, unnest(range(4)) r(j) where ext and k > 4),
q as (select b.k, name, path, kind, o.id from b join o on b.base = o.k where not exists (select 1 from o x where x.k = b.k and x.name = o.name and x.path = o.path))
"""


def _services(spark, sf_dir):
    k = F.col("c_custkey")
    repo, svc, c = F.floor(k / 10), _text("Svc", k % 4), F.col("service_id")
    rows = table(spark, sf_dir, "customer").select(k.alias("service_id"), repo.alias("repo_id"), svc.alias("service_name"), (k % 10).isin(0, 5, 7).alias("is_extend"))
    pkg = lambda r: F.when(r % 2 == 0, _text("@org/p", r)).otherwise(_text("p", r))
    file = _text(F.when(c % 3 == 0, "lib/sub/f").otherwise("srv/f"), c % 2, F.when(c % 5 == 2, "").otherwise(".cds"))
    # a specifier leads from the service's own folder to srv or lib/sub
    up = F.when(c % 3 == 0, "../../").otherwise("./../")
    other = F.when(F.col("repo_id") % 2 == 1, _text("@org/p", F.col("repo_id") - 1)).otherwise(_text("p", F.col("repo_id") - 1))
    spec = F.when(c % 7 == 0, _text(up, "srv/f", c % 2, ".cds")).when(c % 7 == 1, _text(up, "x/../lib//sub/./f", c % 2)).when(c % 7 == 2, other).when(c % 7 == 3, _text(other, "/srv/f", c % 2))
    kind = F.when(c % 7 < 2, "relative").when(c % 7 < 4, "package")
    return rows.select(
        "*", pkg(F.col("repo_id")).alias("package_name"), F.when(c % 6 == 1, _text("org.", F.col("service_name"))).otherwise(F.col("service_name")).alias("qualified_name"), file.alias("source_file"),
        spec.alias("module_specifier"), F.when(c % 20 >= 10, _text("org.", F.col("service_name"))).alias("imported_symbol"), kind.alias("import_kind"),
    )


@query("g_extension", SERVICES + "select k service_id, status, base base_id from b")
def g_extension(spark, sf_dir):
    return extensions.bases(_services(spark, sf_dir))


@query("u_inherit", SERVICES + """select q.k service_id, q.name, q.path, case when i.id is null then 'add' when i.kind = q.kind and i.base_id = q.id then 'keep' else 'update' end as action, i.id operation_id, q.id base_operation_id
from q left join i on q.k = i.k and q.name = i.name and q.path = i.path
union all select k, name, path, 'delete', id, base_id from i where not exists (select 1 from q where q.k = i.k and q.name = i.name and q.path = i.path)""")
def u_inherit(spark, sf_dir):
    """What becomes of stored inherited operations, some of them changed since."""
    services = _services(spark, sf_dir)
    k, j = F.col("service_id"), F.col("j")
    each = services.where("not is_extend or service_id > 4").select(k, "repo_id", "is_extend", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    none = F.lit(None).cast("string")

    def of(rows, id, at, kind, provenance, base):
        return rows.select(id.alias("operation_id"), k, _text("op", (at + j) % 5).alias("name"), _text("/p", j % 2).alias("path"), _text("type", kind).alias("type"), *(none.alias(c) for c in extensions.COPIED[1:]), F.lit(provenance).alias("provenance"), base.alias("base_operation_id"))

    every = services.select(k, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    stored = of(each.where("is_extend"), k * 10 + 5 + j, k - 4, F.when(F.col("repo_id") % 3 == 0, 9).otherwise(j), "inherited", (k - 4) * 10 + j)
    return extensions.inherited(extensions.bases(services), of(every, k * 10 + j, k, j, "direct", F.lit(None).cast("long")).unionByName(stored))


GRAPH = """with o as (select l_orderkey * 8 + l_linenumber ordinal, l_linenumber % 3 step, case when l_partkey % 2 = 0 then 'calls' else 'emits' end as type, case l_linenumber when 1 then 'dynamic' when 2 then null else 'resolved' end status,
  case when l_linenumber % 2 = 0 then 0.5::double else 0 end confidence, 'd' || l_linenumber % 2 decision,
  'n' || l_suppkey % 90 sk, 'svc' sp, 'S' || l_linenumber % 3 sl, case when l_suppkey % 5 > 0 then 'repo-' || l_suppkey % 7 end sr, 'a/f' || l_suppkey % 9 sf, case when l_linenumber % 4 > 0 then l_linenumber end sn,
  'n' || l_partkey % 60 tk, 'part' tp, 'P' || l_linenumber % 2 tl, 'repo-' || l_partkey % 11 tr, null::varchar tf, l_linenumber tn,
  case when l_orderkey % 3 > 0 then 'x' || l_partkey % 4 end xf, l_orderkey % 50 xs, l_partkey, l_suppkey from lineitem),
v as (select sk as key, sp kind, sl as label, sr repo, sf file, sn as line from o union all select tk, tp, tl, tr, tf, tn from o),
b as (select distinct *, '["' || kind || '","' || label || '",' || coalesce('"' || repo || '"', 'null') || ',' || coalesce('"' || file || '"', 'null') || ',' || coalesce(line::varchar, 'null') body from v),
w as (select * from b qualify row_number() over (partition by key order by body) = 1),
n as (select row_number() over (order by key) - 1 n, * from w),
rd as (select repo, row_number() over (order by repo) - 1 n from (select distinct repo from n where repo is not null)),
fd as (select file, row_number() over (order by file) - 1 n from (select distinct file from n where file is not null)),
g as (select step, type, sk, tk, status, confidence, decision, count(*) count, min(ordinal) first_ordinal, min((coalesce(xf, ''), xs)) site from o group by all),
e as (select row_number() over (order by step, a.n, b.n, type, status nulls first, site, first_ordinal) - 1 n, g.*, a.n f, b.n t from g join n a on sk = a.key join n b on tk = b.key)
"""


def _observations(spark, sf_dir):
    k, j, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    none = F.lit(None).cast("string")
    source = F.struct(_text("n", s % 90).alias("key"), F.lit("svc").alias("kind"), _text("S", j % 3).alias("label"), F.when(s % 5 > 0, _text("repo-", s % 7)).alias("repo"), _text("a/f", s % 9).alias("file"), F.when(j % 4 > 0, j).cast("int").alias("line"))
    target = F.struct(_text("n", p % 60).alias("key"), F.lit("part").alias("kind"), _text("P", j % 2).alias("label"), _text("repo-", p % 11).alias("repo"), none.alias("file"), j.cast("int").alias("line"))
    site = F.struct(none.alias("repo"), F.when(k % 3 > 0, _text("x", p % 4)).alias("file"), (k % 50).alias("start"), (k % 50).alias("end"), F.lit(None).cast("int").alias("line"))
    ref = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    refs = F.array(ref("operation", p.cast("string")), ref("operation", F.when(j > 2, s.cast("string"))), ref("symbol", _text("s", p % 13)))
    return table(spark, sf_dir, "lineitem").select(
        (k * 8 + j).alias("ordinal"), (j % 3).alias("step"), F.when(p % 2 == 0, "calls").otherwise("emits").alias("type"), F.when(j == 1, "dynamic").when(j != 2, "resolved").alias("status"),
        F.when(j % 2 == 0, F.lit(0.5)).when(j == 1, F.lit(-2.0)).alias("confidence"), _text("d", j % 2).alias("decision"), source.alias("source"), target.alias("target"), site.alias("site"), refs.alias("refs"),
    )


@query("g_compact_nodes", GRAPH + "select key, n.n, kind, label, rd.n repo, fd.n file, line from n left join rd using (repo) left join fd using (file)")
def g_compact_nodes(spark, sf_dir):
    return compact.nodes(_observations(spark, sf_dir), Scratch(spark, "compact"))[0]


def _edges(spark, sf_dir):
    observed, scratch = _observations(spark, sf_dir), Scratch(spark, "compact")
    return observed, compact.edges(observed, compact.nodes(observed, scratch)[0], scratch)


@query("g_compact_edges", GRAPH + """select n, step, type, sk source_key, tk target_key, status, confidence, decision, f "from", t "to", count, first_ordinal from e""")
def g_compact_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


@query("g_compact_refs", GRAPH + """, m as (select e.n edge, o.* from o join e on o.step = e.step and o.type = e.type and o.sk = e.sk and o.tk = e.tk and o.status is not distinct from e.status and o.confidence is not distinct from e.confidence and o.decision = e.decision),
r as (select edge, 'operation' kind, l_partkey::varchar as value from m union select edge, 'operation', l_suppkey::varchar from m where ordinal % 8 > 2 union select edge, 'symbol', 's' || l_partkey % 13 from m)
select edge, kind, list(value order by try_cast(value as bigint) nulls last, value)[:5] "values", count(*) total, least(count(*), 5) shown, greatest(count(*) - 5, 0) omitted from r group by 1, 2""")
def g_compact_refs(spark, sf_dir):
    return compact.references(compact.members(*_edges(spark, sf_dir)))


@query("g_compact_status", GRAPH + "select status, sum(count)::bigint observations, count(*) edges, (sum(count) - count(*))::bigint collapsed from e group by 1")
def g_compact_status(spark, sf_dir):
    return compact.statuses(_edges(spark, sf_dir)[1])
