"""Bindings, coverage, severity and value checks on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import checks, versions
from lodestrata.operators import advisories, binding, coverage, graph, severity

from .driver_queries import _query, _t


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---- bindings


@_query("""with n as (select p_partkey % 20 project_id, case when p_partkey % 3 = 0 then 'NPM' else 'npm' end ecosystem, p_brand package, cast(p_size % 7 as varchar) as version, case when p_partkey % 4 = 0 then cast(p_partkey as varchar) end as instance, p_partkey ref from part),
e as (select l_orderkey, l_linenumber, l_partkey % 20 project_id, 'npm' ecosystem, p_brand package, case when l_linenumber < 6 then cast(p_size % 7 as varchar) end as version, case when l_suppkey % 5 = 0 then cast(l_partkey as varchar) end as instance from lineitem join part on l_partkey = p_partkey),
x as (select project_id, lower(ecosystem) ecosystem, package, version, instance, min(ref) ref from n group by all),
w as (select project_id, lower(ecosystem) ecosystem, package, version, count(*) k, min(ref) ref from n where version is not null group by all)
select l_orderkey, l_linenumber, coalesce(x.ref, case when e.instance is null and w.k = 1 then w.ref end) ref, case when x.ref is not null then 'exact' when e.instance is null and w.k = 1 then 'unique' else 'unresolved' end how
from e left join x on x.project_id = e.project_id and x.ecosystem = e.ecosystem and x.package = e.package and x.version is not distinct from e.version and x.instance is not distinct from e.instance
left join w on w.project_id = e.project_id and w.ecosystem = e.ecosystem and w.package = e.package and w.version = e.version""")
def edge_targets(spark, sf_dir):
    part, line = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem")
    nodes = part.select((F.col("p_partkey") % 20).alias("project_id"), F.when(F.col("p_partkey") % 3 == 0, "NPM").otherwise("npm").alias("ecosystem"), F.col("p_brand").alias("package"), _s(F.col("p_size") % 7).alias("version"), F.when(F.col("p_partkey") % 4 == 0, _s("p_partkey")).alias("instance"), F.col("p_partkey").alias("ref"))
    edges = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).alias("project_id"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("package"), F.when(F.col("l_linenumber") < 6, _s(F.col("p_size") % 7)).alias("version"), F.when(F.col("l_suppkey") % 5 == 0, _s("l_partkey")).alias("instance")
    )
    return binding.bind(edges, nodes).select("l_orderkey", "l_linenumber", "ref", "how")


@_query("""with t as (select c_custkey, c_nationkey project_id, case when c_custkey % 2 = 0 then 'PyPI' else 'npm' end ecosystem, c_mktsegment package, 'runtime' scope from customer),
d as (select s_nationkey project_id, case when s_suppkey % 2 = 0 then 'pypi' else 'NPM' end ecosystem, case s_suppkey % 4 when 0 then 'BUILDING' when 1 then 'MACHINERY' else 'HOUSEHOLD' end package, case when s_suppkey % 3 = 0 then 'runtime' else 'build' end scope, case when s_suppkey % 7 = 0 then 'transitive' else 'direct' end kind from supplier)
select c_custkey, case when count(d.package) = 0 then 'unmatched' when bool_or(d.scope <> 'build') then 'used' else 'build-only' end status, count(d.package) n_declarations
from t left join d on d.kind = 'direct' and d.project_id = t.project_id and lower(d.ecosystem) = lower(t.ecosystem) and d.package = t.package group by c_custkey""")
def tool_usages(spark, sf_dir):
    tools = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("project_id"), F.when(F.col("c_custkey") % 2 == 0, "PyPI").otherwise("npm").alias("ecosystem"), F.col("c_mktsegment").alias("package"), F.lit("runtime").alias("scope"))
    k = F.col("s_suppkey")
    declared = _t(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("project_id"), F.when(k % 2 == 0, "pypi").otherwise("NPM").alias("ecosystem"), F.when(k % 4 == 0, "BUILDING").when(k % 4 == 1, "MACHINERY").otherwise("HOUSEHOLD").alias("package"),
        F.when(k % 3 == 0, "runtime").otherwise("build").alias("scope"), F.when(k % 7 == 0, "transitive").otherwise("direct").alias("kind"),
    )
    return binding.tool_usages(tools, declared).select("c_custkey", "status", "n_declarations")


@_query("""with u as (select c_custkey, c_custkey % 30 project_id, case c_custkey % 6 when 0 then 'left-pad' when 1 then '#' else '#a' || c_custkey % 50 end reference from customer),
i as (select s_suppkey % 30 project_id, '#a' || s_suppkey % 50 alias, min(case s_suppkey % 7 when 0 then './src/f' || s_suppkey || '.js' when 1 then '@s/p' || s_suppkey || '/sub' when 2 then 'fs' when 3 then './../up.js' when 4 then 'Upper' when 5 then null else 'pkg' || s_suppkey || '/x' end) target from supplier group by 1, 2),
f as (select distinct s_suppkey % 30 project_id, './src/f' || s_suppkey || '.js' path from supplier where s_suppkey % 2 = 0),
k as (select u.*, i.target t, f.path is not null there, case when u.reference not like '#%' then 'unmatched' when u.reference = '#' or i.target is null then 'unknown' when i.target like '%..%' then 'unknown' when i.target like './%' then case when f.path is not null then 'local' else 'unknown' end
  when i.target = 'fs' then 'builtin' when i.target = 'Upper' then 'unknown' else 'package' end kind from u left join i on i.project_id = u.project_id and i.alias = u.reference left join f on f.project_id = u.project_id and f.path = i.target)
select c_custkey, kind, case when kind = 'package' then regexp_replace(t, '/(x|sub)$', '') when kind in ('local', 'builtin') then t end target from k""")
def alias_imports(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    usages = _t(spark, sf_dir, "customer").select("c_custkey", (k % 30).alias("project_id"), F.when(k % 6 == 0, "left-pad").when(k % 6 == 1, "#").otherwise(F.concat(F.lit("#a"), _s(k % 50))).alias("reference"))
    file = F.concat(F.lit("src/f"), _s(s), F.lit(".js"))
    target = F.when(s % 7 == 0, F.concat(F.lit("./"), file)).when(s % 7 == 1, F.concat(F.lit("@s/p"), _s(s), F.lit("/sub"))).when(s % 7 == 2, "fs").when(s % 7 == 3, "./../up.js").when(s % 7 == 4, "Upper").when(s % 7 == 6, F.concat(F.lit("pkg"), _s(s), F.lit("/x")))
    supplier = _t(spark, sf_dir, "supplier")
    imports = supplier.select((s % 30).alias("project_id"), F.concat(F.lit("#a"), _s(s % 50)).alias("alias"), target.alias("target"))
    sources = supplier.where(s % 2 == 0).select((s % 30).alias("project_id"), file.alias("path"))
    return binding.alias_imports(usages, imports, sources, ["fs", "path"]).select("c_custkey", "kind", "target")


@_query("""with d as (select o_orderkey declaration, o_custkey % 40 project_id, 'Pkg.' || o_custkey % 9 package, o_orderkey % 6 least from orders),
l as (select c_custkey record, c_custkey % 40 project_id, 'pkg-' || c_custkey % 9 package, case when c_custkey % 11 > 0 then c_custkey % 8 end ver from customer),
h as (select declaration, count(*) n, count(*) filter (ver is null) u, min(record) record from d join l on l.project_id = d.project_id and l.package = lower(replace(d.package, '.', '-')) where ver is null or ver >= least group by 1)
select declaration, case when n is null then 'none' when n > 1 then 'ambiguous' when u > 0 then 'unknown' else 'bound' end outcome, case when n = 1 and u = 0 then record end record from d left join h using (declaration)""")
def lock_bindings(spark, sf_dir):
    k = F.col("c_custkey")
    declared = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("declaration"), (F.col("o_custkey") % 40).alias("project_id"), F.concat(F.lit("Pkg."), _s(F.col("o_custkey") % 9)).alias("package"), versions.pep440_key(F.concat(_s(F.col("o_orderkey") % 6), F.lit(".0"))).alias("least"))
    locks = _t(spark, sf_dir, "customer").select(k.alias("record"), (k % 40).alias("project_id"), F.concat(F.lit("pkg-"), _s(k % 9)).alias("package"), versions.pep440_key(F.when(k % 11 > 0, _s(k % 8)).otherwise("not a version")).alias("key"))
    holds = binding.specifier_holds(F.col("key"), F.array(F.struct(F.lit(">=").alias("op"), F.col("least").alias("key"))))
    return binding.bind_locks(declared, locks, holds).select("declaration", "outcome", "record")


# ---- coverage


@_query("""select n_nationkey project_id, 'selected' status from nation join region on n_regionkey = r_regionkey where lower(r_name) in ('asia', 'europe') and n_nationkey in (select c_custkey from customer)
union all select c_custkey, 'unknown' from customer where c_custkey not in (select n_nationkey from nation)""")
def selected_projects(spark, sf_dir):
    projects = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("r_name").alias("ecosystem"))
    own, unknown = coverage.select_projects(projects, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id")), ["Asia", "europe"])
    return own.select("project_id", F.lit("selected").alias("status")).unionByName(unknown.select("project_id", F.lit("unknown").alias("status")))


@_query("""select p_partkey from part where p_size % 6 > 0 and case p_partkey % 5 when 0 then p_partkey % 2 = 0 and p_partkey % 3 = 0 when 1 then p_partkey % 2 = 0 when 2 then p_partkey % 2 = 0 when 3 then p_partkey % 2 = 0 and p_partkey % 3 <> 1 else true end""")
def advisory_eligible(spark, sf_dir):
    k = F.col("p_partkey")
    eco = F.element_at(F.array(*map(F.lit, ["Maven", "PyPI", "Cargo", "npm", "Go"])), (k % 5 + 1).cast("int"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", eco.alias("ecosystem"), F.when(F.col("p_size") % 6 > 0, "1").alias("version"), F.when(k % 2 == 0, F.concat(F.lit("pkg:"), F.lower(eco), F.lit("/x@1"))).otherwise("pkg:generic/x@1").alias("purl"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("public"))
    return coverage.advisory_eligible(rows).select("p_partkey")


@_query("""with f as (select 'd' || s_suppkey % 10 || '/h' || s_suppkey % 60 || '.h' path from supplier union select 'h' || s_suppkey % 5 || '.h' from supplier),
i as (select c_custkey, 'd' || c_custkey % 10 || '/m' || c_custkey || '.c' path, case c_custkey % 7 when 0 then 'stdio.h' when 1 then 'sys/types.h' else 'h' || c_custkey % 60 || '.h' end reference, c_custkey % 3 > 0 quoted from customer)
select path, reference, quoted from i where c_custkey % 7 > 1 and not (quoted and ('d' || c_custkey % 10 || '/' || reference in (select path from f) or reference in (select path from f)))""")
def foreign_headers(spark, sf_dir):
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    supplier = _t(spark, sf_dir, "supplier")
    files = supplier.select(F.concat(F.lit("d"), _s(s % 10), F.lit("/h"), _s(s % 60), F.lit(".h")).alias("path")).union(supplier.select(F.concat(F.lit("h"), _s(s % 5), F.lit(".h"))))
    includes = _t(spark, sf_dir, "customer").select(F.concat(F.lit("d"), _s(k % 10), F.lit("/m"), _s(k), F.lit(".c")).alias("path"), F.when(k % 7 == 0, "stdio.h").when(k % 7 == 1, "sys/types.h").otherwise(F.concat(F.lit("h"), _s(k % 60), F.lit(".h"))).alias("reference"), (k % 3 > 0).alias("quoted"))
    return coverage.foreign_headers(includes, files, ["stdio.h", "stdlib.h"])


_FILES = "case c_custkey % 6 when 0 then 'a' || c_custkey || '/Gemfile' when 1 then 'b' || c_custkey || '/x.CSPROJ' when 2 then 'c' || c_custkey || '/build.gradle' when 3 then 'composer.json' when 4 then 'e' || c_custkey || '/readme.md' else 'f' || c_custkey || '/App.csproj' end"


@_query(f"with f as (select c_custkey, {_FILES} path from customer) select distinct path from f where c_custkey % 6 in (0, 1, 3, 5) and path not in (select path from f where c_custkey % 4 = 0)")
def uncovered_manifests(spark, sf_dir):
    files = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_FILES).alias("path"))
    return coverage.uncovered_manifests(files, files.where("c_custkey % 4 = 0"), ["Gemfile", "composer.json", "build.gradle"], [".csproj"])


_CODES = "case event_id % 8 when 0 then 'command.shell' when 1 then 'usage.rust-macro' when 2 then 'x.unsupported-y' when 3 then 'manifest.cmake-dynamic' when 4 then 'manifest.parse' when 5 then 'lock.read' when 6 then 'z.uncollected' else 'plain' end"
_PATHS = "case when event_id % 8 = 7 then null when event_id % 8 = 5 then 'p' || event_id % 20 || '/pylock.dev.toml' else 'p' || event_id % 20 || '/f.txt' end"


@_query(f"""with d as (select user_id % 20 project_id, {_CODES} code, case when event_id % 3 = 0 then 'error' else 'warning' end severity, {_PATHS} path from events)
select path, code reason, project_id from d where path is not null and (code in ('command.shell', 'usage.rust-macro', 'x.unsupported-y', 'manifest.cmake-dynamic', 'z.uncollected') or code = 'lock.read' and severity = 'error') group by all
union select 'r' || n_nationkey, 'capability.usage-unsupported', n_nationkey from nation where n_regionkey = 1 union select 'm' || s_suppkey, 'coverage.unsupported-manifest', null from supplier""")
def coverage_gaps(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("project_id"), F.expr(_CODES).alias("code"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning").alias("severity"), F.expr(_PATHS.replace("'p' || event_id % 20 ||", "concat('p', event_id % 20) ||")).alias("path"))
    capable = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.concat(F.lit("r"), _s("n_nationkey")).alias("root"), F.lit("usage").alias("name"), F.when(F.col("n_regionkey") == 1, "unsupported").otherwise("complete").alias("state"))
    return coverage.gaps(rows, capable, _t(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), _s("s_suppkey")).alias("path")))


# ---- severity and identifiers


_SCORES = """select 'a' || o_orderkey % 700 advisory, case when o_orderkey % 700 % 5 = 0 then case when o_orderkey % 3 = 0 then 'severity' else 'affected' end when o_orderkey % 700 % 2 = 0 then 'severity' else 'affected' end field,
case when o_orderkey % 31 = 0 then '' else 'CVSS_V' || (2 + o_orderkey % 3) end as type, cast(o_orderkey % 10 as varchar) score, case o_custkey % 3 when 0 then true when 1 then false end as match, o_orderkey from orders"""


@_query(f"""with s as ({_SCORES}), c as (select advisory, bool_or(field = 'severity') and bool_or(field = 'affected') conflict from s group by 1)
select o_orderkey, case when conflict then 'unknown' when field = 'severity' then 'applicable' when match is null then 'unknown' when match then 'applicable' else 'not-applicable' end applicability, type <> '' valid from s join c using (advisory)""")
def severity_applicability(spark, sf_dir):
    return severity.applicability(_scores(spark, sf_dir)).select("o_orderkey", "applicability", "valid")


def _scores(spark, sf_dir):
    o, a = F.col("o_orderkey"), F.col("o_orderkey") % 700
    field = F.when(a % 5 == 0, F.when(o % 3 == 0, "severity").otherwise("affected")).when(a % 2 == 0, "severity").otherwise("affected")
    return _t(spark, sf_dir, "orders").select(F.concat(F.lit("a"), _s(a)).alias("advisory"), field.alias("field"), F.when(o % 31 == 0, "").otherwise(F.concat(F.lit("CVSS_V"), _s(2 + o % 3))).alias("type"), _s(o % 10).alias("score"), F.when(F.col("o_custkey") % 3 == 0, True).when(F.col("o_custkey") % 3 == 1, False).alias("match"), "o_orderkey")


@_query(f"""with s as ({_SCORES}), c as (select advisory, bool_or(field = 'severity') and bool_or(field = 'affected') conflict from s group by 1),
x as (select 'g' || cast(substr(advisory, 2) as integer) % 90 root, type, score, type <> '' valid, case when conflict then 'unknown' when field = 'severity' then 'applicable' when match is null then 'unknown' when match then 'applicable' else 'not-applicable' end state from s join c using (advisory)),
k as (select root, count(distinct (type, score)) filter (state = 'applicable' and valid) n, bool_or(not valid or state = 'unknown') bad from x group by 1)
select root, n n_scores, least(n, 8) n_kept, n - least(n, 8) n_omitted, case when bad or n > 8 then 'incomplete' when n > 0 then 'reported' else 'not-provided' end status from k""")
def severity_groups(spark, sf_dir):
    rows = severity.applicability(_scores(spark, sf_dir)).withColumn("root", F.concat(F.lit("g"), _s(F.expr("cast(substring(advisory, 2) as int) % 90"))))
    return severity.group_scores(rows, 8)


@_query("""with a as (select case when p_partkey % 2 = 0 then 'CVE-2024-' || (1000 + p_partkey) else 'GHSA-' || p_partkey end advisory, ['CVE-2023-' || (1000 + p_size), 'bad-' || p_size] aliases, case when p_partkey % 3 = 0 then ['CVE-2022-12'] end related, ['CWE-' || p_size, 'CWE-0'] cwes from part),
r as (select advisory, 'id' field, advisory id from a union all select advisory, 'aliases', unnest(aliases) from a union all select advisory, 'related', unnest(related) from a union all select advisory, 'cwe_ids', unnest(cwes) from a)
select distinct advisory, case when regexp_full_match(id, 'CVE-[0-9]{4}-[0-9]{4,19}') then 'CVE' else 'CWE' end as type, id, field from r where regexp_full_match(id, 'CVE-[0-9]{4}-[0-9]{4,19}|CWE-[1-9][0-9]{0,9}')""")
def advisory_identifiers(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = _t(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, F.concat(F.lit("CVE-2024-"), _s(1000 + k))).otherwise(F.concat(F.lit("GHSA-"), _s(k))).alias("advisory"), F.array(F.concat(F.lit("CVE-2023-"), _s(1000 + size)), F.concat(F.lit("bad-"), _s(size))).alias("aliases"),
        F.when(k % 3 == 0, F.array(F.lit("CVE-2022-12"))).alias("related"), F.array(F.concat(F.lit("CWE-"), _s(size)), F.lit("CWE-0")).alias("cwes"),
    )
    return severity.identifiers(rows)


@_query("""select 'CVE-2024-' || (1000 + l_partkey % 300) cve, count(distinct l_orderkey) n_observations, count(distinct l_suppkey) n_advisories, min(l_orderkey) first_issue from lineitem where l_linenumber % 4 in (1, 2) and l_partkey % 300 > 9 group by 1""")
def cve_associations(spark, sf_dir):
    k = F.col("l_partkey") % 300
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("observation"), F.col("l_orderkey").alias("issue"), F.col("l_suppkey").alias("advisory"), F.when(k > 9, F.concat(F.lit("CVE-2024-"), _s(1000 + k))).otherwise("CVE-24-1").alias("id"), F.when(F.col("l_linenumber") % 4 == 1, "id").when(F.col("l_linenumber") % 4 == 2, "aliases").otherwise("related").alias("field"))
    return severity.associations(rows)


@_query("select o_custkey, count(*) n_rows, count(distinct (o_orderstatus, o_orderpriority)) > 1 conflicting from orders group by 1 having count(*) > 1")
def feed_duplicates(spark, sf_dir):
    return severity.feed_duplicates(_t(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


# ---- values


@_query(r"""select p_partkey, regexp_full_match(m, '[A-Za-z0-9_][A-Za-z0-9_.\-]*:[A-Za-z0-9_][A-Za-z0-9_.\-]*') maven, regexp_full_match(n, '(@[a-z0-9~][a-z0-9._~\-]*/)?[a-z0-9~][a-z0-9._~\-]*') npm,
case when p_size % 3 = 0 then '.' when p_size % 3 = 1 then 'a/c' end inside from (select p_partkey, p_size, case p_partkey % 4 when 0 then 'org.x:' || p_partkey when 1 then 'org.x' when 2 then 'a:b:c' else 'g' || p_partkey || ':a b' end m, case p_partkey % 5 when 0 then '@s/p' || p_partkey when 1 then 'Big' || p_partkey when 2 then '@s/' when 3 then 'p.q-' || p_partkey else '.x' end n from part)""")
def name_checks(spark, sf_dir):
    k = F.col("p_partkey")
    m = F.when(k % 4 == 0, F.concat(F.lit("org.x:"), _s(k))).when(k % 4 == 1, "org.x").when(k % 4 == 2, "a:b:c").otherwise(F.concat(F.lit("g"), _s(k), F.lit(":a b")))
    n = F.when(k % 5 == 0, F.concat(F.lit("@s/p"), _s(k))).when(k % 5 == 1, F.concat(F.lit("Big"), _s(k))).when(k % 5 == 2, "@s/").when(k % 5 == 3, F.concat(F.lit("p.q-"), _s(k))).otherwise(".x")
    path = F.when(F.col("p_size") % 3 == 0, "a/../").when(F.col("p_size") % 3 == 1, "./a//b/../c").otherwise("a/../../etc")
    return _t(spark, sf_dir, "part").select("p_partkey", checks.maven_coordinate(m).alias("maven"), checks.npm_name(n).alias("npm"), checks.inside(path).alias("inside"))


@_query("""select event_id, floor(epoch(ts))::bigint at_second, case when event_id % 4 = 2 then 0.0 else (event_id % 1000) / 1000.0 end::double fraction, case when epoch(timestamp '2024-01-01') - epoch(date_trunc('second', ts)) < 0 then 'future' when epoch(timestamp '2024-01-01') - epoch(date_trunc('second', ts)) > 86400 then 'stale' else 'fresh' end state
from events where event_id % 4 > 0 union all select event_id, null, null, 'unknown' from events where event_id % 4 = 0""")
def event_times(spark, sf_dir):
    k = F.col("event_id")
    whole = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 4 == 0, F.concat(whole, F.lit("+01:00"))).when(k % 4 == 2, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.lpad(_s(k % 1000), 3, "0"), F.lit("Z")))
    rows = _t(spark, sf_dir, "events").select("event_id", checks.rfc3339(text).alias("t"))
    return rows.select("event_id", F.unix_timestamp("t.at").alias("at_second"), F.col("t.fraction").cast("double").alias("fraction"), checks.staleness(F.col("t.at"), F.timestamp_seconds(F.lit(1704067200)), 86400).alias("state"))


@_query("""select o_orderkey, case o_orderkey % 5 when 0 then '{"a":' || o_custkey || ',"b":[1,{"c":"x","d":null}]}' when 1 then '"t' || o_custkey || '"' end as value, case o_orderkey % 5 when 2 then 'json.invalid' when 3 then 'json.not-finite' when 4 then 'json.not-unicode' end problem,
case when o_orderkey % 5 = 0 and length(cast(o_custkey as varchar)) > 2 then 33 + length(cast(o_custkey as varchar)) end omitted from orders""")
def strict_json(spark, sf_dir):
    k, c = F.col("o_orderkey"), _s("o_custkey")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('{ "b" : [1, {"d":null, "c":"x"}], "a":'), c, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit(' "t'), c, F.lit('"')))
        .when(k % 5 == 2, F.concat(F.lit('{"a":1,"a":'), c, F.lit("}"))).when(k % 5 == 3, F.lit("[1, NaN]")).otherwise(F.lit('"\\ud800"'))
    )
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", checks.strict_json(text).alias("j"))
    most = F.get_json_object(checks.bounded(F.col("j.value"), 35), "$.length").cast("long")
    return rows.select("o_orderkey", "j.value", "j.problem", most.alias("omitted"))


@_query("""select c_custkey, case c_custkey % 4 when 0 then 'A=1|npx|eslint|--fix|a b' || c_custkey when 1 then 'pytest|-q' when 3 then 'tsc' end words, case c_custkey % 4 when 0 then 'eslint' when 1 then 'pytest' when 3 then 'tsc' end tool, case c_custkey % 4 when 0 then 'lint' when 1 then 'test' end capability from customer""")
def command_words(spark, sf_dir):
    k = F.col("c_custkey")
    command = F.when(k % 4 == 0, F.concat(F.lit("A=1 npx eslint --fix 'a b"), _s(k), F.lit("'"))).when(k % 4 == 1, 'pytest   "-q"').when(k % 4 == 2, "rm -rf x && make").otherwise("tsc")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", checks.shell_words(command).alias("words")).withColumn("tool", checks.executable(F.col("words")))
    able = F.create_map(*[F.lit(x) for x in ("eslint", "lint", "pytest", "test")])
    return rows.select("c_custkey", F.array_join("words", "|").alias("words"), "tool", F.try_element_at(able, F.col("tool")).alias("capability"))


@_query("""select s_suppkey, case s_suppkey % 6 when 0 then 'registry' when 1 then 'registry' when 2 then 'git' when 3 then 'path' when 4 then 'registry' else 'unknown' end kind, s_suppkey % 6 = 0 or s_suppkey % 6 = 4 public from supplier""")
def registry_origins(spark, sf_dir):
    k = F.col("s_suppkey")
    url = F.when(k % 6 == 0, "https://pypi.org/simple/").when(k % 6 == 1, F.concat(F.lit("https://index.corp/"), _s(k))).when(k % 6 == 2, "git+ssh://h/x").when(k % 6 == 3, "../x").when(k % 6 == 4, "https://registry.npmjs.org")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", checks.registry_origin(url).alias("o")).select("s_suppkey", "o.kind", "o.public")


# ---- versions and ranges

_QUALIFIERS = ["alpha", "beta", "milestone", "rc", "snapshot", "", "sp", "xyz"]
_MAVEN = "select p_partkey k, p_size % 3 a, p_partkey % 4 b, p_partkey % 8 q, p_size % 5 n from part"


@_query(f"""with v as ({_MAVEN}), r as (select k, [a, b, case when q = 5 and n > 0 then 9 else q end, case when q = 5 and n = 0 then 0 else n end] t from v)
select x.k, case when x.t > y.t then 1 when x.t < y.t then -1 else 0 end sign from r x join r y on y.k = x.k + 1""")
def maven_order(spark, sf_dir):
    """Versions are written in three ways that mean the same; numbers behind a qualifier of nothing come after every qualifier."""
    v = _t(spark, sf_dir, "part").selectExpr(*_MAVEN.removeprefix("select ").removesuffix(" from part").replace("p_partkey k", "p_partkey as k").replace("% 3 a", "% 3 as a").replace("% 4 b", "% 4 as b").replace("% 8 q", "% 8 as q").replace("% 5 n", "% 5 as n").split(", "))
    name = F.element_at(F.array(*map(F.lit, _QUALIFIERS)), (F.col("q") + 1).cast("int"))
    short = F.when((F.col("q") < 3) & (F.col("n") > 0), F.substring(name, 1, 1)).when(name == "rc", "CR").otherwise(F.upper(name))
    base, n = F.concat(_s("a"), F.lit("."), _s("b")), _s("n")
    bare = F.when(F.col("n") > 0, F.concat(base, F.lit("-"), n)).otherwise(base)
    text = F.when(name == "", F.when(F.col("k") % 3 == 1, F.concat(F.regexp_replace(bare, "-.*", ""), F.lit(".0-ga"), F.when(F.col("n") > 0, F.concat(F.lit("-"), n)).otherwise(""))).otherwise(bare))
    text = text.when(F.col("k") % 3 == 0, F.concat(base, F.lit("-"), name, F.lit("-"), n)).when(F.col("k") % 3 == 1, F.concat(base, F.lit(".0-"), short, n)).otherwise(F.concat(base, name, n))
    rows = v.select("k", text.alias("t"))
    pairs = rows.join(rows.select((F.col("k") - 1).alias("k"), F.col("t").alias("u")), "k")
    return pairs.select("k", versions.maven_compare(F.col("t"), F.col("u")).alias("sign"))


_ECOSYSTEMS = ["npm", "PyPI", "Go", "Maven", "RubyGems", "Hex"]


@_query("""with p as (select p_partkey, p_type, length(p_type) % 5 kind, p_partkey % 6 eco, p_size % 6 a, p_partkey % 10 b from part)
select cast(p_partkey as varchar) identity, 'adv-' || eco || '-' || p_type advisory, case when eco = 5 then 'unknown' when kind = 2 or kind = 4 then 'unknown'
  when kind = 0 and a >= 1 and a < 3 then 'affected' when kind = 1 and a >= 1 and (a < 2 or a = 2 and b < 5) then 'affected' when kind = 3 and (a < 2 or a = 2 and b <= 5 or a >= 4) then 'affected' else 'not-affected' end status,
case when eco < 5 and (kind = 0 and a >= 1 and a < 3 or kind = 1 and a >= 1 and (a < 2 or a = 2 and b < 5)) then '3.0.0' end fix, kind in (2, 4) invalid from p""")
def advisories_mixed(spark, sf_dir):
    """Six ecosystems; ranges with a fix, with a limit, contradicting, with a last affected version, and without a start."""
    k = F.col("p_partkey")
    eco = F.element_at(F.array(*map(F.lit, _ECOSYSTEMS)), (k % 6 + 1).cast("int"))
    version = F.concat(F.when(k % 6 == 2, "v").otherwise(""), _s(F.col("p_size") % 6), F.lit("."), _s(k % 10), F.lit(".0"))
    part = _t(spark, sf_dir, "part")
    rows = part.select(_s("p_partkey").alias("identity"), eco.alias("ecosystem"), F.lower("p_type").alias("package"), version.alias("version"))
    event = lambda b, kind: F.struct(F.lit(b).alias("boundary"), F.lit(kind).alias("kind"))
    fixed = [event("3.0.0", "fixed"), event("1.0.0", "introduced")]
    kind = F.length("p_type") % 5
    ranges = (
        F.when(kind == 0, F.array(F.array(*fixed))).when(kind == 1, F.array(F.array(*fixed, event("2.5.0", "limit")))).when(kind == 2, F.array(F.array(event("2.0.0", "introduced"), event("2.0.0", "fixed"))))
        .when(kind == 3, F.array(F.array(event("0", "introduced"), event("2.5.0", "last_affected")), F.array(event("4.0.0", "introduced")))).otherwise(F.array(F.array(event("9.0.0", "fixed"))))
    )
    known = part.select((k % 6).alias("e"), "p_type").distinct()
    adv = known.select(F.concat(F.lit("adv-"), _s("e"), F.lit("-"), "p_type").alias("advisory"), F.element_at(F.array(*map(F.lit, _ECOSYSTEMS)), (F.col("e") + 1).cast("int")).alias("ecosystem"), F.lower("p_type").alias("package"), F.lit(None).cast("array<string>").alias("versions"), ranges.alias("ranges"), F.lit(None).cast("timestamp").alias("withdrawn"))
    return advisories.match(rows, adv).select("identity", "advisory", "status", "fix", "invalid")


@_query("""select o_orderkey, o_orderkey % 2 = 0 and not (o_orderkey % 3 = 0 and o_orderkey % 5 = 0) and not (o_custkey % 4 = 0 and o_orderkey % 3 = 0) valid from orders""")
def range_validity(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    event = lambda b, kind, when: F.when(when, F.struct(F.lit(b).alias("boundary"), F.lit(kind).alias("kind")))
    events = F.array_compact(F.array(event("1", "introduced", o % 2 == 0), event("2", "fixed", o % 3 == 0), event("3", "last_affected", o % 5 == 0), event("2", "introduced", c % 4 == 0), event("9", "limit", c % 2 == 0)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.when((o % 2 != 0) & (c % 4 == 0), F.lit(False)).otherwise(versions.valid_events(events)).alias("valid"))


# ---- graphs


@_query("""with recursive e as (select p_partkey s, p_partkey * 2 t from part union all select p_partkey, p_partkey + 7 from part), n as (select p_partkey k from part),
r(node, fact) as (select p_partkey, p_partkey % 5 from part where p_partkey <= 25 union select t, fact from r join e on e.s = r.node join n on n.k = t) select node, fact from r""")
def propagated_facts(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    edges = part.select(k.alias("source"), F.explode(F.array(k * 2, k + 7)).alias("target")).join(part.select(k.alias("target")), "target", "left_semi")
    out, settled = graph.fixpoint(edges, part.where(k <= 25).select(k.alias("node"), (k % 5).alias("fact")), rounds=5000)
    assert settled
    return out


@_query("""with recursive r(node, distance) as (select 1::bigint, 0 union all select p_partkey, distance + 1 from r join part on p_partkey in (2 * node, 2 * node + 1)) select node, distance::bigint distance, case when node > 1 then node // 2 end before from r""")
def first_paths(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    edges = part.select((F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_partkey").alias("child")).where("parent >= 1")
    return graph.first_paths(edges, part.where("p_partkey = 1").select(F.col("p_partkey").alias("node"))).select("node", F.col("distance").cast("long").alias("distance"), "before")
