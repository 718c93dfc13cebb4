"""The finding rules on the driver's tables; the SQL is written from the rules, not from the operators.

Customers are packages of 53 projects in four ecosystems, orders their declarations and resolved versions, lineitems usages
of packages, customers' rows also capabilities. Kinds, scopes, markers and constraints come from keys, so that every rule
has rows on either side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import evidence, inventory

from .driver_queries import _query, _t

_ECO = "case {k} % 4 when 0 then 'npm' when 1 then 'Go' when 2 then 'Maven' else 'PyPI' end"
_DECLARED = f"""select o_custkey % 53 project_id, {_ECO.format(k='o_custkey')} ecosystem, cast(o_custkey as string) package,
case o_orderkey % 5 when 0 then 'runtime' when 1 then 'test' when 2 then 'build' when 3 then 'development' else 'peer' end scope,
case substring(o_orderpriority, 1, 1) when '1' then 'conditional' when '2' then 'transitive' when '3' then 'environment' else 'direct' end kind,
case when o_orderkey % 2 = 0 then 'require' else 'replace' end go_kind,
case when o_custkey % 4 = 2 then case o_orderkey % 3 when 0 then 'profile-dependency' when 1 then 'dependency' else 'profile-management' end end maven_kind,
case o_custkey % 4 when 0 then 'SemVer' when 1 then 'go' when 2 then 'maven' else 'PEP440' end constraint_scheme,
case o_orderkey % 7 when 0 then '' when 1 then '${{v}}' else concat('1.', cast(o_orderkey % 10 as string)) end constraint_raw,
concat('g', cast(o_orderkey % 3 as string)) group_name, case when o_orderkey % 4 = 0 then 'm' end marker,
concat('d', cast(o_orderkey % 2 as string), case when o_orderkey % 6 = 0 then '/pyproject.toml' else '/requirements.txt' end) source_path, o_orderkey % 3 line_no,
o_totalprice price, o_orderstatus status from orders"""
_K = "(o_custkey * 2 + case when o_custkey % 3 = 0 then 1 else 0 end)"
_USED = f"""select {_K} % 53 project_id, {_ECO.format(k=_K)} ecosystem, case when l_linenumber = 7 and {_K} % 53 % 2 = 1 then null else cast({_K} as string) end package,
case l_returnflag when 'R' then 'build' when 'A' then 'test' else 'runtime' end scope, case when l_linenumber = 4 then 'environment-command' when l_linestatus = 'F' then 'optional' else 'regular' end kind,
case when l_linenumber = 7 and {_K} % 53 % 2 = 1 then 'unknown' when l_linenumber = 6 then 'inferred' when l_linenumber = 5 then 'configured' else 'exact' end mapping_confidence
from lineitem join orders on l_orderkey = o_orderkey"""
_CAPABLE = """select c_custkey % 53 project_id, case c_custkey % 3 when 0 then 'manifest' when 1 then 'usage' else 'mapping' end as name,
case when c_custkey % 53 % 9 = 0 and c_acctbal < 0 then 'partial' else 'complete' end state from customer"""
_BASE = f"""d0 as ({_DECLARED}), d as (select project_id, lower(ecosystem) eco, * exclude (project_id) from d0),
u0 as ({_USED}), u as (select project_id, lower(ecosystem) eco, * exclude (project_id) from u0), cap as ({_CAPABLE}),
ok as (select * from d where (kind in ('direct', 'conditional') or eco = 'go' and kind = 'transitive' and go_kind = 'require') and scope <> 'build' and (maven_kind is null or maven_kind = 'dependency')),
direct as (select * from ok where kind = 'direct'),
elsewhere as (select project_id, eco, package, bool_or(maven_kind = 'profile-dependency') profile, bool_or(kind = 'environment') environment from d anti join ok using (project_id, eco, package) group by all),
q as (select * from u where package is not null and mapping_confidence in ('exact', 'configured') and kind <> 'environment-command'),
doubtful as (select distinct project_id from cap where name = 'manifest' and state <> 'complete'),
blind as (select project_id from doubtful union select project_id from cap where name in ('usage', 'mapping') and state <> 'complete' union select project_id from u where mapping_confidence = 'unknown'),
seen as (select * from q where not exists (select 1 from elsewhere e where e.project_id = q.project_id and e.eco = q.eco and e.package = q.package and (e.profile or e.environment)))"""


def _rows(spark, sf_dir, sql):
    for name in ("orders", "lineitem", "customer"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql.replace("'${", "'$' || '{"))  # Spark would put a session variable for ${v}, here nothing


def _relations(spark, sf_dir):
    declared = _rows(spark, sf_dir, _DECLARED).withColumnsRenamed({"group_name": "group", "line_no": "line"})
    resolved = declared.select(*evidence.KEY, F.when(F.col("status") == "P", "1").alias("version"))
    return declared, _rows(spark, sf_dir, _USED), resolved, _rows(spark, sf_dir, _CAPABLE)


def _duck(sql):
    return sql.replace("as string)", "as varchar)")


@_query(_duck(f"""with {_BASE}
select project_id, eco ecosystem, package, 'dependency.missing' code, case when bool_and(kind = 'optional') then 'warning' else 'error' end severity from seen anti join ok using (project_id, eco, package)
where project_id not in (select project_id from doubtful) group by all
union all select distinct s.project_id, s.eco, s.package, 'dependency.scope-mismatch', 'error' from seen s semi join ok using (project_id, eco, package)
where not exists (select 1 from ok o where o.project_id = s.project_id and o.eco = s.eco and o.package = s.package and case when o.kind = 'conditional' then true when s.kind = 'optional' then o.scope <> 'build'
  when s.scope = 'runtime' then o.scope in ('runtime', 'peer', 'host') when s.scope = 'test' then o.scope in ('runtime', 'development', 'test', 'optional') when s.scope = 'build' then o.scope in ('runtime', 'development', 'build') else o.scope <> 'build' end)
union all select distinct project_id, eco, package, 'dependency.unused', 'warning' from direct where project_id not in (select project_id from blind)
and not exists (select 1 from u where u.project_id = direct.project_id and u.eco = direct.eco and u.package = direct.package and (mapping_confidence = 'inferred' or mapping_confidence in ('exact', 'configured') and u.kind <> 'environment-command'))
union all select project_id, eco, package, 'dependency.unpinned', 'warning' from direct where not exists (select 1 from d r where r.status = 'P' and r.project_id = direct.project_id and r.eco = direct.eco and r.package = direct.package)
group by all having not bool_or(price > 300000) and not bool_or(eco = 'maven' and (trim(constraint_raw) = '' or contains(constraint_raw, '${{')))"""))
def dependency_findings(spark, sf_dir):
    return evidence.findings(*_relations(spark, sf_dir), F.col("price") > 300000)


@_query(_duck(f"with {_BASE} select project_id, eco ecosystem, package, 'profile' kind from elsewhere where profile union all select project_id, eco, package, 'environment' from elsewhere where environment"))
def declared_elsewhere(spark, sf_dir):
    declared = _relations(spark, sf_dir)[0]
    rows = [evidence.only_elsewhere(declared, kind).withColumn("kind", F.lit(kind)) for kind in ("profile", "environment")]
    return rows[0].unionByName(rows[1])


@_query(_duck(f"""with {_BASE} select project_id, eco ecosystem, package, package installation_name, count(distinct (scope, group_name, coalesce(marker, ''))) n_contexts,
case when eco = 'pypi' then count(distinct (source_path, line_no, scope, group_name, coalesce(marker, ''), constraint_raw)) else count(*) end n_assertions from direct group by project_id, eco, package
having count(*) >= 2 and not (eco = 'pypi' and count(distinct case when ends_with(source_path, '/pyproject.toml') then source_path end) > 1)
and count(distinct (scope, group_name, coalesce(marker, ''))) < case when eco = 'pypi' then count(distinct (source_path, line_no, scope, group_name, coalesce(marker, ''), constraint_raw)) else count(*) end"""))
def repeated_declarations(spark, sf_dir):
    return evidence.repeated_declarations(_relations(spark, sf_dir)[0])


@_query(_duck(f"""with {_BASE}, f as (select project_id, eco, package, count(*) n from seen anti join ok using (project_id, eco, package) group by all)
select d.project_id, d.ecosystem, d.package, coalesce(f.n, 0) n_usages from (select distinct project_id, ecosystem, package from d0) d left join f on f.project_id = d.project_id and f.eco = lower(d.ecosystem) and f.package = d.package"""))
def undeclared_usages_of_inventory(spark, sf_dir):
    declared, used, *_ = _relations(spark, sf_dir)
    gone = evidence.only_elsewhere(declared, "profile").unionByName(evidence.only_elsewhere(declared, "environment"))
    seen = evidence.qualified_usages(used).join(gone.distinct(), evidence.KEY, "left_anti")
    lone = evidence.missing(seen, evidence.eligible_declarations(declared))
    rows = declared.select(*evidence.KEY).distinct().withColumn("eco", F.lower("ecosystem"))
    return rows.join(lone.select("project_id", F.col("ecosystem").alias("eco"), "package", "n_usages"), ["project_id", "eco", "package"], "left").select(*evidence.KEY, F.coalesce("n_usages", F.lit(0)).alias("n_usages"))


@_query("""select c_custkey, c_mktsegment, c_nationkey from customer where lower(c_mktsegment) = 'building' and c_nationkey = 7""")
def inventory_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("ecosystem"), F.col("c_nationkey").alias("project_id"), F.col("c_custkey").cast("string").alias("package"), "c_custkey", "c_mktsegment", "c_nationkey")
    return inventory.filtered(rows, ecosystem="building", project="7").select("c_custkey", "c_mktsegment", "c_nationkey")


@_query("""with inv as (select n_nationkey project_id, r_name ecosystem, n_name package from nation join region on n_regionkey = r_regionkey union all select 100 + s_suppkey, 'S', 'pkg' || (s_suppkey % 50 + s_suppkey % 3 * 1000) from supplier),
req as (select c_custkey request, 'pkg' || (c_custkey % 2100) package from customer union all select 1000000 + n_nationkey, n_name from nation)
select request, req.package, case count(inv.ecosystem) when 0 then 'not-found' when 1 then 'found' else 'ambiguous' end outcome, count(inv.ecosystem) n,
case when count(inv.ecosystem) = 1 then min(project_id) end project_id, case when count(inv.ecosystem) = 1 then min(inv.ecosystem) end ecosystem from req left join inv on inv.package = req.package group by request, req.package""")
def explain_packages(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("r_name").alias("ecosystem"), F.col("n_name").alias("package"))
    supplier = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).alias("project_id"), F.lit("S").alias("ecosystem"), F.concat(F.lit("pkg"), (F.col("s_suppkey") % 50 + F.col("s_suppkey") % 3 * 1000).cast("string")).alias("package"))
    requests = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.concat(F.lit("pkg"), (F.col("c_custkey") % 2100).cast("string")).alias("package")).union(_t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000000).cast("long"), "n_name"))
    return inventory.explain(nation.unionByName(supplier), requests)


@_query("""with inv as (select c_custkey % 40 project_id, case when c_custkey % 2 = 0 then 'PyPI' else 'npm' end ecosystem, case when c_custkey % 4 < 2 then 'Pkg_' else 'pkg-' end || c_custkey package from customer),
f as (select o_custkey % 40 project_id, case when o_custkey % 2 = 0 then 'PyPI' else 'npm' end ecosystem, 'pkg-' || o_custkey package from orders)
select project_id, ecosystem, inv.package, coalesce((select count(*) from f where f.project_id = inv.project_id and f.ecosystem = inv.ecosystem and (f.package = inv.package or inv.ecosystem = 'PyPI' and f.package = lower(replace(inv.package, '_', '-')))), 0) n_findings from inv""")
def findings_of_inventory(spark, sf_dir):
    eco = lambda c: F.when(F.col(c) % 2 == 0, "PyPI").otherwise("npm").alias("ecosystem")
    inv = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("project_id"), eco("c_custkey"), F.concat(F.when(F.col("c_custkey") % 4 < 2, "Pkg_").otherwise("pkg-"), F.col("c_custkey").cast("string")).alias("package"))
    found = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("project_id"), eco("o_custkey"), F.concat(F.lit("pkg-"), F.col("o_custkey").cast("string")).alias("package"))
    return inventory.with_findings(inv, found)


@_query("""select 'nation' as "table", cast(row_number() over (order by n_nationkey) as integer) place, cast(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}) as varchar) as row, (select count(*) from nation) total from nation qualify place between 3 and 7
union all select 'region', cast(row_number() over (order by r_name desc) as integer) place, cast(to_json({'r_name': r_name, 'r_regionkey': r_regionkey}) as varchar), (select count(*) from region) from region qualify place between 3 and 7""")
def shared_page(spark, sf_dir):
    return inventory.shared_page({"nation": (_t(spark, sf_dir, "nation"), ["n_nationkey"]), "region": (_t(spark, sf_dir, "region"), [F.col("r_name").desc()])}, 5, 2)


@_query("""with p as (select page_id project_id, case when page_id % 9 = 0 then '.' else regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') end root from pages)
select project_id, root, row_number() over (order by case when root = '.' then 0 else length(root) - length(replace(root, '/', '')) + 1 end, root, project_id) place from p qualify place <= 40""")
def project_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("project_id"), F.when(F.col("page_id") % 9 == 0, ".").otherwise(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")).alias("root"))
    return inventory.page(rows, inventory.projects_in_order(rows), 40).select("project_id", "root", F.col("place").cast("long").alias("place"))


@_query("""with c as (select distinct p_brand package, p_size as version from part), r as (select *, row_number() over (partition by package order by version) round from c), n as (select round, count(*) n from r group by 1)
select round, cast(p as bigint) part, cast(least(4, n - 4 * p) as bigint) n from n, lateral (select unnest(range(0, (n + 3) // 4)) p)""")
def batch_sizes(spark, sf_dir):
    """Batches of four: every one but the last of a round is full."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_size").alias("version"))
    return inventory.batches(rows, 4).groupBy("round", "part").agg(F.count("*").alias("n")).select(F.col("round").cast("long").alias("round"), F.col("part").cast("long").alias("part"), "n")
