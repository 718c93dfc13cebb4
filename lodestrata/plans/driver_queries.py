"""The operators applied to the driver's tables, each with the SQL that must give the same rows.

Adapters rename the tables' columns to evidence columns: customers are projects, orders declarations,
lineitems usages, parts packages. Every query reads whole tables; conditions on values only say which rows play which part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import literal_references, redact
from lodestrata.operators import compare, evidence, graph, inventory, lookup

QUERIES, ORACLE = {}, {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _declarations(spark, sf_dir):
    """Orders as declarations: scope from the status, kind from the priority."""
    scope = F.when(F.col("o_orderstatus") == "F", "runtime").when(F.col("o_orderstatus") == "O", "test").otherwise("build")
    return _t(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 97).alias("project_id"), F.lit("npm").alias("ecosystem"), F.col("o_custkey").cast("string").alias("package"), scope.alias("scope"),
        F.when(F.col("o_orderpriority").startswith("1"), "conditional").otherwise("direct").alias("kind"), F.col("o_orderkey").cast("string").alias("source_path"),
        F.lit("semver").alias("constraint_scheme"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("group_name"),
    )


_DECLARATIONS = """d as (select o_orderkey % 97 project_id, 'npm' ecosystem, cast(o_custkey as varchar) package,
  case o_orderstatus when 'F' then 'runtime' when 'O' then 'test' else 'build' end scope, case when o_orderpriority like '1%' then 'conditional' else 'direct' end kind,
  cast(o_orderkey as varchar) source_path, o_totalprice price, o_orderpriority group_name from orders)"""


def _usages(spark, sf_dir):
    """Lineitems as usages of the order's customer; scope from the return flag, kind from the line status."""
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    scope = F.when(F.col("l_returnflag") == "R", "build").when(F.col("l_returnflag") == "A", "test").otherwise("runtime")
    return rows.select(
        (F.col("l_orderkey") % 89).alias("project_id"), F.lit("npm").alias("ecosystem"), F.col("o_custkey").cast("string").alias("package"), scope.alias("scope"),
        F.when(F.col("l_linestatus") == "F", "optional").otherwise("regular").alias("kind"), F.lit("exact").alias("mapping_confidence"), (F.col("l_suppkey") % 7).cast("string").alias("source_path"),
    )


_USAGES = """u as (select l_orderkey % 89 project_id, 'npm' ecosystem, cast(o_custkey as varchar) package, case l_returnflag when 'R' then 'build' when 'A' then 'test' else 'runtime' end scope,
  case when l_linestatus = 'F' then 'optional' else 'regular' end kind, cast(l_suppkey % 7 as varchar) source_path from lineitem join orders on l_orderkey = o_orderkey)"""
_ELIGIBLE = "e as (select * from d where kind in ('direct', 'conditional') and scope <> 'build')"


@_query("""with p as (select n_nationkey, lower(r_name) ecosystem from nation join region on n_regionkey = r_regionkey)
select ecosystem, count(*) n_projects, cast(coalesce(sum(c), 0) as bigint) n_customers, cast(coalesce(sum(s), 0) as bigint) n_suppliers, cast(coalesce(sum(o), 0) as bigint) n_orders
from p left join (select c_nationkey k, count(*) c from customer group by 1) c on c.k = n_nationkey
left join (select s_nationkey k, count(*) s from supplier group by 1) s on s.k = n_nationkey
left join (select c_nationkey k, count(*) o from customer join orders on c_custkey = o_custkey group by 1) o on o.k = n_nationkey group by ecosystem""")
def ecosystem_summary(spark, sf_dir):
    projects = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("project_id"), F.col("r_name").alias("ecosystem"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), "c_custkey")
    orders = customers.join(_t(spark, sf_dir, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey")).select("project_id")
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"))
    return inventory.ecosystem_summary(projects, {"customers": customers, "suppliers": suppliers, "orders": orders})


@_query(f"with {_DECLARATIONS}, {_USAGES}, {_ELIGIBLE} select project_id, ecosystem, package, count(*) n_usages, case when bool_and(kind = 'optional') then 'warning' else 'error' end severity from u where not exists (select 1 from e where e.project_id = u.project_id and e.ecosystem = u.ecosystem and e.package = u.package) group by all")
def missing_usages(spark, sf_dir):
    return evidence.missing(evidence.qualified_usages(_usages(spark, sf_dir)), evidence.eligible_declarations(_declarations(spark, sf_dir)))


_ACCEPT = """case when e.kind = 'conditional' then true when u.kind = 'optional' then e.scope <> 'build' when u.scope = 'runtime' then e.scope in ('runtime', 'peer', 'host')
  when u.scope = 'test' then e.scope in ('runtime', 'development', 'test', 'optional') when u.scope = 'build' then e.scope in ('runtime', 'development', 'build') else e.scope <> 'build' end"""


@_query(f"""with {_DECLARATIONS}, {_USAGES}, {_ELIGIBLE} select project_id, ecosystem, package, count(*) n_usages from u
where exists (select 1 from e where e.project_id = u.project_id and e.package = u.package) and not exists (select 1 from e where e.project_id = u.project_id and e.package = u.package and {_ACCEPT}) group by all""")
def scope_mismatch(spark, sf_dir):
    return evidence.scope_mismatches(evidence.qualified_usages(_usages(spark, sf_dir)), evidence.eligible_declarations(_declarations(spark, sf_dir)))


@_query("select o_orderkey % 10 project_id, 'npm' ecosystem, cast(o_orderkey as varchar) package from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def unused_declarations(spark, sf_dir):
    key = lambda c: [(F.col(c) % 10).alias("project_id"), F.lit("npm").alias("ecosystem"), F.col(c).cast("string").alias("package")]
    return evidence.unused(_t(spark, sf_dir, "orders").select(*key("o_orderkey"), F.lit("direct").alias("kind"), F.lit("runtime").alias("scope")), _t(spark, sf_dir, "lineitem").select(key("l_orderkey")))


@_query(f"with {_DECLARATIONS}, {_ELIGIBLE} select project_id, ecosystem, package, count(*) n_declarations from e d where kind = 'direct' and not exists (select 1 from orders where o_orderstatus = 'P' and o_orderkey % 97 = d.project_id and cast(o_custkey as varchar) = d.package) group by all having not bool_or(price > 250000)")
def unpinned(spark, sf_dir):
    resolved = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 97).alias("project_id"), F.lit("npm").alias("ecosystem"), F.col("o_custkey").cast("string").alias("package"))
    return evidence.unpinned(_declarations(spark, sf_dir), resolved, F.col("price") > 250000)


@_query("""select o_custkey project_id, 'npm' ecosystem, strftime(o_orderdate, '%m') package, count(distinct o_orderpriority) n_contexts, count(distinct o_orderkey) n_places from orders
group by all having count(distinct o_orderkey) >= 2 and count(distinct o_orderpriority) < count(distinct o_orderkey)""")
def duplicate_declarations(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.lit("npm").alias("ecosystem"), F.date_format("o_orderdate", "MM").alias("package"), "o_orderpriority", "o_orderkey")
    return evidence.duplicates(rows, ["o_orderpriority"], ["o_orderkey"])


_ROLL = """with d as (select p_partkey k, p_name n from part where p_size > 5), r as (select l_partkey k, p_name n, l_returnflag v from lineitem join part on l_partkey = p_partkey where l_discount > 0.05),
u as (select l_partkey k, l_linestatus s from lineitem where l_quantity > 25),
x as (select k, 1 tag, n, null v, null s from d union all select k, 2, n, v, null from r union all select k, 3, null, null, s from u)
select 'parts' project_id, 'npm' ecosystem, cast(k as varchar) package, max(n) display_name, coalesce(string_agg(distinct v, ',' order by v), '') versions, bool_or(tag = 1) declared, bool_or(tag = 3 and coalesce(s, '') <> 'tool') imported,
count(*) filter (tag = 3) n_usages, case when count(distinct v) = 1 then max(v) end resolved_version from x group by k"""


def _inventory(spark, sf_dir):
    part, line = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem")
    key = lambda c: [F.lit("parts").alias("project_id"), F.lit("npm").alias("ecosystem"), F.col(c).cast("string").alias("package")]
    declared = part.where("p_size > 5").select(*key("p_partkey"), F.col("p_name").alias("display_name"))
    resolved = line.where("l_discount > 0.05").join(part, F.col("l_partkey") == F.col("p_partkey")).select(*key("l_partkey"), F.col("p_name").alias("display_name"), F.col("l_returnflag").alias("version"))
    used = line.where("l_quantity > 25").select(*key("l_partkey"), F.lit(None).cast("string").alias("display_name"), F.col("l_linestatus").alias("kind"))
    return inventory.roll_up(declared, resolved, used)


@_query(_ROLL)
def inventory_rollup(spark, sf_dir):
    return _inventory(spark, sf_dir).withColumn("versions", F.array_join("versions", ","))


@_query(f"select package, display_name, n_usages from ({_ROLL}) where contains(lower(coalesce(display_name, '')), 'gear') order by package limit 50 offset 20")
def inventory_search_page(spark, sf_dir):
    return inventory.page(inventory.search(_inventory(spark, sf_dir), "gear", ["display_name"]), ["package"], 50, 20).select("package", "display_name", "n_usages")


@_query("""with y as (select l_partkey, year(l_shipdate) yr, row_number() over (partition by l_partkey, year(l_shipdate) order by l_orderkey, l_linenumber) occurrence from lineitem),
o as (select l_partkey, occurrence from y where yr = 1995), n as (select l_partkey, occurrence from y where yr = 1996)
select *, 'added' change from (select * from n except select * from o) union all select *, 'removed' change from (select * from o except select * from n)""")
def snapshot_diff(spark, sf_dir):
    rows = compare.occurrences(_t(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("yr"), "l_orderkey", "l_linenumber"), ["l_partkey", "yr"], ["l_orderkey", "l_linenumber"])
    return compare.snapshot_diff(rows.where("yr = 1995"), rows.where("yr = 1996"), ["l_partkey", "occurrence"])


@_query("""with l as (select p_type, count(*) n from part where p_size <= 25 group by 1), r as (select p_type, count(*) n from part where p_size > 25 group by 1)
select coalesce(l.p_type, r.p_type) p_type, coalesce(l.n, 0) n_left, coalesce(r.n, 0) n_right, least(coalesce(l.n, 0), coalesce(r.n, 0)) matched, greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0) left_only, greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0) right_only
from l full join r on l.p_type = r.p_type""")
def inventory_multiset_compare(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return compare.multiset_compare(part.where("p_size <= 25"), part.where("p_size > 25"), ["p_type"])


@_query("""with o as (select o_orderkey % 5000 path, sha256(string_agg(cast(o_custkey as varchar), ',' order by o_orderkey)) digest from orders where year(o_orderdate) < 1996 group by 1),
n as (select o_orderkey % 5000 path, sha256(string_agg(cast(o_custkey as varchar), ',' order by o_orderkey)) digest from orders where year(o_orderdate) between 1995 and 1997 group by 1)
select coalesce(o.path, n.path) path, case when o.path is null then 'added' when n.path is null then 'removed' else 'modified' end status from o full join n on o.path = n.path where o.digest is distinct from n.digest""")
def input_changes(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("path"), "o_orderkey", F.col("o_custkey").cast("string").alias("c"), F.year("o_orderdate").alias("y"))

    def digest(df):
        return compare.ordered_digest(df, ["path"], ["o_orderkey"], F.col("c"), ",")

    return compare.input_changes(digest(rows.where("y < 1996")), digest(rows.where("y between 1995 and 1997")))


@_query("""with r as (select p_type, min(p_size) + 3 lo, max(p_size) - 3 hi from part group by p_type)
select p_partkey, p.p_type, p_size, cast(lo as bigint) lo, cast(hi as bigint) hi from part p join r on p.p_type = r.p_type and p_size >= lo and p_size < hi""")
def version_range_match(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    ranges = part.groupBy("p_type").agg((F.min("p_size") + 3).cast("long").alias("lo"), F.lit(True).alias("lo_inclusive"), (F.max("p_size") - 3).cast("long").alias("hi"), F.lit(False).alias("hi_inclusive"))
    return lookup.in_ranges(part.select("p_partkey", "p_type", "p_size"), ranges, ["p_type"], "p_size").select("p_partkey", "p_type", "p_size", "lo", "hi")


def _event_states(e):
    """``(user_id, affected, n_events)``: the state after a user's views (introduced) and purchases (fixed) in order, as
    ``event_state`` folds them; the last event alone decides, so no user's events are gathered."""
    kind = F.when(F.col("event_type") == "view", "introduced").when(F.col("event_type") == "purchase", "fixed")
    reached = F.col("event_id").isNull() | (F.col("event_id") <= F.lit(2**62))
    rows = e.select("user_id", "event_id", kind.alias("kind"), (reached & kind.isNotNull()).alias("counts"))
    last = F.max(F.when(F.col("counts"), F.struct(F.col("event_id").alias("boundary"), "kind")))
    return rows.groupBy("user_id").agg(F.coalesce(last["kind"] == "introduced", F.lit(False)).alias("affected"), F.count("kind").alias("n_events"))


@_query("""with e as (select user_id, event_id, case event_type when 'view' then 1 when 'purchase' then 0 end state from events)
select user_id, coalesce(arg_max(state, event_id) filter (state is not null) = 1, false) affected, count(state) n_events from e group by user_id""")
def event_state_fold(spark, sf_dir):
    return _event_states(_t(spark, sf_dir, "events"))


@_query("""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path from pages), o as (select distinct regexp_extract(path, '^[^/]+', 0) root from p union select distinct regexp_extract(path, '^[^/]+/[^/]+', 0) from p where path like '%/en/%'),
h as (select page_id, path, max(length(root)) n from p join o on path = root or starts_with(path, root || '/') where root <> '' group by all) select page_id, path, left(path, n) root from h""")
def longest_prefix_owner(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("path"))
    roots = pages.select(F.regexp_extract("path", "^[^/]+", 0).alias("root")).union(pages.where(F.col("path").contains("/en/")).select(F.regexp_extract("path", "^[^/]+/[^/]+", 0))).where("root <> ''").distinct()
    return lookup.longest_prefix(pages, "path", roots, "root").where("root is not null")


@_query("""with a as (select distinct lower(w) as name from (select unnest(string_split(p_name, ' ')) w from part) where w <> '' union select distinct lower(n_name) from nation),
n as (select distinct o_clerk near from (select lower(replace(p_type, ' ', '')) o_clerk from part union select distinct lower(w) || 's' from (select unnest(string_split(p_name, ' ')) w from part) where w <> '' union select distinct substr(lower(w), 2) from (select unnest(string_split(p_name, ' ')) w from part) where length(w) > 1))
select name, near, case when length(name) = length(near) then 'substitution' when length(name) < length(near) then 'deletion' else 'insertion' end mechanism from a, n where name <> near and levenshtein(name, near) = 1""")
def name_typo_pairs(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).where("name <> ''").distinct()
    names = words.union(_t(spark, sf_dir, "nation").select(F.lower("n_name"))).distinct()
    known = part.select(F.lower(F.regexp_replace("p_type", " ", "")).alias("near")).union(words.select(F.concat("name", F.lit("s")))).union(words.where("length(name) > 1").select(F.expr("substring(name, 2)"))).distinct()
    return lookup.typo_pairs(names, known).where("mechanism <> 'transposition'")


@_query(r"""select doc_id, regexp_replace(regexp_replace(text, '(https?://)[^/\s:@]+:[^/\s@]+@', '\1***@', 'g'), '(?i)\b(token|password|secret|api_key)(\s*[=:]\s*)[^\s,;]+', '\1\2***', 'g') as text from documents where text is not null""")
def redact_secrets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", redact(F.col("text")).alias("text"))


@_query("""select page_id, u ref, count(*) n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) u from pages) group by all""")
def literal_references_count(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(literal_references(F.col("html"))).alias("ref")).groupBy("page_id", "ref").agg(F.count("*").alias("n"))


def _part_paths(part, targets):
    edges = part.select((F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_partkey").alias("child")).where("parent >= 1")
    out = graph.reverse_paths(edges, part.where(targets).select(F.col("p_partkey").alias("node")), 30)
    return out.select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.col("length").cast("long").alias("length"), "rooted")


@_query("""with recursive e as (select p_partkey child, p_partkey // 2 parent from part where p_partkey // 2 >= 1),
w(node, path, len) as (select p_partkey, cast(p_partkey as varchar), 0 from part union all select parent, path || '/' || cast(parent as varchar), len + 1 from w join e on node = child)
select path, cast(len as bigint) length, not exists (select 1 from e where child = node) rooted from w""")
def reverse_paths(spark, sf_dir):
    return _part_paths(_t(spark, sf_dir, "part"), "true")


@_query("select o_orderstatus code, count(*) n, max(left(o_orderpriority, 1)) severity_rank, arg_max(o_orderpriority, left(o_orderpriority, 1)) severity from orders group by 1")
def rule_severity_max(spark, sf_dir):
    rank = F.substring("o_orderpriority", 1, 1)
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"), F.max(rank).alias("severity_rank"), F.max_by("o_orderpriority", rank).alias("severity"))


@_query("""with r(ord, pri, st, price) as (values (0, '1-URGENT', null, 200000.0), (1, null, 'F', 150000.0), (2, '5-LOW', null, 0.0), (3, null, null, 300000.0))
select o_orderkey, cast(min(ord) as integer) ord from orders, r where (pri is null or pri = o_orderpriority) and (st is null or st = o_orderstatus) and o_totalprice >= price group by 1""")
def policy_first_match(spark, sf_dir):
    price = lambda least: F.col("o_totalprice") >= least
    rules = [(0, (F.col("o_orderpriority") == "1-URGENT") & price(200000.0)), (1, (F.col("o_orderstatus") == "F") & price(150000.0)), (2, (F.col("o_orderpriority") == "5-LOW") & price(0.0)), (3, price(300000.0))]
    return _t(spark, sf_dir, "orders").select("o_orderkey", lookup.first_rule(rules).alias("ord")).where("ord is not null")


@_query(f"""with {_USAGES}, s as (select project_id, ecosystem, package, scope, count(*) n from u group by all),
f as (select project_id, ecosystem, package, string_agg(distinct source_path, ',' order by source_path) files from u group by all)
select project_id, ecosystem, package, cast(sum(n) as bigint) n_usages, any_value(files) files, string_agg(scope || '=' || cast(n as varchar), ',' order by scope) scopes from s join f using (project_id, ecosystem, package) group by all""")
def impact_histogram(spark, sf_dir):
    out = inventory.impact(_usages(spark, sf_dir))
    return out.select(*evidence.KEY, "n_usages", F.array_join("files", ",").alias("files"), F.array_join(F.transform("scopes", lambda s: F.concat(s["scope"], F.lit("="), s["n"].cast("string"))), ",").alias("scopes"))


@_query("select distinct user_id from events where event_type = 'error'")
def error_projects(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_type = 'error'").select("user_id").distinct()


@_query("select d.doc_id, case when l.doc_id is null then 'not-listed' else 'listed' end status, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
def left_join_status(spark, sf_dir):
    marks = _t(spark, sf_dir, "labels").withColumn("listed", F.lit(True))
    return _t(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left").select("doc_id", F.when(F.col("listed"), "listed").otherwise("not-listed").alias("status"), "quality", "toxic")


@_query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) occurrence from lineitem")
def occurrence_number(spark, sf_dir):
    return compare.occurrences(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).withColumn("occurrence", F.col("occurrence").cast("long"))


@_query("select package, version, row_number() over (partition by package order by version) round from (select distinct p_brand package, p_size as version from part)")
def coordinate_batches(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_size").alias("version"))
    return inventory.batches(rows).select("package", "version", F.col("round").cast("long").alias("round"))


@_query("select n_regionkey, sha256(string_agg(cast(n_nationkey as varchar) || '|' || n_name, chr(10) order by n_nationkey)) digest from nation group by 1")
def state_digest(spark, sf_dir):
    return compare.state_digest(_t(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])


@_query("""with recursive r(node, distance) as (select p_partkey, 0 from part where p_partkey = 1 union all select p_partkey, distance + 1 from r join part on p_partkey in (2 * node, 2 * node + 1)) select node, cast(distance as bigint) distance from r""")
def reachable_nodes(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    edges = part.select((F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_partkey").alias("child")).where("parent >= 1")
    return graph.reachable(edges, part.where("p_partkey = 1").select(F.col("p_partkey").alias("node"))).select("node", F.col("distance").cast("long").alias("distance"))


def _candidates(spark, sf_dir, nations, by):
    nation = _t(spark, sf_dir, "nation").where(nations).select((F.col("n_nationkey") % by).alias("k"), "n_name")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % by).alias("sk"))
    return lookup.unique_match(supplier, nation, F.col("sk") == F.col("k"), ["s_suppkey"], "n_name").select("s_suppkey", F.col("n_candidates").cast("long").alias("n_candidates"), "n_name")


# of 25 nations by their number's rest of 13, one is alone and the others are in pairs
@_query("""select s_suppkey, count(n_name) n_candidates, case when count(n_name) = 1 then max(n_name) end n_name from supplier left join (select n_nationkey % 13 k, n_name from nation) on k = s_nationkey % 13 group by 1""")
def unique_candidate(spark, sf_dir):
    return _candidates(spark, sf_dir, "true", 13)


@_query("""select c_custkey, c_acctbal, c_mktsegment, cast(row_number() over (order by c_acctbal desc, c_custkey) as integer) place from customer order by c_acctbal desc, c_custkey limit 100""")
def findings_page(spark, sf_dir):
    return inventory.page(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), [F.col("c_acctbal").desc(), "c_custkey"], 100).drop("truncated")
