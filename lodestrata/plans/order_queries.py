"""Queries that order, sum up and walk whole tables: places, levels, paths, conflicts and bindings by specifier text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import binding, constraints, graph, inventory, ranking, selection

from .driver_queries import _query, _t


def _s(c):
    return c.cast("string")


@_query("select l_orderkey, l_linenumber, row_number() over (order by l_shipdate desc, l_orderkey, l_linenumber) place from lineitem")
def global_places(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ranking.ranked(rows, [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@_query("""select l_orderkey, l_linenumber, place, true truncated from (select *, cast(row_number() over (order by l_extendedprice, l_orderkey, l_linenumber) as integer) place from lineitem)
where place > 5000 and place <= 5500""")
def deep_page(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return inventory.page(rows, ["l_extendedprice", "l_orderkey", "l_linenumber"], 500, 5000).drop("l_extendedprice")


@_query("select o_orderkey, sum(o_orderkey % 11 - 5) over (partition by o_orderpriority order by o_orderdate, o_orderkey rows unbounded preceding) running from orders")
def running_totals(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", (F.col("o_orderkey") % 11 - 5).alias("v"))
    return ranking.running_sum(rows, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "v").select("o_orderkey", "running")


def _chain(spark, sf_dir):
    """Orders as calls: each waits for its customer's previous one; of some customers the first waits for the last, so all of these go round."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderkey", 2).over(w).alias("second"))
    last = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.min("o_orderkey").alias("first")).where("o_custkey % 9 = 4 and last > first")
    previous = rows.where("before is not null").select(F.col("o_orderkey").alias("node"), F.col("before").alias("dep"))
    skipping = rows.where("second is not null and o_custkey % 8 = 0").select(F.col("o_orderkey").alias("node"), F.col("second").alias("dep"))
    return rows.select(F.col("o_orderkey").alias("node")), previous.union(skipping).union(last.select(F.col("first").alias("node"), F.col("last").alias("dep"))), previous


@_query("""select o_orderkey node, case when o_custkey % 9 = 4 and count(*) over (partition by o_custkey) > 1 then null else row_number() over (partition by o_custkey order by o_orderkey) - 1 end as level from orders""")
def order_levels(spark, sf_dir):
    nodes, edges, _ = _chain(spark, sf_dir)
    return graph.longest_levels(nodes, edges)


@_query("""with o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) i, max(o_orderkey) over (partition by o_custkey) last, count(*) over (partition by o_custkey) n from orders)
select last target, n - i step, k node from o""")
def order_paths(spark, sf_dir):
    """The way from each customer's last order back to the first, along breadth-first predecessors."""
    _, _, previous = _chain(spark, sf_dir)
    orders = _t(spark, sf_dir, "orders")
    tree = previous.select("node", F.col("dep").alias("before"))
    return graph.path_steps(tree, orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("node")))


_CONSTRAINTS = """d as (select o_custkey % 700 package, o_orderkey k, o_orderkey % 3 a, o_orderkey % 10 b, o_orderkey % 13 m, o_custkey % 700 % 6 kind, o_orderkey % 40 = 7 odd from orders)"""


@_query(f"""with {_CONSTRAINTS}, c as (select package, kind, k, case when kind = 5 and k % 4 = 0 then 'semver' when kind in (3, 4) then 'semver' else 'pep440' end scheme, a * 10 + b v, a, m, odd from d),
g as (select package, count(*) n_declarations, count(distinct scheme) ns, bool_or(odd) unknown, count(distinct case when m = 12 and not odd then scheme || ' ' || v end) pins from c group by 1),
grid as (select unnest(range(0, 160)) / 2.0 x),
f as (select package, x, bool_and(case when m = 12 then x = v when m < 4 then x >= v when m < 8 then x < v + 45 when m < 10 then case scheme when 'pep440' then x <> v else x < 50 end else x >= v and x < (a + 3) * 10 end) fits from c, grid where not odd group by 1, 2)
select package, n_declarations, case when n_declarations < 2 then false when pins > 1 then true when ns > 1 or unknown then null else not exists (select 1 from f where f.package = g.package and fits) end conflict from g""")
def constraint_conflicts(spark, sf_dir):
    """Orders as declarations of 700 packages under PEP 440, SemVer or both; the SQL tries all versions a.b and one between each two."""
    k, package = F.col("o_orderkey"), F.col("o_custkey") % 700
    kind, a, b, m = package % 6, k % 3, k % 10, k % 13
    scheme = F.when((kind == 5) & (k % 4 == 0), "semver").when(kind.isin(3, 4), "semver").otherwise("pep440")
    npm = scheme == "semver"
    at = lambda x, y: F.concat(_s(x), F.lit("."), _s(y), F.when(npm, ".0").otherwise(""))
    v = at(a, b)
    far, upper = at(F.floor((a * 10 + b + 45) / 10), (b + 5) % 10), at(a + 3, F.lit(0))
    text = (
        F.when(k % 40 == 7, "who knows").when(m == 12, F.concat(F.when(npm, "=").otherwise("=="), v)).when(m < 4, F.concat(F.lit(">="), v)).when(m < 8, F.concat(F.lit("<"), far))
        .when(m < 10, F.when(npm, F.lit("<5.0.0 || <4")).otherwise(F.concat(F.lit("!="), v))).otherwise(F.concat(F.lit(">="), v, F.when(npm, " ").otherwise(", "), F.lit("<"), upper))
    )
    rows = _t(spark, sf_dir, "orders").select(package.alias("package"), scheme.alias("scheme"), text.alias("constraint_raw"), F.lit(None).cast("string").alias("marker"))
    return constraints.conflicts(rows, ["package"])


@_query("""with d as (select o_orderkey declaration, o_custkey % 40 project_id, 'Pkg.' || o_custkey % 9 package, o_orderkey % 6 a, o_orderkey % 8 form from orders),
l as (select c_custkey record, c_custkey % 40 project_id, 'pkg-' || c_custkey % 9 package, case when c_custkey % 11 > 0 then c_custkey % 8 end x, c_custkey % 4 y from customer),
h as (select declaration, count(*) n, count(*) filter (x is null or form = 7) u, min(record) record from d join l on l.project_id = d.project_id and l.package = lower(replace(d.package, '.', '-'))
where x is null or case form when 0 then x >= a when 1 then x = a when 2 then x = a and y >= 1 when 3 then x <> a when 4 then x < a or x > a + 1 or x = a + 1 and y > 0 when 5 then x > a + 1 when 6 then true else true end group by 1)
select declaration, case when n is null then 'none' when n > 1 then 'ambiguous' when u > 0 then 'unknown' else 'bound' end outcome, case when n = 1 and u = 0 then record end record from d left join h using (declaration)""")
def lock_bindings_by_text(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    a, form = _s(o % 6), o % 8
    text = (
        F.when(form == 0, F.concat(F.lit(">="), a, F.lit(".0"))).when(form == 1, F.concat(F.lit("=="), a, F.lit(".*"))).when(form == 2, F.concat(F.lit("~="), a, F.lit(".1"))).when(form == 3, F.concat(F.lit("!="), a, F.lit(".*")))
        .when(form == 4, F.concat(F.lit("!="), a, F.lit(".*, !="), _s(o % 6 + 1), F.lit(".0"))).when(form == 5, F.concat(F.lit(">="), _s(o % 6 + 2))).when(form == 6, "").otherwise("=>1")
    )
    declared = _t(spark, sf_dir, "orders").select(o.alias("declaration"), (F.col("o_custkey") % 40).alias("project_id"), F.concat(F.lit("Pkg."), _s(F.col("o_custkey") % 9)).alias("package"), F.lit("pep440").alias("constraint_scheme"), text.alias("constraint_raw"))
    version = F.when(k % 11 > 0, F.concat(_s(k % 8), F.lit("."), _s(k % 4), F.when(k % 3 == 0, ".0").when(k % 3 == 1, "+local").otherwise(""))).otherwise("not a version")
    locks = _t(spark, sf_dir, "customer").select(k.alias("record"), (k % 40).alias("project_id"), F.concat(F.lit("pkg-"), _s(k % 9)).alias("package"), version.alias("version"))
    return binding.bind_locks_by_text(declared, locks).select("declaration", "outcome", "record")


_ENTRIES = """e as (select conv_id % 40 response, conv_id record, role list, row_number() over (partition by conv_id, role order by turn, text) - 1 place, strlen(coalesce(text, '')) + 2 n from conversations),
s as (select response, 60 base, sum(n) filter (place between 1 and 12) b12, sum(n) filter (place between 1 and 6) b6, sum(n) filter (place between 1 and 3) b3, sum(n) filter (place = 1) b1, max(place) top from e group by 1),
p as (select response, top, case when base + coalesce(b12, 0) <= 2000 then 12 when base + coalesce(b6, 0) <= 2000 then 6 when base + coalesce(b3, 0) <= 2000 then 3 when base + coalesce(b1, 0) <= 2000 then 1 end page_limit,
  case when base + coalesce(b12, 0) <= 2000 then base + coalesce(b12, 0) when base + coalesce(b6, 0) <= 2000 then base + coalesce(b6, 0) when base + coalesce(b3, 0) <= 2000 then base + coalesce(b3, 0) when base + coalesce(b1, 0) <= 2000 then base + coalesce(b1, 0) end n_bytes from s)"""


def _paged(spark, sf_dir):
    """Conversations as the records of 40 responses, a list of texts for each role."""
    rows = _t(spark, sf_dir, "conversations")
    place = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn", "text")) - 1
    entries = rows.select((F.col("conv_id") % 40).alias("response"), F.col("conv_id").alias("record"), F.col("role").alias("list"), place.alias("place"), F.col("text").alias("json"))
    responses = entries.select("response", F.lit(60).alias("base_bytes")).distinct()
    return entries, selection.byte_pages(responses, entries, ["response"], 12, 1, 2000)


@_query(f"""with {_ENTRIES} select response, case when page_limit is null then 'budget-exceeded' else 'ok' end status, page_limit, cast(n_bytes as bigint) n_bytes, page_limit is null or top >= 1 + page_limit truncated, case when page_limit is null or top >= 1 + page_limit then 1 + page_limit end next_offset from p""")
def response_pages(spark, sf_dir):
    return _paged(spark, sf_dir)[1].withColumn("n_bytes", F.col("n_bytes").cast("long"))


@_query(f"with {_ENTRIES} select record, list, cast(place as integer) place from e join p using (response) where place >= 1 and place < 1 + page_limit")
def response_entries(spark, sf_dir):
    entries, pages = _paged(spark, sf_dir)
    return selection.page_entries(entries, pages, ["response"], 1).select("record", "list", "place")
