"""More operators on the driver's tables: versions, advisories, groups, lookups, reports and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.functions.text import parse_purl, purl, scope_of_path
from lodestrata.functions.versions import npm_ranges, semver_key
from lodestrata.operators import advisories, compare, constraints, graph, ranking
from lodestrata.plans import reports
from lodestrata.sources.feeds import risk_context
from lodestrata.sources.manifests import js_loads
from lodestrata.streaming.refresh import event_counts

from .driver_queries import _query, _t


def _versions(spark, sf_dir):
    """Parts as resolved npm packages: the type is the package, size and price make the version."""
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("identity"), F.lit("npm").alias("ecosystem"), F.lower("p_type").alias("package"), F.concat_ws(".", (F.col("p_size") % 5).cast("string"), F.col("p_size").cast("string"), F.lit("0")).alias("version"), "p_size")


@_query("""select cast(p_partkey as varchar) identity, 'adv-' || lower(p_type) advisory, case when p_size % 5 >= 1 and p_size % 5 < 3 then 'affected' else 'not-affected' end status,
case when p_size % 5 >= 1 and p_size % 5 < 3 then '3.0.0' end fix from part""")
def advisory_match(spark, sf_dir):
    rows = _versions(spark, sf_dir)
    event = lambda b, k: F.struct(F.lit(b).alias("boundary"), F.lit(k).alias("kind"))
    adv = rows.select("package").distinct().select(
        F.concat(F.lit("adv-"), "package").alias("advisory"), F.lit("npm").alias("ecosystem"), "package", F.lit(None).cast("array<string>").alias("versions"),
        F.array(F.array(event("3.0.0", "fixed"), event("1.0.0", "introduced"))).alias("ranges"), F.lit(None).cast("timestamp").alias("withdrawn"),
    )
    return advisories.match(rows, adv).select("identity", "advisory", "status", "fix")


@_query("""select identity, case when a then 'matched' else 'not-matched-in-supplied-records' end status from (select cast(p_partkey as varchar) identity, p_size % 5 in (1, 2) a from part)""")
def advisory_status(spark, sf_dir):
    return advisories.observe(_versions(spark, sf_dir), advisory_match(spark, sf_dir))


@_query("select p_partkey, cast(dense_rank() over (order by p_size % 5, p_size) as bigint) rank from part")
def version_order(spark, sf_dir):
    rows = _versions(spark, sf_dir).select(F.col("identity").cast("long").alias("p_partkey"), semver_key(F.col("version")).alias("key"))
    return ranking.dense_ranked(rows, "key").select("p_partkey", "rank")


@_query("""with c as (select p_brand, p_size % 4 m from part group by all) select 'p' project_id, 'npm' ecosystem, p_brand package, count(*) n_declarations,
count(distinct m) filter (m <> 3) > 1 conflict from c group by p_brand""")
def semver_conflict(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 4).alias("m")).distinct()
    text = F.when(F.col("m") == 3, ">=0.0.1").otherwise(F.concat(F.lit("^"), (F.col("m") + 1).cast("string"), F.lit(".2.0")))
    decl = rows.select(F.lit("p").alias("project_id"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("package"), text.alias("constraint_raw"))
    return constraints.semver_conflicts(decl)


@_query("""select p_partkey, case p_size % 6 when 0 then '1.0.0' when 1 then '0.' || p_size || '.0' when 2 then p_size || '.1.0' when 3 then null when 4 then p_size || '.0.0' else p_size || '.2.3' end lo,
case p_size % 6 when 0 then '2.0.0' when 1 then '0.' || (p_size + 1) || '.0' when 2 then p_size || '.2.0' when 3 then p_size || '.0.0' when 4 then (p_size + 1) || '.0.0' else p_size || '.2.3' end hi from part""")
def npm_range_bounds(spark, sf_dir):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 6 == 0, "^1").when(F.col("p_size") % 6 == 1, F.concat(F.lit("^0."), s)).when(F.col("p_size") % 6 == 2, F.concat(F.lit("~"), s, F.lit(".1"))).when(F.col("p_size") % 6 == 3, F.concat(F.lit("<"), s)).when(F.col("p_size") % 6 == 4, F.concat(s, F.lit(".x"))).otherwise(F.concat(s, F.lit(".2.3")))
    distinct = _t(spark, sf_dir, "part").select("p_size").distinct().withColumn("r", npm_ranges(text))
    return _t(spark, sf_dir, "part").join(distinct, "p_size").select("p_partkey", F.col("r")[0]["lo"].alias("lo"), F.col("r")[0]["hi"].alias("hi"))


@_query("""with k as (select o_orderkey, o_custkey from orders where o_totalprice > 200000) select cast(o_orderkey as varchar) node, cast(min(o_orderkey) over (partition by o_custkey) as varchar) root from k
qualify count(*) over (partition by o_custkey) > 1""")
def alias_group_roots(spark, sf_dir):
    # neighbours in a customer's order chain are aliases; text is padded so that its order is the number's
    rows = _t(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey", F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("a"))
    pairs = rows.withColumn("b", F.lead("a").over(W.partitionBy("o_custkey").orderBy("a"))).where("b is not null")
    plain = lambda c: F.col(c).cast("long").cast("string").alias(c)
    return graph.alias_groups(pairs).select(plain("node"), plain("root"))


@_query("""select c_custkey, c_mktsegment reference, case when c_nationkey < 5 then 'n' || c_nationkey when c_mktsegment like 'A%' then 'seg' end package, case when c_nationkey < 5 then 'configured' when c_mktsegment like 'A%' then 'inferred' else 'unknown' end mapping_confidence from customer""")
def priority_mapping(spark, sf_dir):
    known = _t(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("package"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("reference"))
    return constraints.priority_lookup(rows, "c_nationkey", [("configured", known)], F.when(F.col("reference").startswith("A"), "seg")).drop("c_nationkey")


def _value_diff(events, old, new):
    def maps(side):
        rows = events.where(side).groupBy((F.col("user_id") % 50).alias("id"), "event_type").agg(F.max("value").alias("v"))
        return rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))

    return compare.map_diff(maps(old), maps(new), "id", "m")


@_query("""with e as (select user_id % 50 id, event_type k, value v, coalesce(ts < timestamp '2024-01-16', false) before from events), x as (select id, k, max(v) v from e where before group by all), y as (select id, k, max(v) v from e where not before group by all)
select coalesce(x.id, y.id) id, coalesce(x.k, y.k) key, x.v old, y.v as new, case when x.v is null then 'added' when y.v is null then 'removed' else 'changed' end change from x full join y on x.id = y.id and x.k = y.k where x.v is distinct from y.v""")
def metadata_diff(spark, sf_dir):
    before = F.coalesce(F.col("ts") < F.expr("timestamp '2024-01-16'"), F.lit(False))
    return _value_diff(_t(spark, sf_dir, "events"), before, ~before)


@_query("""select '{"ruleId":"' || o_orderstatus || '","level":"' || case when o_totalprice > 300000 then 'error' when o_totalprice > 100000 then 'warning' else 'note' end || '","message":{"text":"order ' || o_orderkey || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"o/' || o_custkey || '"},"region":{"startLine":' || (o_orderkey % 90 + 1) || '}}}]}' result from orders""")
def sarif_report(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("code"), F.when(F.col("o_totalprice") > 300000, "error").when(F.col("o_totalprice") > 100000, "warning").otherwise("info").alias("severity"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"), F.concat(F.lit("o/"), F.col("o_custkey").cast("string")).alias("path"), (F.col("o_orderkey") % 90 + 1).alias("line"))
    return reports.sarif_results(rows)


@_query("""select 'pkg:npm/' || p_partkey || '@' || p_size purl, 'npm' as type, cast(p_partkey as varchar) as name, cast(p_size as varchar) as version from part""")
def package_urls(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(purl(F.lit("NPM"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("purl"))
    return rows.withColumn("p", parse_purl(F.col("purl"))).select("purl", "p.type", "p.name", "p.version")


@_query("""select page_id, case when regexp_matches(url, '/(test|tests)/') then 'test' when regexp_matches(url, '/(docs|tools|scripts|examples|benchmarks)(/|$)') then 'development' else 'runtime' end scope from pages""")
def path_scopes(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", scope_of_path(F.col("url")).alias("scope"))


@_query("""select d.doc_id identity, case when l.doc_id is null then 'not-listed' else 'listed' end kev_status, cast(e.quality as double) / 2 epss from documents d left join (select * from labels where toxic = 1) l on d.doc_id = l.doc_id left join labels e on d.doc_id = e.doc_id""")
def risk_feed_context(spark, sf_dir):
    marks = _t(spark, sf_dir, "labels")
    listed = marks.where("toxic = 1").select(F.col("doc_id").alias("cve"), F.lit(None).cast("date").alias("date_added"))
    scores = marks.select(F.col("doc_id").alias("cve"), (F.col("quality") / 2).alias("score"), F.lit(None).cast("double").alias("percentile"))
    refs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("identity"), F.col("doc_id").alias("cve"))
    return risk_context(refs, listed, scores).select("identity", "kev_status", "epss")


@_query("""select c_nationkey project_id, bool_and(c_acctbal > -900) and c_nationkey not in (select s_nationkey from supplier where s_acctbal < -800) complete from customer group by c_nationkey""")
def evidence_completeness(spark, sf_dir):
    caps = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), F.when(F.col("c_acctbal") > -900, "complete").otherwise("incomplete").alias("state"))
    bad = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"), F.when(F.col("s_acctbal") < -800, "error").otherwise("warning").alias("severity"))
    return reports.completeness(caps, bad)


@_query("""select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) as value from events group by all""")
def hourly_events(spark, sf_dir):
    """An extension: the reference has no windows."""
    return event_counts(_t(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@_query("""select o_orderstatus code, count(*) n, case when max(o_totalprice) > 300000 then 'error' else 'info' end severity from orders group by 1""")
def finding_counts(spark, sf_dir):
    return reports.finding_counts(_t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("code"), F.when(F.col("o_totalprice") > 300000, "error").otherwise("info").alias("severity")))


@_query("""select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) reference from pages""")
def module_loads(spark, sf_dir):
    """Links written as JavaScript loads, then read by the source scanner."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    files = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("require('"), x, F.lit("');"))), "\n").alias("text"))
    return js_loads(files).select(F.col("path").cast("long").alias("page_id"), "reference")
