"""CMake replies of one build for each order, a target for each of its lines; the SQL works on orders and lines and never sees a reply."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.sources import cmake_model

from .driver_queries import _query, _t


def _replies(spark, sf_dir):
    """``(path, text)``: indexes (one in nine cut off, one in nine with two models), models (missing, of another version, with a repeated target) and target files."""
    orders, lines = _t(spark, sf_dir, "orders").select("o_orderkey"), _t(spark, sf_dir, "lineitem")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))  # the tables repeat numbers
    lines = lines.select("l_orderkey", place.alias("l_linenumber"), "l_partkey", "l_suppkey", "l_returnflag")
    k, form, number = F.col("o_orderkey"), F.col("o_orderkey") % 9, F.col("l_linenumber")
    home = F.concat(F.lit("b"), k.cast("string"), F.lit("/"))
    version = lambda minor: F.concat(F.lit('{"major":2,"minor":'), minor.cast("string"), F.lit("}"))
    entry = F.concat(F.lit('{"kind":"codemodel","version":'), version(k % 9 + 1), F.lit(',"jsonFile":"model.json"}'))
    index = F.concat(F.lit('{"objects":[{"kind":"cache-v2","version":{"major":2,"minor":0},"jsonFile":"c.json"},'), entry, F.when(form == 1, F.concat(F.lit(","), entry)).otherwise(""), F.when(form == 0, "").otherwise("]}"))
    indexes = orders.select(F.concat(home, F.lit("index-1.json")).alias("path"), index.alias("text"))

    own = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    file = F.when(F.col("l_partkey") % 7 == 3, F.lit("../x.json")).otherwise(F.concat(F.lit("target-"), number.cast("string"), F.lit(".json")))
    listed = F.struct(number, F.to_json(F.struct(F.concat(F.lit("t"), number.cast("string")).alias("id"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("name"), file.alias("jsonFile"))).alias("j"))
    # an order has no more lines than an order form holds; a model is one document
    lists = own.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "R", listed))).alias("t"), F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", listed))).alias("a"))
    text = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(F.transform(c, lambda x: x["j"]), F.array().cast("array<string>")), ","), F.lit("]"))
    twice = F.when((form == 4) & (F.size("t") > 0), F.concat(F.slice("t", 1, 1), F.col("t"))).otherwise(F.col("t"))
    body = F.concat(F.lit(',"targets":'), text(twice), F.lit(',"abstractTargets":'), text(F.col("a")), F.lit("}"))
    model = F.concat(F.lit('{"kind":"codemodel","version":'), version(F.when(form == 3, F.lit(0)).otherwise(k % 9 + 1)), F.lit(',"configurations":[{"name":"Debug"'), body, F.when(k % 2 == 0, F.concat(F.lit(',{"name":"Release"'), body)).otherwise(""), F.lit("]}"))
    models = orders.join(lists, "o_orderkey", "left").where(form != 2).select(F.concat(home, F.lit("model.json")).alias("path"), model.alias("text"))

    t = lambda n: F.concat(F.lit('"t'), n.cast("string"), F.lit('"'))
    target = F.concat(
        F.lit('{"id":'), t(number), F.lit(',"name":"n'), (F.col("l_suppkey") + F.when(F.col("l_partkey") % 7 == 2, 1).otherwise(0)).cast("string"), F.lit('","type":"'), F.col("l_returnflag"), F.lit('","abstract":'), F.when(F.col("l_returnflag") == "R", "true").otherwise("false"),
        F.lit(',"dependencies":[{"id":'), t(number + 1), F.when(F.col("l_suppkey") % 3 == 0, '},{"id":"gone"').otherwise(""), F.lit('}],"linkLibraries":[{"fragment":"-lm"},{"id":'), t(number + 1), F.lit(',"fromDependency":{"id":'), t(number - 1), F.lit("}}]"),
        F.when(F.col("l_partkey") % 7 == 1, "").otherwise("}"),
    )
    targets = own.where("l_partkey % 7 <> 0").select(F.concat(home, F.lit("target-"), number.cast("string"), F.lit(".json")).alias("path"), target.alias("text"))
    return indexes.unionByName(models).unionByName(targets)


_ROWS = """with o as (select o_orderkey k, o_orderkey % 9 f, 'b' || o_orderkey || '/index-1.json' as i from orders),
l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem),
c as (select *, 'Debug' as c from o where f > 3 union all select *, 'Release' from o where f > 3 and k % 2 = 0),
t as (select k, f, i, c, l_linenumber n, l_suppkey s, l_returnflag r, l_partkey % 7 d, case l_partkey % 7 when 0 then 'missing' when 1 then 'malformed' when 2 then 'disagrees' when 3 then 'outside' else 'reported' end st from c join l on l_orderkey = k),
e as (select t.*, 'order' as relation, 0 as ordinal, 't' || (n + 1) as child, cast(null as varchar) fragment, cast(null as varchar) from_id from t where st = 'reported' union all select *, 'order', 1, 'gone', null, null from t where st = 'reported' and s % 3 = 0
  union all select *, 'link', 0, null, '-lm', null from t where st = 'reported' union all select *, 'link', 1, 't' || (n + 1), null, 't' || (n - 1) from t where st = 'reported'),
x as (select e.i as index, e.c as configuration, 't' || e.n as parent, relation, ordinal, child, fragment, case when child is not null then q.n is not null end present, case when child is not null then coalesce(q.st, 'absent') end child_status, from_id, case when from_id is not null then p.n is not null end from_present
  from e left join t q on q.k = e.k and q.c = e.c and 't' || q.n = child left join t p on p.k = e.k and p.c = e.c and 't' || p.n = from_id)"""


@_query(f"""{_ROWS} select i as index, c as configuration, 't' || n as id, 'n' || s as name, case when r = 'R' then 'abstractTargets' else 'targets' end collection, case when st = 'reported' then r end kind, st status from t""")
def cmake_model_targets(spark, sf_dir):
    return cmake_model.model(_replies(spark, sf_dir))["targets"]


@_query(f"{_ROWS} select * from x")
def cmake_model_relations(spark, sf_dir):
    return cmake_model.model(_replies(spark, sf_dir))["relationships"]


@_query(f"""{_ROWS} select i as index, case f when 0 then 'index.malformed' when 1 then 'index.codemodels' when 2 then 'model.missing' else 'model.disagrees' end code, case f when 0 then null when 1 then '2' else 'b' || k || '/model.json' end subject from o where f < 4
union all select i, 'target.' || st, c || '/t' || n from t where st <> 'reported'
union all select i, 'target.repeated', c || '/t' || min(n) from t where f = 4 and r <> 'R' group by i, c
union all select distinct index, 'relationship.dangling', configuration || '/' || parent || '/' || z from (select index, configuration, parent, child z from x where not present union all select index, configuration, parent, from_id from x where not from_present)""")
def cmake_model_problems(spark, sf_dir):
    return cmake_model.model(_replies(spark, sf_dir))["problems"]
