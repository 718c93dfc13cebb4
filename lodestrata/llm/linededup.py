"""Cross-site boilerplate lines: distinct sites of a line by mergeable HyperLogLog sketches.

Lines are known by two 64-bit hashes of their trimmed text. (1) A count by line drops the lines with too
few occurrences to reach ``min_sites``. (2) The others get a sketch of their sites, built in salted parts
and merged by aggregation. (3) Lines whose estimate is near the threshold get exact distinct counts. The
lines that remain over the threshold are boilerplate: all their occurrences but the first go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted_side, cut, fresh

#: A quarter of the generated tables' 20 sources: a passage in 20 documents with a hot source can be on fewer than half of them.
MIN_SITES, MIN_CHARS = 5, 20
#: log2 of the sketch's registers (standard error 3 %), and the share of the threshold on either side that is counted exactly.
LG_K, NEAR = 10, 0.25
SALTS = 16
#: Line hashes are broadcast up to this number (16 bytes each); beyond it, lines are joined by a shuffle.
BROADCAST_LINES = 500_000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``docs(id, site, text)`` to a row for each line long enough: ``id, th, site, pos, h1, h2``."""
    rows = docs.select("id", "site", F.xxhash64("text").alias("th"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    return rows.select("id", "th", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(sites: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``(h1, h2)`` of the lines of ``sites(h1, h2, site)`` that occur on at least ``min_sites`` distinct non-null sites."""
    key = ["h1", "h2"]
    parts = sites.withColumn("salt", F.pmod(F.xxhash64("site"), F.lit(SALTS))).groupBy(*key, "salt").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    spread = cut(parts.groupBy(key).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("sites")))
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select(key)
    near = spread.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select(key)
    exact = sites.select(*key, "site").join(counted_side(near, broadcast_lines), key).where("site is not null").distinct().groupBy(key).agg(F.count("*").alias("n"))
    return cut(sure.union(exact.where(F.col("n") >= min_sites).select(key)))


def drop_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS,
    removed_col: str | None = None, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; every row and column stays.

    A line (trimmed of spaces, at least ``min_chars`` code points) is boilerplate if it occurs on
    ``min_sites`` or more distinct values of ``site_col``, nulls not counted. Shorter lines (headings, list marks,
    greetings) are no passages and stay, however often they repeat: that is part of what the operator means by a
    line, at any size of the input. Its first occurrence, by smallest id (nulls first) and place, stays, so that no
    passage leaves the corpus altogether; in rows that repeat that id and text it stays in each. Null texts stay
    null; a text whose lines all go becomes empty. ``removed_col`` names a column for the number of lines taken out.
    Nothing is sampled or capped.

    The texts are read three times: lines are counted, those that occur often enough are written once, texts are
    filtered by the places found, which are broadcast up to ``broadcast_lines`` and else joined by a shuffle.
    """
    lines = _lines(docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.col(text_col).alias("text")), min_chars)
    often = cut(lines.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"))
    found = cut(lines.join(counted_side(often, broadcast_lines), ["h1", "h2"]))
    bad = boilerplate(found.select("h1", "h2", "site"), min_sites, broadcast_lines)
    hits = found.drop("site").join(counted_side(bad, broadcast_lines), ["h1", "h2"])
    place = F.struct("id", "th", "pos")
    first = cut(hits.groupBy("h1", "h2").agg(F.min(place).alias("first")))
    again = cut(hits.join(counted_side(first, broadcast_lines), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "th", "pos").distinct())
    n_places = again.count()
    gone_col, id2, th2 = fresh(docs, "gone_"), fresh(docs, "id_"), fresh(docs, "th_")
    gone = again.groupBy("id", "th").agg(F.collect_list("pos").alias(gone_col)).withColumnsRenamed({"id": id2, "th": th2})
    side = F.broadcast(gone) if n_places <= broadcast_lines else gone
    out = docs.join(side, F.col(f"`{id_col}`").eqNullSafe(F.col(id2)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(th2)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(gone_col), i)), "\n")
    cols = [F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(kept).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed_col:
        cols.append(F.coalesce(F.size(gone_col), F.lit(0)).cast("long").alias(removed_col))
    return out.select(cols)


ORACLE = f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents where text is not null),
k as (select doc_id, source, pos, line, trim(line) t, length(trim(line)) >= {MIN_CHARS} own from l),
b as (select t, min((doc_id, pos)) f from k where own group by t having count(distinct source) >= {MIN_SITES}),
m as (select k.doc_id, k.pos, k.line, coalesce(k.own and b.t is not null and (k.doc_id, k.pos) <> b.f, false) gone from k left join b on k.t = b.t)
select d.doc_id, case when d.text is null then null else coalesce(x.text, '') end as text, coalesce(x.n, 0) n_removed
from documents d left join (select doc_id, string_agg(line, chr(10) order by pos) filter (not gone) as text, cast(count(*) filter (gone) as bigint) n from m group by doc_id) x using (doc_id)
"""
