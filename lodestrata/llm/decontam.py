"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Each window keeps
the least of its hashed 4-word grams; documents keep the same minimum for each of their own windows.
Equal windows have equal minima, so joining the two sets of minima finds every shared span of 13 words
or more; windows that follow each other with one minimum are one row of that join. A hit is then extended to its whole window, word by word, and windows merge into spans. An item
of L < 13 words is its own L-gram (a window of one gram), looked up in the documents' L-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, without

WINDOW, GRAM = 13, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark's windows are broadcast up to this number (under 64 MB), their marks (a number each) up to the other; beyond it, they are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_MARKS = 200_000, 1_000_000


def _word(letters: str) -> str:
    """The pattern of words of ``letters``, 0-9 and all beyond ASCII: what isn't in them is listed one by one, which Java looks up in a table; ranges cost it ten times as much."""
    return "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in "0123456789" + letters) + "]+"


#: ``WORD``, and words before lower-casing.
LISTED_WORD, ANY_WORD = _word(LOWER), _word(LOWER + UPPER)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased. Null: no words."""
    plain = F.length(text) == F.octet_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)), F.lit(LISTED_WORD), F.lit(0))


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _wide(df: DataFrame, col: str, n: int, join, stem: str) -> tuple[DataFrame, str]:
    """Adds the array whose item i combines items i to i + n - 1 of array ``col``; its tail is not to be used."""
    have, name, at = col, None, 0
    power, made = 1, []
    while True:
        if n & power:
            if name is None:
                name, at = have, power
            else:
                df = df.withColumn(f"{stem}_{at + power}", F.zip_with(F.col(have), _shift(F.col(name), power), join))
                name, at = f"{stem}_{at + power}", at + power
                made.append(name)
        power *= 2
        if power > n:
            return df.drop(*[x for x in made if x != name]), name
        df = df.withColumn(f"{stem}p{power}", F.zip_with(F.col(have), _shift(F.col(have), power // 2), join))
        df = df.drop(*[x for x in made if x not in (name, f"{stem}p{power}")])
        have = f"{stem}p{power}"
        made = [x for x in made if x == name] + [have]


def _minima(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``marks``: an array of (length, minima), one minimum for each window of that length in ``w``."""
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    marks = []
    for length in lengths:
        stem = f"g{length}"
        df, gram = _wide(df, "h", GRAM if length == WINDOW else length, lambda a, b: F.xxhash64(a, b), stem)
        if length == WINDOW:
            df, gram = _wide(df, gram, WINDOW - GRAM + 1, lambda a, b: F.least(a, b), f"{stem}m")
        marks.append(F.struct(F.lit(length).alias("length"), F.slice(F.col(gram), F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(0))).alias("minima")))
    return df.withColumn("marks", F.array(*marks))


def _windows(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """A row for each window: ``keep`` columns, ``length``, ``start`` (from 0), ``mark``; null marks match nothing.

    The outer forms of explode keep Catalyst from pushing a size filter through the chain of arrays,
    which would write each array's whole derivation out again at every use.
    """
    marked = _minima(df, lengths).select(*keep, F.explode_outer("marks").alias("x"))
    return marked.select(*keep, F.col("x.length").alias("length"), F.posexplode_outer("x.minima").alias("start", "mark"))


def _runs(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """A row for each run of windows of one length that follow each other and have the same mark: ``keep`` columns, ``length``, ``start``, ``end`` (the first window beyond), ``key``.

    Neighbours mostly share their least gram, so runs are several times fewer than windows.
    """
    marked = _minima(df, lengths).select(*keep, F.explode_outer("marks").alias("x")).select(*keep, "x.length", "x.minima")
    n, at = F.size("minima"), lambda i: F.get(F.col("minima"), i)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    marked = marked.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(F.col("starts"), i + 1), n).alias("end"), at(s).alias("mark")))
    return marked.select(*keep, "length", F.explode_outer(runs).alias("r")).select(*keep, "length", "r.start", "r.end", F.when(F.col("r.mark").isNotNull(), _key("length", "r.mark")).alias("key"))


def _key(length: str, mark: str) -> Column:
    """One number for a mark and its windows' length; should two marks share one, the comparison word by word parts them."""
    return F.xxhash64(length, mark)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int], int]:
    """Distinct windows ``(length, mark, span, items)``, the lengths that occur and the number of windows.

    Items without words (null, empty, punctuation) have no window; an item with a null id has its windows, but isn't named in ``items``.
    """
    items = cut(benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0).withColumn("own", F.least(F.size("w"), F.lit(WINDOW))))
    lengths = sorted(r[0] for r in items.select("own").distinct().collect())  # 13 numbers at most
    rows = _windows(items, lengths, ["item", "own", "w"]) if lengths else items.selectExpr("item", "own", "w", "0 as length", "0 as start", "0L as mark").limit(0)
    rows = rows.where("length = own").select("length", "mark", F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ").alias("span"), F.col("item").cast("string").alias("item"))
    found = cut(rows.groupBy("length", "mark", "span").agg(F.collect_set("item").alias("items")))
    return found, lengths, found.count()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_marks: int = BROADCAST_MARKS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A word is hit if any occurrence of a benchmark window covers it; ``n_items`` counts items (null ids
    apart) with an occurring window, ``items_sha256`` is the hash of their ids, sorted as strings and comma-joined;
    ``contaminated`` is n_hit > 0 and 20 n_hit >= n_words. Null and empty texts have no words and are
    clean. Repeated rows each give a row (rows are told apart by id and text hash, null ids included);
    an empty benchmark leaves all documents clean. Texts are scanned whole, whatever their length.
    """
    bench, lengths, n = benchmark_windows(benchmark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    counted = base.select("id", "th", F.when(F.col("t").isNull(), 0).otherwise(F.regexp_count("t", F.lit(ANY_WORD))).cast("long").alias("n_words"))
    if n == 0:
        hits = counted.select("id", "th", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    else:
        split = base.select("id", "th", words(F.col("t")).alias("w")).where(F.size("w") >= min(lengths))
        # sides too large for a broadcast say so: Spark's own estimate takes texts for as small as the file they were packed in
        side = lambda df, few: F.broadcast(df) if few else df.hint("merge")
        marks = cut(bench.select(_key("length", "mark").alias("key")).distinct())
        near = cut(_runs(split, lengths, ["id", "th"]).join(side(marks, marks.count() <= broadcast_marks), "key", "left_semi").select("id", "th", "length", "start", "end"))
        # only the places of equal marks move; the words of their documents are read again and compared there
        places = near.groupBy("id", "th").agg(F.collect_set(F.struct("length", "start", "end")).alias("places")).withColumnsRenamed({"id": "i2", "th": "th2"})
        texts = base.join(side(places, near.count() <= BROADCAST_KEYS), F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("th2"))).select("id", "th", words(F.col("t")).alias("w"), "places")
        window = lambda p, at: F.struct(p["length"].alias("length"), at.alias("start"), F.array_join(F.slice("w", at + 1, p["length"]), " ").alias("span"))
        read = texts.select("id", "th", F.explode(F.flatten(F.transform("places", lambda p: F.transform(F.sequence(p["start"], p["end"] - 1), lambda at: window(p, at))))).alias("x"))
        found = read.select("id", "th", "x.*").join(side(bench, n <= broadcast_windows), ["length", "span"])
        spans = found.select("id", "th", F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("span"), "items")
        per = spans.groupBy("id", "th").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
        cover = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(x["end"] - F.greatest(s["to"], x["start"]), F.lit(0))).alias("n")))
        hits = per.select("id", "th", cover["n"].alias("n_hit"), "items")
    hits = hits.withColumnsRenamed({"id": "i2", "th": "th2"})
    out = counted.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("i2")) & F.col("th").eqNullSafe(F.col("th2")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``contamination`` marks; columns and clean rows stay as they are.

    Null, empty and wordless texts are clean; null ids and repeated rows are judged by their texts like others; an empty
    table stays empty, an empty benchmark keeps all. Keys of contaminated rows (id and text hash) filter the rows.
    """
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("k")
    bad = contamination(docs.select(key, F.col(text_col).alias("t")), benchmark, "k", "t").where("contaminated")
    return without(docs, bad.select("k.i", "k.h"), id_col, F.xxhash64(F.col(f"`{text_col}`")))


ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from benchmark),
bw as (select distinct item_id, least(len(w), 13) n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') span
       from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') span
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, lens where len(w) >= n)),
hit as (select doc_id, dw.n, s, item_id from dw join bw using (n, span)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from (select distinct doc_id, s, n from hit)) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct doc_id, cast(item_id as varchar) i from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""
