"""References in texts, ``${name}``, filled in from tables of values that refer to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import merged, written

#: A reference or a stretch without one; a lone ``$`` or an open ``${`` is text.
_PIECE = r"\$\{([^${}]*)\}|[^$]+|\$"
#: Texts that would grow beyond so many characters are left as they are and marked.
MOST = 65_536


def _pieces(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """``(*by, place, piece, ref)``: the pieces of a text in order; ``ref`` is the name of a reference, null for plain text."""
    found = F.regexp_extract_all(F.col(text), F.lit(_PIECE), F.lit(0))
    return rows.select(*by, F.posexplode(found).alias("place", "piece")).withColumn("ref", F.when(F.col("piece").rlike(r"^\$\{.*\}\z"), F.expr("substring(piece, 3, length(piece) - 3)")))


def _joined(pieces: Column) -> Column:
    """Pieces (place, text) of one text put together; they are as many as the text has, so a row holds them."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["text"]), "")


def resolve(values: DataFrame, rounds: int = 200, most: int = MOST) -> DataFrame:
    """``(scope, key, value, status)`` of ``values(scope, key, value)`` with references to keys of the same scope filled in.

    ``status``: resolved; unresolved where a reference has no value (it stays in the text); cycle in or behind a cycle of
    references, or beyond ``rounds`` levels of them; too-long beyond ``most`` characters. The last two keep the text as given. Each round
    joins only references to values that the round before settled; the joins are merges. Of several values of a key the least counts; null values are empty.
    """
    rows = values.groupBy("scope", "key").agg(F.min(F.coalesce("value", F.lit(""))).alias("value"))
    rows = merged(written(rows))  # used in each round
    pieces = merged(written(_pieces(rows.where(F.contains("value", F.lit("${"))), ["scope", "key"], "value")))
    known = rows.select("scope", F.col("key").alias("ref")).withColumn("there", F.lit(True))
    pieces = merged(written(pieces.join(known, ["scope", "ref"], "left").select("scope", "key", "place", F.coalesce("there", F.lit(False)).alias("waits"), "ref", "piece")))
    # a text waits for its distinct references that have values; the others stay as they are
    waiting = merged(written(pieces.where("waits").groupBy("scope", "key").agg(F.count_distinct("ref").alias("n"))))
    lost = pieces.where("ref is not null and not waits").select("scope", "key").distinct().withColumn("lost", F.lit(True))
    first = rows.join(waiting, ["scope", "key"], "left_anti").join(lost, ["scope", "key"], "left")
    done = merged(written(first.select("scope", "key", "value", F.when(F.col("lost"), "unresolved").otherwise("resolved").alias("status"))))
    front = done
    links = merged(written(pieces.where("waits").select("scope", "key", "ref").distinct()))
    arrived = None
    for _ in range(rounds):
        new = links.join(front.select("scope", F.col("key").alias("ref")), ["scope", "ref"]).groupBy("scope", "key").agg(F.count("*").alias("got"))
        arrived = merged(written(new if arrived is None else arrived.unionByName(new).groupBy("scope", "key").agg(F.sum("got").alias("got"))))
        ready = merged(written(waiting.join(arrived, ["scope", "key"]).where("got = n").select("scope", "key")))
        if ready.isEmpty():
            break
        arrived = arrived.join(ready, ["scope", "key"], "left_anti")
        own = pieces.join(ready, ["scope", "key"], "left_semi").join(done.select("scope", F.col("key").alias("ref"), F.col("value").alias("fill"), F.col("status").alias("from")), ["scope", "ref"], "left")
        text = F.when(F.col("waits"), F.col("fill")).otherwise(F.col("piece"))
        own = merged(written(own.select("scope", "key", "place", text.alias("text"), "from", "ref", "waits")))
        size = own.groupBy("scope", "key").agg(F.sum(F.length("text")).alias("size"), F.bool_or((F.col("from") == "unresolved") | (F.col("ref").isNotNull() & ~F.col("waits"))).alias("open"), F.bool_or(F.col("from") == "too-long").alias("long"))
        fits = own.join(size.where((F.col("size") <= most) & ~F.coalesce("long", F.lit(False))), ["scope", "key"]).groupBy("scope", "key", "open").agg(_joined(F.struct("place", "text")).alias("value"))
        fine = fits.select("scope", "key", "value", F.when(F.col("open"), "unresolved").otherwise("resolved").alias("status"))
        long = size.where((F.col("size") > most) | F.col("long")).select("scope", "key").join(rows, ["scope", "key"]).select("scope", "key", "value", F.lit("too-long").alias("status"))
        front = merged(written(fine.unionByName(long)))
        done = merged(written(done.unionByName(front)))
    rest = rows.join(done, ["scope", "key"], "left_anti").select("scope", "key", "value", F.lit("cycle").alias("status"))
    return done.unionByName(rest)


def fill(rows: DataFrame, scope: str, text: str, resolved: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the column ``text`` with its references filled in from ``resolve``'s rows of the row's ``scope``.

    References without a value, in cycles or too long stay as they are. Distinct texts are filled in once; the joins are merges.
    """
    texts = rows.where(F.contains(F.col(text), F.lit("${"))).select(F.col(scope).alias("scope"), F.col(text).alias("text")).distinct()
    values = merged(resolved.where("status in ('resolved', 'unresolved')").select("scope", F.col("key").alias("ref"), "value"))
    pieces = _pieces(texts, ["scope", "text"], "text").join(values, ["scope", "ref"], "left")
    done = pieces.groupBy("scope", "text").agg(_joined(F.struct("place", F.coalesce("value", "piece").alias("text"))).alias("filled_"))
    own = merged(done.select(F.col("scope").alias("scope_"), F.col("text").alias("text_"), "filled_"))
    return rows.join(own, (rows[scope] == own["scope_"]) & (rows[text] == own["text_"]), "left").select(*[rows[c] for c in rows.columns], F.coalesce("filled_", rows[text]).alias(name))
