"""SimHash near-duplicates: 64-bit fingerprints, pivot distance table, exact verification.

A pair of fingerprints within ``radius`` bits has, for every reference fingerprint (pivot), distances
that differ by ``radius`` at most (triangle inequality). The pivot table holds each distinct
fingerprint's distances to ``PIVOTS``. So that no cross join is needed, candidates come from an equi join
on whole segments: with ``m`` segments, ``radius`` = 4 differing bits touch four of them at most, so m - 4
agree in any pair sought. Candidates whose largest coordinate difference is over ``radius`` are discarded
by the table, survivors are verified by the full distance (``pivot_report`` counts all three). A pair is
kept only under the first segments on which it agrees, so it comes out once. Nothing is lost or capped.

The number of segments follows the number of fingerprints (``segments_for``), so that a key of agreeing
segments holds a few fingerprints at any size of the input. Where a key holds a large class of near copies,
its members link to one representative first, and only pairs of different groups are sought after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import BROADCAST_KEYS, counted_side, cut, fresh, small_batches, without
from .components import components
from .workers import trimming

RADIUS = 4
#: A key of agreeing segments with more fingerprints than this is linked through a representative first.
LARGE_KEY = 64


def _pivots(n: int, seed: int = 42) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63, n, dtype=np.int64)]


PIVOTS = _pivots(16)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text as a signed 64-bit integer.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``width`` words
    joined by a space, repeats included (fewer words: the whole sequence). Null, empty or blank: 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    stops = ends[min(width, len(words)) - 1 :]
    hashes = b"".join([digest(flat[s:e], 42) for s, e in zip(starts[:n].tolist(), stops.tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, n, 8192):  # memory stays small for a very long text
        ones += np.unpackbits(rows[at : at + 8192], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def each(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())

    return trimming(each)(parts)


fingerprint_udf = F.arrow_udf(_fingerprints, LongType())


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def segments_for(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of 6 to 9 segments for ``n`` distinct fingerprints: keys of 21, 27, 32 or 35 bits and more than n / 4 values."""
    m = next((m for m in (6, 7, 8) if 4 << (64 * (m - RADIUS) // m) >= n), 9)
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(segment: tuple[int, int]) -> int:
    low, width = segment
    return _signed(((1 << width) - 1) << low)


def _pivot_words(fp: Column) -> list[Column]:
    """The pivot table of a fingerprint: 16 distances, eight to a long."""
    words = []
    for at in range(0, len(PIVOTS), 8):
        word = F.lit(0).cast("long")
        for k, p in enumerate(PIVOTS[at : at + 8]):
            word = word.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * k))
        words.append(word)
    return words


def _keyed(fps: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """``fps(fp, ...)`` with its pivot table ``p0, p1`` and a row for each key ``k, s`` of agreeing segments."""
    groups = list(combinations(segments, len(segments) - RADIUS))
    p0, p1 = _pivot_words(F.col("fp"))
    mask = lambda group: F.lit(_signed(sum(_mask(x) & (2**64 - 1) for x in group)))
    keys = F.array(*[F.struct(F.lit(k).cast("int").alias("k"), F.col("fp").bitwiseAND(mask(g)).alias("s")) for k, g in enumerate(groups)])
    return fps.select("*", p0.alias("p0"), p1.alias("p1"), F.explode(keys).alias("key")).select(*fps.columns, "p0", "p1", "key.k", "key.s")


def _tests(segments: list[tuple[int, int]], radius: int) -> tuple[Column, Column, Column]:
    """Over rows ``a`` and ``b`` of ``_keyed``: the pivot table lets the pair pass; it is within ``radius``; this key is its first."""
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    coordinate = lambda side, p, i: F.shiftright(F.col(f"{side}.{p}"), 8 * i).bitwiseAND(F.lit(255))
    widest = F.greatest(*[F.abs(coordinate("a", p, i) - coordinate("b", p, i)) for p in ("p0", "p1") for i in range(8)])
    first = F.lit(-1)
    agree = {x: differ.bitwiseAND(F.lit(_mask(x))) == 0 for x in segments}
    for k, group in reversed(list(enumerate(combinations(segments, len(segments) - RADIUS)))):
        whole = F.lit(True)
        for x in group:
            whole = whole & agree[x]
        first = F.when(whole, F.lit(k)).otherwise(first)
    return widest <= radius, F.bit_count(differ) <= radius, first == F.col("a.k")


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.s") == F.col("b.s")))


def near_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``(u, v)``, u < v, of the distinct non-null longs in ``fps(fp)`` within ``radius`` <= 4 bits.

    Its result is quadratic in a class of near copies; ``near_duplicates`` doesn't need it (see ``near_links``).
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    segments = segments_for(fps.count())
    rows = _keyed(fps.select("fp"), segments)
    passes, near, own = _tests(segments, radius)
    return _candidates(rows, rows).where(F.col("a.fp") < F.col("b.fp")).where(passes).where(near & own).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def pivot_report(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of numbers of pairs: ``candidates`` of the equi join, those ``discarded`` by the pivot table, ``survivors``, ``verified``."""
    segments = segments_for(fps.count())
    rows = _keyed(fps.select("fp"), segments)
    passes, near, own = _tests(segments, radius)
    count = lambda c: F.count_if(c)
    return _candidates(rows, rows).where((F.col("a.fp") < F.col("b.fp")) & own).agg(F.count("*").alias("candidates"), count(~passes).alias("discarded"), count(passes).alias("survivors"), count(passes & near).alias("verified"))


def near_links(fps: DataFrame, radius: int = RADIUS, large: int = LARGE_KEY) -> DataFrame:
    """Links ``(u, v)`` that give the same components as all pairs of ``fps(fp)`` within ``radius`` bits.

    Keys with at most ``large`` fingerprints are searched whole. In a larger key all fingerprints near its least one link to
    that one, which joins most of a class of near copies by as many links as it has members; then the members outside
    the key's largest group so far meet the key's other members, and pairs already in one group are left out.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    segments = segments_for(fps.count())
    rows = _keyed(fps.select("fp"), segments)
    passes, near, own = _tests(segments, radius)
    pair = [F.col("a.fp").alias("u"), F.col("b.fp").alias("v")]
    wide = cut(rows.groupBy("k", "s").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where(F.col("n") > large).select("k", "s", "least"))
    n_wide = wide.count()
    if n_wide == 0:
        return _candidates(rows, rows).where(F.col("a.fp") < F.col("b.fp")).where(passes).where(near & own).select(pair)
    side = F.broadcast(wide) if n_wide <= BROADCAST_KEYS else wide
    small = rows.join(side, ["k", "s"], "left_anti")
    found = cut(_candidates(small, small).where(F.col("a.fp") < F.col("b.fp")).where(passes).where(near & own).select(pair))
    members = rows.join(side, ["k", "s"])
    stars = cut(members.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius)).select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct())
    groups = components(found.union(stars))
    placed = cut(members.drop("least").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    largest = placed.groupBy("k", "s", "root").agg(F.count("*").alias("n")).groupBy("k", "s").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    marked = placed.join(largest, ["k", "s"])
    others = marked.where(F.col("root") != F.col("main"))
    # of two members outside the largest group, the pair is met once
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp"))
    rest = _candidates(others, marked).where((F.col("a.root") != F.col("b.root")) & once).where(passes).where(near & own).select(pair)
    return found.union(stars).union(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (long), ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits; equal
    fingerprints link, those of texts without words (0) included. Null texts count as empty. Rows with a null
    id take part and carry null; a component of null ids only has a null ``component_id``. Repeated rows each
    give a row; other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        fps = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(classes.select("fp"), radius))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = labelled.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    member = labelled.join(least, "root").select("fp", "component_id")
    return fps.join(member, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id.

    Columns and their order stay. Where several rows share that id, one of the smallest by its row hash stays; of
    rows equal in all columns one stays. A component of null ids keeps one row likewise, texts without words (null and
    empty ones) are one component, an empty table stays empty. Keys (id and row hash) filter the rows where they are
    read; only rows that repeat in all columns are shuffled.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") or t == "variant" else F.col(f"`{c}`") for c, t in docs.dtypes])
    keyed = docs.select(F.struct(F.col(id_col).alias("i"), row_hash.alias("h")).alias("key"), F.col(text_col).alias("text"))
    ids = cut(near_duplicates(keyed, "key", "text", radius).select("key", "component_id").groupBy("key").agg(F.first("component_id").alias("component_id"), F.count("*").alias("n")))
    keep = ids.groupBy("component_id").agg(F.min("key").alias("key")).select("key")
    gone = ids.join(keep, "key", "left_anti").select("key.i", "key.h")
    kept = without(docs, gone, id_col, row_hash)
    repeats = cut(ids.where("n > 1").join(keep, "key", "left_semi").select("key.i", "key.h"))
    if repeats.isEmpty():
        return kept
    i, h = fresh(docs, "repeat_i"), fresh(docs, "repeat_h")
    side = counted_side(repeats.select(F.col("i").alias(i), F.col("h").alias(h)), BROADCAST_KEYS)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (row_hash == F.col(h))
    return without(kept, repeats, id_col, row_hash).unionByName(kept.join(side, same).dropDuplicates([i, h]).drop(i, h))
