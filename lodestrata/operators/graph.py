"""Paths, reachability and groups over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import Grown, cut, written


def reverse_paths(edges: DataFrame, targets: DataFrame, depth: int = 64) -> DataFrame:
    """Simple paths against the edges: ``(path, length, rooted, truncated)`` from each node of ``targets(node)`` to its ancestors.

    ``edges(parent, child)``. A path repeats no node and has ``depth`` edges at most; ``rooted`` tells whether
    nothing points at its last node, ``truncated`` whether it goes on beyond ``depth``. One join for each level, on the frontier only:
    edges are evaluated once and tell whether their parent is a root, and the joins are merges (see ``fixpoint``).
    """
    up = edges.select("parent", "child").distinct()
    below = written(up.select(F.col("child").alias("node")).distinct().withColumn("below", F.lit(True)))
    up = written(up.join(below.hint("merge"), F.col("parent") == F.col("node"), "left").select("parent", "child", F.col("below").isNull().alias("top")))
    onward = lambda df: df.join(up.hint("merge"), F.col("end") == F.col("child")).where(~F.array_contains("path", F.col("parent")))
    front = written(targets.select("node").distinct().join(below.hint("merge"), "node", "left").select(F.array("node").alias("path"), F.col("node").alias("end"), F.col("below").isNull().alias("rooted")))
    out, ended = front.limit(0), False
    for _ in range(depth):
        longer = written(onward(front).select(F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("end"), F.col("top").alias("rooted")))
        if longer.isEmpty():
            ended = True
            break
        out, front = out.union(front), longer
    told = lambda df, truncated: df.select("path", (F.size("path") - 1).alias("length"), "rooted", truncated.alias("truncated"))
    if ended:
        return told(out.union(front), F.lit(False))
    more = onward(front).select("path").distinct().withColumn("more", F.lit(True))
    return told(out, F.lit(False)).union(told(front.join(more.hint("merge"), "path", "left"), F.coalesce("more", F.lit(False))))


def reachable(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """``(node, distance)``: nodes within reach of ``roots(node)`` along ``edges(parent, child)`` by breadth-first rounds."""
    links = written(edges.select("parent", "child"))
    front = written(roots.select("node").distinct().withColumn("distance", F.lit(0)))
    seen = Grown(front)
    for step in range(1, rounds + 1):
        front = written(front.join(links.hint("merge"), F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(seen.rows().select("node").hint("merge"), "node", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            return seen.rows()
        seen.add(front)
    raise RuntimeError(f"not done after {rounds} rounds")


def alias_groups(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)``: equivalence groups of ``pairs(a, b)``, known by their least member; label propagation with shortcuts."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = cut(step.join(step.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.least("root", "far").alias("root")))
        changed = jump.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was")
        labels = jump
        if changed.isEmpty():
            return labels
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def fixpoint(edges: DataFrame, facts: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """Facts ``(node, fact)`` carried along ``edges(source, target)`` until nothing new comes, and whether that was within ``rounds``.

    Each round joins only the facts that are new; facts and edges are distinct, so cycles end. Edges are evaluated once, and the
    joins are merges: a table of any size that is broadcast goes through the driver, in every round.
    """
    links = written(edges.select("source", "target").distinct())
    front = written(facts.select("node", "fact").distinct())
    known = Grown(front)
    for _ in range(rounds):
        front = written(front.join(links.hint("merge"), F.col("node") == F.col("source")).select(F.col("target").alias("node"), "fact").distinct().join(known.rows().hint("merge"), ["node", "fact"], "left_anti"))
        if front.isEmpty():
            return known.rows(), True
        known.add(front)
    return known.rows(), False


def first_paths(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """``(node, distance, before)`` of nodes in reach of ``roots(node)`` along ``edges(parent, child)``: breadth first, with the least predecessor."""
    links = written(edges.select("parent", "child"))
    front = written(roots.select("node").distinct().select("node", F.lit(0).alias("distance"), F.lit(None).cast(roots.schema["node"].dataType).alias("before")))
    seen = Grown(front)
    for step in range(1, rounds + 1):
        found = front.join(links.hint("merge"), F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("before"))
        front = written(found.join(seen.rows().select("node").hint("merge"), "node", "left_anti").select("node", F.lit(step).alias("distance"), "before"))
        if front.isEmpty():
            return seen.rows()
        seen.add(front)
    raise RuntimeError(f"not done after {rounds} rounds")


def climb(steps: DataFrame) -> DataFrame:
    """``(u, p, w, b, circling)``: where each row of ``steps(u, p, w, b)`` ends that walks on from ``p`` as long as ``p`` is a ``u`` too.

    A step stands for level(u) = max(b, level(p) + w); a walk's ``w`` and ``b`` stand for the whole walk. ``u`` is unique.
    Each round doubles all walks (a walk is joined with the walk from where it ends), so rounds are logarithmic in the
    longest; rows that still walk after that are in or behind a cycle.
    """
    rows = written(steps.select("u", "p", F.col("w").cast("long").alias("w"), F.col("b").cast("long").alias("b"), F.lit(True).alias("circling")))
    for _ in range(rows.count().bit_length() + 1):
        ahead = rows.select(F.col("u").alias("p"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("b").alias("b2"))
        far = F.col("p2").isNotNull()
        rows = written(rows.join(ahead, "p", "left").select("u", F.coalesce("p2", "p").alias("p"), F.when(far, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"), F.when(far, F.greatest("b", F.col("b2") + F.col("w"))).otherwise(F.col("b")).alias("b"), far.alias("circling")))
        if rows.where("circling").isEmpty():
            break
    return rows


def path_steps(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target, step, node)``: the nodes from each node of ``targets(node)`` (step 0) up to its root along ``tree(node, before)``.

    ``before`` is null at a root; a target that isn't in the tree is its own root; targets in or behind a cycle have no rows.
    Jump tables (a node and its 2^k-th ancestor) are joined with themselves: rounds are logarithmic in the longest path.
    """
    links = tree.where("before is not null").groupBy("node").agg(F.min("before").alias("before"))
    circling = climb(links.select(F.col("node").alias("u"), F.col("before").alias("p"), F.lit(1).alias("w"), F.lit(0).alias("b"))).where("circling").select(F.col("u").alias("node"))
    jump = written(links.join(circling, "node", "left_anti"))
    out = targets.select("node").where("node is not null").distinct().join(circling, "node", "left_anti").select(F.col("node").alias("target"), F.lit(0).cast("long").alias("step"), "node")
    size = 1
    while not jump.isEmpty():
        out = written(out.union(out.join(jump, "node").select("target", F.col("step") + size, F.col("before").alias("node"))))
        jump = written(jump.join(jump.select(F.col("node").alias("before"), F.col("before").alias("far")), "before").select("node", F.col("far").alias("before")))
        size *= 2
    return out


#: The level of what is in or behind a cycle, above any walk's length.
ENDLESS = 1 << 60
#: Edges that a longer walk implies are sought if that joins at most so many rows for each edge.
WALKS_PER_EDGE = 8


def _thinned(core: DataFrame, phase: int) -> DataFrame:
    """``core`` without edges (u, v) beside which a walk u, x, v is as long.

    x must come after v in an order that changes with the phase: so the last dependency of each node behind a cycle that is
    itself behind one stays, and nothing behind a cycle is set free.
    """
    edges = core.where("v is not null")
    into, out = edges.groupBy(F.col("v").alias("x")).count(), edges.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("n"))
    if (into.join(out, "x").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0) > WALKS_PER_EDGE * edges.count():
        return core
    order = lambda c: F.xxhash64(c, F.lit(phase))
    second = edges.select(F.col("u").alias("x"), "v", F.col("w").alias("w2"))
    walks = edges.select("u", F.col("v").alias("x"), F.col("w").alias("w1")).join(second, "x").where(order("x") > order("v")).groupBy("u", "v").agg(F.max(F.col("w1") + F.col("w2")).alias("walk"))
    return core.join(edges.join(walks, ["u", "v"]).where("walk >= w").select("u", "v"), ["u", "v"], "left_anti")


def longest_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)`` of each of ``nodes(node)``: the longest walk along ``edges(node, dep)``, 0 without one; null in or behind a cycle.

    Edges from or to other nodes, and null nodes, are ignored; repeated rows count once. ``node`` may be a struct.

    Each phase settles the nodes that wait for nothing and takes out those that wait for one other: their chains are
    walked by doubling and hung on where they end, so a chain of any length takes one phase of logarithmic rounds. What waits
    for several is joined to those ends, loses edges that a longer walk implies, and goes into the next phase. A phase
    without either kind leaves only what is in or behind cycles.
    """
    own = nodes.select("node").where("node is not null").distinct()
    links = edges.select(F.col("node").alias("u"), F.col("dep").alias("v")).distinct()
    links = links.join(own.select(F.col("node").alias("v")), "v", "left_semi").join(own.select(F.col("node").alias("u")), "u", "left_semi")
    core = written(links.select("u", "v", F.lit(1).cast("long").alias("w")))
    settled = written(own.join(core.select(F.col("u").alias("node")), "node", "left_anti").withColumn("level", F.lit(0).cast("long")))
    known, hung, phase = Grown(settled), [], 0
    level = lambda c: F.least(c, F.lit(ENDLESS))
    while not core.isEmpty():
        phase += 1
        rows = core.join(settled.select(F.col("node").alias("v"), "level"), "v", "left")  # what waits for a settled node waits no more, but has its level as a floor
        open_ = F.col("level").isNull()
        core = written(rows.select("u", F.when(open_, F.col("v")).alias("v"), F.when(open_, F.col("w")).otherwise(level(F.col("level") + F.col("w"))).alias("w")).groupBy("u", "v").agg(F.max("w").alias("w")))
        if phase > 1:
            core = written(_thinned(core, phase))
        both = core.where("v is not null").select("u", "v")
        looped = both.join(both.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").select("u").distinct().withColumn("looped", F.lit(True))
        stats = core.groupBy("u").agg(F.count("v").alias("n"), F.max(F.when(F.col("v").isNull(), F.col("w"))).alias("floor"), F.max(F.when(F.col("v").isNotNull(), F.struct("v", "w"))).alias("only")).join(looped, "u", "left")
        endless = F.coalesce(F.col("looped"), F.lit(False)) | (F.coalesce("floor", F.lit(0)) >= ENDLESS)
        stats = written(stats.select("u", "n", F.coalesce("floor", F.lit(0).cast("long")).alias("floor"), "only", endless.alias("endless")))
        ended = stats.where("endless or n = 0").select(F.col("u").alias("node"), F.when(F.col("endless"), F.lit(ENDLESS)).otherwise(F.col("floor")).alias("level"))
        walks = climb(stats.where("not endless and n = 1").select("u", F.col("only.v").alias("p"), F.col("only.w").alias("w"), F.col("floor").alias("b")))
        stops = written(walks.join(ended.select(F.col("node").alias("p"), "level"), "p", "left").select("u", "p", "w", "b", F.when(F.col("circling"), F.lit(ENDLESS)).otherwise(level(F.greatest("b", F.col("level") + F.col("w")))).alias("level"), (~F.col("circling") & F.col("level").isNull()).alias("hangs")))
        settled = written(ended.union(stops.where("not hangs").select(F.col("u").alias("node"), "level")))
        ends = stops.where("hangs").select("u", "p", "w", "b")
        several = stats.where("not endless and n > 1").select("u")
        if settled.isEmpty() and ends.isEmpty():
            known.add(several.select(F.col("u").alias("node"), F.lit(ENDLESS).alias("level")))
            break
        known.add(settled)
        hung.append(ends)
        on = core.join(several, "u", "left_semi").join(ends.select(F.col("u").alias("v"), "p", F.col("w").alias("w2"), "b"), "v", "left")
        null = F.lit(None).cast(core.schema["v"].dataType)
        moved = F.when(F.col("p").isNull(), F.array(F.struct("v", "w"))).otherwise(F.array(F.struct(F.col("p").alias("v"), (F.col("w") + F.col("w2")).alias("w")), F.struct(null.alias("v"), (F.col("b") + F.col("w")).alias("w"))))
        core = written(on.select("u", F.inline(moved)).groupBy("u", "v").agg(F.max("w").alias("w")))
    for ends in reversed(hung):
        at = known.rows().select(F.col("node").alias("p"), "level")
        known.add(written(ends.join(at, "p").select(F.col("u").alias("node"), level(F.greatest("b", F.col("level") + F.col("w"))).alias("level"))))
    return known.rows().select("node", F.when(F.col("level") < ENDLESS, F.col("level")).alias("level"))
