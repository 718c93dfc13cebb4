"""Context-tree weighting of bytes: a language model learnt and applied as Spark jobs.

A text is its lower-cased words, each closed by a space, then one end byte; white space between words counts as one
space. A byte is eight binary decisions. The context of a decision is the bits of the byte so far and the ``depth``
bytes before it, whatever word they belong to (end bytes stand before a text's start), so the order of words matters.
Each context of each length d = 0..depth holds a Krichevsky-Trofimov estimate of its counts; bottom up, a node's
weighted probability is half its own estimate and half the product of its children's, which gives the weight of its
estimate; top down, these weights mix the estimates of all depths. A context never seen in training is not mixed in:
the estimate before it keeps its share. Costs per byte add up to the code length of a text.

Scale: tasks count the grams (a context and its byte, one 64-bit number) of the texts they read, sums are hash
aggregations, depths are joined level by level. A document needs the score of each of its grams: the most frequent
ones (a fixed number) are broadcast, all others are joined by a shuffle of (document, rare gram, count). Words, of
which the base score needs the counts, go the same way. What is gathered grows with the corpus; what is broadcast
does not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DEPTH = 5
END = b"\n"
#: Most frequent words and grams that are broadcast; the bounds don't depend on the input.
FREQUENT_WORDS = 200_000
FREQUENT_GRAMS = 1_000_000
#: Distinct words, and grams, that a task holds before it passes their counts on.
TASK_WORDS = 500_000
TASK_GRAMS = 2_000_000
#: Bytes of texts whose grams are looked at together.
CHUNK = 500_000


def tokens(text: str | None) -> list[bytes]:
    """Words (A-Z lower-cased, cut at ASCII white space) and the end token."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def coded(words: list[bytes], depth: int) -> bytes:
    """The bytes of a text's ``tokens`` behind the context before its start."""
    return END * depth + b" ".join(words)  # the end token closes the last word with a space before it


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``depth`` bytes of context and a byte, for each byte of each coded text; the number for each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) - depth
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    code = flat[depth:].copy()
    for k in range(1, depth + 1):
        code |= flat[depth - k : len(flat) - k] << (8 * k)
    inside = np.ones(len(code), bool)
    ends = np.cumsum(lengths + depth)[:-1]
    for k in range(depth):
        inside[ends - depth + k] = False  # grams that run from one text into the next one's start
    return code[inside], lengths


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_table(keys: np.ndarray, lps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Grams and their scores in an open hash table of at least twice their number (grams, scores, bits); empty places hold -1."""
    bits = max(4, (2 * len(keys)).bit_length())
    table, scores = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
    slot, waiting = _slots(keys, bits), np.arange(len(keys))
    while len(waiting):
        free = waiting[table[slot[waiting]] == -1]
        table[slot[free]] = keys[free]  # of several that want a place, the last has it
        placed = table[slot[waiting]] == keys[waiting]
        scores[slot[waiting[placed]]] = lps[waiting[placed]]
        waiting = waiting[~placed]
        slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
    return table, scores, bits


def look_up(code: np.ndarray, table: np.ndarray, scores: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The score of each gram and whether the table has it."""
    slot = _slots(code, bits)
    there = table[slot]
    hit = there == code
    waiting = np.flatnonzero(~hit & (there != -1))
    while len(waiting):
        slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
        there = table[slot[waiting]]
        hit[waiting] = there == code[waiting]
        waiting = waiting[(there != code[waiting]) & (there != -1)]
    return np.where(hit, scores[slot], np.float32(0)), hit


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, own = np.unique(np.concatenate(keys), return_inverse=True)
    return g, np.bincount(own, np.concatenate(counts), len(g)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` of ``docs(text, train)``: a row for each token of any text, its number in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        more: set[bytes] = set()

        def rows() -> pa.RecordBatch:
            words = [*seen, *(w for w in more if w not in seen)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen.get(w, 0) for w in words], pa.int64())], ["word", "c"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (seen if train else more).update(tokens(text.as_py()))
                if len(seen) + len(more) > TASK_WORDS:
                    yield rows()
                    seen, more = Counter(), set()
        if seen or more:
            yield rows()

    return docs.select("text", "train").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """``(g, c)`` of ``docs(text, train)``: a row for each gram of any text, its number in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        size = 0

        def take() -> None:
            for train, texts in waiting.items():
                if texts:
                    g, c = np.unique(_grams(texts, depth)[0], return_counts=True)
                    keys.append(g)
                    counts.append(c if train else np.zeros(len(g), np.int64))
                    texts.clear()

        def rows() -> pa.RecordBatch:
            g, c = keys[0], counts[0]
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], ["g", "c"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                waiting[bool(train)].append(coded(tokens(text.as_py()), depth))
                size += len(waiting[bool(train)][-1])
                if size >= CHUNK:
                    take()
                    size = 0
                    if sum(map(len, keys)) > 2 * TASK_GRAMS:
                        keys[:], counts[:] = ([x] for x in _merged(keys, counts))
                        if len(keys[0]) > TASK_GRAMS:
                            yield rows()
        take()
        if keys:
            keys[:], counts[:] = ([x] for x in _merged(keys, counts))
            yield rows()

    return docs.select("text", "train").mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _level(counts: DataFrame, sums: DataFrame | None) -> DataFrame:
    """Nodes of one depth. ``counts(g, c)``; ``sums(ctx, node, s)``: log products of the children, null at the last depth.

    A row for each context: ``own`` bytes, ``path`` (for each byte, eight estimates of its bits and eight
    weights as 32-bit floats, nan where nothing was counted), ``nodes`` and their log ``weighted`` probabilities.
    """
    rows = counts.groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.collect_list(F.struct(F.col("g").bitwiseAND(F.lit(255)).cast("int").alias("b"), "c")).alias("x"))
    if sums is None:
        rows = rows.withColumn("y", F.array().cast("array<struct<node:int,s:double>>"))
    else:
        rows = rows.join(sums.groupBy("ctx").agg(F.collect_list(F.struct("node", "s")).alias("y")), "ctx", "left")
    last = sums is None

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):  # 256 nodes for each context
                batch = big.slice(at, 2000)
                n = batch.num_rows
                x, y = batch.column("x"), batch.column("y")
                many = pa.compute.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = x.flatten()
                byte, c = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
                of = np.repeat(np.arange(n), many)
                count = np.zeros((2, n * 256))
                node = [of * 256 + ((1 << k) | (byte >> (8 - k))) for k in range(8)]
                bit = [(byte >> (7 - k)) & 1 for k in range(8)]
                for k in range(8):
                    np.add.at(count, (bit[k], node[k]), c)
                total = count.sum(0)
                used = np.flatnonzero(total)
                a, b = count[0, used], count[1, used]
                estimate = np.zeros(n * 256)
                estimate[used] = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)
                weight, weighted = np.ones(n * 256), estimate.copy()
                if not last:
                    below = np.zeros(n * 256)
                    flat_y = y.flatten()
                    many_y = pa.compute.fill_null(pa.compute.list_value_length(y), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    below[np.repeat(np.arange(n), many_y) * 256 + flat_y.field(0).to_numpy(zero_copy_only=False)] = flat_y.field(1).to_numpy(zero_copy_only=False)
                    weight = 1 / (1 + np.exp(np.clip(below - estimate, -700, 700)))
                    weighted = np.logaddexp(estimate, below) - np.log(2)
                path = np.empty((len(byte), 16), "<f4")
                for k in range(8):
                    t = total[node[k]]
                    path[:, k] = np.where(t > 0, (count[bit[k], node[k]] + 0.5) / (t + 1), np.nan)
                    path[:, 8 + k] = weight[node[k]]
                cuts = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
                ups = pa.array(np.searchsorted(used, np.arange(n + 1) * 256).astype(np.int32))
                paths = pa.Array.from_buffers(pa.binary(), len(byte), [None, pa.py_buffer((64 * np.arange(len(byte) + 1)).astype(np.int32).tobytes()), pa.py_buffer(path.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ctx"), pa.ListArray.from_arrays(cuts, pa.array(byte.astype(np.int32))), pa.ListArray.from_arrays(cuts, paths), pa.ListArray.from_arrays(ups, pa.array((used % 256).astype(np.int32))), pa.ListArray.from_arrays(ups, pa.array(weighted[used]))],
                    ["ctx", "own", "path", "nodes", "weighted"],
                )

    return rows.select("ctx", "x", "y").mapInArrow(weigh, "ctx long, own array<int>, path array<binary>, nodes array<int>, weighted array<double>")


def _mix(state: np.ndarray, path: np.ndarray) -> np.ndarray:
    """One depth further down: ``state`` has shares so far, what remains and the last estimate, eight each."""
    done, left, before = state[:, :8], state[:, 8:16], state[:, 16:]
    estimate, weight = path[:, :8], path[:, 8:]
    seen = ~np.isnan(estimate)
    return np.hstack([np.where(seen, done + left * weight * estimate, done), np.where(seen, left * (1 - weight), left), np.where(seen, estimate, before)]).astype("<f4")


START = np.concatenate([np.zeros(8), np.ones(8), np.full(8, 0.5)]).astype("<f4")


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((width * np.arange(len(rows) + 1)).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width)


def gram_scores(counts_of: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(g, c, lp)``: log10 probability of each gram of ``counts_of(g, c)`` under the tree that these counts build."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    counts = {depth: cut(counts_of)}
    for d in range(depth - 1, -1, -1):
        counts[d] = cut(counts[d + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)).alias("g")).agg(F.sum("c").alias("c")))
    levels, sums = {}, None
    for d in range(depth, -1, -1):
        levels[d] = cut(_level(counts[d], sums))
        if d:
            up = levels[d].select(F.col("ctx").bitwiseAND(F.lit((1 << (8 * d - 8)) - 1)).alias("ctx"), F.explode(F.arrays_zip("nodes", "weighted")).alias("z"))
            sums = up.groupBy("ctx", F.col("z.nodes").alias("node")).agg(F.sum("z.weighted").alias("s"))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                state = _mix(_floats(batch.column("state"), 24), _floats(batch.column("path"), 16))
                p = state[:, :8] + state[:, 8:16] * state[:, 16:]
                yield pa.RecordBatch.from_arrays([batch.column("g"), _binary(state), pa.array(np.log10(p.astype(np.float64)).sum(1))], ["g", "state", "lp"])

    state = None
    for d in range(depth + 1):
        rows = levels[d].select("ctx", F.explode(F.arrays_zip("own", "path")).alias("z")).select((F.shiftleft("ctx", 8).bitwiseOR(F.col("z.own").cast("long"))).alias("g"), F.col("z.path").alias("path"))
        if state is None:
            rows = rows.withColumn("state", F.lit(bytearray(START.tobytes())))
        else:
            rows = rows.withColumn("short", F.col("g").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(state.select(F.col("g").alias("short"), "state"), "short")
        state = rows.select("g", "path", "state").mapInArrow(mix, "g long, state binary, lp double")
    return counts[depth].join(state.select("g", "lp"), "g")


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """Rows of ``rows(c, ...)`` with the largest counts, ``most`` at most: a histogram of counts finds the least one, no sort."""
    size = F.floor(16 * F.log2(F.col("c") + 1)).cast("int")
    least, n = None, 0
    for r in sorted(rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n + r.n > most:
            break
        least, n = r.size, n + r.n
    return rows.where(F.lit(False) if least is None else size >= least)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, fold: int = 7, held: int = 2,
    frequent: int = FREQUENT_WORDS, frequent_grams: int = FREQUENT_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score``, ``n_bytes``, ``bits_per_byte``.

    Rows whose crc32 of the id as text leaves ``held`` modulo ``fold`` are scored but not learnt from (a null
    id is learnt from). Null and empty texts are the end token alone. Repeated rows each give a row and are
    each counted. With nothing to learn from, every bit costs one bit. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == held, F.lit(False)).alias("held"))
    learn = rows.select("text", (~F.col("held")).alias("train"))
    words = cut(word_counts(learn))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    grams = cut(gram_scores(gram_counts(learn, depth), depth))
    top = _most_frequent(words, frequent).toArrow()
    top_grams = _most_frequent(grams, frequent_grams).select("g", "lp").toArrow()
    known = docs.sparkSession.sparkContext.broadcast((dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True)), gram_table(top_grams.column("g").to_numpy(), top_grams.column("lp").to_numpy())))
    floor = float(np.log10(n + v + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashed = known.value
        key = TaskContext.get().partitionId() << 40

        def looked_up(texts: list[bytes]) -> list[tuple]:
            """For each text its bytes, the sum of the known grams' scores, the other grams and their numbers."""
            code, lengths = _grams(texts, depth)
            lps, hit = look_up(code, *hashed)
            starts = np.cumsum(lengths) - lengths
            sums = np.add.reduceat(lps, starts, dtype=np.float64)
            rest = np.flatnonzero(~hit)
            cuts = np.searchsorted(rest, np.append(starts, len(code)))
            return [(int(lengths[i]), float(sums[i]), *np.unique(code[rest[cuts[i] : cuts[i + 1]]], return_counts=True)) for i in range(len(texts))]

        for batch in batches:
            out: list[tuple] = []
            waiting: list[bytes] = []
            found: list[tuple] = []
            size = 0
            for text in batch.column(1):
                own = tokens(text.as_py())
                waiting.append(coded(own, depth))
                size += len(waiting[-1])
                each = Counter(own)
                cs = np.array([table.get(w, -1) for w in each], np.float64)
                m = np.fromiter(each.values(), np.int64, len(each))
                far = cs < 0
                rare = [w for w, x in zip(each, far, strict=True) if x] if far.any() else []
                out.append((key, len(own), int(m[cs > 0].sum()), float((m[~far] * (np.log10(cs[~far] + 1) - floor)).sum()), rare, m[far].tolist()))
                key += 1
                if size >= CHUNK:
                    found += looked_up(waiting)
                    waiting, size = [], 0
            if waiting:
                found += looked_up(waiting)
            cols, more = list(zip(*out, strict=True)) if out else [[]] * 6, list(zip(*found, strict=True)) if found else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["key", "n_tokens", "known", "base", "rare", "times", "n_bytes", "lp", "grams", "gram_times"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, k) for x, k in zip([*cols, *more], kinds, strict=True))], ["id", "held", *names])

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, held boolean, key long, n_tokens long, known long, base double, rare array<binary>, times array<long>, n_bytes long, lp double, grams array<long>, gram_times array<long>"
    read_rows = cut(rows.select("id", "text", "held").mapInArrow(read, schema))
    rare = read_rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("key", F.col("z.rare").alias("word"), F.col("z.times").alias("m"))
    rest = rare.join(words, "word").groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * (F.log10(F.col("c") + 1) - floor)).alias("base2"))
    far = read_rows.select("key", F.explode(F.arrays_zip("grams", "gram_times")).alias("z")).select("key", F.col("z.grams").alias("g"), F.col("z.gram_times").alias("m"))
    tail = far.join(grams, "g").groupBy("key").agg(F.sum(F.col("m") * F.col("lp")).alias("lp2"))
    total = F.col("lp") + F.coalesce("lp2", F.lit(0.0))
    return read_rows.drop("rare", "times", "grams", "gram_times").join(rest, "key", "left").join(tail, "key", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), total.alias("score"), "n_bytes", (-total / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
