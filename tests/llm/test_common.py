import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontam, linededup, simhash
from lodestrata.llm.common import hash_sample, without
from lodestrata.llm.components import components


@pytest.mark.parametrize("n,most,bits", [(1000, 20, 12), (1000, 20, 1), (1000, 1, 2), (1000, 1000, 12), (1000, 999, 3), (0, 5, 12)])
def test_samples_hold_between_one_and_the_bound(spark, n, most, bits):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("x"))
    got = {r.id for r in hash_sample(df, ["id"], most, bits).collect()}
    again = {r.id for r in hash_sample(df.repartition(7), ["id"], most, bits).collect()}
    assert got == again and (len(got) == n if n <= most else most // 2 <= len(got) <= most and len(got) >= 1)


def test_sample_of_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("id"))
    assert hash_sample(df, ["id"], 20).count() == 20


@pytest.mark.parametrize("most", [10, 0])
def test_without_matches_null_ids_and_clashing_names(spark, most):
    df = spark.createDataFrame([(1, "a", 1), (None, "b", 2), (1, "a", 3), (2, None, 4)], "id long, t string, gone_i int")
    gone = df.where("gone_i in (1, 2, 4)").select(F.col("id").alias("i"), F.xxhash64("t").alias("h"))
    left = without(df, gone, "id", F.xxhash64("t"), most)
    assert left.columns == df.columns and left.count() == 0
    assert sorted(r.gone_i for r in without(df, gone.where("i = 2"), "id", F.xxhash64("t"), most).collect()) == [1, 2, 3]


def test_links_of_large_keys_give_the_components_of_all_pairs(spark):
    base = 0x0123456789ABCDEF
    values = {base ^ (1 << i) for i in range(60)} | {base ^ (1 << i) ^ (1 << j) for i in range(0, 50, 3) for j in range(i + 1, 50, 7)}
    values |= {base ^ 0x1F << s for s in range(0, 55, 5)} | {0x7F00FF00FF00FF00 ^ (1 << i) for i in range(5)} | {base ^ (0b111111 << s) for s in range(0, 50, 9)}
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    want = {r.node: r.root for r in components(simhash.near_pairs(fps)).collect()}
    for large in (1, 4, 1000):
        links = simhash.near_links(fps, large=large)
        assert {r.node: r.root for r in components(links).collect()} == want
    few, all_pairs = simhash.near_links(fps, large=4).count(), simhash.near_pairs(fps).count()
    assert few < all_pairs


def test_the_pivot_table_discards_before_the_check(spark):
    fps = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    r = simhash.pivot_report(fps).first()
    assert r.candidates == r.discarded + r.survivors and r.verified <= r.survivors < 0.01 * r.candidates


def test_segments_follow_the_number_of_fingerprints():
    for n, keys in ((10, 15), (2**23, 15), (2**24, 35), (2**29, 35), (2**30, 70), (2**34, 70), (2**40, 126)):
        segments = simhash.segments_for(n)
        m = len(segments)
        assert sum(w for _, w in segments) == 64 and {6: 15, 7: 35, 8: 70, 9: 126}[m] == keys


def test_very_long_texts_are_read_whole(spark):
    item = " ".join(f"bench{i}" for i in range(13))
    long = " ".join(f"w{i}" for i in range(120_000)) + f" {item}"
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        got = {r.doc_id: r for r in decontam.contamination(docs, bench, broadcast_windows=limit).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (120_013, 13, 1, False) and got[2].n_hit == 0
    line = "a line that stands on many sites of the corpus"
    lines = spark.createDataFrame([(i, "\n".join(f"own {i} {k} line of this text" for k in range(30_000)) + f"\n{line}", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    got = linededup.drop_boilerplate(lines, removed_col="n").select("doc_id", "n", F.substring_index("text", "\n", -1).alias("last")).collect()
    assert {r.doc_id: r.n for r in got} == {i: int(i > 0) for i in range(5)} and [r.doc_id for r in got if r.last == line] == [0]


def test_whole_texts_go_to_python_in_small_batches_and_settings_come_back(spark):
    from lodestrata.llm.common import BATCH_CONF, cut, small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = {k: spark.conf.get(k, None) for k in BATCH_CONF}
    rows = spark.range(0, 1200, 1, 1).selectExpr("repeat('x', 10) as text")
    with small_batches(spark):
        small = cut(rows.mapInArrow(sizes, "n long"))
    assert small.agg({"n": "sum"}).first()[0] == 1200 and max(r.n for r in small.collect()) <= 500
    assert {k: spark.conf.get(k, None) for k in BATCH_CONF} == before


def test_workers_give_memory_back_when_a_task_ends_or_is_given_up(monkeypatch):
    from lodestrata.llm import workers

    told = []
    monkeypatch.setattr(workers, "trim", lambda: told.append(1))
    assert list(workers.trimming(lambda parts: (2 * x for x in parts))(iter([1, 2]))) == [2, 4] and told == [1]
    given_up = workers.trimming(lambda parts: (x for x in parts))(iter([1, 2]))
    next(given_up)
    given_up.close()
    assert told == [1, 1]
