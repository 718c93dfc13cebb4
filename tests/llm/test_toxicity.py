import random
import zlib

from lodestrata.llm import toxicity

SCHEMA = "doc_id long, text string, y double, x int, id string, c_0 int"


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("ban", "der", "fin", "gol")]
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "grumfol", "scum"]))
        rows.append((i, " ".join(text), 0.0, 1, "z", 2))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    extra = [(None, "null id", 0.0, 1, "z", 2), (1000, None, 0.0, 1, "z", 2), (1001, "", 0.0, 1, "z", 2), (0, rows[0][1], 0.0, 1, "z", 2), (1002, "x " * 50_000 + "idiot", 0.0, 1, "z", 2)]
    df, marks = spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None), (0, labels[0][1])], "doc_id long, toxic int")
    got = toxicity.score(df, marks).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(df, flipped).collect() if r.doc_id is not None}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id is not None)  # held-out labels aren't read
    kept = toxicity.drop_toxic(df, marks)
    gone = {r.doc_id for r in got if r.predicted}
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got) and not gone & {r.doc_id for r in kept.select("doc_id").collect()}


def test_one_class_no_labels_and_empty(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows[:20], SCHEMA)
    for marks in ([], [(i, 0) for i in range(20)]):
        got = toxicity.score(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
        assert len(got) == 20 and len({r.score for r in got}) == 1
    assert toxicity.score(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_features_see_obfuscation_and_the_reader():
    plain, veiled, near = (toxicity.features(t, {}) for t in ("a calm note about the day", "such an id1ot and m0r0n", "you are an idiot"))
    assert len(plain) == toxicity.N_FEATURES and plain[1] == 0 and veiled[14] > plain[14] and near[7] > 0 and toxicity.features(None, {}) == [0.0] * toxicity.N_FEATURES
