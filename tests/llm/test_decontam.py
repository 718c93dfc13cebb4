import hashlib
import re

import pytest

from lodestrata.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, w string, id int, span string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        own = words(t)
        n = min(13, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[s : s + n]:
                    hit.update(range(at, at + n))
                    found.add(str(i))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


ITEM = " ".join(f"item{i}" for i in range(30))
ITEMS = [(10, ITEM), (2, ITEM.upper() + " tail"), (3, "short item here"), (4, "..."), (5, None), (6, "éa ÉA"), (7, "of " * 20), (None, ITEM), (8, "")]
FILL = " ".join(f"fill{i}" for i in range(100))
TEXTS = [
    f"{FILL} {ITEM} {FILL}", " ".join(ITEM.split()[:13]), " ".join(ITEM.split()[:12]), f"x {' '.join(ITEM.split()[5:20])}, y", "a SHORT-item.here b", "éa ÉA éa éa", "of " * 100, "of " * 12, None, "", "!!!",
    f"{' '.join(ITEM.split()[:15])} {' '.join(ITEM.split()[10:28])}", f"{FILL} short item here {FILL} {FILL}",
]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_equals_brute_force(spark, limit):
    docs = [(i, t, "w", 1, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "w", 1, "s"), (1, TEXTS[1], "w", 1, "s")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(docs, DOCS), bench, broadcast_windows=limit).collect()
    items = [(i, t) for i, t in ITEMS if i is not None]
    want = sorted([(str(d[0]), *brute(d[1], items)) for d in docs])
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_empty_tables_and_filter(spark):
    docs = spark.createDataFrame([(i, t, "w", 1, "s") for i, t in enumerate(TEXTS)], DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r.contaminated or r.n_hit for r in clean)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    kept = decontam.drop_contaminated(docs, bench)
    items = [(i, t) for i, t in ITEMS if i is not None]
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if not brute(t, items)[4]}


def test_plan_has_no_python(spark, capsys):
    docs = spark.createDataFrame([(1, "a", "w", 1, "s")], DOCS)
    decontam.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).explain()
    assert not re.search("Python|Pandas|ArrowEval", capsys.readouterr().out)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_items_with_a_null_id_hit_words(spark, limit):
    bench = spark.createDataFrame([(None, ITEM), (None, "two words"), (7, "another item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {ITEM} y", "w", 1, "s"), (2, "two words and another item", "w", 1, "s"), (3, FILL, "w", 1, "s")], DOCS)
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, bench, broadcast_windows=limit).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (30, 0, sha(""), True), 2: (4, 1, sha("7"), True), 3: (0, 0, sha(""), False)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [3]


def test_beyond_the_bounds_runs_of_windows_are_joined_and_nothing_is_broadcast(spark, monkeypatch):
    cut, plans, joined = decontam.cut, [], []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = cut(df)
        if "end" in out.columns:
            joined.append(out.count())
        return out

    monkeypatch.setattr(decontam, "cut", kept)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    docs = spark.createDataFrame([(i, t, "w", 1, "s") for i, t in enumerate(TEXTS)], DOCS)
    out = decontam.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast_windows=0, broadcast_marks=0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    items = [(i, t) for i, t in ITEMS if i is not None]
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == {i: brute(t, items) for i, t in enumerate(TEXTS)}
    assert not [p for p in plans if "Broadcast" in p]
    assert 0 < joined[0] < sum(len(words(t)) for t in TEXTS) / 4  # "of " * 100 is one row, not 88


def test_listed_characters_are_those_of_the_ranges(spark):
    text = " ".join(f"a{chr(c)}B" for c in [*range(0x180), 0x2028, 0xE000, 0xFFFF, 0x10000, 0x1F600])
    row = spark.createDataFrame([(text,)], "t string").select(decontam.words(decontam.F.col("t")).alias("w"), decontam.F.regexp_count("t", decontam.F.lit(decontam.ANY_WORD)).alias("n")).first()
    assert row.w == words(text) and row.n == len(row.w)
    assert "-" not in decontam.LISTED_WORD + decontam.ANY_WORD  # a range costs ten times a list
