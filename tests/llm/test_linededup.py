from collections import defaultdict

import pytest

from lodestrata.llm import linededup

SCHEMA = "doc_id long, text string, source string, text_hash int, gone_ int, id_ string"
LINE, NEAR = "a boilerplate line that is long enough", "a line on exactly the threshold of sites"


def brute(docs, min_sites=3, min_chars=20):
    sites, first = defaultdict(set), {}
    for i, t, s in docs:
        for p, line in enumerate(t.split("\n")) if t is not None else ():
            if len(x := line.strip(" ")) >= min_chars:
                if s is not None:
                    sites[x].add(s)
                key = ((i is not None, i), p)
                first[x] = min(first.get(x, key), key)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, t, _ in docs:
        if t is None:
            out.append((i, None))
        else:
            out.append((i, "\n".join(x for p, x in enumerate(t.split("\n")) if not (x.strip(" ") in bad and first[x.strip(" ")] != ((i is not None, i), p)))))
    return sorted(out, key=repr)


def docs():
    rows = [(i, f"own text number {i} of this document\n  {LINE} \nshort\n", f"s{i % 5}") for i in range(12)]
    rows += [(20 + i, f"{NEAR}\nother text {i} of some length here", f"t{i}") for i in range(3)] + [(30 + i, "a line on two sites only, as it happens", f"t{i % 2}") for i in range(9)]
    return [*rows, (40, None, "s1"), (41, "", "s2"), (42, LINE, None), (None, f"{LINE}\nnull id text of some length", "s9"), (44, "short\nshort", "s3"), (45, f"{LINE}\n{LINE}", "s1")]


@pytest.mark.parametrize("limit", [linededup.BROADCAST_LINES, 0])
def test_equals_brute_force(spark, limit):
    rows = docs()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = linededup.drop_boilerplate(df, min_sites=3, broadcast_lines=limit)
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(rows)


def test_counts_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, f"{LINE}\nx", f"s{i}", 1, 2, "x") for i in range(4)] + [(2, f"{LINE}\ny", "s0", 1, 2, "x")], SCHEMA)
    got = linededup.drop_boilerplate(df, min_sites=3, removed_col="n").collect()
    assert sorted((r.doc_id, r.text, r.n) for r in got) == [(1, f"{LINE}\nx", 0)] * 4 + [(2, "y", 1)]
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


def test_many_sites_go_by_sketch(spark):
    rows = [(i, f"{LINE}\nowntext of document {i} here", f"site{i}", 1, 2, "x") for i in range(300)]
    got = linededup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=100, removed_col="n").collect()
    assert sum(r.n for r in got) == 299


def test_long_passage_under_a_hot_source_goes_at_the_default_threshold(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    hot = [(i, f"{passage}\nown text number {i} of this document", "hot" if i < 12 else f"s{i}", 1, 2, "x") for i in range(20)]
    copies = [(100 + i, "a line of a document that was copied to four sources", f"c{i}", 1, 2, "x") for i in range(4)]
    got = linededup.drop_boilerplate(spark.createDataFrame(hot + copies, SCHEMA), removed_col="n").collect()
    assert {r.doc_id: r.n for r in got} == {i: int(0 < i < 20) for i in [*range(20), *range(100, 104)]}
    assert [r.doc_id for r in got if passage in r.text] == [0]
