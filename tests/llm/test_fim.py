import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import fim

SCHEMA = "doc_id long, text string, n int, output string, T string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA)


def brute(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_equals_brute_force_and_restores_every_text(spark):
    odd = ["", None, "a", "\r\n\n", "é世🤦🏼‍♂️" * 9, "<P>", "x<M>y", "<", "<S", "P>", "<<S>", "a<P", "<M<", ">", " \t", "same", "same", "\x00 ́"]
    rows = [(i, odd[i % len(odd)]) for i in range(400)] + [(None, "no id"), (5, "twice"), (5, "twice"), (10**18, "big"), (-3, "minus"), (900, "long " * 60_000)]
    got = fim.transform(frame(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted((key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got)) == sorted(key((i, *brute(i, t))) for i, t in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    d = fim.digests(frame(spark, [(3, "abc")])).first()
    assert d.output_sha256 == hashlib.sha256(brute(3, "abc")[4].encode()).hexdigest() and d.restored_sha256 == hashlib.sha256(b"abc").hexdigest()


def test_empty_table_and_other_units(spark):
    assert fim.transform(frame(spark, []), unit=r"\S+").count() == 0
    rows = [(i, " one  two\nthree four ") for i in range(60)]
    got = fim.transform(frame(spark, rows), unit=r"\S+", plain_percent=0, suffix_first_percent=0, marks=("[p]", "{s}", "(m)")).collect()
    ends = {0, 4, 9, 15, 20}
    assert all(r.n == 4 and r.form == "psm" and r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends for r in got) and len({r.output for r in got}) > 5
    again = spark.createDataFrame(got).select(fim.restored(F.col("output"), F.col("form"), ("[p]", "{s}", "(m)")).alias("t")).distinct().collect()
    assert [r.t for r in again] == [rows[0][1]]
    with pytest.raises(ValueError):
        fim.transform(frame(spark, rows), marks=("<P>", "<S>", "P>"))


def test_matches_are_never_stored():
    class Counting:
        def __init__(self):
            self.live = self.most = 0

        def finditer(self, text):
            for m in re.compile(fim.CODE_POINT).finditer(text):
                self.live += 1
                yield m

    c = Counting()
    assert fim.count_units(c, "abc" * 1000) == 3000 and c.live == 3000
    c = Counting()
    assert fim.cut_points(c, "abc" * 1000, 10, 25) == (10, 25) and c.live == 25  # nothing is matched behind the second rank
    assert fim.cut_points(c, "abc", 0, 0) == (0, 0) and fim.cut_points(c, "abc", 2, 2) == (2, 2) and fim.cut_points(c, "abc", 0, 3) == (0, 3)
