"""Fill-in-middle texts: cut a text into prefix, middle and suffix and write them in an order that a model learns to fill.

A text's units (code points, or the matches of any pattern) are matched twice by a lazy iterator: the first pass counts
them, the second stops at the two ranks where the text is cut. Neither keeps a unit, so memory doesn't grow with
their number. Only the two cut points come from Python; draws, forms, outputs and the way back are Spark expressions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line ends included.
CODE_POINT = r"(?s:.)"
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain; of a hundred others so many have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20


def count_units(unit: re.Pattern, text: str) -> int:
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def cut_points(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Where the ``first``-th and the ``second``-th unit end (``first <= second``; 0: before the text)."""
    matches: Iterator[re.Match] = unit.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


def _cutter(pattern: str):
    @F.pandas_udf("n long, a long, b long")
    def cutter(text: pd.Series, draw1: pd.Series, draw2: pd.Series) -> pd.DataFrame:
        unit, out = re.compile(pattern), []
        for t, x, y in zip(text, draw1, draw2, strict=True):
            n = count_units(unit, t)
            out.append((n, *cut_points(unit, t, *sorted((x % (n + 1), y % (n + 1))))))
        return pd.DataFrame(out, columns=["n", "a", "b"])

    return cutter


def _checked(marks: tuple[str, str, str]) -> None:
    if len(set(marks)) != 3 or not all(marks) or any(c in m[1:] for c in {m[0] for m in marks} for m in marks):
        raise ValueError("marks must differ, and none may hold the first character of a mark behind its own first")


def transform(docs: DataFrame, seed: int = 1, unit: str = CODE_POINT, marks: tuple[str, str, str] = MARKS, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output`` of each row.

    Draws are the first four groups of eight hex digits of the sha256 of ``seed:doc_id``, so they don't depend on
    how rows are dealt out. The prefix ends after the smaller, the middle after the larger of two drawn numbers of
    units; what follows is the suffix. ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle). Texts that are empty or hold a mark are plain.

    A null text is empty; a null id draws as an empty one; repeated ids draw the same; an empty table gives an empty
    result. Other columns are left out, so their names can't clash.
    """
    _checked(marks)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"), *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)))
    cut = rows.withColumn("c", _cutter(unit)("t", "h1", "h2"))
    a, b = F.col("c.a").cast("int"), F.col("c.b").cast("int")
    plain = (F.col("t") == "") | (F.col("h3") % 100 >= 100 - plain_percent)
    for m in marks:
        plain = plain | F.contains("t", F.lit(m))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first_percent, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring("t", F.lit(1), a), F.substring("t", a + 1, b - a), F.substring("t", b + 1, F.length("t") - b)
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    told = F.col("form") != "plain"
    return cut.withColumn("form", form).select("doc_id", F.col("c.n").alias("n"), "form", F.when(told, a.cast("long")).alias("prefix_chars"), F.when(told, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from, read off the marks alone. Null where either is null.

    A mark's first character stands in no mark but at its start, so a mark that is found is one that was written.
    """
    _checked(marks)
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        j = F.position(F.lit(second), output)
        k = F.position(F.lit(m), output)
        return F.substring(output, F.lit(len(first) + 1), j - 1 - len(first)), F.substring(output, j + len(second), k - j - len(second)), F.substring(output, k + len(m), F.length(output))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2))


def digests(docs: DataFrame, **options) -> DataFrame:
    """``transform``'s numbers and form with the sha256 of its output and of the text restored from output and form."""
    made = transform(docs, **options)
    back = restored(F.col("output"), F.col("form"), options.get("marks", MARKS))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = """
with t as (select doc_id, coalesce(text, '') x, length(coalesce(text, '')) n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
d as (select *, cast('0x' || h[1:8] as bigint) % (n + 1) r1, cast('0x' || h[9:16] as bigint) % (n + 1) r2,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 90 then 'plain' when cast('0x' || h[25:32] as bigint) % 100 < 20 then 'spm' else 'psm' end form from t),
c as (select *, least(r1, r2) a, greatest(r1, r2) b from d)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars, sha256(case form when 'plain' then x
  when 'psm' then '<P>' || substr(x, 1, a) || '<S>' || substr(x, b + 1) || '<M>' || substr(x, a + 1, b - a) else '<S>' || substr(x, b + 1) || '<P>' || substr(x, 1, a) || '<M>' || substr(x, a + 1, b - a) end) output_sha256,
  sha256(x) restored_sha256 from c
"""
