"""Version order as column expressions: keys whose text order is the scheme's order, ranges and their folds.

A key is null where a version doesn't parse, which callers must treat as unknown. Numbers of any length
are written as their length and digits, so comparing text compares them.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: The grammars of the public version formats.
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\z"
PEP440 = (
    r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\z"
)
GEM = r"^\s*(?:[0-9]+(?:\.[0-9A-Za-z]+)*(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)?\s*\z"


def _num(digits: Column) -> Column:
    n = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(n).cast("string"), 4, "0"), n)


def semver_key(version: Column) -> Column:
    part = lambda i: F.regexp_extract(version, SEMVER, i)
    ids = F.transform(F.split(part(4), r"\."), lambda x: F.when(x.rlike(r"^\d+\z"), F.concat(F.lit("0"), _num(x))).otherwise(F.concat(F.lit("1"), x)))
    tail = F.when(part(4) == "", F.lit("~")).otherwise(F.concat(F.lit("-"), F.array_join(ids, "!")))
    return F.when(version.rlike(SEMVER), F.concat(_num(part(1)), _num(part(2)), _num(part(3)), tail))


def go_key(version: Column) -> Column:
    return semver_key(F.regexp_replace(version, "^v", ""))


def pep440_key(version: Column) -> Column:
    v = F.lower(F.trim(version))
    part = lambda i: F.regexp_extract(v, PEP440, i)
    release = F.array_join(F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+\z", ""), r"\."), _num), ".")
    has_pre, has_post, has_dev = part(3) != "", (part(5) != "") | (part(6) != ""), part(8) != ""
    pre = (
        F.when(has_pre, F.concat(F.when(part(3).isin("a", "alpha"), "1").when(part(3).isin("b", "beta"), "2").otherwise("3"), _num(part(4))))
        .when(has_dev & ~has_post, F.lit("0"))
        .otherwise(F.lit("4"))
    )
    post = F.when(has_post, F.concat(F.lit("1"), _num(F.concat(part(5), part(7))))).otherwise(F.lit("0"))
    dev = F.when(has_dev, F.concat(F.lit("0"), _num(part(9)))).otherwise(F.lit("9"))
    local = F.transform(F.split(part(10), "[-_.]"), lambda x: F.when(x.rlike(r"^\d+\z"), F.concat(F.lit("1"), _num(x))).otherwise(F.concat(F.lit("0"), x)))
    tail = F.when(part(10) == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.array_join(local, "!")))
    return F.when(v.rlike(PEP440), F.concat(_num(part(1)), F.lit("."), release, F.lit(" "), pre, F.lit(" "), post, F.lit(" "), dev, tail))


def gem_key(version: Column) -> Column:
    v = F.lower(F.regexp_replace(F.trim(version), "-", ".pre."))
    tokens = F.regexp_extract_all(F.when(v == "", F.lit("0")).otherwise(v), F.lit("[0-9]+|[a-z]+"), F.lit(0))
    coded = F.array_join(F.transform(tokens, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("c"), _num(x))).otherwise(F.concat(F.lit("a"), x, F.lit("!")))), "")
    zeros = F.regexp_replace(F.regexp_replace(coded, r"(c0000)+(?=a)", ""), r"(c0000)+\z", "")
    return F.when(version.rlike(GEM), F.concat(zeros, F.lit("b")))


def version_key(scheme: Column, version: Column) -> Column:
    """The key of a version under ``pep440``, ``semver``, ``go`` or ``rubygems``; null for other schemes (Maven: ``maven_compare``)."""
    return F.when(scheme == "pep440", pep440_key(version)).when(scheme == "semver", semver_key(version)).when(scheme == "go", go_key(version)).when(scheme == "rubygems", gem_key(version))


#: Maven's qualifiers in order (the empty one is a release) and their other names.
MAVEN_ORDER = ["alpha", "beta", "milestone", "rc", "snapshot", "", "sp"]
MAVEN_ALIAS = {"ga": "", "final": "", "release": "", "cr": "rc"}
#: Names that stand for others only right before a digit.
MAVEN_SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}
_MAVEN_PIECE = re.compile(r"\d+|[^\d.\-]+|[.\-]")
#: Places in the order of one position: qualifiers, then numbers behind a hyphen, then numbers behind a dot.
_QUALIFIER, _HYPHEN, _DOT = 0, 1, 2


def maven_tokens(text: str) -> list[tuple[int, int, str]]:
    """A Maven version as comparable tokens (place, number or rank, text), trimmed as Maven's version order describes it.

    Dots, hyphens and changes between digits and letters part tokens (a change counts as a hyphen), nothing between two
    separators is 0. From the end, tokens that equal nothing are dropped at the end and in front of a hyphen or qualifier.
    """
    pieces = _MAVEN_PIECE.findall(text.strip().lower())
    tokens: list[tuple[int, int, str]] = []
    prefix, filled = _DOT, False
    for i, piece in enumerate(pieces):
        if piece in ".-":
            if not filled:
                tokens.append((prefix, 0, ""))
            prefix, filled = (_DOT if piece == "." else _HYPHEN), False
            continue
        if filled:
            prefix = _HYPHEN
        if piece.isdigit():
            tokens.append((prefix, int(piece), ""))
        else:
            before_digit = i + 1 < len(pieces) and pieces[i + 1].isdigit()
            name = MAVEN_SHORT.get(piece, piece) if before_digit else piece
            name = MAVEN_ALIAS.get(name, name)
            tokens.append((_QUALIFIER, MAVEN_ORDER.index(name), "") if name in MAVEN_ORDER else (_QUALIFIER, len(MAVEN_ORDER), name))
        filled = True
    if not filled:
        tokens.append((prefix, 0, ""))
    kept: list[tuple[int, int, str]] = []
    for token in reversed(tokens):
        if token == _maven_nothing(token) and (not kept or kept[-1][0] != _DOT):
            continue
        kept.append(token)
    return kept[::-1]


def _maven_nothing(beside: tuple[int, int, str]) -> tuple[int, int, str]:
    """What a missing token counts as where the other version has ``beside``."""
    return (_QUALIFIER, MAVEN_ORDER.index(""), "") if beside[0] == _QUALIFIER else (beside[0], 0, "")


def maven_order(a: str | None, b: str | None) -> int | None:
    """-1, 0 or 1; null if either is null or blank. Pairwise, as no order-preserving key covers its mixed lists."""
    if not a or not b or not a.strip() or not b.strip():
        return None
    left, right = maven_tokens(a), maven_tokens(b)
    for i in range(max(len(left), len(right))):
        x = left[i] if i < len(left) else _maven_nothing(right[i])
        y = right[i] if i < len(right) else _maven_nothing(left[i])
        if x != y:
            return 1 if x > y else -1
    return 0


def maven_compare(a: Column, b: Column) -> Column:
    return F.arrow_udf(lambda x, y: pa.array([maven_order(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32()), IntegerType())(a, b)


def maven_places(version: str | None, others: list[str]) -> tuple[str | None, list[str | None]]:
    """Keys of ``version`` and ``others`` whose text order is their Maven order among themselves (they mean nothing elsewhere)."""
    known = [x for x in {version, *others} if x and x.strip()]
    ranked, place, before = {}, 0, None
    for x in sorted(known, key=functools.cmp_to_key(lambda p, q: maven_order(p, q) or 0)):
        place += before is not None and maven_order(before, x) != 0
        ranked[x], before = f"{place:09d}", x
    return ranked.get(version), [ranked.get(x) for x in others]


def maven_local_keys(version: Column, others: Column) -> Column:
    """``maven_places`` over columns as a struct (own, keys); nulls in ``others`` (no array) give null."""
    kind = pa.struct([("own", pa.string()), ("keys", pa.list_(pa.string()))])

    def places(v: pa.Array, o: pa.Array) -> pa.Array:
        rows = (None if y is None else maven_places(x, y) for x, y in zip(v.to_pylist(), o.to_pylist(), strict=True))
        return pa.array([None if r is None else {"own": r[0], "keys": r[1]} for r in rows], kind)

    return F.arrow_udf(places, StructType([StructField("own", StringType()), StructField("keys", ArrayType(StringType()))]))(version, others)


_TERM = re.compile(r"^(\^|~>?|>=|<=|>|<|=)?\s*v?(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:\+[0-9A-Za-z.-]+)?$")


def npm_intervals(text: str | None) -> list[dict] | None:
    """Alternatives of an npm range as intervals of release versions; null if it holds anything else (tags, URLs, prereleases)."""
    if text is None:
        return None

    def text_of(v: list[int]) -> str:
        return ".".join(map(str, v))

    def term(op: str, nums: list[int]) -> tuple[list[int] | None, bool, list[int] | None, bool] | None:
        low = nums + [0] * (3 - len(nums))

        def bump(at: int) -> list[int]:
            return [*low[:at], low[at] + 1, *[0] * (2 - at)]

        if not nums:
            return (None, False, None, False) if op in ("", "=", ">=", "<=", "^", "~", "~>") else None
        end = bump(len(nums) - 1)
        if op == "^":
            first = next((i for i, n in enumerate(nums) if n), len(nums) - 1)
            return low, True, bump(first), False
        if op in ("~", "~>"):
            return low, True, bump(min(1, len(nums) - 1)), False
        if op == ">":
            return (low, False, None, False) if len(nums) == 3 else (end, True, None, False)
        if op == ">=":
            return low, True, None, False
        if op == "<":
            return None, False, low, False
        if op == "<=":
            return (None, False, low, True) if len(nums) == 3 else (None, False, end, False)
        return (low, True, low, True) if len(nums) == 3 else (low, True, end, False)

    out = []
    for alternative in text.split("||"):
        alternative = alternative.strip()
        if m := re.match(r"^(\S+)\s+-\s+(\S+)$", alternative):
            alternative = f">={m[1]} <={m[2]}"
        alternative = re.sub(r"(\^|~>?|>=|<=|>|<|=)\s+", r"\1", alternative)
        low = high = None
        low_in = high_in = False
        for t in alternative.split() or ["*"]:
            m = _TERM.match(t)
            if not m:
                return None
            nums: list[int] = []
            for x in m.groups()[1:]:
                if x is None or x in "xX*":
                    break
                nums.append(int(x))
            got = term(m[1] or "", nums)
            if got is None:
                return None
            lo, lo_in, hi, hi_in = got
            if lo is not None and (low is None or lo > low or lo == low and not lo_in):
                low, low_in = lo, lo_in
            if hi is not None and (high is None or hi < high or hi == high and not hi_in):
                high, high_in = hi, hi_in
        out.append({"lo": low and text_of(low), "lo_inclusive": low_in, "hi": high and text_of(high), "hi_inclusive": high_in})
    return out


INTERVALS = ArrayType(StructType([StructField("lo", StringType()), StructField("lo_inclusive", BooleanType()), StructField("hi", StringType()), StructField("hi_inclusive", BooleanType())]))


def npm_ranges(text: Column) -> Column:
    """``npm_intervals`` over a column, once for each distinct text of a batch."""

    def ranges(col: pa.Array) -> pa.Array:
        known: dict[str | None, list[dict] | None] = {}
        texts = col.to_pylist()
        for t in texts:
            if t not in known:
                known[t] = npm_intervals(t)
        return pa.array([known[t] for t in texts], pa.list_(pa.struct([("lo", pa.string()), ("lo_inclusive", pa.bool_()), ("hi", pa.string()), ("hi_inclusive", pa.bool_())])))

    return F.arrow_udf(ranges, INTERVALS)(text)


def keyed_intervals(ranges: Column, key=semver_key) -> Column:
    """Bounds of intervals as keys; null bounds stay open."""
    return F.transform(ranges, lambda r: F.struct(key(r["lo"]).alias("lo"), r["lo_inclusive"].alias("lo_inclusive"), key(r["hi"]).alias("hi"), r["hi_inclusive"].alias("hi_inclusive")))


def intersect(a: Column, b: Column) -> Column:
    """Non-empty intersections of two arrays of keyed intervals; empty: no version satisfies both. Null if either is null.

    Both must be columns of the table, as Spark takes no Python function inside a lambda.
    """

    def meet(x: Column, y: Column) -> Column:
        lo = F.when(x["lo"].isNull(), y["lo"]).when(y["lo"].isNull(), x["lo"]).otherwise(F.greatest(x["lo"], y["lo"]))
        hi = F.when(x["hi"].isNull(), y["hi"]).when(y["hi"].isNull(), x["hi"]).otherwise(F.least(x["hi"], y["hi"]))
        lo_in = F.when(x["lo"].eqNullSafe(y["lo"]), x["lo_inclusive"] & y["lo_inclusive"]).when(lo.eqNullSafe(x["lo"]), x["lo_inclusive"]).otherwise(y["lo_inclusive"])
        hi_in = F.when(x["hi"].eqNullSafe(y["hi"]), x["hi_inclusive"] & y["hi_inclusive"]).when(hi.eqNullSafe(x["hi"]), x["hi_inclusive"]).otherwise(y["hi_inclusive"])
        return F.struct(lo.alias("lo"), lo_in.alias("lo_inclusive"), hi.alias("hi"), hi_in.alias("hi_inclusive"))

    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: meet(x, y))))
    return F.filter(both, lambda r: r["lo"].isNull() | r["hi"].isNull() | (r["lo"] < r["hi"]) | ((r["lo"] == r["hi"]) & r["lo_inclusive"] & r["hi_inclusive"]))


def valid_events(events: Column) -> Column:
    """Whether events (array of (boundary, kind)) make a range: something is introduced, fixed and last_affected don't mix, and
    no boundary has two kinds. A null boundary counts as one boundary; limits stand apart."""
    own = F.filter(events, lambda e: e["kind"] != "limit")
    has = lambda kind: F.exists(own, lambda e: e["kind"] == kind)
    distinct = F.size(F.array_distinct(F.transform(own, lambda e: F.struct(e["boundary"].alias("boundary"), e["kind"].alias("kind")))))
    known = F.forall(events, lambda e: e["kind"].isin("introduced", "fixed", "last_affected", "limit"))
    return known & has("introduced") & ~(has("fixed") & has("last_affected")) & (distinct == F.size(F.array_distinct(F.transform(own, lambda e: F.coalesce(e["boundary"], F.lit(""))))))


def event_state(events: Column, version: Column) -> Column:
    """Whether ``version`` is affected after ``events`` (array of (boundary, kind)) in order; all three are in one order's terms.

    A null boundary lies before every version. introduced opens, fixed closes at its boundary, last_affected after it. Where
    there are limits, the version must also lie before one of them; a limit with a null boundary has no end.
    """
    own, limits = F.filter(events, lambda e: e["kind"] != "limit"), F.filter(events, lambda e: e["kind"] == "limit")
    ordered = F.array_sort(own, lambda a, b: F.when(a["boundary"].isNull() & b["boundary"].isNotNull(), -1).when(a["boundary"].isNotNull() & b["boundary"].isNull(), 1).when(a["boundary"] < b["boundary"], -1).when(a["boundary"] > b["boundary"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))

    def step(state: Column, e: Column) -> Column:
        reached = e["boundary"].isNull() | (e["boundary"] <= version)
        return F.when(reached & (e["kind"] == "introduced"), True).when(reached & (e["kind"] == "fixed"), False).when(reached & (e["kind"] == "last_affected") & (version > e["boundary"]), False).otherwise(state)

    within = (F.size(limits) == 0) | F.exists(limits, lambda e: e["boundary"].isNull() | (version < e["boundary"]))
    return F.aggregate(ordered, F.lit(False), step) & within


def cargo_ranges(text: Column) -> Column:
    """Cargo requirements as intervals: comma-separated terms all hold, a bare version is a caret term."""
    bare = F.regexp_replace(text, r"(^|,)\s*(?=\d)", "$1^")
    return npm_ranges(F.regexp_replace(F.regexp_replace(bare, r"([<>=~^])\s+", "$1"), ",", " "))


def maven_range(text: Column) -> Column:
    """A Maven range as (lo, lo_inclusive, hi, hi_inclusive) in version text; ``[1]`` is one version; null if it is no single range."""
    rule = r"^\s*([\[(])\s*([^,\[\]()]*?)\s*(,?)\s*([^,\[\]()]*?)\s*([\])])\s*\z"
    part = lambda i: F.regexp_extract(text, rule, i)
    lo, hi = F.nullif(F.when(part(3) == "", part(4)).otherwise(part(2)), F.lit("")), F.nullif(part(4), F.lit(""))
    return F.when(text.rlike(rule) & ((part(3) != "") | (part(2) == "")), F.struct(lo.alias("lo"), (part(1) == "[").alias("lo_inclusive"), hi.alias("hi"), (part(5) == "]").alias("hi_inclusive")))


def poetry_specifier(text: Column) -> Column:
    """Poetry's caret and tilde terms as a PEP 440 specifier; other terms stay as they are."""
    number = r"(\d+)(?:\.(\d+))?(?:\.(\d+))?"
    rule = rf"^\s*([\^~])\s*{number}\s*\z"
    n = [F.regexp_extract(text, rule, i) for i in (2, 3, 4)]
    full = F.concat_ws(".", *[F.nullif(x, F.lit("")) for x in n])
    up = lambda c: (c.cast("long") + 1).cast("string")
    caret = (
        F.when((n[0] != "0") | (n[1] == ""), up(n[0])).when((n[1] != "0") | (n[2] == ""), F.concat(n[0], F.lit("."), up(n[1])))
        .otherwise(F.concat(n[0], F.lit("."), n[1], F.lit("."), up(n[2])))
    )
    tilde = F.when(n[1] == "", up(n[0])).otherwise(F.concat(n[0], F.lit("."), up(n[1])))
    return F.when(text.rlike(rule), F.concat(F.lit(">="), full, F.lit(",<"), F.when(F.regexp_extract(text, rule, 1) == "^", caret).otherwise(tilde))).otherwise(text)
