"""Checks and projections of single values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public formats of identifiers and coordinates.
CVE = r"^CVE-[0-9]{4}-[0-9]{4,19}\z"
CWE = r"^CWE-[1-9][0-9]{0,9}\z"
MAVEN_COORDINATE = r"^[A-Za-z0-9_][A-Za-z0-9_.\-]*:[A-Za-z0-9_][A-Za-z0-9_.\-]*\z"
NPM_NAME = r"^(?:@[a-z0-9~][a-z0-9._~\-]*/)?[a-z0-9~][a-z0-9._~\-]*\z"
RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,30}))?Z\z"


def identifier_kind(text: Column) -> Column:
    """``CVE`` or ``CWE`` where a whole text is one, else null."""
    return F.when(text.rlike(CVE), "CVE").when(text.rlike(CWE), "CWE")


def maven_coordinate(text: Column) -> Column:
    return text.rlike(MAVEN_COORDINATE)


def npm_name(text: Column) -> Column:
    """Whether a text is an npm package name: lower case, at most 214 characters, a scope of one segment."""
    return text.rlike(NPM_NAME) & (F.length(text) <= 214)


def rfc3339(text: Column) -> Column:
    """(at, fraction): the whole second in UTC and the exact fraction as a decimal; null for other forms and impossible dates."""
    at = F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_extract(text, RFC3339, 1), "T", " "), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    fraction = F.concat(F.lit("0."), F.when(F.regexp_extract(text, RFC3339, 2) == "", "0").otherwise(F.regexp_extract(text, RFC3339, 2))).cast("decimal(31,30)")
    return F.when(text.rlike(RFC3339) & at.isNotNull(), F.struct(at.alias("at"), fraction.alias("fraction")))


def age_seconds(at: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(at)


def staleness(at: Column, now: Column, most: int) -> Column:
    """``fresh``, ``stale`` (older than ``most`` seconds), ``future`` or ``unknown`` (no time)."""
    age = age_seconds(at, now)
    return F.when(age.isNull(), "unknown").when(age < 0, "future").when(age > most, "stale").otherwise("fresh")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space; null for what isn't JSON or has a key twice."""
    return F.to_json(F.try_parse_json(text))


def strict_json(text: Column) -> Column:
    """A struct (value, problem): strict JSON refuses duplicate keys, numbers that aren't finite and lone surrogates."""
    value = F.try_parse_json(text)
    lone = text.rlike(r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})") | text.rlike(r"(?i)(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}")
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', '""')  # what strings say is no number
    endless = bare.rlike(r"(^|[\[:,\s])-?(NaN|Infinity)\b")
    problem = F.when(text.isNull(), "json.missing").when(endless, "json.not-finite").when(value.isNull(), "json.invalid").when(lone, "json.not-unicode")
    return F.struct(F.when(problem.isNull(), F.to_json(value)).alias("value"), problem.alias("problem"))


def bounded(json: Column, most: int = 16384) -> Column:
    """JSON up to ``most`` characters as it is, longer JSON as its size and hash."""
    short = F.to_json(F.struct(F.lit(True).alias("omitted"), F.length(json).alias("length"), F.sha2(json, 256).alias("sha256")))
    return F.when(F.length(json) > most, short).otherwise(json)


def shell_words(command: Column) -> Column:
    """Words of a simple command, quotes taken off; null where it holds operators, expansions or an open quote."""
    words = F.regexp_extract_all(command, F.lit(r"""((?:[^\s'"]|'[^']*'|"[^"]*")+)"""), F.lit(1))
    simple = ~command.rlike(r"[|&;<>`$(){}\\]") & F.regexp_replace(command, r"""'[^']*'|"[^"]*\"""", "").rlike(r"""^[^'"]*\z""")
    return F.when(simple, F.transform(words, lambda w: F.regexp_replace(w, "['\"]", "")))


def executable(words: Column) -> Column:
    """The program of a command's words, behind assignments and ``npx``."""
    rest = F.filter(words, lambda w: ~w.rlike(r"^[A-Za-z_]\w*=") & (w != "npx"))
    return F.try_element_at(rest, F.lit(1))


def inside(path: Column) -> Column:
    """A relative path without ``.`` and doubled separators; null where it leaves its root or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda s, p: F.when(s.isNull(), s).when(p != "..", F.concat(s, F.array(p))).when(F.size(s) > 0, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~path.rlike(r"^(/|[A-Za-z]:)"), F.when(F.size(kept) == 0, F.lit(".")).otherwise(F.array_join(kept, "/")))


def registry_origin(url: Column) -> Column:
    """A struct (kind, public) of where a package comes from: the public indexes by their exact address, other addresses private."""
    bare = F.regexp_replace(url, r"/+\z", "")
    public = bare.isin("https://pypi.org/simple", "https://registry.npmjs.org", "https://registry.yarnpkg.com", "https://repo.maven.apache.org/maven2", "https://proxy.golang.org", "https://index.crates.io", "https://rubygems.org")
    kind = F.when(url.isNull(), "unknown").when(url.rlike(r"^(git\+|git://|ssh://|git@)"), "git").when(url.rlike(r"^(file:|\.{0,2}/)"), "path").when(url.rlike(r"^https?://"), "registry").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.coalesce((kind == "registry") & public, F.lit(False)).alias("public"))


def licenses(component: Column) -> Column:
    """Distinct sorted licences of an SBOM component's ``licenses`` (array of (expression, license (id, name)))."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(component, lambda x: F.coalesce(x["expression"], x["license"]["id"], x["license"]["name"])))))
