"""Where keys and sections stand in JSON and INI texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from .manifests import _rows

#: A JSON token: a string, a mark, or a bare value.
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')


def _json_keys(text: str) -> list[tuple]:
    json.loads(text)  # what isn't JSON has no positions
    out: list[tuple] = []
    stack: list[list] = []  # kind, name or index of the entry at hand
    tokens = list(_TOKEN.finditer(text))
    for i, m in enumerate(tokens):
        t = m[0]
        if t in "{[":
            stack.append([t, 0 if t == "[" else None])
        elif t in "}]":
            stack.pop()
        elif t == "," and stack[-1][0] == "[":
            stack[-1][1] += 1
        elif t[0] == '"' and stack and stack[-1][0] == "{" and i + 1 < len(tokens) and tokens[i + 1][0] == ":" and (i == 0 or tokens[i - 1][0] in "{,"):
            stack[-1][1] = json.loads(t)
            path = "".join(f"[{x}]" if k == "[" else f".{x}" for k, x in stack)
            out.append((text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start()), path))
    return out


def json_keys(files: DataFrame) -> DataFrame:
    """``(path, line, column, key, problem)`` of the keys of JSON texts, from 1; ``key`` is the way from the root, as ``.a[0].b``."""
    rows = _rows(files, "line int, column string, key string", ["line", "column", "key"], lambda text: [(n, str(c), k) for n, c, k in _json_keys(text)])
    return rows.withColumn("column", rows["column"].cast("int"))


def _ini(text: str) -> list[tuple]:
    out, section = [], ""
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\[([^\]]+)\]", line):
            section = m[1]
            out.append((n, section, None))
        elif (m := re.match(r"([^\s#;=:\[][^=:]*?)\s*[=:]", line)) and section:
            out.append((n, section, m[1].strip().lower()))
    return out


def ini_keys(files: DataFrame) -> DataFrame:
    """``(path, line, section, key, problem)`` of the sections (key null) and keys of INI texts; indented lines go on with the value before."""
    return _rows(files, "line int, section string, key string", ["line", "section", "key"], _ini)
