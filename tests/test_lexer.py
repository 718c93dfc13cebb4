"""The lexer's states: what holds no loads, stray and unclosed marks, long texts."""

import time

import pytest

from lodestrata.sources import lexer

from .test_sources import rows, table


@pytest.mark.parametrize(
    "text, language, wanted",
    [
        ("const r=/[`]/; import 'x'; const t=`a`", "JSX", [("x", "regular")]),
        ("a = b / c; d = e / f; import 'x'; const o = {a: 1} / 2; import z from 'z'; while (a) /'/.test(b); import 'w'", "JSX", [("w", "regular"), ("x", "regular"), ("z", "regular")]),
        ("const f = <T,>(x) => x; a < b; c > d; import 'q'", "JSX", [("q", "regular")]),
        ("<a><b c='import'/>it's {x ? <i>'</i> : require('y')}</a>; import 'q'", "JSX", [("q", "regular"), ("y", "regular")]),
        ("return <T>x; import 'q'", "JAVASCRIPT", [("q", "regular")]),
        ("x.return / 2; import 'q'; /3/", "JAVASCRIPT", [("q", "regular")]),
        ("a++ / 2; '/'; import 'q'", "JAVASCRIPT", [("q", "regular")]),
        ("import(a); import('b'); import(`c`)", "JAVASCRIPT", [(None, "computed"), ("b", "dynamic")]),
        ("))}}]] import 'q'", "JAVASCRIPT", [("q", "regular")]),
        ("import { a\nimport b from 'q'", "JAVASCRIPT", [("q", "regular")]),
        ("import ''", "JAVASCRIPT", []),
    ],
)
def test_loads(text, language, wanted):
    assert sorted({(r, k) for _, r, k in lexer.module_loads(text, language)}, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("piece", ["`${", "<a>", "/", "'", "{", "(", "#[[", "\\", "import ", "export {", "a b ", "((}", "){", "/[", "[[\n"])
def test_long_texts_take_linear_time(piece):
    start = time.monotonic()
    for language in ("JAVASCRIPT", "JSX", "GRADLE", "CMAKE"):
        assert sum(1 for _ in lexer.tokens(piece * 5_000, language)) >= 0
    lexer.module_loads(piece * 5_000, "JSX")
    lexer.gradle_calls("dependencies {" + piece * 5_000)
    lexer.cmake_calls(piece * 5_000)
    assert time.monotonic() - start < 10


def test_computed_loads_and_odd_paths(spark):
    from lodestrata.sources import manifests

    files = table(spark, **{"a.ts": "require(x);\nrequire('y')"}).unionByName(spark.createDataFrame([(None, "import 'n'"), ("e.js", None), ("f.js", "")], "path string, text string"))
    assert rows(manifests.js_loads(files, computed=True), "line", "reference", "kind") == [(1, "n", "regular"), (1, None, "computed"), (2, "y", "regular")]
