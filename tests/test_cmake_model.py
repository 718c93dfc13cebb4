"""Replies that aren't as they should be: each step's own status, nothing raised."""

import json

from lodestrata.sources import cmake_model

from .test_sources import rows


def test_model_of_odd_replies(spark):
    index = lambda *models: json.dumps({"objects": [{"kind": "codemodel", "version": {"major": 2, "minor": 9}, "jsonFile": m} for m in models]})
    ok = {"kind": "codemodel", "version": {"major": 2, "minor": 9}, "configurations": [
        {"name": "D", "targets": [{"id": "a", "name": "a", "jsonFile": "a.json"}, {"name": "x"}, {"id": "b", "name": "b", "jsonFile": "a.json"}, {"id": "a", "name": "z", "jsonFile": "z.json"}], "abstractTargets": [{"id": "c", "name": "c", "jsonFile": "c.json"}]},
        {"name": "D", "targets": [{"id": "late", "name": "late", "jsonFile": "l.json"}]},
    ]}
    files = {
        "index-0.json": None, "e/index-1.json": "", "l/index-1.json": "[1]", "n/index-1.json": "{}", "o/index-1.json": index("../m.json"), "m/index-1.json": index("m.json"), "m/m.json": '"text"',
        "p/index-1.json": index("m.json"), "p/m.json": json.dumps(ok), "p/a.json": json.dumps({"id": "a", "name": "a", "type": "EXECUTABLE", "dependencies": [{"id": "b"}, {"id": "gone"}], "linkLibraries": [{"fragment": "-lm"}]}), "p/c.json": json.dumps({"id": "c", "name": "c"}),
    }
    found = cmake_model.model(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert rows(found["models"], "index", "status") == [("m/index-1.json", "malformed"), ("o/index-1.json", "outside"), ("p/index-1.json", "reported")]
    assert rows(found["targets"], "id", "kind", "status") == [("a", "EXECUTABLE", "reported"), ("b", None, "disagrees"), ("c", None, "reported")]
    assert rows(found["relationships"], "parent", "child", "fragment", "present", "child_status") == [("a", "b", None, True, "disagrees"), ("a", "gone", None, False, "absent"), ("a", None, "-lm", None, None)]
    assert rows(found["problems"], "code", "subject") == sorted(
        [("configuration.repeated", "D"), ("index.codemodels", "0"), ("index.malformed", None), ("index.malformed", None), ("index.malformed", None), ("model.malformed", "m/m.json"), ("model.outside", "../m.json"), ("relationship.dangling", "D/a/gone"),
         ("target.collection", "D/c"), ("target.disagrees", "D/b"), ("target.nameless", "D"), ("target.repeated", "D/a")], key=repr)
    empty = cmake_model.model(spark.createDataFrame([], "path string, text string"))
    assert all(df.count() == 0 for df in empty.values())
