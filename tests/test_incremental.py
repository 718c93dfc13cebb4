from lodestrata.plans import incremental, scan

BASE = {
    "package.json": '{"dependencies":{"a":"^1","b":"1.0.0"}}', "x.js": "import 'a'\nimport 'c'\n", "sub/package.json": '{"dependencies":{"c":"1.0.0"}}', "sub/y.js": "import 'c'\nimport 'b'\n", "sub/deep/z.js": "import 'd'\n",
    "py/pyproject.toml": '[project]\ndependencies = ["pyyaml==1", "idle"]\n', "py/m.py": "import yaml, os\nimport odd\n", "py/n.py": "import m\n", "svc/requirements.txt": "-r ../common/base.txt\nflask==1\n", "svc/s.py": "import flask, bs4\n",
    "common/base.txt": "-r more.txt\nbeautifulsoup4==4\n", "common/more.txt": "requests==2\n", "loose/q.py": "def", "go/go.mod": "module e.com/g\nrequire e.com/d v1.0.0\n", "go/g.go": 'package g\nimport "e.com/d/x"\n', "rs/Cargo.toml": '[dependencies]\nserde = "1"\n', "rs/src/l.rs": "use serde::X;\n",
}
STEPS = [
    {"sub/y.js": "import 'c'\nimport 'e'\n"}, {"common/more.txt": "django==3\n-r gone.txt\n"}, {"sub/package.json": None}, {"py/new/requirements.txt": "odd==1\n", "py/new/a.py": "import odd\nimport yaml\n"}, {"loose/requirements.txt": "x==1\n"}, {"py/pyproject.toml": "[broken"},
    {"common/base.txt": None}, {"go/g.go": 'package g\nimport "e.com/zz/y"\n', "rs/src/l.rs": None}, {"py/new/requirements.txt": None, "py/pyproject.toml": '[project]\ndependencies = ["odd-dist==1"]\n'}, {"svc/requirements.txt": "-r ../svc/b.txt\n", "svc/b.txt": "-r requirements.txt\nbeautifulsoup4==4\n"},
]


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, text string")


def plain(relations):
    return {k: sorted(map(repr, (r.asDict() for r in df.collect()))) for k, df in relations.items()}


def test_updates_equal_rebuilds(spark):
    files, mapping = dict(BASE), spark.createDataFrame([("odd", "odd-dist")], "reference string, package string")
    relations, state, names = scan.scan(frame(spark, files)), incremental.file_state(frame(spark, files)), None
    for step, new in ((STEPS[:6], None), (STEPS[6:], mapping)):  # files, folders and included files; then the configuration too
        for path, text in (item for change in step for item in change.items()):
            files.pop(path, None)
            if text is not None:
                files[path] = text
        df = frame(spark, files)
        relations, state = incremental.update(relations, state, df, names, new)
        names, got, want = new, plain(relations), plain(scan.scan(df, new))
        for k in want:
            assert got[k] == want[k], (k, set(got[k]) ^ set(want[k]))


def test_only_stale_projects_are_scanned(spark):
    df = frame(spark, BASE)
    old = scan.scan(df)
    after = dict(BASE, **{"common/more.txt": "urllib3==1\n"})
    state, files = incremental.file_state(df), frame(spark, after)
    changes = incremental.input_changes(state, incremental.file_state(files))
    none = spark.createDataFrame([], "module string")
    stale = incremental.stale_projects(old, changes, scan._projects(files), scan._inclusions(files), none)
    assert [r.project_id for r in stale.collect() if r.project_id != "."] == ["svc"]
    odd = spark.createDataFrame([("odd",)], "module string")
    assert {r.project_id for r in incremental.stale_projects(old, changes.limit(0), scan._projects(df), scan._inclusions(df), odd).collect()} == {"py"}
