import hashlib

import pytest
from tokenizers import Tokenizer

from lodestrata.llm import linededup, queries, toxicity

from .test_decontam import ITEM, ITEMS
from .test_decontam import brute as contamination
from .test_linededup import LINE
from .test_linededup import brute as boilerplate
from .test_simhash import expected as groups
from .test_toxicity import corpus

pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_reduce_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        at = str(tmp_path / name)
        stage(spark, docs, DIR).write.parquet(at)
        after = spark.read.parquet(at)
        if name != "bpe":
            assert sorted(after.columns) == sorted(first) and after.count() <= n
        else:
            assert after.count() == n
        docs, n = after, after.count()
    assert n > 100


def test_run_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    rows = [(i, t) for i, t, *_ in rows[:150]]
    filler = [t for i, t in rows if not dict(labels)[i]]
    rows += [(1000 + i, f"{LINE}\nown words {filler[i]} end") for i in range(20)] + [(1100 + i, filler[0] + " same") for i in range(5)] + [(1200, f"{ITEM} {filler[1]}"), (1201, None), (1202, "")]
    docs = [(i, t, "en", f"s{i % 15}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}

    read = lambda t: spark.read.parquet(str(tmp_path / f"{t}.parquet"))
    toxic = {r.doc_id for r in toxicity.score(read("documents"), read("labels")).collect() if r.predicted}
    truth = dict(labels)
    assert all(truth.get(i, 0) for i in toxic)
    left = boilerplate([(i, t, s) for i, t, _, s, _ in docs if i not in toxic], min_sites=linededup.MIN_SITES)
    roots = {c for _, c in groups(left).values()}
    items = [(i, t) for i, t in ITEMS if i is not None]
    left = [(i, t) for i, t in left if i in roots and not contamination(t, items)[4]]
    tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    want = {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, t in left for x in [tok.encode(t or "", add_special_tokens=False).ids]}
    assert got == want and 1200 not in got


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} and set(queries.ORACLE) <= set(queries.QUERIES)
