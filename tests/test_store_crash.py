import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.checks import strict_json
from lodestrata.plans import store


def test_a_writer_that_dies_blocks_nobody(spark, tmp_path):
    root, df = f"{tmp_path}/s", spark.range(3)
    first = store.publish(spark, root, {"r": df}, None)
    (tmp_path / "s" / "pointer" / "2").touch()  # an older writer's crash between creating and writing
    (tmp_path / "s" / "pointer" / ".half").write_text("dead")  # a crash before the move
    assert store.current(spark, root) == first
    second = store.publish(spark, root, {"r": df.limit(1)}, first)
    assert store.current(spark, root) == second and store.load(spark, root, "r").count() == 1
    with pytest.raises(RuntimeError, match="another version"):
        store.publish(spark, root, {"r": df}, first)
    assert store.current(spark, root) == second


def test_only_one_writer_gets_a_generation(spark, tmp_path):
    root = f"{tmp_path}/s"
    first = store.publish(spark, root, {"r": spark.range(1)}, None)
    store._claim(spark, root, 2, "other")
    with pytest.raises(RuntimeError, match="another version"):
        store._claim(spark, root, 2, "late")
    assert store.current(spark, root) == "other" != first and not list((tmp_path / "s" / "pointer").glob(".late"))


def test_strings_are_no_numbers(spark):
    texts = ['{"a":"x, Infinity pool"}', '{"a":"it is NaN"}', '{"a":"\\" NaN \\\\"}', '{"a": NaN}', "[1,-Infinity]", '{"a":"' + "long, NaN " * 20_000 + '"}', '{"a": "b", "c": Infinity}']
    got = [r.p.problem for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(strict_json(F.col("t")).alias("p")).collect()]
    assert got == [None, None, None, "json.not-finite", "json.not-finite", None, "json.not-finite"] and json.loads(texts[2])
