"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities and rates of a whole text: a fixed lexicon of insults, a lexicon of word stems
learnt from labelled training rows, second-person words near insults, capitals, punctuation, repetition
and obfuscated spellings. Labels are read from training rows only, at most ``SAMPLE_ROWS`` of them (chosen
by the hash of their id); every document is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_sample, small_batches, without
from .toxfeatures import N_FEATURES, features, stems  # noqa: F401
from .workers import trimming

#: Labelled rows that a fit reads at most; this bound lets them be broadcast (an id and a label each).
SAMPLE_ROWS = 20_000
#: Documents of label 1 that must hold a stem; how many times as frequent it must be there. The sample bounds the lexicon.
STEM_DOCUMENTS, STEM_RATIO = 5, 4.0
THRESHOLD = 0.3


def _training(docs: DataFrame, labels: DataFrame, fold: int, held: int, sample: int) -> DataFrame:
    """``(id, y, calibrates)`` of the labelled training rows that are read: null ids and labels are no training rows."""
    own = labels.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    own = own.where(F.crc32(F.col("id").cast("string")) % fold != held)
    known = cut(own.join(docs.select("id").distinct(), "id", "left_semi"))
    return cut(hash_sample(known, ["id"], sample).withColumn("calibrates", F.crc32(F.col("id").cast("string")) % fold == 3))


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of the stems that label 1 has more often, by documents of ``rows(text, y)``, a bounded sample."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(stems(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), batch.column(1)], ["stems", "y"])

    split_rows = rows.select("text", "y").mapInArrow(trimming(split), "stems array<string>, y double")
    counts = split_rows.select(F.explode("stems").alias("stem"), "y").groupBy("stem").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    n_bad, n_good = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    ratio = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
    best = counts.where(F.col("bad") >= STEM_DOCUMENTS).withColumn("ratio", ratio).where(F.col("ratio") >= STEM_RATIO)
    return {r.stem: math.log(r.ratio) for r in best.collect()}


def _scored(rows: DataFrame, marks: DataFrame, fold: int, held: int, sample: int, threshold: float) -> DataFrame:
    """``rows(id, h, text)`` as ``(id, h, held_out, score, predicted)``; texts go to the features and no further."""
    train = _training(rows, marks, fold, held, sample)
    texts = cut(rows.select("id", "text").join(F.broadcast(train), "id"))
    learnt = _lexicon(texts.where("not calibrates"))
    kind = dict(rows.dtypes)["id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(x.as_py(), learnt) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.float64()))], ["id", "a", "x"])

    def vectors(of: DataFrame, a: str, a_kind: str) -> DataFrame:
        return of.select("id", a, "text").mapInArrow(trimming(measure), f"id {kind}, a {a_kind}, x array<double>").withColumn("x", array_to_vector("x"))

    known = cut(vectors(texts.withColumn("a", F.struct("y", "calibrates")), "a", "struct<y:double,calibrates:boolean>").select("id", "a.y", "a.calibrates", "x"))
    sums = {r.calibrates: (r.n, r.bad) for r in known.groupBy("calibrates").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).collect()}
    fit_n, fit_bad = sums.get(False, (0, 0.0))
    cal_n, cal_bad = sums.get(True, (0, 0.0))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % fold == held, F.lit(False)).alias("held_out")
    if not 0 < fit_bad < fit_n:
        value = (fit_bad + cal_bad + 0.5) / (fit_n + cal_n + 1)
        scored = rows.select("id", "h", held_out, F.lit(float(value)).alias("score"))
    else:
        trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=2, seed=1, cacheNodeIds=False)
        fit = known.coalesce(2).cache()
        model = trees.fit(fit.where("not calibrates"))
        chance = lambda df: vector_to_array(df["probability"])[1]
        step = None
        if 0 < cal_bad < cal_n:
            probe = model.transform(fit.where("calibrates"))
            step = IsotonicRegression(featuresCol="p", labelCol="y").fit(probe.select(chance(probe).alias("p"), "y"))
        fit.unpersist()
        out = model.transform(vectors(rows, "h", "long"))
        out = out.withColumn("p", chance(out))
        if step is not None:
            # ties of the calibration are broken by the trees' own chance, so that the order of scores stays fine
            out = step.setPredictionCol("calibrated").transform(out).withColumn("p", 0.98 * F.col("calibrated") + 0.02 * F.col("p"))
        scored = out.select("id", F.col("a").alias("h"), held_out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p"))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 4, held: int = 2,
    sample: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``score`` (0 to 1, the chance of label 1), ``predicted``.

    Labels are read only for ids whose crc32 as text doesn't leave ``held`` modulo ``fold`` (a null id is
    not held out and has no label; an id labelled twice has its largest label). Of these, ids with remainder
    3 calibrate, the others fit the lexicon and the trees. Null and empty texts are scored like any other. Where
    the labels hold one class or none, every score is the smoothed share of label 1. Repeated rows each give a
    row; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("h"), F.col(text_col).alias("text"))
    return _scored(rows, marks, fold, held, sample, threshold).select(F.col("id").alias(id_col), "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``score`` predicts toxic; columns and other rows stay as they are.

    Null and empty texts and null ids are scored and kept or dropped like others, repeated rows go or stay together,
    an empty table stays empty; columns of any name may be there. Keys of toxic rows (id and text hash) filter the rows.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        scored = cut(_scored(rows, marks, 4, 2, SAMPLE_ROWS, threshold).where("predicted = 1").select("id", "h"))
    return without(docs, scored.select(F.col("id").alias("i"), "h"), id_col, F.xxhash64(F.col(f"`{text_col}`")))
