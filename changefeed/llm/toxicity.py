"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (three strengths, and words of harmless texts), how near they stand to
second-person words, shares of capitals and of shouted words, rates of marks and of disguised words. The lexicon is learned from the
training rows: words whose smoothed odds of standing in toxic texts are high.

Fitting uses at most ``SAMPLE`` labelled rows, those of least hash of the id; below that bound all of
them. One part grows the trees, the other calibrates them. Every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.common import keyed, materialise

SAMPLE, LEXICON, LEAST_TEXTS = 20_000, 400, 8
TREES, DEPTH, THRESHOLD = 30, 3, 0.7
NEAR = 5
# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ti vosotros".split())
# Signs that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!|", "oieastasil")
MARKS = "!?*"
FEATURES = ["strong", "medium", "weak", "harmless", "strong_words", "near_person", "person", "capitals", "shouted", "marks", "disguised", "log_words"]
_EDGES = ".,;:!?\"'()[]{}<>-"
_LETTER = re.compile(r"[^\W\d_]")


def plain(word: str) -> str:
    return word.strip(_EDGES).lower()


def features(text: str, strength: dict[str, int]) -> list[float]:
    """The features of a text; zeros for a text without words. ``strength``: 3, 2, 1, or -1 for harmless words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = {3: 0, 2: 0, 1: 0, -1: 0}
    bad, person, disguised = [], [], 0
    for i, raw in enumerate(words):
        w = plain(raw)
        s = strength.get(w, 0)
        if not s and not w.isalpha() and len(w) > 2:
            undone = _disclosed(w)
            s = strength.get(undone, 0) if undone != w else 0
            disguised += s > 0
        if s:
            counts[s] += 1
            if s > 1:
                bad.append(i)
        elif w in SECOND_PERSON:
            person.append(i)
    at = np.array(person)
    near = sum(bool((np.abs(at - i) <= NEAR).any()) for i in bad) if len(at) else 0
    letters = sum(map(str.isalpha, text)) if n < 400 else len(_LETTER.findall(text))
    capitals = sum(map(str.isupper, text))
    shouted = sum(len(w) > 2 and w.isupper() for w in words)
    marks = sum(map(text.count, MARKS))
    return [
        counts[3] / n, counts[2] / n, counts[1] / n, counts[-1] / n, float(counts[3]), near / n, len(person) / n,
        capitals / max(1, letters), shouted / n, marks / n, disguised / n, float(np.log1p(n)),
    ]


def _disclosed(word: str) -> str:
    """A word without the dots, dashes and stars between its letters, look-alike signs read as letters."""
    return "".join(c for c in word.translate(DISGUISES) if c.isalpha())


def learn_lexicon(sample: DataFrame, size: int = LEXICON, least_texts: int = LEAST_TEXTS) -> dict[str, int]:
    """Strength of words by how much likelier they make a toxic text; at most ``size`` words of each sign."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                own = sorted({plain(w) for w in text.split()} - {""})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], ["word", "toxic"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counted = sample.select("text", "toxic").mapInArrow(words, "word string, toxic int")
    counted = counted.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("n") >= least_texts)
    rate_bad, rate_good = (F.col("bad") + 0.5) / (bad + 1), (F.col("n") - F.col("bad") + 0.5) / (good + 1)
    scored = counted.withColumn("odds", F.log(rate_bad / rate_good))
    top = scored.where("odds > 0.7").orderBy(F.desc("odds"), F.desc("n"), "word").limit(size).collect()
    low = scored.where("odds < -0.7").orderBy("odds", F.desc("n"), "word").limit(size).collect()
    out = {r["word"]: -1 for r in low}
    return out | {r["word"]: 3 if r["odds"] > 2.5 else 2 if r["odds"] > 1.5 else 1 for r in top}


def with_features(rows: DataFrame, strength: dict[str, int], keep: tuple[str, ...]) -> DataFrame:
    """The features of each row beside the columns ``keep``."""
    held = rows.sparkSession.sparkContext.broadcast(strength)
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep], *[f"{f} double" for f in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([features(t, held.value) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            arrays = [*[b.column(c) for c in keep], *[pa.array(made[:, i]) for i in range(len(FEATURES))]]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *FEATURES])

    return rows.select(*keep, "text").mapInArrow(run, schema)


class Model:
    """A lexicon, trees and a calibration, or one rate where the training rows have a single class."""

    def __init__(self, strength: dict[str, int], rate: float, trees=None, calibration=None) -> None:  # noqa: ANN001
        self.strength, self.rate, self.trees, self.calibration = strength, rate, trees, calibration


_ASSEMBLER = {"inputCols": FEATURES, "outputCol": "features"}


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Fit on rows (rid, text, toxic)."""
    order = F.xxhash64("rid", F.lit(3))
    picked = labelled.withColumn("order", order).orderBy("order", "rid").limit(sample).withColumn("calibrates", F.col("order") % 3 == 0)
    picked = materialise(picked.select("rid", "text", "toxic", "calibrates"), "sample").repartition(16)
    classes = {(r["calibrates"], r["toxic"]): r["count"] for r in picked.groupBy("calibrates", "toxic").count().collect()}
    n, bad = sum(classes.values()), sum(c for (_, t), c in classes.items() if t == 1)
    if len(classes) < 4:
        return Model({}, bad / n if n else 0.0)
    growing = picked.where(~F.col("calibrates"))
    strength = learn_lexicon(growing)
    table = materialise(with_features(picked, strength, ("rid", "toxic", "calibrates")), "features")
    table = VectorAssembler(**_ASSEMBLER).transform(table.orderBy("rid").coalesce(1))
    table = table.select("features", F.col("toxic").cast("double").alias("label"), "calibrates").cache()
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxMemoryInMB=128)
    grown = gbt.fit(table.where(~F.col("calibrates")))
    margins = _margin(grown.transform(table.where("calibrates"))).select("margin", "label")
    calibration = IsotonicRegression(featuresCol="margin").fit(margins)
    table.unpersist()
    return Model(strength, bad / n, grown, calibration)


def _margin(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("margin", vector_to_array("probability")[1])


def score(rows: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and score. The calibration is flat in places; a thousandth of the margin keeps the order there."""
    if model.trees is None:
        return rows.select(*keep, F.lit(float(model.rate)).alias("score"))
    table = VectorAssembler(**_ASSEMBLER).transform(with_features(rows, model.strength, keep))
    found = model.calibration.setPredictionCol("calibrated").transform(_margin(model.trees.transform(table)))
    blended = 0.999 * F.col("calibrated") + 0.001 * F.col("margin")
    return found.select(*keep, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended)), 10).alias("score"))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text); ``labels`` has doc_id and toxic.

    Rows whose crc32 of the id has remainder 1 by 3 are held out: their labels are never read. Rows without id are
    not held out and have no label. Null texts are empty. Of repeated labels the largest counts, null ones do not. Without labels
    of both classes every score is the rate of toxic rows (0 without any).
    """
    rows = keyed(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out).where("toxic in (0, 1)")
    model = fit(rows.join(known, "doc_id"), sample, trees)
    out = score(rows.withColumn("held_out", held_out), model, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
