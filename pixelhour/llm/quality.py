"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: words (one and two) and word
shapes (one to three; a shape keeps a word's kinds of characters in order, runs
collapsed). Indicators are scaled by the log ratio of their smoothed shares among
good and bad documents, the vector brought to length one, and a linear hinge loss
is minimised by dual coordinate descent. A logistic curve over margins, weighted
back to the labels' own balance, gives the score.

The model is fitted on a bounded sample of the labelled rows (``PER_CLASS`` of
each class, those with the smallest hashed ids) and has a fixed size; scoring is
a pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import documents, remainder, saved
from pixelhour.llm.words import Words, mix, shapes, slices

BUCKETS = 1 << 18
PER_CLASS = 3000
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 30
SEED = 20240131
KEEP = 0.3


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs, by document."""
    owner = words.documents()
    found = []
    for kind, hashes, most in ((1, words.hashes(), 2), (2, shapes(words).hashes(), 3)):
        gram = mix(hashes + np.uint64(kind))
        for n in range(1, most + 1):
            if n > 1:
                gram = mix(gram[:-1] * np.uint64(3) + hashes[n - 1:])
            whole = owner[: len(gram)] == owner[n - 1:]
            found.append(owner[: len(gram)][whole] * BUCKETS + (gram[whole] % np.uint64(BUCKETS)).astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if len(owner) else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # hinge-loss weight of each scaled indicator
    bias: float
    slope: float
    shift: float

    def scores(self, documents: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        scaled = self.ratio[buckets].astype(np.float64)
        length = np.sqrt(np.bincount(documents, scaled * scaled, n))
        margin = np.bincount(documents, scaled * self.weight[buckets], n) / np.where(length > 0, length, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit(rows: list[np.ndarray], good: np.ndarray, share_good: float) -> Model:
    """A model of feature lists and labels (1 is good); ``share_good`` is the labels' balance outside the sample.

    Without rows of both classes every text gets that share.
    """
    flat = np.zeros(BUCKETS, np.float32)
    share_good = min(max(share_good, 1e-6), 1 - 1e-6)
    if not len(good) or good.min() == good.max():
        return Model(flat, flat, 0.0, 0.0, float(np.log(share_good / (1 - share_good))))
    part = [np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g == k]), minlength=BUCKETS) + SMOOTHING for k in (0, 1)]
    ratio = np.log(part[1] / part[1].sum()) - np.log(part[0] / part[0].sum())
    vectors = [ratio[r] for r in rows]
    vectors = [v / max(np.sqrt(v @ v), 1e-12) for v in vectors]
    side = 2.0 * good - 1
    share = np.array([1 - good.mean(), good.mean()])
    cost = COST * 0.5 / share[good]
    alpha, weight, bias = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    order = np.random.Generator(np.random.PCG64(SEED))
    for _ in range(ROUNDS):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = side[i] * (weight[rows[i]] @ vectors[i] + bias) - 1
            step = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i]) - alpha[i]  # the vector and the bias have length 1 each
            if step:
                alpha[i] += step
                weight[rows[i]] += step * side[i] * vectors[i]
                bias += step * side[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    margin = np.array([weight[r] @ v for r, v in zip(rows, vectors, strict=True)]) + bias
    emphasis = np.where(good == 1, share_good / share[1], (1 - share_good) / share[0])
    emphasis /= emphasis.mean()
    slope, shift = 1.0, 0.0
    aim = np.where(good == 1, (good.sum() + 1) / (good.sum() + 2), 1 / ((1 - good).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50)))
        error, curve = emphasis * (p - aim), emphasis * p * (1 - p)
        hessian = np.array([[(curve * margin * margin).sum() + 1e-3, (curve * margin).sum()], [(curve * margin).sum(), curve.sum() + 1e-3]])
        move = np.linalg.solve(hessian, [(error * margin).sum() + 1e-3 * slope, error.sum() + 1e-3 * shift])
        move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return Model(ratio.astype(np.float32), weight.astype(np.float32), float(bias), float(slope), float(shift))


def _listed(batches):
    for batch in batches:
        out: list[bytes] = []
        for row, stop, words in slices(batch.column("text"), lower=False):
            owner, buckets = features(words)
            cut = np.searchsorted(owner, np.arange(stop - row + 1))
            out += [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.record_batch([pa.array(out, pa.binary()), batch.column("good")], ["buckets", "good"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on texts of ``docs`` whose id has a ``quality`` of 0 or 1 in ``labels``: of each class the
    ``per_class`` ids with the smallest hash. An id with several labels counts as bad if one says so;
    of several texts with one id the one with the smallest hash counts."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    marked = saved(marked.withColumn("draw", F.xxhash64("doc_id")))
    counts = {r["good"]: r["count"] for r in marked.groupBy("good").count().collect()}
    picked = [marked.filter(F.col("good") == k).orderBy("draw", "doc_id").limit(per_class) for k in (0, 1)]
    picked = saved(picked[0].union(picked[1]).select("doc_id", "good"))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("draw", F.xxhash64("text"))
    one = rows.groupBy("doc_id", "good").agg(F.min_by("text", "draw").alias("text"))  # a row for each picked id, however often it is repeated
    found = one.select("text", "good").mapInArrow(_listed, "buckets binary, good int").toPandas()
    order = sorted(range(len(found)), key=lambda i: (found["buckets"][i], found["good"][i]))
    lists = [np.frombuffer(found["buckets"][i], np.int32) for i in order]
    total = sum(counts.values())
    return fit(lists, found["good"].to_numpy(dtype=np.int64)[order], counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score (0 to 1, higher: good likelier) in ``into`` (replaced if there).

    Null and empty texts have no features and get the model's score for none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != into]

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, stop, words in slices(batch.column("text"), lower=False):
                out[row:stop] = shared.value.scores(*features(words), stop - row)
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(out)], [*columns, into])

    rows = docs.select(columns)
    return rows.mapInArrow(run, rows.limit(0).selectExpr("*", f"cast(0 as double) as {into}").schema)


def _model(spark, docs: DataFrame, folder: str) -> Model:
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    return train(docs, labels)


def drop_low_quality(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The rows of ``docs`` that score at least ``KEEP``, learnt from their own labelled rows."""
    given = {"score": "_given_score"} if "score" in docs.columns else {}
    scored = score(docs.withColumnsRenamed(given), _model(spark, docs, folder))
    return scored.filter(F.col("score") >= KEEP).drop("score").withColumnsRenamed({new: old for old, new in given.items()})


def op7_quality(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    scored = score(docs.select("doc_id", "text"), _model(spark, docs, folder))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )
