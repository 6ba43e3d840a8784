"""Score of abusive, hateful or sexually explicit language per document, and rates per source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import passages
from trackweave.llm.boosting import Boosted, Isotonic
from trackweave.llm.passages import DENSE, MOST_GROUPS, Weights, described

#: Labelled documents that the model is fitted on at most, in the order of a hash of doc_id.
FIT_DOCUMENTS = 20_000
#: Parts of the sample; weights and scores of a part come from the others.
FOLDS = 3
#: A document is reported if its calibrated probability reaches this.
THRESHOLD = 0.5
#: Score of a document without any passage.
NOTHING = -8.0


@dataclass
class Model:
    """Boosted trees over passages, trees over documents with their best passages, and the calibration."""

    passage: Boosted
    document: Boosted
    calibrate: Isotonic

    def probability(self, doc: np.ndarray, code: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return self.calibrate(self.document.score(document_features(self.passage, doc, code, dense)))


def document_features(model: Boosted, doc: np.ndarray, code: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Per document: scores of its best and second passage kind, how many are likely, and DENSE."""
    kinds, which = np.unique(code, return_inverse=True)
    score = model.score(described(kinds))[which] if len(kinds) else np.zeros(0)
    order = np.lexsort((-score, doc))
    place = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    best = np.full((len(dense), 2), NOTHING)
    for rank in (0, 1):
        best[doc[order][place == rank], rank] = score[order][place == rank]
    likely = np.bincount(doc, score > 0, len(dense)) if len(doc) else np.zeros(len(dense))
    return np.concatenate([best, likely[:, None], dense], axis=1)


def fit_passages(doc: np.ndarray, code: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 4) -> Boosted:
    """Trees over passages from ratings of whole documents: of a document rated yes, its best passage by the last model counts as yes; of one rated no, all count as no."""
    kinds, which = np.unique(code, return_inverse=True)
    x, base = described(kinds), target.mean() if len(target) else 0.5
    score = (np.bincount(which, (target * weight)[doc], len(kinds)) + 4 * base) / (np.bincount(which, weight[doc], len(kinds)) + 4)
    model = Boosted(rounds=60, depth=5, least_bend=0.3).fit(x[:0], np.zeros(0))
    for _ in range(rounds if len(kinds) else 0):
        best = np.full(len(target), -np.inf)
        np.maximum.at(best, doc, score[which])
        yes = np.bincount(which, (target * weight)[doc] * (score[which] >= best[doc]), len(kinds))
        total = yes + np.bincount(which, ((1 - target) * weight)[doc], len(kinds))
        seen = total > 0
        model = Boosted(rounds=60, depth=5, least_bend=0.3).fit(x[seen], (yes / np.maximum(total, 1e-9))[seen], total[seen])
        score = model.score(x)
    return model


def fit(doc: np.ndarray, code: np.ndarray, dense: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Model:
    """The model of documents 0..n-1 whose passages were weighted by the other folds. Calibrated on scores of documents that the trees did not see."""
    fold = np.arange(len(target)) % FOLDS
    features = np.zeros((len(target), 3 + dense.shape[1]))
    for k in range(FOLDS):
        seen, rows = fold != k, np.nonzero(fold == k)[0]
        number = np.cumsum(seen) - 1
        inner = seen[doc] if len(doc) else np.zeros(0, bool)
        model = fit_passages(number[doc[inner]], code[inner], target[seen], weight[seen])
        own = np.cumsum(~seen) - 1
        features[rows] = document_features(model, own[doc[~inner]], code[~inner], dense[rows])
    trees = lambda: Boosted(rounds=30, depth=3, rate=0.2, least_bend=8.0)
    scores = np.zeros(len(target))
    for k in range(FOLDS):
        scores[fold == k] = trees().fit(features[fold != k], target[fold != k], weight[fold != k]).score(features[fold == k])
    return Model(fit_passages(doc, code, target, weight), trees().fit(features, target, weight), Isotonic().fit(scores, target, weight))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id, target (share of the raters that answered yes to any question), raters; raters that answered nothing do not count."""
    answers = [F.col(c) for c in ("abusive", "hateful", "sexual")]
    any_yes = F.greatest(*answers)  # NULLs are skipped
    return labels.where(F.col("doc_id").isNotNull() & any_yes.isNotNull()).groupBy("doc_id").agg(F.avg((any_yes > 0).cast("double")).alias("target"), F.count(F.lit(1)).alias("raters"))


def group_counts(sample: DataFrame) -> DataFrame:
    """gram, yes_k and no_k (documents of fold k, weighted by their target) of word groups in at least LEAST_DOCUMENTS documents; the most telling MOST_GROUPS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fold, target = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(), batch.column(2).to_numpy()
            start = 0
            for reading in passages.readings(texts):
                doc, code = passages.groups_of(reading)
                key, which = np.unique(np.stack([code, fold[start + doc]], axis=1), axis=0, return_inverse=True)
                yes, all_ = np.bincount(which.ravel(), target[start + doc], len(key)), np.bincount(which.ravel(), minlength=len(key))
                start += reading.documents
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0], pa.int64()), pa.array(key[:, 1], pa.int32()), pa.array(yes, pa.float64()), pa.array(all_ - yes, pa.float64())], names=["gram", "fold", "yes", "no"])

    counted = sample.select("text", "fold", "target").mapInArrow(count, "gram bigint, fold int, yes double, no double")
    sums = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0.0)).alias(f"{c}_{k}") for k in range(FOLDS) for c in ("yes", "no")]
    held, yes = F.sum(F.col("yes") + F.col("no")), F.sum("yes")
    telling = F.abs(F.log((yes + 0.5) / (held + 1.0)) - F.log(F.lit(0.1))) * F.sqrt(held)
    counts = counted.groupBy("gram").agg(*sums, held.alias("held"), telling.alias("telling")).where(F.col("held") >= passages.LEAST_DOCUMENTS)
    return counts.orderBy(F.desc("telling"), "gram").limit(MOST_GROUPS).drop("held", "telling")


def fitted(documents: DataFrame, labels: DataFrame, scratch, limit: int = FIT_DOCUMENTS) -> tuple[Model, Weights]:
    """The model and the weights of word groups, from at most `limit` rated documents.

    Weights are learned per fold from the other folds, so the trees see passages weighted as those of new documents will be. Without
    any rated document, or with all rated alike, the score is the same for all.
    """
    chosen = rated(labels).join(documents.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    at = {r.doc_id: i for i, r in enumerate(chosen)}
    target, raters = np.array([r.target for r in chosen], float), np.array([r.raters for r in chosen], float)
    rows = [(i, k, k % FOLDS, float(target[k])) for i, k in at.items()]
    names = documents.sparkSession.createDataFrame(rows, "doc_id bigint, place int, fold int, target double")
    sample = scratch.save(documents.select("doc_id", "text").join(F.broadcast(names), "doc_id"))  # at most `limit` ids are broadcast
    counts = group_counts(sample).toArrow().to_pydict()
    gram = np.array(counts["gram"], np.int64)
    yes, no = (np.array([counts[f"{c}_{k}"] for k in range(FOLDS)], float).reshape(FOLDS, -1) for c in ("yes", "no"))
    fold = np.arange(len(target)) % FOLDS
    per_fold = []
    for k in range(FOLDS):
        others = [j for j in range(FOLDS) if j != k]
        per_fold.append(Weights.of_counts(gram, yes[others].sum(axis=0), no[others].sum(axis=0), target[fold != k].sum(), (1 - target[fold != k]).sum()))
    weights = Weights.of_counts(gram, yes.sum(axis=0), no.sum(axis=0), target.sum(), (1 - target).sum())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_fold = batch.column(1).to_numpy()
            for k in range(FOLDS):
                part = batch.filter(pa.array(own_fold == k))
                yield from _described(part.column(0), part.column(2), per_fold[k])

    found = sample.select("place", "fold", "text").mapInArrow(describe, "place int, codes array<bigint>, dense array<float>").collect()
    dense = np.zeros((len(target), len(DENSE)), np.float32)
    for r in found:
        dense[r.place] = r.dense
    doc = np.repeat([r.place for r in found], [len(r.codes) for r in found]).astype(int) if found else np.zeros(0, int)
    code = np.array([c for r in found for c in r.codes], np.int64)
    return fit(doc, code, dense, target, np.sqrt(raters)), weights


def _described(names: pa.Array, texts: pa.Array, weights: Weights) -> Iterator[pa.RecordBatch]:
    start = 0
    for reading in passages.readings([t or "" for t in texts.to_pylist()]):
        doc, code, dense = passages.passages(reading, weights)
        n = reading.documents
        ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(code, pa.int64()))
        rows = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * len(DENSE)).astype(np.int32)), pa.array(dense.ravel(), pa.float32()))
        yield pa.RecordBatch.from_arrays([names.slice(start, n), codes, rows], names=["place", "codes", "dense"])
        start += n


def scored(documents: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """doc_id, source, lang, probability of every document. NULL and empty texts are scored like a text without any listed word.

    Two passes over the rated sample fit the model; one pass over the whole texts scores every document. The model and the weights of
    at most MOST_GROUPS word groups (3 MB) go to the executors with the code.
    """
    model, weights = fitted(documents, labels, scratch)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for reading in passages.readings([t or "" for t in batch.column(3).to_pylist()]):
                chance = model.probability(*passages.passages(reading, weights))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, reading.documents) for c in batch.columns[:3]), pa.array(chance, pa.float64())], names=["doc_id", "source", "lang", "probability"])
                start += reading.documents

    return scratch.save(documents.select("doc_id", "source", "lang", "text").mapInArrow(predict, "doc_id bigint, source string, lang string, probability double"))


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (NULL is a source of its own): documents, cases, rate of cases, and the mean probability."""
    case = F.count_if(F.col("probability") >= threshold)
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), case.alias("cases"), (case / F.count(F.lit(1))).alias("rate"), F.avg("probability").alias("mean_probability"))
