"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features: the n-grams of 4, 6 and 8 characters (code points) of the text (A-Z in lower
case), hashed into 2**20 buckets; a bucket's value is log(1 + 40 * count / sqrt(characters
+ 200)). From labelled documents the log ratio of smoothed document counts of each bucket
(toxic against clean) is taken; the buckets with the strongest evidence are kept and a
logistic regression is fitted over the kept ones, each scaled by its ratio.

Fitting reads at most ``sample_rows`` labelled documents of ``sample_bytes`` bytes in all
(the smallest hashes of their ids, so the sample does not depend on order or partitions);
that sample is held by one task, and the model, a table of a fixed size, by the driver. Scoring
reads whole texts, needs no shuffle, and works on blocks of characters at a time.

Defined results: a null or empty text has no features and scores by the intercept; with no
labelled rows, or only one class, every score is the smoothed share of label 1; null labels
are left out; of a document's repeated labels the largest counts; repeated rows are scored
each; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import materialise, text_or_empty

BITS, SIZES = 20, (4, 6, 8)
_BLOCK = 500_000


def _buckets(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram size, the bucket of the n-gram that begins at each character."""
    values = points + np.uint32(32) * ((points >= 65) & (points <= 90)).astype(np.uint32)
    h = np.zeros(len(values), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if n > len(values):
            return
        h = h[: len(values) - n + 1] * np.uint32(0x01000193) + values[n - 1 :] + np.uint32(1)
        if n in SIZES:
            yield n, (h * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)


def _blocks(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined by line feeds, about ``_BLOCK`` characters at a time; longer ones are cut.

    With each: the document of every segment, where it ends, and where its n-grams may
    begin last; a cut text's segments overlap so that each n-gram begins in one of them.
    """
    parts, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), _BLOCK):
            own = t[a : a + _BLOCK + max(SIZES) - 1]
            parts.append((i, own, min(_BLOCK, len(own)) if a + _BLOCK < len(t) else len(own)))
            size += len(own) + 1
            if size >= _BLOCK:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, str, int]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for _, t, _ in parts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    return "\n".join(t for _, t, _ in parts), np.array([i for i, _, _ in parts], np.int64), ends, ends - lengths + np.array([n for _, _, n in parts], np.int64)


def features(texts: list[str], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of chosen buckets; with none chosen, presence by n-gram size."""
    found, times = [], []
    for joined, docs, ends, last in _blocks(texts):
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        for n, bucket in _buckets(points):
            at = np.arange(len(bucket)) if chosen is None else np.flatnonzero(chosen[bucket])
            part = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
            inside = (at + n <= ends[part]) & (at < last[part])
            pairs, counts = np.unique(docs[part[inside]] << BITS | bucket[at[inside]], return_counts=True)
            found.append(pairs)
            times.append(counts)
    pairs, counts = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (found, times))
    if chosen is None:
        # a text that was cut may name a bucket of one size in several blocks
        if any(len(t) > _BLOCK for t in texts):
            pairs = np.unique(pairs)
        return pairs >> BITS, pairs & ((1 << BITS) - 1), np.ones(len(pairs))
    pairs, back = np.unique(pairs, return_inverse=True)
    counts = np.bincount(back, weights=counts, minlength=len(pairs))
    doc = pairs >> BITS
    sizes = np.array([len(t) for t in texts], np.float64)
    return doc, pairs & ((1 << BITS) - 1), np.log1p(counts * (40 / np.sqrt(sizes + 200))[doc])


@dataclass
class Model:
    weights: np.ndarray  # by bucket; 0 where not kept
    chosen: np.ndarray
    intercept: float

    def __reduce__(self):
        kept = np.flatnonzero(self.chosen)  # what is not kept weighs nothing
        return _unpacked, (kept, self.weights[kept], self.intercept)

    def score(self, texts: list[str]) -> np.ndarray:
        doc, bucket, value = features(texts, self.chosen)
        total = np.bincount(doc, weights=self.weights[bucket] * value, minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _unpacked(kept: np.ndarray, values: np.ndarray, intercept: float) -> Model:
    weights, chosen = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
    weights[kept], chosen[kept] = values, True
    return Model(weights, chosen, intercept)


def log_count_ratios(texts: list[str], labels: np.ndarray, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: log of its smoothed share of toxic documents over that of clean ones, and how many documents of each label hold it."""
    size, hits = 1 << BITS, np.zeros((2, 1 << BITS), np.int32)
    positives, n = int(labels.sum()), len(labels)
    for a in range(0, n, 200):
        doc, bucket, _ = features(texts[a : a + 200])
        for y in (0, 1):
            hits[y] += np.bincount(bucket[labels[a + doc] == y], minlength=size).astype(np.int32)
    return np.log((hits[1] + smooth) / (positives + 2 * smooth)) - np.log((hits[0] + smooth) / (n - positives + 2 * smooth)), hits


def fit(texts: list[str], labels: np.ndarray, keep: int = 6000, smooth: float = 0.5, penalty: float = 2e-4, rounds: int = 400, settled: float = 1e-4) -> Model:
    """Ratios, feature choice and regression on labelled texts; ends early once the loss of ten rounds falls by less than ``settled`` of itself."""
    n, positives = len(labels), int(labels.sum())
    size = 1 << BITS
    weights, chosen = np.zeros(size, np.float64), np.zeros(size, bool)
    base = np.log((positives + smooth) / (n - positives + smooth))
    if not positives or positives == n:
        return Model(weights, chosen, float(base))
    ratio, hits = log_count_ratios(texts, labels, smooth)
    # evidence: how far the toxic count lies from what the bucket's total leads to expect
    total = hits.sum(0)
    share = positives / n
    strength = np.abs(hits[1] - share * total) / np.sqrt(share * (1 - share) * np.maximum(total, 1) + 1)
    strength[total < 5] = 0
    best = np.argsort(-strength, kind="stable")[:keep]
    chosen[best[strength[best] > 2]] = True
    parts = []
    for a in range(0, n, 200):
        doc, bucket, value = features(texts[a : a + 200], chosen)
        parts.append((doc + a, bucket, value))
    doc, bucket, value = (np.concatenate(x) for x in zip(*parts))
    column = np.cumsum(chosen) - 1
    col, width = column[bucket], int(chosen.sum())
    if not width:
        return Model(weights, chosen, float(base))
    scaled = ratio[chosen]
    value = scaled[col] * value
    w, b = np.zeros(width), base
    mean_w, mean_b, sq_w, sq_b = np.zeros(width), 0.0, np.zeros(width), 0.0
    losses = []
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = np.bincount(doc, weights=value * w[col], minlength=n) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        losses.append(float(np.logaddexp(0, np.where(labels == 1, -z, z)).mean() + penalty / 2 * (w @ w)))
        if t > 50 and losses[-11] - losses[-1] < settled * losses[-11]:
            break
        grad_w = np.bincount(col, weights=value * gap[doc], minlength=width) / n + penalty * w
        grad_b = gap.mean()
        mean_w, mean_b = 0.9 * mean_w + 0.1 * grad_w, 0.9 * mean_b + 0.1 * grad_b
        sq_w, sq_b = 0.999 * sq_w + 0.001 * grad_w**2, 0.999 * sq_b + 0.001 * grad_b**2
        rate = 0.05 * (1 - t / (rounds + 1))
        w -= rate * (mean_w / (1 - 0.9**t)) / (np.sqrt(sq_w / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mean_b / (1 - 0.9**t)) / (np.sqrt(sq_b / (1 - 0.999**t)) + 1e-8)
    weights[chosen] = w * scaled
    return Model(weights, chosen, float(b))


def sample_frame(docs: DataFrame, labels: DataFrame, label: str, train, rows: int, room: int, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """_text, _label of at most ``rows`` labelled documents, ``room`` bytes in all, that ``train`` admits: one partition in the order of their ids' hashes; None without any."""
    docs = docs.select(F.col(key), text_or_empty(text).alias("_text"))
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).where(train)
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    # ids first: some labelled ones, the smallest hashes, meet the documents' ids in a scan without a shuffle; more where too few are there
    asked = 4 * rows
    while True:
        tried = materialise(known.orderBy(F.xxhash64(key), key).limit(asked), "labelled")
        held = docs.select(key).join(F.broadcast(tried), key).groupBy(key).agg(F.max("_label").alias("_label"))  # at most ``asked`` rows
        picked = materialise(held.orderBy(F.xxhash64(key), key).limit(rows), "picked")
        if picked.count() >= rows or tried.count() < asked:
            break
        asked *= 4
    # one scan of the texts; what it keeps has a bound in rows
    met = docs.join(F.broadcast(picked), key).select(key, "_label", "_text", F.xxhash64("_text").alias("_hash"))
    met = materialise(met, "labelled-texts")
    sizes = met.select(key, "_hash", F.octet_length("_text").alias("_bytes")).orderBy(F.xxhash64(key), key, "_hash").limit(rows).collect()
    taken = []
    for r in sizes:  # in this order; a text for which no room is left is passed over
        if r["_bytes"] <= room:
            room -= r["_bytes"]
            taken.append((r[key], r["_hash"]))
    if not taken:
        return None
    chosen = spark.createDataFrame(taken, met.select(key, "_hash").schema).distinct()
    return met.join(F.broadcast(chosen), [key, "_hash"]).orderBy(F.xxhash64(key), key, "_hash").limit(len(taken)).select("_text", "_label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, rows: int, room: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and labels of ``sample_frame``, in the driver."""
    sample = sample_frame(docs, labels, label, train, rows, room, key, text)
    got = [] if sample is None else sample.collect()
    return [r["_text"] for r in got], np.array([r["_label"] for r in got], np.int64)


def fitted(sample: DataFrame | None, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """What ``fit`` makes of a labelled sample, in the one task that holds the sample; the driver gets the result alone."""
    if sample is None:
        return fit([], np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(labels, np.int64)))], pa.binary())], ["model"])

    return pickle.loads(sample.mapInArrow(run, "model binary").first()["model"])


def train_model(docs: DataFrame, labels: DataFrame, train, sample_rows: int = 8000, sample_bytes: int = 64_000_000, key: str = "doc_id", text: str = "text") -> Model:
    return fitted(sample_frame(docs, labels, "toxic", train, sample_rows, sample_bytes, key, text), fit)


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score column; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series(own.score(texts.tolist()))

    return docs.withColumn(score, scored(text_or_empty(text)))
