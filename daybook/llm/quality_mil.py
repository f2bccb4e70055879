"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (about 512 bytes each, all of the text). Every passage is
described by what its bytes are (shares of character classes, of pairs of classes and of
single punctuation marks, word lengths, repetition of words), encoded by a small tanh
layer, and weighted by gated attention; the weighted mean of the encodings gives the
score. Encoder, attention and output are learned together, from document labels alone.

Fitting reads at most ``sample_rows`` labelled documents of ``sample_bytes`` bytes in all
(as the toxicity operator samples); the model is a few thousand numbers. Scoring needs no shuffle and holds a block
of passages at a time.

Features of a document don't depend on the documents beside it.

Defined results: a null or empty text is one empty passage; with no labelled rows, or one
class only, every score is the smoothed share of label 1; null labels are left out;
repeated rows are scored each; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty
from daybook.llm.toxicity import fitted, sample_frame

PASSAGE = 512
HIDDEN, GATE = 24, 12
_MARKS = "!#$%&'()*+,-./:;<=>?@[]_|{}~\""
_BLOCK = _SPAN = 1_000_000


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Fine class of each byte (marks apart) and its coarse class."""
    coarse = np.full(256, 5, np.uint8)
    coarse[ord("a") : ord("z") + 1] = 0
    coarse[ord("A") : ord("Z") + 1] = 1
    coarse[ord("0") : ord("9") + 1] = 2
    for b in b" \t\r\x0b\x0c":
        coarse[b] = 3
    coarse[10] = 4
    coarse[128:] = 6
    fine = coarse.copy()
    for i, mark in enumerate(_MARKS):
        fine[ord(mark)] = 7 + i
    return fine, coarse


_FINE, _COARSE = _classes()
_N_FINE, _N_COARSE = 7 + len(_MARKS), 7
WIDTH = _N_FINE + _N_COARSE**2 + 4


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the document of each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    rows, owners, start = [], [], 0
    while start < len(raw):
        stop, size = start, 0
        while stop < len(raw) and (stop == start or size + len(raw[stop]) <= _BLOCK):
            size += len(raw[stop])
            stop += 1
        sizes = np.array([len(r) for r in raw[start:stop]], np.int64)
        counts = np.maximum(1, (sizes + PASSAGE // 2) // PASSAGE)  # a short end joins the passage before
        owner = np.repeat(np.arange(stop - start), counts)
        rows.append(_describe(b"".join(raw[start:stop]), sizes, counts, owner))
        owners.append(owner + start)
        start = stop
    if not rows:
        return np.zeros((0, WIDTH)), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


def _describe(joined: bytes, sizes: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    data = np.frombuffer(joined, np.uint8)
    n = int(counts.sum())
    first = np.cumsum(counts) - counts
    inner = np.arange(n) - np.repeat(first, counts)
    begins = np.repeat(np.cumsum(sizes) - sizes, counts) + inner * PASSAGE
    lengths = np.diff(np.append(begins, len(data)))
    coarse = _COARSE[data]
    stops = np.cumsum(sizes)
    closes = np.zeros(len(data), bool)  # the last byte of a document
    closes[stops[sizes > 0] - 1] = True
    single, double = np.zeros((n, _N_FINE), np.int64), np.zeros((n, _N_COARSE**2), np.int64)
    per_span = max(1, _SPAN // PASSAGE)
    for p in range(0, n, per_span):  # so many passages at a time: what is held a byte is held for these
        q = min(n, p + per_span)
        x, y = int(begins[p]), int(begins[q - 1] + lengths[q - 1])
        at = np.repeat(np.arange(q - p), lengths[p:q])
        single[p:q] = np.bincount(at * _N_FINE + _FINE[data[x:y]], minlength=(q - p) * _N_FINE).reshape(q - p, _N_FINE)
        i = np.flatnonzero(~closes[x:y])  # a pair lies within one document
        pair = coarse[x + i].astype(np.int64) * _N_COARSE + coarse[x + i + 1]
        double[p:q] = np.bincount(at[i] * _N_COARSE**2 + pair, minlength=(q - p) * _N_COARSE**2).reshape(q - p, -1)
    length = np.maximum(lengths, 1)[:, None]
    blanks = single[:, 3] + single[:, 4] + 1
    # repetition: equal 12-byte windows at word starts of a document
    opens = coarse < 3
    opens[1:] &= (coarse[:-1] >= 3) | closes[:-1]
    starts = np.flatnonzero(opens)
    starts = starts[starts + 12 <= stops[np.searchsorted(stops, starts, "right")]] if len(starts) else starts
    repeated, begun = np.zeros(n), np.zeros(n)
    if len(starts):
        h = np.zeros(len(starts), np.uint64)
        for k in range(12):
            h = h * np.uint64(0x100000001B3) + data[starts + k].astype(np.uint64)
        within = np.searchsorted(begins, starts, "right") - 1
        within = np.minimum(within, n - 1)
        h ^= owner[within].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        begun = np.bincount(within, minlength=n)
        repeated = np.bincount(within, weights=(times[back] > 1).astype(float), minlength=n)
    rest = np.stack([lengths / blanks / 10, np.log1p(lengths) / 6, repeated / np.maximum(begun, 1), np.log1p(np.repeat(sizes, counts)) / 10], 1)
    return np.concatenate([np.sqrt(single / length), np.sqrt(double / length), rest], 1)


class Model:
    """Gated attention over passage encodings; ``parts`` are its arrays."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    def _forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        p = self.parts
        x = (x - p["mean"]) / p["spread"]
        h = np.tanh(x @ p["w"] + p["wb"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        logit = (v * u) @ p["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, logit)
        e = np.exp(logit - top[owner])
        weight = e / np.bincount(owner, weights=e, minlength=n)[owner]
        bag = np.zeros((n, h.shape[1]))
        np.add.at(bag, owner, weight[:, None] * h)
        return x, h, v, u, weight, bag, bag @ p["c"] + p["b"][0]

    def score(self, texts: list[str]) -> np.ndarray:
        if "share" in self.parts:
            return np.full(len(texts), self.parts["share"][0])
        x, owner = passages(texts)
        z = self._forward(x, owner, len(texts))[-1] if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(model: Model, x: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss of documents in all learned parts, by hand."""
    q, n = model.parts, len(labels)
    xs, h, v, u, weight, bag, z = model._forward(x, owner, n)
    gz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
    g = {"c": bag.T @ gz, "b": np.array([gz.sum()])}
    gbag = gz[:, None] * q["c"]
    along = (gbag[owner] * h).sum(1)  # what more weight on the passage does
    mean = np.bincount(owner, weights=weight * along, minlength=n)
    glogit = weight * (along - mean[owner])
    g["a"] = (v * u).T @ glogit
    gv, gu = glogit[:, None] * q["a"] * u * (1 - v**2), glogit[:, None] * q["a"] * v * u * (1 - u)
    g["v"], g["u"] = h.T @ gv, h.T @ gu
    gh = (weight[:, None] * gbag[owner] + gv @ q["v"].T + gu @ q["u"].T) * (1 - h**2)
    return g | {"w": xs.T @ gh, "wb": gh.sum(0)}


def fit(texts: list[str], labels: np.ndarray, epochs: int = 40, batch: int = 256, penalty: float = 1e-4, seed: int = 11) -> Model:
    """Minimise the documents' log loss by Adam."""
    n, positives = len(labels), int(labels.sum())
    if not positives or positives == n:
        return Model({"share": np.array([(positives + 0.5) / (n + 1)])})
    blocks = [passages(texts[a : a + 500]) for a in range(0, n, 500)]
    x = np.concatenate([b[0] for b in blocks])
    owner = np.concatenate([b[1] + 500 * i for i, b in enumerate(blocks)])
    rng = np.random.default_rng(seed)
    p = {
        "w": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "wb": np.zeros(HIDDEN),
        "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE),
        "c": rng.normal(0, 0.3, HIDDEN), "b": np.array([np.log(positives / (n - positives))]),
    }
    model = Model(p | {"mean": x.mean(0), "spread": x.std(0) + 1e-3})
    names = list(p)
    first, second = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}
    begins = np.searchsorted(owner, np.arange(n + 1))
    step, steps = 0, epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            step += 1
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), begins[docs + 1] - begins[docs])
            q = model.parts
            g = gradient(model, x[rows], own, labels[docs])
            rate = 0.01 * (1 - step / (steps + 1))
            for k in names:
                d = g[k] + (penalty * q[k] if k not in ("b", "wb") else 0)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                q[k] = q[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train_model(docs: DataFrame, labels: DataFrame, train, sample_rows: int = 6000, sample_bytes: int = 64_000_000, key: str = "doc_id", text: str = "text") -> Model:
    return fitted(sample_frame(docs, labels, "quality", train, sample_rows, sample_bytes, key, text), fit)


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score column; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(shared.value)
        for texts in batches:
            out, listed = [], texts.tolist()
            for a in range(0, len(listed), 500):
                out.append(own.score(listed[a : a + 500]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(score, scored(text_or_empty(text)))
