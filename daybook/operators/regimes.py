"""Hidden states of many series: a Gaussian Markov model fitted by expectation and maximisation over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.sources.shared import cut

FLOOR = 1e-3  # least variance of a feature, in units of its variance over all rows


def log_densities(x: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """rows x states: log density of each row under each state's independent normals."""
    gap = x[:, None, :] - means[None]
    return -0.5 * (np.log(2 * np.pi * spreads).sum(1)[None] + (gap * gap / spreads[None]).sum(2))


def forward_backward(x: np.ndarray, start: np.ndarray, moves: np.ndarray, means: np.ndarray, spreads: np.ndarray):
    """Log likelihood, each row's shares of the states, and expected moves of one series; scaled a step at a time."""
    logs = log_densities(x, means, spreads)
    top = logs.max(1, keepdims=True)
    dens = np.exp(logs - top)
    n, k = dens.shape
    ahead, back, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        row = (start if t == 0 else ahead[t - 1] @ moves) * dens[t]
        scale[t] = row.sum()
        ahead[t] = row / scale[t]
    for t in range(n - 2, -1, -1):
        back[t] = moves @ (dens[t + 1] * back[t + 1]) / scale[t + 1]
    moved = moves * (ahead[:-1].T @ (dens[1:] * back[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
    return float(np.log(scale).sum() + top.sum()), ahead * back, moved


def best_path(x: np.ndarray, start: np.ndarray, moves: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """The likeliest sequence of states of one series; of equal ones the lower number."""
    logs, step = log_densities(x, means, spreads), np.log(moves)
    came = np.zeros(logs.shape, int)
    now = np.log(start) + logs[0]
    for t in range(1, len(logs)):
        ways = now[:, None] + step
        came[t] = ways.argmax(0)
        now = ways.max(0) + logs[t]
    path = [int(now.argmax())]
    for t in range(len(logs) - 1, 0, -1):
        path.append(int(came[t, path[-1]]))
    return np.array(path[::-1])


def laid_out(flat: np.ndarray, lengths: np.ndarray, cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Series side by side, some ``cells`` rows at a time: their places, the rows that each has (longest first), and series x steps x features."""
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        part = order[at : at + max(1, cells // int(lengths[order[at]]))]
        own, steps = lengths[part], np.arange(lengths[part[0]])
        x = flat[np.minimum(begins[part][:, None] + steps, len(flat) - 1)]
        yield part, own, x
        at += len(part)


def expected_counts(x: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """The sums of ``forward_backward`` over series laid out side by side: log likelihood, first rows' shares, moves, shares, and shares times x and x squared."""
    m, n, d = x.shape
    k = len(start)
    logs = log_densities(x.reshape(-1, d), means, spreads).reshape(m, n, k)
    top = logs.max(2, keepdims=True)
    dens = np.exp(logs - top)
    held = np.arange(n) < lengths[:, None]
    open_ = held.sum(0)  # the longest come first, so these are the first ones
    ahead, back, scale = np.zeros((m, n, k)), np.ones((m, n, k)), np.ones((m, n))
    for t in range(n):
        a = open_[t]
        row = (start if t == 0 else ahead[:a, t - 1] @ moves) * dens[:a, t]
        scale[:a, t] = row.sum(1)
        ahead[:a, t] = row / scale[:a, t, None]
    for t in range(n - 2, -1, -1):
        a = open_[t + 1]
        back[:a, t] = (dens[:a, t + 1] * back[:a, t + 1]) @ moves.T / scale[:a, t + 1, None]
    share = ahead * back
    later = held[:, 1:]
    moved = moves * (ahead[:, :-1][later].T @ (dens[:, 1:] * back[:, 1:] / scale[:, 1:, None])[later])
    rows, weights = x[held], share[held]
    like = np.log(scale).sum() + top[..., 0][held].sum()
    return np.concatenate([[like], share[:, 0].sum(0), moved.ravel(), weights.sum(0), (weights.T @ rows).ravel(), (weights.T @ (rows * rows)).ravel()])


def best_paths(x: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """``best_path`` of series laid out side by side, series x steps."""
    m, n, d = x.shape
    logs, step = log_densities(x.reshape(-1, d), means, spreads).reshape(m, n, -1), np.log(moves)
    open_ = (np.arange(n) < lengths[:, None]).sum(0)
    came, path = np.zeros(logs.shape, np.int32), np.zeros((m, n), np.int32)
    now = np.log(start) + logs[:, 0]
    for t in range(1, n):
        a = open_[t]
        ways = now[:a, :, None] + step
        came[:a, t] = ways.argmax(1)
        now[:a] = ways.max(1) + logs[:a, t]
    state = now.argmax(1)
    path[np.arange(m), lengths - 1] = state
    for t in range(n - 1, 0, -1):
        a = open_[t]
        state[:a] = came[np.arange(a), t, state[:a]]
        path[:a, t - 1] = state[:a]
    return path


def _flat(rows: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows of all series below each other, and how many each series has."""
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, d), lengths


def hidden_states(df: DataFrame, key: str, order: str, features: list[str], states: int = 4, rounds: int = 50, gain: float = 0.01, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """``df`` (key, order, features; rows with a null feature left out) with ``state``, numbered by its first feature's mean, and the log likelihood after each round.

    A series is the rows of a key in their order, one row of arrays, held by one task (a row a day, so years are some thousands); series are dealt to tasks.
    A round is one narrow pass: each task adds up its series' expected counts, and only these sums, whose size depends on states and features alone,
    come to the driver. Starts from k-means; ends when a round gains less than ``gain``. With fewer rows than three a state, the result is empty.
    """
    spark = df.sparkSession
    known = df.select(key, order, *features).dropna(subset=features)
    stats = known.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_pop)]).first()
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{order}` {df.schema[order].dataType.simpleString()}, state int"
    if stats["n"] < states * 3:
        return spark.createDataFrame([], schema), []
    scaled = F.array(*[(F.col(c).cast("double") - stats[f"avg{i}"]) / max(stats[f"stddev_pop{i}"], 1e-8) for i, c in enumerate(features)])
    series = cut(known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), scaled.alias("x")))).alias("rows")))
    points = series.select(F.explode("rows.x").alias("x")).select(array_to_vector("x").alias("features"))
    k, d = states, len(features)
    means = np.zeros((k, d))
    found = np.array(KMeans(k=k, seed=seed).fit(points).clusterCenters())
    means[: len(found)] = found
    means[len(found) :] = found[-1]  # fewer different rows than states: the spare states share a centre
    means = means[np.lexsort(means.T[::-1])]
    spreads, start, moves = np.ones((k, d)), np.full(k, 1 / k), np.full((k, k), 1 / k)
    cuts = np.cumsum([1, k, k * k, k, k * d, k * d])

    def expect(model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cuts[-1])
            for batch in batches:
                for _, lengths, x in laid_out(*_flat(batch.column(0), d)):
                    total += expected_counts(x, lengths, *model)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        return run

    xs, history = series.select(F.col("rows.x").alias("x")), []
    for _ in range(rounds):
        sums = xs.mapInArrow(expect((start, moves, means, spreads)), "s array<double>")
        row = sums.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(cuts[-1])]).first()
        like, first, moved, mass, one, two = np.split(np.array(row), cuts[:-1])
        history.append(float(like[0]))
        if len(history) > 1 and history[-1] - history[-2] < gain:
            break
        held = np.maximum(mass, 1e-10)[:, None]
        means = one.reshape(k, d) / held
        spreads = np.maximum(two.reshape(k, d) / held - means * means, FLOOR)
        start = (first + 1e-10) / (first + 1e-10).sum()
        moved = moved.reshape(k, k) + 1e-10
        moves = moved / moved.sum(1, keepdims=True)

    by = np.lexsort(means.T[::-1])  # states by the mean of the first feature
    model = start[by], moves[np.ix_(by, by)], means[by], spreads[by]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch.column(2), d)
            ends = np.cumsum(sizes)
            found = np.zeros(len(flat), np.int32)
            for part, lengths, x in laid_out(flat, sizes):
                path, held = best_paths(x, lengths, *model), np.arange(x.shape[1]) < lengths[:, None]
                found[((ends - sizes)[part][:, None] + np.arange(x.shape[1]))[held]] = path[held]
            paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), paths], ["k", "o", "p"])

    keyed = series.select(F.col(key).alias("k"), F.col("rows.o").alias("o"), F.col("rows.x").alias("x"))
    types = dict(keyed.dtypes)
    done = keyed.mapInArrow(walk, f"k {types['k']}, o {types['o']}, p array<int>")
    zipped = done.select("k", F.explode(F.arrays_zip("o", "p")).alias("z"))
    return zipped.select(F.col("k").alias(key), F.col("z.o").alias(order), F.col("z.p").alias("state")), history
