"""Exact k-means over integer vectors: heaps of bound gaps say which vectors must be looked at again.

Vectors are cut to integers and dealt into blocks of bounded size as they are read. In a block
each cluster keeps a heap of its vectors by the gap between the second-nearest centroid's
distance and the own one's, as of the last exact scan. When centroids move, a cluster's
drift grows by its own move and the largest move of any other: a gap that the drift since its
scan has not used up still proves the assignment. So each round pops what stands at a
heap's top up to the cluster's drift, scans those vectors exactly against all centroids and
pushes them on the heap of the cluster they now belong to. A heap is keyed by gap plus
drift at the scan, so nothing else in it is touched.

Scale: no vector is shuffled. A round reads the stored blocks and writes them with their new
heaps; sums a cluster and component (centroids x components numbers a block) are combined
by Spark and come to the driver as the new centroids. Blocks keep the narrowest integers
that hold their vectors. A lost executor costs tasks of one round.

Exactness: distances are whole numbers (products in double precision only while they stay
under 2**53); gaps are square roots, so they are held short by a margin of 1e-9 of
what they were taken from, and a tie always pops.

Defined results: vectors that are null, of another width, or hold a null or non-finite
component take no part; components beyond 2**27 are held at it, so that distances fit a long;
a null id takes part, but starts no centroid while ids are left; repeated rows are vectors of
their own; fewer vectors than centroids give fewer centroids; inertia beyond a long is held at
its end; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import materialise

_LIMIT = 1 << 27
_BLOCK = "ids array<long>, width int, vectors binary, labels binary, heaps array<struct<keys binary, rows binary>>, sums array<long>, counts array<long>, scanned long, dist array<long>"


def whole_vectors(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """id, v: the vectors that take part."""
    v = F.col(vector)
    fine = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull()).where(fine).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _cut(flat: np.ndarray, width: int, scale: float) -> np.ndarray:
    return np.clip(np.floor(flat * scale), -_LIMIT, _LIMIT).astype(np.int64).reshape(-1, width)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact, as int64."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * top * top * points.shape[1] < 2**53 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


class Block:
    """Vectors with their labels and a heap a cluster."""

    def __init__(self, ids: pa.Array, points: np.ndarray, k: int):
        self.ids, self.points, self.k = ids, points, k
        self.labels = np.full(len(points), -1, np.int64)
        self.heaps: list = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(k)]
        self.sums, self.counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
        self.scanned = 0

    def _scan(self, rows: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> list[list[tuple[float, int]]]:
        """Assign ``rows`` exactly; what to push on each heap."""
        found = distances(self.points[rows], centroids)
        labels = found.argmin(1)  # ties: the smaller number
        old = self.labels[rows]
        moved = old != labels
        for rest, sign in ((old, -1), (labels, 1)):
            own = moved & (rest >= 0)
            np.add.at(self.sums, rest[own], sign * self.points[rows[own]])
            np.add.at(self.counts, rest[own], sign)
        self.labels[rows] = labels
        upper = np.sqrt(found[np.arange(len(rows)), labels].astype(np.float64))
        found[np.arange(len(rows)), labels] = np.iinfo(np.int64).max
        lower = np.sqrt(found.min(1).astype(np.float64)) if self.k > 1 else np.full(len(rows), np.inf)
        margin = 1e-9 * (1 + upper + np.where(np.isinf(lower), 0, lower) + drift[labels])
        keys = lower - upper - margin + drift[labels]
        self.scanned += len(rows)
        pushed: list[list[tuple[float, int]]] = [[] for _ in range(self.k)]
        for label, key, row in zip(labels.tolist(), keys.tolist(), rows.tolist()):
            pushed[label].append((key, row))
        return pushed

    def start(self, centroids: np.ndarray) -> None:
        for j, own in enumerate(self._scan(np.arange(len(self.points)), centroids, np.zeros(self.k))):
            heapq.heapify(own)
            self._keep(j, own)

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Pop every vector whose gap the drift has used up, and scan it again."""
        popped, opened = [], {}
        for j in range(self.k):
            keys, rows = self.heaps[j]
            if not len(keys) or keys[0] > drift[j]:
                continue  # the top has a gap left, and so has all below it
            heap = opened[j] = list(zip(keys.tolist(), rows.tolist()))
            while heap and heap[0][0] <= drift[j]:
                popped.append(heapq.heappop(heap)[1])
        if not popped:
            return
        for j, own in enumerate(self._scan(np.array(popped), centroids, drift)):
            if not own and j not in opened:
                continue
            heap = opened.get(j)
            if heap is None:
                heap = list(zip(self.heaps[j][0].tolist(), self.heaps[j][1].tolist()))
            for entry in own:
                heapq.heappush(heap, entry)
            self._keep(j, heap)

    def _keep(self, j: int, heap: list[tuple[float, int]]) -> None:
        self.heaps[j] = np.array([k for k, _ in heap], np.float64), np.array([r for _, r in heap], np.int64)

    def own_distances(self, centroids: np.ndarray) -> np.ndarray:
        gap = self.points - centroids[self.labels]
        return (gap * gap).sum(1)

    def row(self, dist: np.ndarray | None = None) -> dict:
        kind = np.min_scalar_type(-int(np.abs(self.points).max(initial=1)) - 1)
        return {
            "ids": self.ids.to_pylist(), "width": kind.itemsize, "vectors": self.points.astype(kind).tobytes(), "labels": self.labels.astype(np.int32).tobytes(),
            "heaps": [{"keys": k.tobytes(), "rows": r.astype(np.int32).tobytes()} for k, r in self.heaps],
            "sums": self.sums.ravel().tolist(), "counts": self.counts.tolist(), "scanned": self.scanned, "dist": None if dist is None else dist.tolist(),
        }

    @classmethod
    def read(cls, row: dict, components: int) -> "Block":
        points = np.frombuffer(row["vectors"], f"i{row['width']}").astype(np.int64).reshape(-1, components)
        out = cls(pa.array(row["ids"], pa.int64()), points, len(row["heaps"]))
        out.labels = np.frombuffer(row["labels"], np.int32).astype(np.int64)
        out.heaps = [(np.frombuffer(h["keys"], np.float64), np.frombuffer(h["rows"], np.int32).astype(np.int64)) for h in row["heaps"]]
        out.sums, out.counts = np.array(row["sums"], np.int64).reshape(out.k, components), np.array(row["counts"], np.int64)
        return out


_SCHEMA = pa.schema([
    ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()), ("labels", pa.binary()), ("heaps", pa.list_(pa.struct([("keys", pa.binary()), ("rows", pa.binary())]))),
    ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("scanned", pa.int64()), ("dist", pa.list_(pa.int64())),
])


def _build(centroids: np.ndarray, scale: float, block_rows: int):
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def done() -> pa.RecordBatch:
            block = Block(pa.concat_arrays(ids), np.concatenate(parts), len(centroids))
            block.start(centroids)
            return pa.RecordBatch.from_pylist([block.row()], schema=_SCHEMA)

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, block_rows - n)
                ids.append(part.column(0))
                parts.append(_cut(part.column(1).flatten().to_numpy(zero_copy_only=False), width, scale))
                n, at = n + len(part), at + len(part)
                if n == block_rows:
                    yield done()
                    ids, parts, n = [], [], 0
        if n:
            yield done()

    return run


def _advance(centroids: np.ndarray, drift: np.ndarray, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a block at a time
                block = Block.read(batch.slice(i, 1).to_pylist()[0], centroids.shape[1])
                block.advance(centroids, drift)
                yield pa.RecordBatch.from_pylist([block.row(block.own_distances(centroids) if last else None)], schema=_SCHEMA)

    return run


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor of the mean of each cluster; an empty one stays."""
    k, width = centroids.shape
    total = lambda name: blocks.select(F.posexplode(name).alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    # centroids x components rows, whatever the number of vectors
    sums = {r["at"]: int(r["n"]) for r in total("sums").collect()}
    counts = {r["at"]: int(r["n"]) for r in total("counts").collect()}
    return np.array([[sums[j * width + c] // counts[j] for c in range(width)] if counts[j] else centroids[j].tolist() for j in range(k)], np.int64)


def _drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    order = np.sort(move)
    rest = np.where(move == order[-1], order[-2] if len(order) > 1 and (move == order[-1]).sum() == 1 else order[-1], order[-1])
    return drift + move + (rest if len(move) > 1 else 0)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: int = 1, key: str = "vec_id", vector: str = "embedding", block_rows: int = 8192,
    report: list | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance of every vector that takes part, and the final centroids.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id``. ``report``, if given, gets how many
    vectors each round scanned exactly.
    """
    rows = whole_vectors(vectors, key, vector, width)
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(lot.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return rows.sparkSession.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, width), np.int64)
    centroids = _cut(np.array([r["v"] for r in first]).ravel(), width, scale)
    drift = np.zeros(len(centroids))
    blocks = materialise(rows.mapInArrow(_build(centroids, scale, block_rows), _BLOCK), "blocks")
    for r in range(rounds):
        moved = _moved(blocks, centroids)
        drift, centroids = _drifted(drift, centroids, moved), moved
        blocks = materialise(blocks.mapInArrow(_advance(centroids, drift, r == rounds - 1), _BLOCK), f"blocks-{r}")
        if report is not None:
            report.append(blocks.agg(F.sum("scanned")).first()[0])
    if not rounds:
        blocks = materialise(blocks.mapInArrow(_advance(centroids, drift, True), _BLOCK), "blocks-last")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, dist in zip(batch.column(0), batch.column(1), batch.column(2)):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(labels.as_py(), np.int32)), dist.values], ["id", "cluster", "distance"])

    return blocks.select("ids", "labels", "dist").mapInArrow(spread, "id long, cluster int, distance long"), centroids


def digests(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with its cluster's inertia, the whole, and its final centroid's digest."""
    top = F.lit((1 << 63) - 1)
    long = lambda c: F.least(F.col(c), top).cast("long").alias(c)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))  # a row a centroid
    own = {r["cluster"]: int(r["cluster_inertia"]) for r in sums.collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    limit = (1 << 63) - 1
    rows = [(j, min(n, limit), min(sum(own.values()), limit), shas[j]) for j, n in own.items()]
    of = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3) -> str:
    """The same by SQL, every vector against every centroid in every round."""
    sql = ["""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY 1 LIMIT %d)
)""" % k]  # fmt: skip
    for i in range(rounds + 1):
        sql.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(kv) AS v, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS d
  FROM (SELECT r, vec_id, kept.v AS kv, cluster, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY r
)""")
        if i < rounds:
            sql.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT cluster, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY pos) AS v
    FROM (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM a{i}) GROUP BY ALL) GROUP BY cluster
  ) m USING (cluster)
)""")
    return ",\n".join(sql) + f"""
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = oracle()
