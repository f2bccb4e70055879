"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are quantised to integers. Candidates are dealt into shards of bounded size; each
shard's ball tree is built once and stored. Queries are dealt into blocks. A task loads one
shard's tree and streams one block's queries past it: for each query it visits nodes in
descending order of their upper bound (query . centre + |query| * radius) until the bound
falls below the query's k-th score. Work goes in rounds: a block meets one shard, then one
more, then two, four and so on, and every round starts from the k-th scores of all rounds
before it, so that most nodes are cut off at once and few rows leave a task.

Scale: each query meets each shard once, which the exact question asks for. Candidates are
shuffled once, for the trees; trees travel once a block (a block has ``block_rows``
queries, or less where that gives the tasks work, 64 blocks at most), queries once a
shard. A round's partitions follow the cluster, not the number of pairs. Nothing is broadcast; a task holds one tree and one Arrow batch of queries.
Scores are exact: products are summed in double precision only while all sums stay under
2**53, else in Python integers and held to the range of a long.

Defined results: vectors that are null or hold a null or non-finite component take no part;
shorter vectors are filled up with zeros; an empty vector scores 0 with all; a null id is
no query and no candidate; repeated ids are rows of their own, none a candidate of a
query with its id; ties go to the smaller id; with no candidates there are no rows.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import materialise

_LIMIT = (1 << 63) - 1


def quantise(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array of long): floor(256 * x); rows that take no part are gone."""
    v = F.col(vector)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * 256.0).cast("double"))
    return vectors.where(F.col(key).isNotNull()).where(fine).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


class BallTree:
    """Leaves of a ball tree over integer vectors, with a centre and radius for each node."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right
        self.centres, self.radii = [], []
        if len(points):
            self._grow(0, len(points), leaf)
        self.centres = np.asarray(self.centres).reshape(len(self.nodes), points.shape[1])
        self.radii = np.asarray(self.radii)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        own = self.points[self.order[a:b]]
        centre = own.mean(0)
        apart = np.sqrt(((own - centre) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(apart.max()) * (1 + 1e-9))
        if b - a > leaf and self.radii[me] > 0:
            # split at the median along the line through two far points
            far = own[apart.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            along = np.argpartition(own @ (other - far), half)
            self.order[a:b] = self.order[a:b][along]
            self.nodes[me] = (a, b, self._grow(a, a + half, leaf), self._grow(a + half, b, leaf))
        return me

    def pack(self, ids: np.ndarray) -> bytes:
        """The tree and its points' ids, in the tree's order."""
        out = io.BytesIO()
        np.savez(out, points=self.points[self.order], ids=ids[self.order], nodes=np.asarray(self.nodes, np.int64), centres=self.centres, radii=self.radii)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> tuple["BallTree", np.ndarray]:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as held:
            tree.points, tree.centres, tree.radii = held["points"], held["centres"], held["radii"]
            tree.nodes, ids = held["nodes"].tolist(), held["ids"]
        tree.order = np.arange(len(tree.points))
        return tree, ids


def _products(q: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (points @ q).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(q, p)) for p in points]
    return np.asarray([max(-_LIMIT - 1, min(_LIMIT, s)) for s in sums], np.int64)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its row number, ids and scores of at most k candidates scoring its floor or more."""
    points = tree.points
    if not len(points):
        return
    top = max((np.abs(a).max(initial=0.0) for a in (queries, points)), default=0.0)
    exact = top * top * max(1, points.shape[1]) < 2**53
    norms = np.sqrt((queries**2).sum(1))
    slack = 1e-9 * (norms[:, None] * np.sqrt((tree.centres**2).sum(1))[None, :] + 1)
    bounds = queries @ tree.centres.T + norms[:, None] * tree.radii[None, :] + slack
    for i in range(len(queries)):
        floor = int(floors[i])
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # best first: a node's children stand no higher than the node
        heap = [(-bounds[i, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if exact and -bound < floor:
                break  # neither this nor any node left can reach the k-th score
            a, b, left, right = tree.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-min(-bound, bounds[i, left]), left))
                heapq.heappush(heap, (-min(-bound, bounds[i, right]), right))
                continue
            rows = tree.order[a:b]
            scores = _products(queries[i], points[rows], exact)
            ok = (scores >= floor) & (ids[rows] != query_ids[i])
            if ok.any():
                s, v = np.concatenate([best_s, scores[ok]]), np.concatenate([best_i, ids[rows[ok]]])
                order = np.lexsort((v, -s))[:k]
                best_s, best_i = s[order], v[order]
                if len(best_s) == k:
                    floor = max(floor, int(best_s[-1]))
        yield i, best_i, best_s


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of ``width`` numbers: shorter vectors are filled up with zeros, longer ones cut."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = rows["v"].tolist()
    tree = BallTree(_matrix(vectors, max(map(len, vectors))))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "tree": [tree.pack(rows["vec_id"].to_numpy())]})


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and block, each pair's tree before its queries."""
        tree = ids = pair = None
        for batch in batches:
            own = np.asarray(batch.column("shard")).astype(np.int64) << 32 | np.asarray(batch.column("block"))
            begins = np.asarray(batch.column("tree").is_valid())
            begins[1:] |= own[1:] != own[:-1]
            edges = [*np.flatnonzero(begins).tolist(), len(batch)]
            for a, b in zip([0, *edges] if edges[0] else edges, edges if edges[0] else edges[1:]):
                if batch.column("tree")[a].is_valid:
                    tree, ids = BallTree.unpack(batch.column("tree")[a].as_py())
                    pair, a = own[a], a + 1
                elif own[a] != pair:
                    continue  # a shard without candidates
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                number = np.asarray(part.column("query_row"))
                # what a query has beyond the candidates' width meets zeros
                q = _matrix([np.asarray(v.values) for v in part.column("v")], tree.points.shape[1])
                rows, found, scores = [], [], []
                for i, v, s in search(tree, ids, q, np.asarray(part.column("vec_id")), np.asarray(part.column("floor")), k):
                    rows.append(np.full(len(v), number[i]))
                    found.append(v)
                    scores.append(s)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, found, scores)], ["query_row", "vec_id", "score"])

    return run


def shard_size(total: int) -> int:
    """Candidates a shard: more where there are many, so that trees are copied to fewer pairs, up to what a task holds."""
    return min(131_072, max(8192, math.ceil(total / 2048)))


def partitions(pairs: int, spark: SparkSession) -> int:
    """Tasks of a round: one for each pair of block and shard while these are few, else several pairs a task."""
    return min(pairs, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None, block_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    rows = materialise(quantise(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()), "quantised")
    total = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    if not total or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = math.ceil(total / (shard_rows or shard_size(total)))
    blocks = max(math.ceil(n_asked / block_rows), min(shards, math.ceil(n_asked / 512), 64))
    lowest = F.lit(-_LIMIT - 1).cast("long")
    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    trees = materialise(dealt.groupBy("shard").applyInPandas(_grow, "shard int, tree binary"), "trees")
    asked = asked.select("row", "vec_id", "v", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    asked = materialise(asked.withColumnRenamed("row", "query_row"), "queries")

    def pairs(frame: DataFrame, column: str, values: Column) -> DataFrame:
        return frame.withColumn(column, F.explode(values))

    best, lo, hi = None, 0, 1
    while lo < shards:
        steps = F.sequence(F.lit(lo), F.lit(min(hi, shards) - 1))
        # block b begins at shard b and goes on from there
        held = pairs(trees, "step", steps).withColumn("first", F.pmod(F.col("shard") - F.col("step"), F.lit(shards)))
        held = held.where(F.col("first") < blocks).withColumn("block", F.explode(F.sequence("first", F.lit(blocks - 1), F.lit(shards))))
        held = held.select("shard", "block", "tree", *[F.lit(None).cast(t).alias(c) for c, t in (("query_row", "long"), ("vec_id", "long"), ("floor", "long"), ("v", "array<double>"))])
        if best is None:
            known = asked.withColumn("floor", lowest)
        else:
            floors = best.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("floor"))
            known = asked.join(floors, "query_row", "left").withColumn("floor", F.coalesce("floor", lowest))
        known = pairs(known, "shard", F.transform(steps, lambda j: F.pmod(F.col("block") + j, F.lit(shards)).cast("int")))
        met = held.unionByName(known.withColumn("tree", F.lit(None).cast("binary")).select(held.columns))
        n_tasks = partitions(blocks * (min(hi, shards) - lo), spark)
        met = met.repartition(n_tasks, "shard", "block").sortWithinPartitions("shard", "block", F.col("tree").isNull())
        found = met.mapInArrow(_meet(k), "query_row long, vec_id long, score long")
        # at most k rows a query and shard, and k of the rounds before, reach the window
        found = found if best is None else found.unionByName(best)
        order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
        best = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        lo, hi = hi, hi * 2
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    ids = asked.select("query_row", F.col("vec_id").alias("query_id"))
    return ranked.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
