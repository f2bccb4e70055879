"""Shortest paths from many starts: nodes numbered in their order, links stored in blocks of neighbours' lists, walks that read these blocks.

Nodes are numbered from 0 in the order of their ids. A block holds the lists of a stretch of nodes, along the links (OUT) or against them (IN).
A task walks from a few hundred starts, a level at a time for BATCH of them, and holds their state (a number for each start and node between
the least and the greatest that they reach) and up to HELD bytes of blocks. State never moves; what leaves a task is a sum a node.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut, scratch

OUT, IN = "out", "in"
LINKS = 2_000_000  # links of a block
TASK_STARTS, BATCH = 512, 64  # starts of a task, and of those that walk side by side
HELD, STATE = 512 << 20, 256 << 20  # bytes of blocks and of state that a task holds
SMALL = 1_000_000  # nodes whose numbers are sent to every task
_STRETCH = 100_000  # ids that are numbered together
_BYTES = 48  # of state, for each start and node


def numbered(ids: DataFrame) -> DataFrame:
    """id, at: each different id with its place in their order; a row a stretch of ids is all that meets in one place."""
    ids = cut(ids.where("id IS NOT NULL").distinct())
    held = cut(ids.repartitionByRange(ids.count() // _STRETCH + 1, "id").withColumn("_stretch", F.spark_partition_id()))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.groupBy("_stretch").agg(F.count("*").alias("_n")).select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inner = F.row_number().over(Window.partitionBy("_stretch").orderBy("id"))
    return cut(held.join(F.broadcast(ahead), "_stretch").select("id", (F.col("_ahead") + inner - 1).alias("at")))


def store_links(edges: DataFrame, places: DataFrame, n: int) -> tuple[dict[str, str], int]:
    """Folders of the blocks along the links and against them, and the nodes of a block; ``edges`` (source, target) are read twice."""
    width = max(1, LINKS * n // max(edges.count(), n, 1))
    source, target = (places.select(F.col("id").alias(c), F.col("at").cast("int").alias(f"_{c}")) for c in ("source", "target"))
    if n <= SMALL:
        source, target = F.broadcast(source), F.broadcast(target)
    pairs = edges.join(source, "source").join(target, "target")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        block, near = int(rows["block"].iloc[0]), rows["near"].to_numpy()
        sizes = np.bincount(near - block * width, minlength=width).astype("<i4")
        ends = rows["far"].to_numpy()[np.argsort(near, kind="stable")].astype("<i4")
        return pd.DataFrame({"block": [block], "sizes": [sizes.tobytes()], "ends": [ends.tobytes()]})

    folders = {}
    for way, near, far in ((OUT, "_source", "_target"), (IN, "_target", "_source")):
        dealt = pairs.select(F.expr(f"CAST({near} div {width} AS INT)").alias("block"), F.col(near).alias("near"), F.col(far).alias("far")).repartition(n // width + 1, "block")
        folders[way] = scratch(edges.sparkSession, f"links-{way}")
        dealt.groupBy("block").applyInPandas(pack, "block int, sizes binary, ends binary").write.partitionBy("block").parquet(folders[way])
    return folders, width


class Links:
    """The stored blocks, read when they are asked for; the HELD bytes asked for last stay."""

    def __init__(self, folders: dict[str, str], width: int, n: int):
        from pyarrow import fs

        self.width, self.n, self.paths, self.known, self.held, self.bytes = width, n, {}, {}, OrderedDict(), 0
        for way, uri in folders.items():
            self.store, root = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
            for found in self.store.get_file_info(fs.FileSelector(root, recursive=True)):
                folder = found.path.split("/")[-2]
                if folder.startswith("block=") and found.base_name.endswith(".parquet"):
                    self.paths[way, int(folder.partition("=")[2])] = found.path

    def _read(self, way: str, block: int, column: str) -> np.ndarray:
        from pyarrow import parquet

        with self.store.open_input_file(self.paths[way, block]) as f:
            return np.frombuffer(parquet.ParquetFile(f).read(columns=[column])[column][0].as_buffer(), "<i4")

    def sizes(self, way: str, block: int) -> np.ndarray:
        """How many neighbours each node of the block has."""
        if (way, block) not in self.known:
            self.known[way, block] = self._read(way, block, "sizes") if (way, block) in self.paths else np.zeros(self.width, "<i4")
        return self.known[way, block]

    def degrees(self, way: str, low: int, high: int) -> np.ndarray:
        first = low // self.width
        every = np.concatenate([self.sizes(way, b) for b in range(first, (high - 1) // self.width + 1)])
        return every[low - first * self.width : high - first * self.width].astype(np.int64)

    def lists(self, way: str, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each node's list begins, and the lists."""
        if (way, block) not in self.held:
            sizes = self.sizes(way, block).astype(np.int64)
            self.held[way, block] = np.cumsum(sizes) - sizes, self._read(way, block, "ends")
            self.bytes += sum(a.nbytes for a in self.held[way, block])
            while self.bytes > HELD and len(self.held) > 1:
                self.bytes -= sum(a.nbytes for a in self.held.popitem(last=False)[1])
        self.held.move_to_end((way, block))
        return self.held[way, block]

    def neighbours(self, way: str, asked: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the ``asked`` sorted nodes, block after block: which of ``asked``, nodes with neighbours, numbers of these, neighbours."""
        bounds = np.arange(0, self.n + self.width, self.width)
        parts = [np.searchsorted(nodes, bounds) for nodes in asked]
        for block in range(len(bounds) - 1):
            mine = [i for i, at in enumerate(parts) if at[block] < at[block + 1]]
            if not mine or (way, block) not in self.paths:
                continue
            first, ends = self.lists(way, block)
            for i in mine:
                nodes = asked[i][parts[i][block] : parts[i][block + 1]]
                sizes = self.sizes(way, block)[nodes - block * self.width]
                nodes, sizes = nodes[sizes > 0], sizes[sizes > 0]
                if len(nodes):
                    begin = first[nodes - block * self.width]
                    yield i, nodes, sizes, np.concatenate([ends[a:z] for a, z in zip(begin.tolist(), (begin + sizes).tolist())])


def _reached(links: Links, starts: np.ndarray) -> np.ndarray:
    """Whether any of the starts reaches a node."""
    seen, front = np.zeros(links.n, bool), np.unique(starts)
    seen[front] = True
    while len(front) and not seen.all():
        found = np.zeros(links.n, bool)
        for _, _, _, ends in links.neighbours(OUT, [front]):
            found[ends] = True
        front = np.flatnonzero(found & ~seen)
        seen[front] = True
    return seen


class _Walk:
    """The state of one start, over the nodes from ``low`` on; the last place stands for all other nodes."""

    def __init__(self, start: int, size: int):
        self.level, self.paths, self.through = np.full(size, -1, np.int32), np.zeros(size + 1), np.zeros(size + 1)
        self.level[start], self.paths[start], self.fronts, self.seen = 0, 1, [np.array([start])], 1


def _turn(links: Links, low: int, size: int, jobs: list[tuple[str, bool, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each job (way, take, nodes, x): sums of x, which nodes ``take`` from their neighbours or else give to them."""
    sums = [np.zeros(size + 1) for _ in jobs]
    for way in (OUT, IN):
        mine = [i for i, job in enumerate(jobs) if job[0] == way]
        for k, nodes, sizes, ends in links.neighbours(way, [jobs[i][2] + low for i in mine]):
            _, take, _, x = jobs[mine[k]]
            total, at = sums[mine[k]], np.subtract(ends, low, dtype=np.intp)
            if way == IN and size < links.n:  # a neighbour may be none that is reached
                at[(at < 0) | (at > size)] = size
            if take:
                total[nodes - low] = np.add.reduceat(x[at], np.cumsum(sizes) - sizes)
            elif len(at) * 8 < size:
                np.add.at(total, at, np.repeat(x[nodes - low], sizes))
            else:
                total += np.bincount(at, np.repeat(x[nodes - low], sizes), size + 1)
    return sums


def _only(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    kept = np.zeros_like(x)
    kept[nodes] = x[nodes]
    return kept


def passed(links: Links, starts: np.ndarray) -> tuple[int, np.ndarray]:
    """The least node that the starts reach, and what passes through each node from there on.

    Each level is found from the front or from the nodes not seen, and handed back from the one side or the other, whichever has fewer links.
    """
    reached = _reached(links, starts)
    places = np.flatnonzero(reached)
    low, high, every = int(places[0]), int(places[-1]) + 1, len(places)
    size, reached = high - low, reached[low:high]
    out, into = (links.degrees(way, low, high) for way in (OUT, IN))
    walks = [_Walk(int(s) - low, size) for s in starts]
    live = walks
    while live := [w for w in live if w.seen < every]:
        jobs = []
        for w in live:
            front, links_ahead = w.fronts[-1], out[w.fronts[-1]].sum()
            job = OUT, False, front, w.paths
            if links_ahead > size:
                unseen = np.flatnonzero(reached & (w.level < 0))
                if into[unseen].sum() < links_ahead:
                    job = IN, True, unseen, _only(w.paths, front)
            jobs.append(job)
        for w, sums in zip(live, _turn(links, low, size, jobs)):
            found = np.flatnonzero((sums[:-1] > 0) & (w.level < 0))
            if not np.isfinite(sums[found]).all():
                raise ArithmeticError("more shortest paths than a double can count")
            w.level[found], w.paths[found], w.seen = len(w.fronts), sums[found], w.seen + len(found) if len(found) else every
            if len(found):
                w.fronts.append(found)
    total = np.zeros(size)
    for back in range(max(len(w.fronts) for w in walks) - 2):
        jobs, live = [], [w for w in walks if len(w.fronts) - 2 - back > 0]
        for w in live:
            here, after = w.fronts[-2 - back], w.fronts[-1 - back]
            x = np.zeros(size + 1)
            x[after] = (1 + w.through[after]) / w.paths[after]
            jobs.append((OUT, True, here, x) if out[here].sum() <= into[after].sum() else (IN, False, after, x))
        for w, sums in zip(live, _turn(links, low, size, jobs)):
            here = w.fronts[-2 - back]  # the start takes no score of its own
            w.through[here] = w.paths[here] * sums[here]
            total[here] += w.through[here]
    return low, total


def through_nodes(starts: DataFrame, folders: dict[str, str], width: int, n: int) -> DataFrame:
    """at, through: what passes each node, of the starts (``at``) of a task."""
    batch = max(1, min(BATCH, STATE // (_BYTES * max(n, 1))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b["at"].to_numpy() for b in batches]
        begun = np.sort(np.concatenate(every)) if every else np.zeros(0, np.int64)
        links, totals = Links(folders, width, n), np.zeros(n if len(begun) else 0)
        for i in range(0, len(begun), batch):
            low, total = passed(links, begun[i : i + batch])
            totals[low : low + len(total)] += total
        at = np.flatnonzero(totals)
        yield pd.DataFrame({"at": at, "through": totals[at]})

    return starts.repartitionByRange(starts.count() // TASK_STARTS + 1, "at").mapInPandas(walk, "at long, through double")
