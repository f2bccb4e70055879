"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Pieces are dealt evenly over partitions. Each partition packs its own by best-fit
decreasing and computes lower bounds on the sequences that its pieces need, from
dual-feasible functions of the lengths. Where the count meets the bound the partition
is certified. The loose sequences (all that are not nearly full, and more where a
partition has a gap) are then taken apart, their pieces are exchanged into fewer
partitions and packed again, until the total meets the bound of the whole table or a
round saves nothing.

A round that saves nothing is tried once more, dealt anew and with more sequences of
the partitions that miss their bound. How many sequences came out, the bound of
the whole table and each round's sum of partition bounds are logged and, where the caller
gives a list, appended to it: what is not certified is thus known.

Only lengths and digests travel: ids stay where they were made. A partition holds at
most about ``rows_per_partition`` pieces; the driver sees a histogram of at most
``capacity`` lengths and a row a partition.

Defined results: a null or empty text is one piece holding the end id; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import materialise, text_or_empty
from daybook.llm.encoding import encoder, groups_by_bytes


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; no shuffle.

    A document longer than the capacity is cut into full pieces after a first one
    that takes the remainder.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end, width = np.asarray([end_id], "<u4").tobytes(), 4
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_by_bytes(texts):
                owner, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(enc.encode(texts[a:b]), a):
                    ids = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes() + end
                    n = len(ids) // width
                    first = n - capacity * (math.ceil(n / capacity) - 1)
                    edges = [0, *range(first, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                        owner.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(ids[x * width : y * width]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(key), text_or_empty(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, into the fullest bin that has room."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        room -= need
        if room:
            if not open_bins[room]:
                rooms |= 1 << room
            open_bins[room].append(b)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[x]: items of length x, 0 to capacity.

    The largest bound from three families of dual-feasible functions: the identity
    (total length), thresholds (items over C - k count whole, those under k not) and
    the rounding functions of Fekete and Schepers. Integer arithmetic throughout.
    """
    x = np.flatnonzero(counts)
    x = x[x > 0]
    if not len(x):
        return 0
    c = counts[x].astype(np.int64)
    best = -(-int((c * x).sum()) // capacity)
    for k in np.unique(np.minimum(x, capacity - x)[np.minimum(x, capacity - x) <= capacity // 2]).tolist():
        value = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
        best = max(best, -(-int((c * value).sum()) // capacity))
    for k in range(1, 33):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, k * x, (k + 1) * x // capacity * capacity)  # k * capacity times the function
        best = max(best, -(-int((c * value).sum()) // (k * capacity)))
    return best


_LOG = logging.getLogger(__name__)


def _pack_round(pieces: DataFrame, capacity: int, partitions: int, number: int, name: str, nearly: float, more: int = 100) -> tuple[DataFrame, dict]:
    """Pack every partition's pieces; mark the bins that the next round takes apart.

    A partition that misses its bound offers one in ``more`` of its sequences, the loosest.
    """
    spent = pieces.columns[:5]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = [f for f in frames if len(f)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = fill < nearly * capacity
        if len(fill) > bound:  # not certified: offer the loosest of them as well
            order = np.argsort(fill, kind="stable")
            loose[order[: max(16, len(fill) // more)]] = True
        loose |= fill == fill.min()
        loose &= fill < capacity
        rows["sequence_id"] = (number << 52) + (part << 26) + bins
        rows["offset"], rows["loose"] = offsets, loose[bins]
        rows["opens"], rows["bound"] = offsets == 0, 0
        rows.loc[0, "bound"] = bound  # one row of the partition carries it
        yield rows

    schema = pieces.select(*spent).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    placed = pieces.select(*spent).repartition(partitions).mapInPandas(run, f"{schema}, sequence_id long, offset long, loose boolean, opens boolean, bound long")
    placed = materialise(placed, name)
    got = placed.agg(
        F.sum(F.col("opens").cast("long")).alias("bins"),
        F.sum((F.col("opens") & F.col("loose")).cast("long")).alias("loose"),
        F.sum(F.col("loose").cast("long")).alias("loose_rows"),
        F.sum("bound").alias("bound"),
    ).first()
    return placed, {k: v or 0 for k, v in got.asDict().items()}


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_partition: int = 50_000, nearly: float = 0.98, max_rounds: int = 12, report: list | None = None) -> DataFrame:
    """Give each piece a sequence_id and an offset; see the module's text for the method.

    ``report`` takes a dictionary a round: round, sequences (in all, after it), bound (of the
    table), partition_bounds (the sum of those of the round's partitions), packed (the
    round's own sequences), certified (sequences equal the bound).
    """
    sizes = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    total = sum(r["count"] for r in sizes)
    columns = [*pieces.columns, "sequence_id", "offset"]
    if not total:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    floor = lower_bound(counts, capacity)

    def told(number: int, bins: int, got: dict) -> None:
        row = {"round": number, "sequences": bins, "bound": floor, "partition_bounds": got["bound"], "packed": got["bins"], "certified": bins == floor}
        _LOG.info("packing %s", row)
        if report is not None:
            report.append(row)

    placed, got = _pack_round(pieces, capacity, math.ceil(total / rows_per_partition), 0, "packed-0", nearly)
    bins, done, tried = got["bins"], [], False
    told(0, bins, got)
    for number in range(1, max_rounds + 1):
        if bins <= floor or got["loose"] < 2:
            break
        loose = placed.filter("loose")
        again, new = _pack_round(loose, capacity, math.ceil(got["loose_rows"] / rows_per_partition), number, f"packed-{number}", nearly, 20 if tried else 100)
        if new["bins"] >= got["loose"]:  # the exchange saved nothing: keep what was
            if tried or new["bins"] > got["loose"]:
                break
            tried = True
        else:
            tried = False
        done.append(placed.filter("NOT loose").select(*columns))
        bins -= got["loose"] - new["bins"]
        placed, got = again, new
        told(number, bins, got)
    out = placed.select(*columns)
    for d in done:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack: a row per piece with its place in a sequence."""
    return pack(materialise(cut_pieces(docs, tokenizer_path, capacity, end_id, key, text), "pieces"), capacity)
