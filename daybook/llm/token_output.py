"""Token ids as raw binary shards with a minimal perfect hash index.

Layout of an output folder::

    shard-00000.ids   the ids of the shard's documents, nothing else, as
                      little-endian unsigned integers (two bytes where the
                      vocabulary allows, else four), documents in ascending key
    shard-00000.idx   JSON header, then the document table (keys, token offsets)
                      and the index: bit arrays of a minimal perfect hash, and
                      per slot a 32-bit fingerprint, the first document's number
                      and the number of documents with the key

A key is found with a fixed number of hash probes: level bit arrays give the
slot, the stored fingerprint rejects most keys that were never written and the
stored key the rest, the slot names the first document of the key and how many
follow it, and the offsets name the bytes. Rows that repeat a key stand side by side.

Defined results: a null text is empty and holds only the end id; rows with a null
key come first, are counted in the header and are null again when read; an empty
table gives an empty folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty
from daybook.llm.encoding import encoded_slices, encoder

_GAMMA, _MAX_LEVELS = 2.0, 40
_MANIFEST = "shard int, n_docs long, n_nulls long, n_tokens long, first_key long, last_key long"
_ROWS = "doc_id long, start long, ids binary"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """SplitMix64 finaliser of ``keys`` under a seed (the multipliers are fixed values)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x51ED) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct keys.

    Level after level, each key not yet placed sets a bit of an array twice as
    long as the keys left; bits hit once place their key, the others go on. A
    key's slot is the rank of its bit, so ``n`` keys take slots 0 to n - 1 at
    under four bits each.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            if len(levels) == _MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(1, int(_GAMMA * len(left)))
            at = mix(left, len(levels)) % np.uint64(size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(hits == 1)
            left = left[hits[at.astype(np.int64)] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it (surely absent)."""
        found = np.full(len(keys), -1, np.int64)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            todo = np.flatnonzero(found < 0)
            if not len(todo):
                break
            at = (mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[todo[hit]] = ranks[at[hit]]
        return found


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _index_bytes(keys: np.ndarray, nulls: int, offsets: np.ndarray, dtype: str) -> bytes:
    """keys: of all documents, the ``nulls`` first ones unused, then ascending, repeats included; offsets: n + 1 token offsets."""
    known = keys[nulls:]
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]])) if len(known) else np.zeros(0, np.int64)
    unique = known[first]
    mph = PerfectHash.build(unique)
    slots = mph.slots(unique)
    marks, docs, runs = np.zeros(mph.n, "<u4"), np.zeros(mph.n, "<u4"), np.zeros(mph.n, "<u4")
    marks[slots], docs[slots], runs[slots] = fingerprints(unique), first + nulls, np.diff(np.append(first, len(known)))
    parts = [keys.astype("<i8").tobytes(), offsets.astype("<u8").tobytes(), marks.tobytes(), docs.tobytes(), runs.tobytes(), *(np.packbits(b).tobytes() for b in mph.levels)]
    head = json.dumps({"version": 2, "dtype": dtype, "n_docs": len(keys), "n_nulls": nulls, "n_keys": int(mph.n), "levels": [len(b) for b in mph.levels]}).encode()
    return b"DBTK" + len(head).to_bytes(4, "little") + head + b"".join(parts)


class Shard:
    """Keyed access to one shard: ``find`` by the index, ``read`` by byte range."""

    def __init__(self, folder: str, shard: int):
        self.store, root = _store(folder)
        self.ids_path = f"{root}/shard-{shard:05d}.ids"
        with self.store.open_input_stream(f"{root}/shard-{shard:05d}.idx") as f:
            raw = f.read()
        if raw[:4] != b"DBTK":
            raise ValueError(f"shard {shard} has no index")
        at = 8 + int.from_bytes(raw[4:8], "little")
        head = json.loads(raw[8:at])
        self.dtype, self.nulls = np.dtype(head["dtype"]), head["n_nulls"]

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        n, k = head["n_docs"], head["n_keys"]
        self.keys, self.offsets = take("<i8", n), take("<u8", n + 1).astype(np.int64)
        self.marks, self.docs, self.runs = take("<u4", k), take("<u4", k), take("<u4", k)
        levels = []
        for size in head["levels"]:
            levels.append(np.unpackbits(take("u1", (size + 7) // 8), count=size).astype(bool))
        self.mph = PerfectHash(levels)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document of each key (-1 where the shard doesn't hold it) and how many it has."""
        slots = self.mph.slots(keys)
        first, run = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        ok = slots >= 0
        ok[ok] = self.marks[slots[ok]] == fingerprints(keys[ok])
        ok[ok] = self.keys[self.docs[slots[ok]]] == keys[ok]
        first[ok], run[ok] = self.docs[slots[ok]], self.runs[slots[ok]]
        return first, run

    def read(self, source, first: int, past: int) -> np.ndarray:
        """Ids of the documents numbered first to past - 1."""
        a, b = int(self.offsets[first]), int(self.offsets[past])
        width = self.dtype.itemsize
        return np.frombuffer(source.read_at((b - a) * width, a * width), self.dtype)

    def documents(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Document numbers, token offsets and ids (four bytes an id) of all documents, by their keys.

        The documents of null keys come first. Each distinct key then goes through the
        index, and the documents that it names are read, about ``width`` ids at a time.
        """
        known = self.keys[self.nulls :]
        first, run = self.find(known[np.concatenate([[True], known[1:] != known[:-1]])] if len(known) else known)
        ahead = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
        number = np.concatenate([np.arange(self.nulls), np.repeat(first, run) + ahead])
        if len(number) != len(self.keys) or (number < 0).any():
            raise ValueError(f"index of {self.ids_path} doesn't hold all its documents")
        sizes = self.offsets[number + 1] - self.offsets[number]
        with self.store.open_input_file(self.ids_path) as source:
            a, ends = 0, np.cumsum(sizes)
            while a < len(number):
                b = int(np.searchsorted(ends, ends[a] - sizes[a] + width, "right"))
                b = min(max(b, a + 1), len(number), a + 4096)
                some, ids = number[a:b], []
                # documents that stand side by side are read at once
                edges = np.flatnonzero(np.diff(some) != 1) + 1
                for x, y in zip([0, *edges.tolist()], [*edges.tolist(), b - a]):
                    raw = self.read(source, int(some[x]), int(some[y - 1]) + 1).astype("<u4").tobytes()
                    at = 4 * (self.offsets[some[x:y]] - self.offsets[some[x]])
                    ids += [raw[i : i + 4 * n] for i, n in zip(at.tolist(), sizes[a + x : a + y].tolist())]
                yield some, self.offsets[some], ids
                a = b


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every document's ids to ``folder`` and return the manifest, one row a shard.

    Documents are range-partitioned on the key (a hash of the text breaks up runs of
    one key), so shards follow each other in key order and no task holds more than
    its range. Only the text is shuffled, once. A task writes under its attempt's
    name and renames when whole: a lost executor's shard is simply written again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))  # nulls first below: they begin the first shards
    # the hash of the text comes second in the order, so equal rows give equal files
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"), "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/shard-{task.partitionId():05d}"
        part = f"{final}.{task.taskAttemptId()}.part"
        enc = encoder(tokenizer_path)
        kind = enc.dtype if end_id is None or end_id < 1 << 16 else np.dtype("<u4")
        tail = b"" if end_id is None else np.asarray([end_id], kind).tobytes()
        keys, counts, nulls = [], [], 0
        with store.open_output_stream(f"{part}.ids") as out:
            for batch in batches:
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                nulls += batch.column(0).null_count
                for ids in encoded_slices(enc, batch.column(1)):
                    if kind != enc.dtype:
                        ids = np.frombuffer(ids, enc.dtype).astype(kind).tobytes()
                    out.write(ids + tail)
                    counts.append((len(ids) + len(tail)) // kind.itemsize)
        if not counts:
            store.delete_file(f"{part}.ids")
            return
        every = np.concatenate(keys).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        with store.open_output_stream(f"{part}.idx") as out:
            out.write(_index_bytes(every, nulls, offsets, kind.str))
        for end in ("ids", "idx"):
            store.move(f"{part}.{end}", f"{final}.{end}")
        known = every[nulls:]
        ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
        row = [task.partitionId(), len(every), nulls, int(offsets[-1]), *ends]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.int64()) for i, v in enumerate(row)], ["shard", "n_docs", "n_nulls", "n_tokens", "first_key", "last_key"])

    # a row a shard: the manifest is small however large the corpus
    found = sorted(rows.mapInArrow(write, _MANIFEST).collect(), key=lambda r: r["shard"])
    return spark.createDataFrame(found, _MANIFEST)


def _over_shards(spark: SparkSession, manifest: DataFrame, read, schema: str) -> DataFrame:
    """``read(shard number, ids before the shard)`` of every shard, a task each."""
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], start))
        start += r["n_tokens"]
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from read(number, base)

    return spark.createDataFrame(rows, "shard int, start long").repartition(len(rows)).mapInArrow(run, schema)


def read_token_shards(spark: SparkSession, folder: str, manifest: DataFrame, width: int = 500_000) -> DataFrame:
    """Every document of a folder: doc_id, start, ids (binary, four bytes an id).

    Each distinct key of a shard is looked up in its index, and the documents that the
    index names are read from their offsets, about ``width`` ids at a time.
    """

    def read(number: int, base: int) -> Iterator[pa.RecordBatch]:
        shard = Shard(folder, number)
        for some, at, ids in shard.documents(width):
            yield pa.RecordBatch.from_arrays([pa.array(shard.keys[some], pa.int64(), mask=some < shard.nulls), pa.array(at + base, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return _over_shards(spark, manifest, read, _ROWS)


def shard_digests(spark: SparkSession, folder: str, manifest: DataFrame, width: int = 500_000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read as ``read_token_shards`` reads them."""

    def read(number: int, base: int) -> Iterator[pa.RecordBatch]:
        shard = Shard(folder, number)
        for some, at, ids in shard.documents(width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.keys[some], pa.int64(), mask=some < shard.nulls), pa.array(at + base, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return _over_shards(spark, manifest, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup_tokens(keys: DataFrame, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of chosen keys: doc_id, ids (null where the key was never written).

    The manifest's key ranges (a row a shard) route each key to its shard; there the
    index answers. Keys that a range boundary leaves in two shards give a row each.
    """
    listed = sorted(manifest.collect(), key=lambda r: r["shard"])
    ranges = sorted((r["first_key"], r["last_key"], r["shard"]) for r in listed if r["first_key"] is not None)
    firsts, lasts = np.asarray([r[0] for r in ranges], np.int64), np.asarray([r[1] for r in ranges], np.int64)
    numbers, unkeyed = [r[2] for r in ranges], [r["shard"] for r in listed if r["n_nulls"]]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_k, out_s = [], []
            for k in batch.column(0).to_pylist():
                if k is None:
                    held = unkeyed
                else:
                    held = numbers[int(np.searchsorted(lasts, k, "left")) : int(np.searchsorted(firsts, k, "right"))]
                for s in held or [-1]:
                    out_k.append(k)
                    out_s.append(s)
            yield pa.RecordBatch.from_pydict({"k": pa.array(out_k, pa.int64()), "shard": pa.array(out_s, pa.int32())})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        source = None
        for batch in batches:
            got_k, got = [], []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = []
                if s >= 0:
                    if opened is None or opened[0] != s:
                        opened = (s, Shard(folder, s))
                        source = opened[1].store.open_input_file(opened[1].ids_path)
                    shard = opened[1]
                    first, n = (0, shard.nulls) if k is None else (int(x[0]) for x in shard.find(np.asarray([k], np.int64)))
                    ids = [shard.read(source, i, i + 1).astype("<u4").tobytes() for i in range(first, first + n)]
                for one in ids or [None]:
                    got_k.append(k)
                    got.append(one)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(got_k, pa.int64()), "ids": pa.array(got, pa.binary())})

    routed = keys.select(F.col(key).cast("long").alias("k")).mapInArrow(route, "k long, shard int")
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(fetch, "doc_id long, ids binary")
