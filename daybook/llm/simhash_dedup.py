"""Near-duplicate groups by SimHash, found through deletion-variant signatures.

A fingerprint has 64 bits; documents link at ``MOST`` = 3 or fewer differing bits. Cut
into two segments of 32, one of them differs by at most one bit. So each segment is
indexed 32 times, each time with one bit wildcarded, and fingerprints that link share one
of their 64 variants. An equality join on variants gives the candidates, a count of
differing bits verifies them.

Copies collapse first: only distinct fingerprints are indexed. A variant that two
fingerprints share is verified at once from its count, minimum and maximum, which
combine before the shuffle. For a variant shared by up to ``group_limit`` fingerprints,
its members (a bounded array) are compared in a task, which returns a spanning forest of
their links, not all pairs. Larger groups are cut again by the same rule on the rest of
the fingerprint, and what is still too large is linked through hubs: fingerprints that
agree outside three given bits differ by at most three, and all patterns of three that
can still matter are tried. Every link between different fingerprints is kept or implied.

Components by alternating large-star and small-star rounds over distinct fingerprints,
each round written to the shared folder; only counts reach the driver.

Defined results: a text without words (null and empty too) has fingerprint zero and
links like any other; repeated rows share a component; a null key is never a component's
id unless all its members are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import materialise, text_or_empty

MOST, WORDS, SEED = 3, 3, 42
_SMALL = 200_000  # keys that may be broadcast
_BLOCK = 200_000  # shingles hashed at a time


def fingerprint(text: str) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, as an unsigned integer."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # splits at \x20 and \x09 to \x0d
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(WORDS, len(words))
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    ends = ends[width - 1 :]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), _BLOCK):
        pairs = zip(begins[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([digest(view[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); no shuffle."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key), text_or_empty(text).alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """variant, fp: 64 rows a fingerprint; a variant names its segment, wildcard and other bits."""

    def of(segment: Column, first: int) -> list[Column]:
        return [F.shiftleft(F.lit(first + b).cast("long"), 32).bitwiseOR(segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b)).cast("long"))) for b in range(32)]

    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    return fps.select(F.explode(F.array(*of(low, 0), *of(high, 32))).alias("variant"), "fp")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def forest(fps: np.ndarray, step: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (unsigned)."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= MOST
        for i, j in zip(*np.nonzero(near)):
            a, b = root(at + int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((at + int(i), int(j)))
    return out


def _forest_edges(groups: DataFrame) -> DataFrame:
    """groups: fps (array of distinct longs) -> a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                fps = np.sort(np.asarray(row.values, np.int64))
                for i, j in forest(fps.view(np.uint64)):
                    a.append(int(fps[i]))
                    b.append(int(fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def _gathered(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Links inside groups of up to ``limit`` members, and the keys of larger groups.

    rows: keys and fp, distinct. Groups of two never gather: minimum and maximum are all
    they hold.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where(F.col("n") > 1)
    counted = materialise(counted, "groups")
    pairs = counted.where((F.col("n") == 2) & (_apart(F.col("a"), F.col("b")) <= MOST)).select("a", "b")
    some = counted.where((F.col("n") > 2) & (F.col("n") <= limit)).select(*keys)
    if some.count() <= _SMALL:  # two longs a key: a few MB at most; beyond it the keys are shuffled
        some = F.broadcast(some)
    members = rows.join(some, keys).groupBy(*keys).agg(F.collect_set("fp").alias("fps")).select("fps")
    return pairs.unionByName(_forest_edges(members)), counted.where(F.col("n") > limit).select(*keys)


def _hub_masks(fp_bits: int, bit: int, other: int) -> list[int]:
    """Wildcard patterns of three for a group split twice.

    ``bit`` may differ (the first variant's wildcard), ``other`` may differ (the second's),
    the sixteen bits of ``fp_bits`` may differ as far as three allow.
    """
    rest = [1 << i for i in range(64) if fp_bits >> i & 1]
    out = []
    for given in ((), (bit,), (other,), (bit, other)):
        out += [sum(given) + sum(c) for c in combinations(rest, MOST - len(given))]
    return out


def links(fps: DataFrame, group_limit: int = 2048) -> DataFrame:
    """a, b: links among distinct fingerprints whose closure is that of all links."""
    first = variants(fps)
    edges, large = _gathered(first, ["variant"], group_limit)
    if large.isEmpty():
        return edges
    # the same cut on the other segment: two parts of sixteen bits, one differs by one at most
    rows = first.join(large, "variant")
    rest = F.when(F.shiftright("variant", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    rows = rows.withColumn("rest", rest)

    def part(shift: int) -> list[Column]:
        half = F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        return [F.shiftleft(F.lit(shift + b).cast("long"), 32).bitwiseOR(half.bitwiseAND(F.lit(0xFFFF ^ (1 << b)).cast("long"))) for b in range(16)]

    second = rows.select("variant", F.explode(F.array(*part(0), *part(16))).alias("second"), "fp")
    more, huge = _gathered(second, ["variant", "second"], group_limit)
    edges = edges.unionByName(more)
    if huge.isEmpty():
        return edges

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, s, fp in zip(*(c.to_pylist() for c in batch.columns)):
                slot, sub = v >> 32, s >> 32  # sub: bit 0 to 31 of the other segment
                base = 32 if slot < 32 else 0
                free = 0xFFFF << (base + (0 if sub >= 16 else 16))
                masks = np.array(_hub_masks(free, 1 << slot, 1 << (base + sub)), np.uint64)
                held = np.uint64(fp & (1 << 64) - 1) & ~masks
                yield pa.RecordBatch.from_arrays([pa.array(masks.view(np.int64)), pa.array(held.view(np.int64)), pa.array(np.full(len(masks), fp, np.int64))], ["mask", "held", "fp"])

    hubs = second.join(huge, ["variant", "second"]).mapInArrow(patterns, "mask long, held long, fp long")
    least = hubs.groupBy("mask", "held").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where(F.col("b") != F.col("most"))
    linked = hubs.join(least.select("mask", "held", "b"), ["mask", "held"]).where(F.col("fp") != F.col("b"))
    return edges.unionByName(linked.select(F.col("fp").alias("a"), "b"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """v, root: the smallest vertex of each vertex's component (a, b undirected).

    Rounds go on until the stars repeat; a run that has not settled after ``max_rounds`` raises.
    """
    edges = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    edges, before = materialise(edges, "stars"), None
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the least of the neighbourhood
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: smaller neighbours, and the vertex, move to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v")
        edges = materialise(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select("v", F.col("u").alias("root"))
        before = state
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", group_limit: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = materialise(fingerprints(docs, key, text), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(fps.select("fp"), group_limit)).withColumnRenamed("v", "fp")
    grouped = fps.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    member = grouped.select("fp", "root").join(named, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(member, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest key.

    Rows with one key are one document. A null key stays only if nothing smaller is known.
    """
    groups = near_duplicates(docs, key, text)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs[key].eqNullSafe(first["_first"]), "left_semi")
