"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 32 bytes cuts each text where its low bits are zero,
so equal passages are cut alike wherever they stand. Documents are dealt by a
content anchor (the smallest hash of a line), which brings copies and near copies
together; a task encodes each distinct chunk once and reuses its ids for every
document that holds it. A chunk's ids are exact except near its ends, where the
cut may have fallen inside a word: each join is encoded again over a window that
grows until its margins hold no other join and their ids equal both chunks' ids.

Why not one global chunk table: moving every chunk to its hash and its ids back to
its documents shuffles about 1.7 times the input, dealing whole documents once 1.0.

Defined results: a null text is empty and has no ids; the string of a special token
is encoded as that token, as the library does; an empty table gives no rows; repeated
rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty
from daybook.llm.encoding import Encoder, byte_alphabet, encoder, groups_by_bytes

WINDOW_BITS = 5  # 32 bytes
#: One fixed random word for each byte value.
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def chunk_cuts(data: np.ndarray, mask_bits: int = 11, least: int = 512, most: int = 16384) -> list[int]:
    """Inner cut positions of a UTF-8 byte array, each at the start of a character.

    A position is a candidate where the hash of the 32 bytes before it has
    ``mask_bits`` zero bits; pieces under ``least`` bytes aren't cut off, and one of
    ``most`` bytes without a candidate is cut there.
    """
    n = len(data)
    if n <= least:
        return []
    h = _GEAR[data]
    for k in range(WINDOW_BITS):
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    found = np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1
    cuts, last = [], 0
    for at in [*found.tolist(), n]:
        while at - last > most:
            last = _char_start(data, last + most)
            if last >= n:
                return cuts
            cuts.append(last)
        if at < n and at - last >= least:
            at = _char_start(data, at)
            if at < n:
                cuts.append(at)
                last = at
    return cuts


def _char_start(data: np.ndarray, at: int) -> int:
    while at < len(data) and 0x80 <= data[at] < 0xC0:
        at += 1
    return at


def word_gaps(data: np.ndarray) -> np.ndarray:
    """Positions of a space or line feed after a printable ASCII character.

    No pre-token of byte-level BPE spans such a position, so encodings meet there.
    """
    a, b = data[:-1], data[1:]
    return np.flatnonzero(((b == 32) | (b == 10)) & (a > 32) & (a < 127)) + 1


class ChunkEncoder:
    """Encodes documents chunk by chunk; keeps the ids of the chunks it has met."""

    def __init__(self, path: str, cache_bytes: int = 48_000_000):
        self.enc: Encoder = encoder(path)
        if self.enc.mode != "byte":
            raise ValueError("chunk reuse needs a byte-level BPE tokenizer")
        self.kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.kept_bytes, self.cache_bytes = 0, cache_bytes
        self.encoded = self.reused = 0
        letters = byte_alphabet()
        self.spell = [b""] * self.enc.vocab_size
        for token, i in self.enc.tok.get_vocab(with_added_tokens=False).items():
            self.spell[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for i, t in self.enc.tok.get_added_tokens_decoder().items():
            self.spell[i] = t.content.encode()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spell.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def _ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.enc.dtype)

    def _chunks(self, wanted: dict[bytes, None]) -> dict[bytes, np.ndarray]:
        """Ids of distinct chunks, from the cache or encoded now, together."""
        have, new = {}, []
        for c in wanted:
            ids = self.kept.get(c)
            if ids is None:
                new.append(c)
            else:
                self.kept.move_to_end(c)
                have[c] = ids
        self.encoded += len(new)
        self.reused += len(have)
        for c, raw in zip(new, self.enc.encode([c.decode() for c in new])):
            have[c] = self.kept[c] = self._ids(raw)
            self.kept_bytes += len(c) + len(raw) + 200
        while self.kept_bytes > self.cache_bytes:
            c, ids = self.kept.popitem(last=False)
            self.kept_bytes -= len(c) + ids.nbytes + 200
        return have

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, exactly those of the library."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.enc.added and self.enc.added.search(t)]
        for i, raw in zip(whole, self.enc.direct([texts[i] for i in whole])):
            out[i] = self._ids(raw)
        plans, wanted = [], {}
        for i, t in enumerate(texts):
            if out[i] is None:
                raw = t.encode()
                data = np.frombuffer(raw, np.uint8)
                edges = [0, *chunk_cuts(data), len(raw)] if raw else [0]
                parts = [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]
                wanted.update(dict.fromkeys(parts))
                plans.append((i, raw, data, edges, parts))
        ids_of = self._chunks(wanted)
        joins = []  # (plan, window) of all documents, encoded together
        for plan in plans:
            if len(plan[4]) > 1:
                gaps = word_gaps(plan[2])
                joins += [(plan, gaps, w) for w in self._windows(plan[3], gaps, len(plan[1]))]
        redone = self.enc.encode([p[1][w[0] : w[3]].decode() for p, _, w in joins])
        fixed: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for (plan, gaps, w), raw in zip(joins, redone):
            fixed.setdefault(plan[0], []).append(self._agree(plan, gaps, w, self._ids(raw), ids_of))
        for i, raw, _, edges, parts in plans:
            if len(parts) < 2:
                out[i] = ids_of[parts[0]] if parts else np.zeros(0, self.enc.dtype)
            else:
                got = self._assemble(edges, parts, ids_of, fixed.get(i, []))
                out[i] = self._ids(self.enc.direct([texts[i]])[0]) if got is None else got
        return out

    @staticmethod
    def _windows(edges: list[int], gaps: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
        """For each join: (from, a, b, to).

        [a, b) reaches to the nearest gaps about the join; [from, to) one word further
        on each side, to compare with the chunks. Windows that overlap are one.
        """
        out: list[tuple[int, int, int, int]] = []
        stops = np.concatenate([[0], gaps, [n]])
        for p in edges[1:-1]:
            k = int(np.searchsorted(stops, p))
            j = k + int(stops[k] == p)  # a join at a gap takes in a word on either side
            w = (int(stops[max(k - 2, 0)]), int(stops[k - 1]), int(stops[j]), int(stops[min(j + 1, len(stops) - 1)]))
            if out and w[1] < out[-1][2]:
                w = (*out.pop()[:2], *w[2:])
            out.append(w)
        return out

    def _slice(self, edges, parts, ids_of, a: int, b: int) -> np.ndarray | None:
        """Chunk ids of the bytes [a, b), None if a token spans an edge."""
        got = []
        k = max(0, int(np.searchsorted(edges, a, "right")) - 1)
        while k < len(parts) and edges[k] < b:
            ids = ids_of[parts[k]]
            ends = np.concatenate([[0], np.cumsum(self.enc.sizes[ids])])
            x, y = max(a, edges[k]) - edges[k], min(b, edges[k + 1]) - edges[k]
            i, j = int(np.searchsorted(ends, x)), int(np.searchsorted(ends, y))
            if ends[i] != x or ends[j] != y:
                return None
            got.append(ids[i:j])
            k += 1
        return np.concatenate(got) if got else np.zeros(0, self.enc.dtype)

    def _agree(self, plan, gaps, w, ids: np.ndarray, ids_of) -> tuple[int, int, np.ndarray]:
        """Ids of [a, b) once the window's margins equal the chunks'; it grows until they do."""
        _, raw, _, edges, parts = plan
        stops = np.concatenate([[0], gaps, [len(raw)]])
        lo, a, b, hi = w
        while True:
            ends = np.concatenate([[0], np.cumsum(self.enc.sizes[ids])]) + lo
            i, j = int(np.searchsorted(ends, a)), int(np.searchsorted(ends, b))
            inside = [e for e in edges[1:-1] if lo < e < a or b < e < hi]
            left, right = self._slice(edges, parts, ids_of, lo, a), self._slice(edges, parts, ids_of, b, hi)
            good = ends[i] == a and ends[j] == b and not inside
            good = good and left is not None and right is not None and np.array_equal(left, ids[:i]) and np.array_equal(right, ids[j:])
            if good or (a == 0 and b == len(raw)):
                return a, b, ids[i:j]
            a, b = lo, hi
            lo = int(stops[max(int(np.searchsorted(stops, lo)) - 1, 0)])
            hi = int(stops[min(int(np.searchsorted(stops, hi)) + 1, len(stops) - 1)])
            ids = self._ids(self.enc.encode([raw[lo:hi].decode()])[0])

    def _assemble(self, edges, parts, ids_of, fixed) -> np.ndarray | None:
        """Chunk ids with the repaired windows in place of what they cover; None if windows cross."""
        windows = self._apart(fixed)
        if windows is None:
            return None
        pieces, at = [], 0  # at: bytes done
        for a, b, ids in [*windows, (edges[-1], edges[-1], None)]:
            c = max(0, int(np.searchsorted(edges, at, "right")) - 1)
            while at < a:
                whole = ids_of[parts[c]]
                stop = min(a, edges[c + 1])
                if at > edges[c] or stop < edges[c + 1]:
                    ends = np.concatenate([[0], np.cumsum(self.enc.sizes[whole])])
                    whole = whole[np.searchsorted(ends, at - edges[c]) : np.searchsorted(ends, stop - edges[c])]
                pieces.append(whole)
                at, c = stop, c + 1
            if ids is not None:
                pieces.append(ids)
                at = b
        return np.concatenate(pieces)

    @staticmethod
    def _apart(fixed):
        """Windows in order; one that grew over its neighbours replaces them."""
        out = []
        for f in sorted(fixed, key=lambda f: (f[0], -f[1])):
            if out and f[1] <= out[-1][1]:
                continue
            if out and f[0] < out[-1][1]:
                return None
            out.append(f)
        return out


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids (binary, little-endian, four bytes an id) and decoded text."""
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    anchor = F.array_min(F.transform(F.split("t", "\n"), lambda line: F.xxhash64(line)))
    rows = rows.withColumn("anchor", anchor)
    # the key splits a group of copies too large for one task
    rows = rows.repartitionByRange("anchor", F.xxhash64("k")).sortWithinPartitions("anchor", "k")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_by_bytes(texts):
                found = coder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([ids.astype("<u4").tobytes() for ids in found], pa.binary()),
                        pa.array([coder.decode(ids) for ids in found], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return rows.select("k", "t").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
