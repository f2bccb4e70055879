"""Exact tokenisation with the tokenizers library and a bounded memo of words.

Byte-level and word BPE never merge across the gap between a non-space
character and a following space or line feed, nor between a letter and a
following ASCII character that is none. A text can therefore be cut there into
*units* whose ids do not depend on what surrounds them. Units repeat in a corpus,
so a task keeps the ids of the units it has met (at most ``memo_entries`` units and
``memo_bytes`` bytes of units and ids) and hands only new ones to the library, many at once.

Texts for which the argument does not hold (they contain another kind of white
space, or the string of an added token) are handed to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space other than the two characters that end a unit. Python's class is
#: wider than the library's, which only sends more texts the direct way.
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Letters known as such to every version of Unicode, before ASCII that is no letter. The
#: dotted capital I is left out: its lower-case form ends in a mark, which is no letter.
_STEM = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]++(?=[ -@\[-`{-~\n]|\Z)"
_BYTE_UNITS = re.compile(rf"[ \n]*+{_STEM}|[ \n]*[^ \n]+|[ \n]+")
_WORD_UNITS = re.compile(rf"{_STEM}|[^ \n]+")
_JOIN = 1500
_MARK = "\x00"


class _Memo(dict):
    """Known units; what did not fit stays in ``extra`` for one batch."""

    extra: dict[str, bytes]

    def __missing__(self, unit: str) -> bytes:
        return self.extra[unit]


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-in for each byte, inverted.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to little-endian id bytes exactly as ``Tokenizer.encode`` does."""

    def __init__(self, path: str, memo_entries: int = 400_000, memo_bytes: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        spec = json.loads(self.tok.to_str())
        self.vocab_size = max(self.tok.get_vocab(with_added_tokens=True).values(), default=0) + 1
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.mode = self._mode(spec)
        self.memo = _Memo()
        self.memo.extra = {}
        self.memo_entries, self.memo_bytes, self.memo_held = memo_entries, memo_bytes, 0
        if self.mode == "byte":
            self.sizes = np.zeros(self.vocab_size, np.int64)
            for token, i in spec["model"]["vocab"].items():
                self.sizes[i] = len(token)
        elif self.mode == "word":
            self.mark = self.tok.encode(_MARK, add_special_tokens=False).ids

    @staticmethod
    def _mode(spec: dict) -> str | None:
        """Which argument for independent units holds for this tokenizer, if any."""
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if spec.get("post_processor") or model.get("type") != "BPE" or model.get("dropout"):
            return None
        if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        parts = pre.get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if norm == ["NFC", "Replace", "Lowercase"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and model.get("end_of_word_suffix"):
            return "word"
        return None

    def direct(self, texts: list[str]) -> list[bytes]:
        """The library's own ids, without units or memo."""
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, text: str) -> bool:
        return bool(_OTHER_SPACE.search(text) or self.added and self.added.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode is None:
            return self.direct(texts)
        find = (_BYTE_UNITS if self.mode == "byte" else _WORD_UNITS).findall
        odd = [i for i, t in enumerate(texts) if self._odd(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(odd, self.direct([texts[i] for i in odd])):
            out[i] = ids
        skip = set(odd)
        cut = {i: find(t) for i, t in enumerate(texts) if i not in skip}
        memo = self.memo
        fresh = [u for u in set().union(*cut.values()) if u not in memo]
        if fresh:
            coded = self._lowered(fresh) if self.mode == "word" else self._units(fresh)
            # what the bounds of the memo still admit; the rest serves this batch alone
            held = np.cumsum([len(u) + len(c) for u, c in zip(fresh, coded)]) + self.memo_held
            room = min(max(0, self.memo_entries - len(memo)), int(np.searchsorted(held, self.memo_bytes, "right")))
            memo.update(zip(fresh[:room], coded[:room]))
            self.memo_held = int(held[room - 1]) if room else self.memo_held
            memo.extra = dict(zip(fresh[room:], coded[room:]))
        get = memo.__getitem__
        for i, units in cut.items():
            out[i] = b"".join(map(get, units))
        memo.extra = {}
        return out

    def _lowered(self, units: list[str]) -> list[bytes]:
        """Ids of units by their lower-case form, which in ASCII has the same ids here."""
        low = [u.lower() if u.isascii() and "<|" not in u else u for u in units]
        new = [u for u in dict.fromkeys(low) if u not in self.memo]
        known = dict(zip(new, self._units(new)))
        return [known[u] if u in known else self.memo[u] for u in low]

    def _units(self, units: list[str]) -> list[bytes]:
        if self.mode == "byte":
            joined = [u for u in units if u[0] in " \n" and u[-1] not in " \n"]
            tail = set(joined)
            single = [u for u in units if u not in tail]
        else:
            joined = [u for u in units if _MARK not in u]
            single = [u for u in units if _MARK in u]
        got = dict(zip(single, self.direct(single)))
        blocks = [joined[i : i + _JOIN] for i in range(0, len(joined), _JOIN)]
        glue = "" if self.mode == "byte" else f" {_MARK} "
        for block, e in zip(blocks, self.tok.encode_batch_fast([glue.join(b) for b in blocks], add_special_tokens=False)):
            ids = np.asarray(e.ids, self.dtype)
            ends = self._ends(block, ids)
            if ends is None:  # never seen; the library's answer a unit at a time
                got.update(zip(block, self.direct(block)))
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            got.update((u, raw[a * width : b * width]) for u, a, b in zip(block, *ends))
        return [got[u] for u in units]

    def _ends(self, block: list[str], ids: np.ndarray) -> tuple[list[int], list[int]] | None:
        """First and past-last token of each unit in the joined text."""
        if self.mode == "byte":
            at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
            want = np.concatenate([[0], np.cumsum([len(u.encode()) for u in block])])
            place = np.searchsorted(at, want)
            if at[-1] != want[-1] or not np.array_equal(at[np.minimum(place, len(at) - 1)], want):
                return None
            return place[:-1].tolist(), place[1:].tolist()
        if len(self.mark) != 1:
            return None
        marks = np.flatnonzero(ids == self.mark[0])
        if len(marks) != len(block) - 1:
            return None
        return [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]


@lru_cache(maxsize=2)
def encoder(path: str, memo_entries: int = 400_000) -> Encoder:
    """The encoder of this Python worker; reused by the tasks that follow in it."""
    return Encoder(path, memo_entries)


def groups_by_bytes(texts: list[str], limit: int = 300_000):
    """Index ranges of about ``limit`` characters each, so that no step holds more."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(column: pa.Array, rows: int = 500) -> Iterator[list[str]]:
    """The texts of an Arrow column as Python strings, ``rows`` at a time and about ``groups_by_bytes`` characters."""
    for at in range(0, len(column), rows):
        texts = column.slice(at, rows).to_pylist()
        for a, b in groups_by_bytes(texts):
            yield texts[a:b]


def encoded_slices(enc: Encoder, column: pa.Array) -> Iterator[bytes]:
    """Ids of each text of an Arrow column."""
    for texts in slices(column):
        yield from enc.encode(texts)
