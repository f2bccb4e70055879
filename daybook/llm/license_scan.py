"""License texts in documents, found through a positional index of their rarest words.

Templates are licence phrases, notices and texts. An index holds for each of their words
the templates and positions where it stands (postings), and how rare the word is among all
documents (IDF, counted over every document). For a document and a template, those words
of the template that the document has are looked up, the highest IDF first, ``probes`` of
them; every occurrence less its posting's position says where the template would begin.
Beginnings on which enough words agree (within ``slack`` words, for text put in or left
out) are candidates. A candidate counts if every mandatory key phrase stands in the stretch and
enough of the template's word pairs do. An exact phrase is found by its rarest word alone
and compared word by word, so none of its places is missed.

Words: A-Z in lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Whole texts are read, in
slices of some megabytes; only a document that has all words of a phrase, or of a
template's key phrases, is looked at further, and then as one number a word. There is no shuffle but the counts of the templates' words.

Scale: two scans of the texts, each without a shuffle of texts. The index is as large as
the templates, a parameter that the caller states; nothing that is broadcast or collected
grows with the documents (document counts of the templates' own words).

Defined results: a null or empty text has no words and no places; repeated rows are
scanned each; an empty table gives no rows; other columns are passed on (``n_words`` and
``places``, in any case, are replaced).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import others, sliced, text_or_empty

#: Bytes to words: what is no part of a word becomes a blank, A-Z become a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PLACE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
SCAN = pa.struct([("n_words", pa.int64()), ("places", pa.list_(PLACE))])
SCAN_DDL = "n_words long, places array<struct<label string, base boolean, first long, last long, score double>>"


class Template(NamedTuple):
    """A licence text. ``keys`` must stand in it word by word; ``share`` of its word pairs must be found. ``exact``: the text itself, in one piece."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 0.6
    exact: bool = False


#: The phrases of the contract.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)
#: Public notices of common licences.
NOTICES = (
    Template("agpl-3", "GNU Affero General Public License, version 3", ("gnu affero general public license version 3",), 1.0),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template(
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        ("redistribution and use in source and binary forms", "may be used to endorse or promote products"),
    ),
    Template("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc0-1", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    Template("gpl-2", "GNU General Public License, version 2", ("gnu general public license version 2",), 1.0),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
        ("gnu general public license", "version 2 of the license"),
    ),
    Template("gpl-3", "GNU General Public License, version 3", ("gnu general public license version 3",), 1.0),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "version 3 of the license"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        ("permission to use copy modify and or distribute this software", "appear in all copies"),
    ),
    Template("lgpl-2.1", "GNU Lesser General Public License, version 2.1", ("gnu lesser general public license version 2 1",), 1.0),
    Template("lgpl-3", "GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",), 1.0),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software released into the public domain",)),
)


def words_of(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(WORDS).split()


def vocabulary(templates: Sequence[Template]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({w for t in templates for w in words_of(t.text)} | {w for t in templates for k in t.keys for w in words_of(k)}))}


def required(template: Template) -> frozenset[bytes]:
    """Words without which a text doesn't hold the template: all of an exact phrase, those of the mandatory key phrases."""
    return frozenset(w for t in ((template.text,) if template.exact else template.keys) for w in words_of(t))


def numbered(body: bytes, known: dict[bytes, int], needs: Sequence[frozenset[bytes]]) -> tuple[int, np.ndarray | None]:
    """How many words a text has and, where it has all of one of ``needs``, each word's number (-1: unknown)."""
    n, met = 0, set()
    for words in sliced(body, WORDS):
        n += len(words)
        met |= known.keys() & set(words)
    if not any(need <= met for need in needs):
        return n, None
    return n, np.concatenate([np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words)) for words in sliced(body, WORDS)])


class Index:
    """Postings of the templates' words, with the words' IDF."""

    def __init__(self, templates: Sequence[Template], idf: dict[bytes, float], probes: int = 8, slack: int = 12, agree: int = 3):
        self.known = vocabulary(templates)
        self.idf = np.zeros(len(self.known))
        for w, i in self.known.items():
            self.idf[i] = idf[w]
        self.needs = [required(t) for t in templates]
        self.templates, self.probes, self.slack, self.agree = list(templates), probes, slack, agree
        number = lambda text: np.array([self.known[w] for w in words_of(text)], np.int32)
        self.texts = [number(t.text) for t in templates]
        self.keys = [[number(k) for k in t.keys] for t in templates]
        self.postings: dict[int, dict[int, np.ndarray]] = {}
        for t, text in enumerate(self.texts):
            for w in np.unique(text).tolist():
                self.postings.setdefault(w, {})[t] = np.flatnonzero(text == w)
        self.pairs = [np.unique(self._pairs(text)) for text in self.texts]

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        return (a * len(self.known) + b)[(a >= 0) & (b >= 0)]

    def lookups(self, present: np.ndarray) -> dict[int, np.ndarray]:
        """Per template that a document with these words may hold: its words to look up, rarest first."""
        of: dict[int, list[int]] = {}
        for w in present[np.lexsort((present, -self.idf[present]))].tolist():
            for t in self.postings.get(w, ()):
                of.setdefault(t, []).append(w)
        out = {}
        for t, words in of.items():
            own, whole = self.templates[t], len(np.unique(self.texts[t]))
            # a share of the pairs is not to be had without many of the words
            if len(words) >= (whole if own.exact or own.share >= 1 else own.share * whole / 2):
                out[t] = np.array(words[: 1 if own.exact else self.probes], np.int32)
        return out

    def scan(self, ids: np.ndarray) -> list[tuple[str, bool, int, int, float]]:
        """Places (label, exact, first word, last word, score) of the templates, by template and place."""
        wanted = self.lookups(np.unique(ids[ids >= 0]))
        if not wanted:
            return []
        at: dict[int, np.ndarray] = {w: np.flatnonzero(ids == w) for w in sorted({w for ws in wanted.values() for w in ws.tolist()})}
        found = []
        for t in sorted(wanted):
            starts, by = [], []
            for w in wanted[t].tolist():
                offsets = (at[w][:, None] - self.postings[w][t][None, :]).ravel()
                starts.append(offsets)
                by.append(np.full(len(offsets), w))
            starts, by = np.concatenate(starts), np.concatenate(by)
            found += self._exact(t, ids, starts) if self.templates[t].exact else self._near(t, ids, starts, by)
        return found

    def _exact(self, t: int, ids: np.ndarray, starts: np.ndarray) -> list:
        text = self.texts[t]
        starts = np.unique(starts[(starts >= 0) & (starts + len(text) <= len(ids))])
        for j, w in enumerate(text.tolist()):
            starts = starts[ids[starts + j] == w]
        return [(self.templates[t].label, True, s, s + len(text) - 1, 1.0) for s in starts.tolist()]

    def _near(self, t: int, ids: np.ndarray, starts: np.ndarray, by: np.ndarray) -> list:
        own, text, found = self.templates[t], self.texts[t], []
        order = np.argsort(starts, kind="stable")
        starts, by = starts[order], by[order]
        edges = np.flatnonzero(np.diff(starts) > self.slack) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(starts)]):
            if len(np.unique(by[a:b])) < min(self.agree, len(np.unique(text))):
                continue
            lo = max(0, int(starts[a]) - self.slack)
            stretch = ids[lo : int(starts[b - 1]) + len(text) + self.slack]
            if not all(self._holds(stretch, k) for k in self.keys[t]):
                continue
            pairs = self._pairs(stretch)
            score = float(np.isin(self.pairs[t], pairs).mean()) if len(self.pairs[t]) else 1.0
            if score >= own.share:
                first = max(int(starts[a]), 0)
                found.append((own.label, False, first, min(int(starts[b - 1]) + len(text), len(ids)) - 1, score))
        return found

    @staticmethod
    def _holds(ids: np.ndarray, phrase: np.ndarray) -> bool:
        places = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0]) if len(ids) >= len(phrase) else np.zeros(0, np.int64)
        for j, w in enumerate(phrase.tolist()):
            places = places[ids[places + j] == w]
        return len(places) > 0


def document_frequencies(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and in how many of them each word of the templates stands."""
    known = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, n = Counter(), 0
        for batch in batches:
            for body in batch.column(0):
                own: set = set()
                for words in sliced(body.as_py(), WORDS):
                    own |= known.keys() & set(words)
                met.update(own)
                n += 1
        rows = [(b"", n), *met.items()]  # no word is empty
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"])

    counted = docs.select(text_or_empty(text).cast("binary").alias("body")).mapInArrow(count, "word binary, n long")
    # as many rows as the templates have words
    found = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), {w: found.get(w, 0) for w in known}


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, text: str = "text", probes: int = 8, slack: int = 12, agree: int = 3) -> DataFrame:
    """``docs`` with ``n_words`` and ``places``: label, base (an exact phrase), first and last word from 0, score (share of the template found)."""
    total, frequencies = document_frequencies(docs, templates, text)
    index = Index(templates, {w: math.log((1 + total) / (1 + n)) for w, n in frequencies.items()}, probes, slack, agree)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(SCAN_DDL)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for bodies in batches:
            n_words, places, offsets = [], [], [0]
            for body in bodies:
                n, ids = numbered(body.as_py(), index.known, index.needs)
                n_words.append(n)
                places += index.scan(ids) if ids is not None else []
                offsets.append(len(places))
            columns = [pa.array([p[i] for p in places], f.type) for i, f in enumerate(PLACE)]
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(PLACE)))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), held], fields=list(SCAN))

    rows = docs.select(F.struct("*").alias("_row"), scanned(text_or_empty(text).cast("binary")).alias("_scan"))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in others(docs, "n_words", "places")], "_scan.n_words", "_scan.places")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, spans and labels a document."""
    base = F.filter("places", lambda p: p["base"])
    firsts = F.transform(base, lambda p: p["first"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        F.col(key).alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
