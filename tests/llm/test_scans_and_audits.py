"""License scans, the source audit and centroid clustering against plain versions, by SQL, and on edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import centroids, license_scan, queries, source_divergence
from daybook.llm.common import sliced

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and associated documentation files (the Thing), to deal in it without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."
TEXTS = [
    "", None, " \n", "Under the MIT License", "under the mit licenses", "UNDER-THE-MIT-LICENSE under the mit license, under the mit", "cc by nc by nc cc by nc 4.0", "Apache License, Version 2.0",
    "éunder the mit license", "under\x00the\x7fmit license", "under the MIT License of 1999: cc-by-nc", "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public License; version 3 is not version 2", f"before {MIT} after", MIT[:120], "the license of the software " * 400, "word " * 300_000 + "Released under the MIT License.",
    "cc by nc " * 2000, "No licence here, just MIT and Apache and GNU.",
]
LABELS = {3: "mit", 5: "mit", 6: "cc-by-nc", 7: "apache-2", 10: "cc-by-nc,mit", 11: "gpl-3", 12: "gpl-3", 13: "mit", 16: "mit", 17: "cc-by-nc"}


def sql(sf, text):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(text)
    return [d[0] for d in r.description], sorted(map(repr, r.fetchall()))


def agrees(spark, sf, name):
    names, want = sql(sf, queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for n in [phrase.split()] for i in range(len(words)) if words[i : i + len(n)] == n]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def base_of(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


@pytest.fixture(scope="module")
def licensed(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[10], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_WORDS string").repartition(3)


def test_license_places_by_hand(licensed):
    scanned = license_scan.scan_licenses(licensed)
    assert scanned.columns == ["doc_id", "text", "n_words", "places"]
    rows = license_scan.digests(scanned).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[10] if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert base_of(r) == plain_base(text), r["doc_id"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        if r["doc_id"] is not None:
            assert r["labels"] == LABELS.get(r["doc_id"], ""), r["doc_id"]
            assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
    span = next(p for r in scanned.where("doc_id = 13").collect() for p in r["places"])
    assert span["label"] == "mit" and not span["base"] and abs(span["first"] - 1) <= 3 and span["score"] > 0.6


def test_license_query_against_plain_words(spark, sf):
    rows = queries.op11_license_index(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert base_of(r) == plain_base(texts[r["doc_id"]])
        gpl = "GNU General Public License, version 3" in texts[r["doc_id"]]
        assert r["labels"] == ",".join(sorted({*r["base_labels"].split(","), "gpl-3" if gpl else ""} - {""}))
    assert any(r["labels"] for r in rows)


def test_rarest_words_are_looked_up_first(spark):
    docs = spark.createDataFrame([(i, "the the license version " + ("gnu " if i == 0 else "")) for i in range(9)], "doc_id long, text string")
    total, met = license_scan.document_frequencies(docs, license_scan.NOTICES)
    assert total == 9 and met[b"gnu"] == 1 and met[b"the"] == 9 and met[b"lesser"] == 0
    index = license_scan.Index(license_scan.NOTICES, {w: math.log(10 / (1 + n)) for w, n in met.items()}, probes=3)
    number = {w: i for w, i in index.known.items()}
    present = np.array(sorted(number[w] for w in license_scan.words_of("gnu general public license version 3")))
    words = [w for w, _ in sorted(number.items(), key=lambda x: x[1])]
    for t, own in index.lookups(present).items():
        idf = [index.idf[w] for w in own.tolist()]
        assert len(own) <= 3 and idf == sorted(idf, reverse=True) and index.templates[t].label
        assert words[own[0]] != b"version"


def test_no_license_table_is_empty(licensed):
    assert license_scan.digests(license_scan.scan_licenses(licensed.where("false"))).count() == 0


def test_slices_keep_words_whole():
    body = ("ab cdé " * 50 + "x" * 40 + " end").encode()
    for size in (1, 3, 7, 64, 1000):
        assert [w for part in sliced(body, source_divergence.TERMS, size) for w in part] == body.translate(source_divergence.TERMS).split()


def plain_divergence(rows, min_docs=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, of, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(terms(text)))
        of[lang, source].update(terms(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        n = {s: {t: of[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 1) // (sum(own.values()) + v) for t, c in own.items()} for s, own in n.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            own = [(f(p[s][t], p[None][t]), t) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items, limit in (("pair", pairs, None), ("term", own, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:limit])]
    return sorted(out)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "délta", "EPS", "zeta", "eta", "Éa", "ÉA", "théta", "iota", "kappa", "x", "y1z", "中文"]
    said = lambda k: " ".join(rng.choice(words, k, p=np.arange(len(words), 0, -1) / 120))
    rows = [(said(int(rng.integers(0, 30))), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 4)}") for _ in range(60)]
    rows += [(None, None, None), ("", "fr", "s9"), ("one two", "fr", None), ("the " * 4000, "en", "s0"), rows[3], rows[3], ("alpha alpha", "en", "lonely"), ("12 34 _", "en", "wordless")]
    return rows, spark.createDataFrame([(t, lang, s, 1, "x") for t, lang, s in rows], "text string, lang string, source string, digest int, Term string").repartition(5)


@pytest.mark.parametrize("options", [{}, {"bits": 2}, {"bits": 1, "few": 0}, {"top": 3}, {"few": 0, "min_docs": 1}])
def test_divergence_by_hand(mixed, options):
    """Digests of one and two bits collide all the time, and are split; groups are joined where they are not few."""
    rows, docs = mixed
    got = source_divergence.compare_sources(docs, **options)
    want = plain_divergence(rows, options.get("min_docs", 3), options.get("top", 200))
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == want
    assert want and {r[2] for r in want} == {"pair", "term"}


def test_divergence_of_nothing(mixed):
    assert source_divergence.compare_sources(mixed[1].where("false")).count() == 0


def test_terms_are_counted_in_portions(mixed):
    """A task that holds few terms writes more rows, and the same counts."""
    whole, parts = (source_divergence.count_terms(mixed[1], held=n) for n in (500_000, 3))
    total = lambda f: sorted(map(tuple, f.groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()))
    assert total(whole) == total(parts) and parts.count() > whole.count()


def test_share_is_exact_for_large_counts(spark):
    pairs = [(0, 7), (7, 7), (1, 3), (10**13, 3 * 10**13), (9 * 10**15 - 1, 9 * 10**15), (123456789012345, 987654321098765)]
    frame = spark.createDataFrame(pairs, "a long, b long").withColumn("p", source_divergence.share(F.col("a"), F.col("b")))
    assert [r["p"] for r in frame.collect()] == [1 + 10**9 * a // b for a, b in pairs]


def test_divergence_query_matches_sql(spark, sf):
    agrees(spark, sf, "op12_source_divergence")


def plain_kmeans(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    lot = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)[:k]
    c = [v for _, v in lot]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, own)), j) for j, own in enumerate(c))
    for r in range(rounds + 1):
        found = [near(v) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
                c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    total = sum(d for d, _ in found)
    by = Counter()
    for d, j in found:
        by[j] += d
    return sorted(((i if i is not None else -1, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)))


def clustered(vectors, **options):
    rows = centroids.digests(*centroids.cluster(vectors, **options)).collect()
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows)


def some_vectors(n, spread=0.05, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (12, 64))
    return [(i, (middles[i % 12] + rng.normal(0, spread, 64)).tolist()) for i in range(n)]


def test_kmeans_by_hand(spark):
    rows = some_vectors(300)
    rows += [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, [float("nan")] + [0.0] * 63), (904, [float("-inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, []), (None, [0.25] * 64)]
    rows += [(7, rows[7][1]), (7, [0.0] * 64), (907, [0.0] * 64), (908, [0.0] * 64), (909, [90.0] * 64)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, ID string").repartition(4)
    report = []
    assert clustered(frame, block_rows=50, report=report) == plain_kmeans(rows)
    # most gaps hold: few vectors are looked at again
    assert len(report) == 3 and 0 <= report[-1] < 100
    assert clustered(frame, k=3, rounds=5, block_rows=7) == plain_kmeans(rows, 3, 5)
    assert clustered(frame, rounds=0) == plain_kmeans(rows, rounds=0)


def test_kmeans_where_all_is_tied(spark):
    """Equal vectors, centroids that coincide: the smaller number wins, empty centroids stay."""
    rows = [(i, [float(i % 2)] * 64) for i in range(40)] + [(50 + i, [0.5] * 64) for i in range(5)]
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), block_rows=8) == plain_kmeans(rows)


def test_kmeans_of_few_and_none(spark):
    rows = some_vectors(5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(frame) == plain_kmeans(rows)
    assert clustered(frame.limit(1)) == plain_kmeans(rows[:1])
    assert clustered(frame.where("false")) == []


def test_kmeans_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-(2**20), 2**20, 64).astype(float).tolist()) for i in range(60)]
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_kmeans(rows)
    beyond = clustered(spark.createDataFrame([(0, [1e300] * 64), (1, [-1e300] * 64)], "vec_id long, embedding array<double>"))
    assert [r[2] for r in beyond] == [0, 0]


def test_heaps_hold_their_gaps(spark):
    """After any number of rounds each heap is in order, holds its cluster's vectors, and no vector below the drift is nearer elsewhere."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    points = rng.integers(-40, 40, (500, 64))
    c, drift = points[:6].copy(), np.zeros(6)
    block = centroids.Block(pa.array(range(500)), points, 6)
    block.start(c)
    for _ in range(6):
        new = np.array([points[block.labels == j].sum(0) // max(1, (block.labels == j).sum()) for j in range(6)])
        drift, c = centroids._drifted(drift, c, new), new
        block = centroids.Block.read(block.row(), 64)
        block.advance(c, drift)
        assert (block.labels == centroids.distances(points, c).argmin(1)).all()
        for j, (keys, rows) in enumerate(block.heaps):
            assert sorted(rows.tolist()) == np.flatnonzero(block.labels == j).tolist()
            assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, len(keys)))
        assert (block.sums == np.array([points[block.labels == j].sum(0) for j in range(6)])).all()
    assert block.scanned < 500


def test_kmeans_query_matches_sql(spark, sf):
    agrees(spark, sf, "op13_heap_kmeans")
