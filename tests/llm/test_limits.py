"""Names that clash in any case, bounded memory and partitions, plain scores of fitted models, and plain versions of the pipeline's first stages."""

import math
import subprocess
import sys

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import chat_format, chunked_bpe, line_dedup, packing, quality_mil, quality_rules, queries, simhash_dedup, token_output, topk, toxicity
from daybook.llm.common import fold, labels, materialise, scratch_path

TEXTS = ["one line of many words here\nand another line of words", "one line of many words here", None, "", "a b c d e f g h i j k l m n o p q r s t"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named as the operators' own are, in another case."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for i, name in enumerate(["N_LINES", "N_Dropped", "KEPT", "N_Words", "Base_Failed", "SCORE", "PIECE", "Start", "LENGTH", "Sequence_Id", "FINGERPRINT", "Component_Id", "N_TOKENS", "_ROW", "_K", "_T", "Ids", "Part", "Formatted"]):
        docs = docs.withColumn(name, F.lit(i))
    return docs


@pytest.mark.parametrize("run", [
    lambda spark, d: line_dedup.digests(line_dedup.dedup_lines(d)),
    lambda spark, d: quality_rules.verdicts(quality_rules.judge_documents(d)),
    lambda spark, d: simhash_dedup.near_duplicates(d),
    lambda spark, d: chunked_bpe.digests(chunked_bpe.encode_documents(d, queries.public_tokenizers.path("byte_bpe_50k.json"))),
    lambda spark, d: packing.pack_documents(d, queries.public_tokenizers.path("byte_bpe_50k.json")),
    lambda spark, d: token_output.shard_digests(spark, *(lambda folder: (folder, token_output.write_token_shards(d, folder, queries.public_tokenizers.path("word_bpe_49k.json"), end_id=1)))(scratch_path(spark, "t"))),
])
def test_names_in_another_case(spark, clashing, run):
    """Clashing columns change no row."""
    plain = clashing.select("doc_id", "text")
    rows = lambda d: sorted(map(repr, run(spark, d).collect()))
    assert rows(clashing) == rows(plain)


def test_clashing_columns_of_turns_and_vectors(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn int, role string, text string")
    dig = lambda t: sorted(map(repr, chat_format.digests(chat_format.format_conversations(t)).collect()))
    assert dig(turns.withColumn("C", F.lit(1)).withColumn("PART", F.lit(2)).withColumn("Formatted", F.lit("x"))) == dig(turns)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    top = lambda d: sorted(map(repr, topk.top_k(d).collect()))
    assert top(v.withColumn("ROW", F.lit(1)).withColumn("V", F.lit(2)).withColumn("Shard", F.lit(0)).withColumn("SCORE", F.lit(0))) == top(v)


def test_a_long_turn_is_assembled_in_bounds():
    """One turn of 64 MB, controls and all: what is held is a few times its length."""
    code = """
import resource
import pyarrow as pa
from daybook.llm import chat_format as c
text = ("a long turn of words </s> and more \\u00e9 " * 1_600_000)[:64_000_000]
batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array(["user", "assistant"]), pa.array(["hi", text])], ["c", "r", "t"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for part in c._slices(batch):
    buffer, turn_at, a, b = c.assemble(part.column(1), part.column(2))
    n += int(c._points(buffer, turn_at)[-1])
assert n > len(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=cp.__file__.rpartition("/")[0])
    assert done.returncode == 0, done.stderr[-800:]
    assert int(done.stdout) < 500, done.stdout


def test_slices_of_turns_change_nothing(spark, monkeypatch):
    rows = [(i % 4, i, ["system", "user", "assistant", "tool"][i % 4 if i < 40 else i % 3], "é<s>" * (i * 37 % 90) + "[INST]" * (i % 3)) for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    want = sorted(map(repr, chat_format.digests(chat_format.format_conversations(turns)).collect()))
    text = lambda buffer, at: [bytes(buffer[a:b]).decode() for a, b in zip(at, at[1:])]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], ["c", "r", "t"])
    buffer, at, begin, end = chat_format.assemble(batch.column(1), batch.column(2))
    whole, points = text(buffer, at), chat_format._points(buffer, np.concatenate([end, begin]))
    monkeypatch.setattr(chat_format, "SLICE", 300)
    monkeypatch.setattr(chat_format, "LONG", 40)
    parts = list(chat_format._slices(batch))
    assert len(parts) > 5 and sum(map(len, parts)) == len(batch)
    assert [t for p in parts for t in text(*chat_format.assemble(p.column(1), p.column(2))[:2])] == whole
    assert (chat_format._points(buffer, np.concatenate([end, begin])) == points).all()
    assert [len(bytes(buffer[:e]).decode()) for e in end.tolist()] == points[: len(end)].tolist()
    got = sorted(map(repr, chat_format.digests(chat_format.format_conversations(turns)).collect()))
    assert [r.split("formatted")[0] for r in got] == [r.split("formatted")[0] for r in want] and got == want


def test_partitions_do_not_follow_the_pairs(spark):
    most = topk.partitions(17_000_000, spark)
    assert topk.partitions(3, spark) == 3 and most == topk.partitions(1 << 40, spark) <= 4 * max(8, spark.sparkContext.defaultParallelism)
    assert topk.shard_size(10_000) == 8192 and topk.shard_size(10**8) == 48829 and topk.shard_size(10**12) == 131_072
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    assert sorted(map(repr, topk.top_k(v, every=3, shard_rows=20, block_rows=10).collect())) == sorted(map(repr, topk.top_k(v, every=3).collect()))


def test_a_line_is_hot_by_the_partitions():
    assert line_dedup.hot_part(8) == 1000 and line_dedup.hot_part(100_000) == 400_000


def test_sample_is_the_smallest_hashes_that_documents_have(spark):
    """Most labelled ids have no document: the sample is found all the same, in a scan a turn."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 4000, 40)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i // 40 % 2) for i in range(4000)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs, known, "toxic", F.lit(True), 7, 10_000)
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id")).limit(7).collect()]
    assert sorted(zip(texts, y.tolist())) == sorted((f"text {i}", i // 40 % 2) for i in order)


def plain_toxicity(model, text):
    values = [ord(c) + 32 * ("A" <= c <= "Z") for c in text]
    counts = {}
    for n in toxicity.SIZES:
        for i in range(len(values) - n + 1):
            h = 0
            for v in values[i : i + n]:
                h = (h * 0x01000193 + v + 1) % 2**32
            b = (h * (0x9E3779B1 + 2 * n) % 2**32) >> (32 - toxicity.BITS)
            if model.chosen[b]:
                counts[b] = counts.get(b, 0) + 1
    z = model.intercept + sum(float(model.weights[b]) * math.log1p(c * 40 / math.sqrt(len(text) + 200)) for b, c in counts.items())
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def plain_passages(text):
    """The feature rows of one text, byte by byte."""
    raw, out = text.encode(), []
    n = max(1, (len(raw) + quality_mil.PASSAGE // 2) // quality_mil.PASSAGE)
    word = lambda b: b < 128 and chr(b).isalnum()
    starts = [i for i, b in enumerate(raw) if word(b) and (i == 0 or not word(raw[i - 1])) and i + 12 <= len(raw)]
    windows = [raw[i : i + 12] for i in starts]
    for k in range(n):
        a, b = k * quality_mil.PASSAGE, (k + 1) * quality_mil.PASSAGE if k < n - 1 else len(raw)
        part = raw[a:b]
        single, double = np.zeros(quality_mil._N_FINE), np.zeros(quality_mil._N_COARSE**2)
        for i in range(a, b):
            single[quality_mil._FINE[raw[i]]] += 1
            if i + 1 < len(raw):
                double[quality_mil._COARSE[raw[i]] * quality_mil._N_COARSE + quality_mil._COARSE[raw[i + 1]]] += 1
        size = max(1, len(part))
        own = [w for i, w in zip(starts, windows) if a <= i < b]
        again = sum(windows.count(w) > 1 for w in own) / max(1, len(own))
        out.append([*np.sqrt(single / size), *np.sqrt(double / size), len(part) / (single[3] + single[4] + 1) / 10, math.log1p(len(part)) / 6, again, math.log1p(len(raw)) / 10])
    return np.array(out)


def plain_quality(model, text):
    p, total, bag = model.parts, 0.0, np.zeros(quality_mil.HIDDEN)
    for row in plain_passages(text):
        h = np.tanh((row - p["mean"]) / p["spread"] @ p["w"] + p["wb"])
        e = math.exp((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"])
        total, bag = total + e, bag + e * h
    z = float(bag / total @ p["c"] + p["b"][0])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


@pytest.fixture(scope="module")
def fitted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, toxicity.train_model(docs, labels(spark, sf), fold("doc_id", 5) != 0), quality_mil.train_model(docs, labels(spark, sf), fold("doc_id", 4) != 2)


def test_scores_by_hand(spark, sf, fitted):
    """The registered scores of some texts, computed n-gram by n-gram and passage by passage from the fitted parts."""
    docs, toxic, good = fitted
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    short = sorted(texts, key=lambda k: len(texts[k]))
    some = [*short[:6], *short[80:88], short[150]]
    for query, model, plain in ((queries.op4_toxicity, toxic, plain_toxicity), (queries.op6_quality_mil, good, plain_quality)):
        got = {r["doc_id"]: r["score"] for r in query(spark, sf).collect()}
        assert got.keys() == texts.keys()
        for k in some:
            assert got[k] == pytest.approx(plain(model, texts[k]), abs=1e-7), k


def test_first_stages_by_hand(spark, sf, fitted):
    """The decisions of the quality, toxicity and line stages on small documents, and the lines and n_chars that are left."""
    docs = materialise(fitted[0].where(F.length("text") < 900), "few")
    rows = {r["doc_id"]: r for r in docs.collect()}
    train = lambda module, n, test: module.train_model(docs, labels(spark, sf), test(fold("doc_id", n)))
    good = train(quality_mil, 4, lambda f: f != 2)
    kept = {k for k, r in rows.items() if plain_quality(good, r["text"]) >= queries.QUALITY_AT}
    after = materialise(cp.keep_quality(spark, docs, sf), "q")
    assert {r["doc_id"] for r in after.collect()} == kept and 0 < len(kept) < len(rows)
    bad = toxicity.train_model(after, labels(spark, sf), fold("doc_id", 5) != 0)
    clean = {k for k in kept if plain_toxicity(bad, rows[k]["text"]) < queries.TOXIC_AT}
    after = materialise(cp.drop_toxic(spark, after, sf), "t")
    assert {r["doc_id"] for r in after.collect()} == clean
    holders = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for k in sorted(clean):
        for line in set(map(key, rows[k]["text"].split("\n"))):
            holders.setdefault(line, []).append(k)
    gone = lambda k, line: len(key(line)) >= 10 and len(holders[key(line)]) > 1 and holders[key(line)][0] != k
    found = {r["doc_id"]: r for r in cp.dedup_lines(spark, after, sf).collect()}
    assert found.keys() == clean
    for k, r in found.items():
        want = "\n".join(line for line in rows[k]["text"].split("\n") if not gone(k, line))
        assert r["text"] == want and (r["n_chars"] == (len(want) if want != rows[k]["text"] else rows[k]["n_chars"]))
        assert (r["lang"], r["source"]) == (rows[k]["lang"], rows[k]["source"])


@pytest.mark.parametrize("module", [toxicity, quality_mil])
def test_classifiers_are_fitted_in_a_task(spark, monkeypatch, module):
    """The labelled texts never reach the driver: its process gets what the fit returns, no more."""
    import os

    monkeypatch.setattr(module, "fit", lambda texts, y: (os.getpid(), sorted(zip(texts, y.tolist()))))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    process, got = module.train_model(docs, known, F.lit(True))
    assert process != os.getpid() and got == [(f"text {i}", i % 2) for i in range(6)]
