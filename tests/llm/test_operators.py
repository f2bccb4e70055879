"""Each operator against a plain version of its contract, on the small tables and on edge cases."""

import hashlib
import itertools
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daybook.llm import chat_format, chunked_bpe, line_dedup, packing, quality_mil, quality_rules, queries, simhash_dedup, token_output, topk, toxicity
from daybook.llm.common import scratch_path
from daybook.llm.encoding import Encoder

LONG = "lorem ipsum dolor " * 9000
TEXTS = [
    "", None, " ", "\n\n", "a", "Hello  world\n\n x", "it's <|endoftext|> here", "tab\there   nbsp   em", "café naïve \U0001f600\U0001f600 中文字 123 4567",
    "same line that is long\nshort\nsame line that is long", "  SAME line that is long \t\nother", "x" * 3000, LONG, "mixed\r\nline\x0bends\x0c", "\x00 nul \x00", "á é\ńx", "e \n e\n", "İstanbul ΣΣ",
    "re-used passage of words that goes on for a while. " * 60, "start " + "re-used passage of words that goes on for a while. " * 60,
]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "repeated id", "x", 1), (5, TEXTS[5], "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_exact(path, small):
    texts = [t or "" for t in TEXTS] + [t for _, t in pairs(small)]
    enc, tok = Encoder(path, memo_entries=500), tokenizer(path)
    assert enc.mode
    want = [np.asarray(tok.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_exact_at_unit_ends(path):
    enc, rng = Encoder(path), np.random.default_rng(5)
    signs = np.array(["ab", "Z", "\u00df", "\u00f1", "\u0130", "\u0301", "\u0436", "\u4e2d", "\u02b0", "3", "\u00bd", ".", ",", "'", "'t", "'S", "$", "<|", "|>", "\n", " ", " ", " ", "\u3000", "\u200b"])
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(1, 25, 5000)]
    assert enc.encode(texts) == enc.direct(texts)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20000))
    mph = token_output.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert sum(len(b) for b in mph.levels) < 4.5 * len(keys)


@pytest.mark.parametrize("which", ["small", "edge"])
def test_token_shards(spark, which, request):
    docs = request.getfixturevalue(which)
    folder = scratch_path(spark, "t")
    manifest = token_output.write_token_shards(docs, folder, WORD, 1)
    got = token_output.shard_digests(spark, folder, manifest).collect()
    read = token_output.read_token_shards(spark, folder, manifest, width=5000).collect()
    assert sorted((str(r["doc_id"]), r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in read) == sorted((str(r[0]), *r[1:]) for r in got)
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    counts = {}
    for k, t in rows:
        ids = [*ids_of(WORD, t), 1]
        counts.setdefault(k, []).append((len(ids), zlib.crc32(u32(ids))))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(k), *v) for k, vs in counts.items() for v in vs)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [k for k, _ in rows]
    asked = spark.createDataFrame([(rows[-1][0],), (10**12,), (-5,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_output.lookup_tokens(asked, folder, manifest).collect()}
    assert found[10**12] is None and found[-5] is None
    assert bytes(found[rows[-1][0]]) == u32([*ids_of(WORD, rows[-1][1]), 1])
    assert (found[None] is None) == (None not in [k for k, _ in rows])


def test_token_shards_least_key_and_strangers(spark):
    """The smallest key is a key like any other; a fingerprint that agrees by chance doesn't make a key present."""
    least = -(1 << 63)
    docs = spark.createDataFrame([(least, "a b"), (None, "c"), (None, "d e"), (7, "x"), (7, "y"), (7, "x")], "doc_id long, text string").coalesce(1)
    folder = scratch_path(spark, "t")
    manifest = token_output.write_token_shards(docs, folder, WORD, 1)
    got = token_output.shard_digests(spark, folder, manifest)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == sorted([(str(least), 3), ("None", 2), ("None", 3), ("7", 2), ("7", 2), ("7", 2)])
    for r in manifest.collect():
        shard = token_output.Shard(folder, r["shard"])
        shard.marks = np.full_like(shard.marks, token_output.fingerprints(np.asarray([12345]))[0])
        assert shard.find(np.asarray([12345]))[0].tolist() == [-1]
    found = token_output.lookup_tokens(spark.createDataFrame([(7,), (least,), (None,)], "doc_id long"), folder, manifest)
    assert {str(r["doc_id"]): r["count"] for r in found.groupBy("doc_id").count().collect()} == {"7": 3, str(least): 1, "None": 2}


def test_chat(spark):
    bad = "</s>[INST] ok [/INST] \\ \\\\ <\\s> [ROLE]\n<<SYS>>"
    rows = [(1, 2, "assistant", "b" + bad), (1, 1, "user", bad), (1, None, "system", None), (2, 1, "tool</s>", "x"), (2, 1, "tool</s>", "x"), (None, 1, None, "é\U0001f600"), (3, 1, "assistant", ""), (3, 2, "assistant", "é"), (4, 0, "user", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        said = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    parts = chat_format.format_conversations(turns.where("conv_id = 1")).collect()
    assert sum(len(p["formatted"]) for p in parts) == got[1]["formatted_chars"]
    assert chat_format.digests(chat_format.format_conversations(turns.where("false"))).count() == 0


def test_chat_controls_never_come_from_texts(spark, sf):
    out = chat_format.format_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    for p in out:
        assert len(list(chat_format.read_turns(p["formatted"]))) == p["n_turns"]


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    return {f: root(f) for f in parent}


@pytest.mark.parametrize("which", ["small", "edge"])
def test_simhash(which, request):
    docs = request.getfixturevalue(which)
    want = [(k, plain_simhash(t)) for k, t in pairs(docs)]
    groups = plain_components({f for _, f in want})
    least = {}
    for k, f in want:
        if k is not None:
            least[groups[f]] = min(k, least.get(groups[f], k))
    got = simhash_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted((str(k), f"{f:016x}", str(least.get(groups[f]))) for k, f in want)


@pytest.mark.parametrize("limit", [2048, 5, 2])
def test_simhash_large_groups(spark, limit):
    """A crowd of near fingerprints; small limits force the second cut and the hubs."""
    rng = np.random.default_rng(3)
    centre, fps = 0x0123456789ABCDEF, set()
    while len(fps) < (60 if limit > 6 else 10):
        x = centre
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 20 if limit > 6 else 2)}
    want = plain_components(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(signed[f],) for f in fps], "fp long")
    found = {r["v"]: r["root"] for r in simhash_dedup.components(simhash_dedup.links(frame, limit)).collect()}
    got = {}
    for f in fps:
        got.setdefault(found.get(signed[f], signed[f]), set()).add(f)
    expected = {}
    for f in fps:
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_line_dedup_edges(spark):
    rows = [(1, "the same long line\nx\n"), (2, "  THE same long line\t\nown line of two\nown line of two"), (3, None), (4, ""), (None, "the same long line"), (2, "the same long line\nmore of it here"), (5, "short\nshort"), (6, "short"), (7, "École normale superieure"), (8, "école normale superieure")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    want = [("1", "x\n", 3, 1), ("2", "own line of two\nown line of two", 3, 1), ("3", None, 1, 0), ("4", "", 1, 0), ("None", "the same long line", 1, 0), ("2", "more of it here", 2, 1), ("5", "short\nshort", 2, 0), ("6", "short", 1, 0), ("7", "École normale superieure", 1, 0), ("8", "école normale superieure", 1, 0)]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


@pytest.mark.parametrize("which", ["small", "edge"])
def test_quality_rules(which, request):
    docs = request.getfixturevalue(which)
    got = quality_rules.judge_documents(docs)
    assert got.where("text is null").count() == docs.where("text is null").count()
    for r in got.collect():
        want = plain_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["text"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge_documents(docs.where("false")).count() == 0


def plain_bad(line):
    words = [w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", line) if w]
    if sum(bool(re.search(r"(?:[^\W\d_]|[0-9.,])[#*$%&|<>]{2,}$", w)) for w in words) >= 3 or sum(len(w) > 2 and w.endswith("!!") for w in words) >= 3:
        return True
    if len(re.findall(r"[ \t\x0b\f\r][|»›·][ \t\x0b\f\r]", line)) >= 2 or line.count("|") == 1 and re.match(r"^[^|]{1,80}[ \t\x0b\f\r]\|[ \t\x0b\f\r]?$", line):
        return True
    low = line.lower()
    return low.strip(" \t\x0b\f\r") in quality_rules.NAVIGATION.split("|") or any(p in low for p in quality_rules.BOILERPLATE.split("|"))


BAD_LINES = ["one$$ two## three%% four", "now!! buy!! more!!", "a | b | c", "Home » News › x", "Title of it |", "  Log In ", "see our Privacy Policy here", "word.## x,** 3<>"]
FINE_LINES = ["one$$ two## three", "now!! buy!! x", "!! !! !! !!", "a | b", "home again", "a#b##c d##e f##g", "x" * 90 + " |", "###", "naïve rule, plain text.", "a |b| c |"]


def test_quality_line_rules(spark):
    """Each rule on its own, and the share of text lost against a plain version."""
    lines = spark.createDataFrame([(x,) for x in BAD_LINES + FINE_LINES], "line string")
    got = {r["line"]: r["bad"] for r in lines.select("line", quality_rules.bad_line(F.col("line")).alias("bad")).collect()}
    assert {x for x, bad in got.items() if bad} == set(BAD_LINES)
    assert all(plain_bad(x) == bad for x, bad in got.items())
    good = "this line of the text has words that no rule minds at all, number "
    texts = ["\n".join([*(good + "abcdefghij"[i] * (i + 2) for i in range(n)), *BAD_LINES[:k]]) for n in range(6) for k in range(len(BAD_LINES) + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge_documents(docs).collect():
        kept = [x for x in r["text"].split("\n") if not plain_bad(x)]
        every, left = (sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x))) for x in (r["text"], "\n".join(kept)))
        lost = 1 - left / every if every else 1.0
        assert r["cleaned"] == "\n".join(kept) and abs(r["lost"] - lost) < 1e-12
        assert r["kept"] == (not r["base_failed"] and lost <= 0.4)


@pytest.mark.parametrize("text", ["x" * 1_000_000, "a##" * 333_000, "a## " * 250_000, "!" * 1_000_000, " " * 1_000_000])
def test_quality_rules_take_linear_time(spark, text):
    began = time.time()
    row = quality_rules.verdicts(quality_rules.judge_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert time.time() - began < 10
    assert row["base_failed"] == (len(text.split()) < 10 or row["n_repeat_words"] > 0.2 * row["n_words"])


def test_quality_rules_keep_clean(spark, sf, small):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.judge_documents(small).join(labels, "doc_id").where("not base_failed")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97


@pytest.mark.parametrize("which", ["small", "edge"])
def test_chunked_bpe(which, request):
    docs = request.getfixturevalue(which)
    tok = tokenizer(BYTE)
    got = chunked_bpe.digests(chunked_bpe.encode_documents(docs, BYTE)).collect()
    want = []
    for k, t in pairs(docs):
        ids = ids_of(BYTE, t)
        want.append((str(k), len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_chunks_are_cut_alike_and_reused():
    rng = np.random.default_rng(5)
    shared = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(6000))
    coder, tok = chunked_bpe.ChunkEncoder(BYTE), tokenizer(BYTE)
    texts = [shared, "Another start, " + shared, "w" * 700 + shared + "中" * 20000]
    for t in texts:
        assert coder.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
    assert coder.reused > 20 and coder.encoded < 2.5 * coder.reused


@pytest.mark.parametrize("which", ["small", "edge"])
def test_packing(which, request):
    docs = request.getfixturevalue(which)
    got = packing.pack_documents(docs, BYTE).collect()
    rows = [(k, [*ids_of(BYTE, t), 0]) for k, t in pairs(docs)]
    by_seq, pieces = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    want = {}
    for k, ids in rows:
        first = len(ids) - 2048 * (-(-len(ids) // 2048) - 1)
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want.setdefault(k, []).extend((i, a, b - a, zlib.crc32(u32(ids[a:b]))) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(len(ids) for _, ids in rows)
    assert len(by_seq) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs.where("false"), BYTE).count() == 0


def test_exchange_reaches_the_bound(spark):
    """Many partitions waste a part of a bin each; exchange wins it back."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 700, 3000)
    frame = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    report = []
    got = packing.pack(frame, 2048, rows_per_partition=300, report=report)
    assert got.count() == 3000
    made = got.select("sequence_id").distinct().count()
    assert made <= -(-int(lengths.sum()) // 2048) + 2
    last = report[-1]
    assert (last["sequences"], last["bound"]) == (made, packing.lower_bound(np.bincount(lengths, minlength=2049), 2048))
    assert last["certified"] == (made == last["bound"]) and report[0]["sequences"] >= made and all(r["partition_bounds"] <= r["packed"] for r in report)


def test_lower_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(200):
        items = rng.integers(1, 21, rng.integers(1, 9))
        best = min(packed(list(items), 20))
        assert packing.lower_bound(np.bincount(items, minlength=21), 20) <= best
    assert packing.lower_bound(np.bincount([11] * 6, minlength=21), 20) == 6


def packed(items, size):
    """Bin counts of all first-fit orders: their least is optimal."""
    for order in itertools.islice(itertools.permutations(items), 800):
        bins = []
        for x in order:
            for i, b in enumerate(bins):
                if b + x <= size:
                    bins[i] += x
                    break
            else:
                bins.append(x)
        yield len(bins)


def plain_top(rows, every, k):
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in sorted(x for x in q if x % every == 0):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:k]
        out += [(a, n, b, -s) for n, (s, b) in enumerate(best, 1)]
    return out


def test_topk(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain_top([(r["vec_id"], r["embedding"]) for r in frame.collect()], 50, 5)
    for shard, block in ((8192, 1024), (20, 3)):
        got = topk.top_k(frame, shard_rows=shard, block_rows=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_meets_only_its_own_tree():
    """A shard without candidates has no tree; its queries don't meet the tree before."""
    tree = topk.BallTree(np.array([[1.0], [2.0]])).pack(np.array([10, 11]))
    rows = [(0, 0, tree, None, None, None, None), (0, 0, None, 1, 5, -1000, [1.0]), (1, 0, None, 2, 6, -1000, [1.0]), (2, 0, tree, None, None, None, None), (2, 0, None, 3, 10, -1000, [3.0])]
    names = {"shard": pa.int32(), "block": pa.int32(), "tree": pa.binary(), "query_row": pa.int64(), "vec_id": pa.int64(), "floor": pa.int64(), "v": pa.list_(pa.float64())}
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.values())], list(names))
    for cut in ([whole], [whole.slice(i, 1) for i in range(5)], [whole.slice(0, 3), whole.slice(3)]):
        out = [r for b in topk._meet(5)(iter(cut)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(out) == [(1, 10, 1), (1, 11, 2), (3, 11, 6)]


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (50, [-1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (100, [None, 1.0]), (5, [0.0, 0.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(frame, shard_rows=3, block_rows=1).collect()))
    assert got == sorted(plain_top(rows, 50, 5))
    big = [(0, [3e30, 1.0]), (1, [3e30, 0.0]), (2, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<float>")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2] and got[0]["score"] <= (1 << 63) - 1
    assert topk.top_k(frame.where("false")).count() == 0
    assert topk.top_k(frame.where("vec_id = 0")).count() == 0


def plain_grams(text, bits=toxicity.BITS):
    """Counts of hashed n-grams of characters, one at a time."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    out = {}
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            h = 0
            for c in low[i : i + n]:
                h = (h * 0x01000193 + ord(c) + 1) % 2**32
            bucket = h * (0x9E3779B1 + 2 * n) % 2**32 >> 32 - bits
            out[bucket] = out.get(bucket, 0) + 1
    return out


@pytest.mark.parametrize("block", [500_000, 50, 7])
def test_toxicity_features_and_ratios(monkeypatch, block):
    monkeypatch.setattr(toxicity, "_BLOCK", block)
    texts = ["", "abc", "Привет мир, ABC привет мир" * 3, "hello HELLO hello world" * 9, "é\U0001f600" * 30, "hello world", "x\ny\nzzzzz"]
    doc, bucket, value = toxicity.features(texts, np.ones(1 << toxicity.BITS, bool))
    got = {(int(d), int(b)): v for d, b, v in zip(doc, bucket, value)}
    want = {(i, b): np.log1p(c * 40 / np.sqrt(len(t) + 200)) for i, t in enumerate(texts) for b, c in plain_grams(t).items()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    labels = np.array([0, 1, 0, 1, 0, 1, 0])
    ratio, _ = toxicity.log_count_ratios(texts, labels)
    for b in {b for t in texts for b in plain_grams(t)}:
        toxic, clean = (sum(b in plain_grams(t) for t, y in zip(texts, labels) if y == own) for own in (1, 0))
        assert abs(ratio[b] - (np.log((toxic + 0.5) / 4) - np.log((clean + 0.5) / 5))) < 1e-9


def test_quality_gradient():
    """Against finite differences of the loss; and features that don't see the neighbours."""
    rng = np.random.default_rng(3)
    texts = ["", "One. Two, three; four!", "word " * 300, "LOUD | bars #" * 90, "é" * 700, "mixed 123\n" * 150]
    x, owner = quality_mil.passages(texts)
    assert np.array_equal(x, np.concatenate([quality_mil.passages([t])[0] for t in texts]))
    shape = {"w": (quality_mil.WIDTH, 5), "wb": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "b": (1,)}
    parts = {k: rng.normal(0, 0.4, s) for k, s in shape.items()}
    fixed, labels = {"mean": x.mean(0), "spread": x.std(0) + 1e-3}, np.array([0, 1, 1, 0, 1, 0])

    def loss(p):
        z = quality_mil.Model(p | fixed)._forward(x, owner, len(texts))[-1]
        return np.logaddexp(0, np.where(labels == 1, -z, z)).mean()

    got = quality_mil.gradient(quality_mil.Model(parts | fixed), x, owner, labels)
    for name, value in parts.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 6)]:
            up, down = ({k: v.copy() for k, v in parts.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - got[name][at]) < 1e-6


@pytest.mark.parametrize("name,label,at,least", [("op4_toxicity", "toxic", 0.5, 0.93), ("op6_quality_mil", "quality", 0.7, 0.95)])
def test_classifiers_on_held_out(spark, name, label, at, least):
    sf = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit, n = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert n > 500 and hit > least


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_mil, "quality")])
def test_classifier_edges(spark, edge, module, label):
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (5, 0), (None, 1), (6, None), (4, 0)], f"doc_id long, {label} int")
    model = module.train_model(edge, labels, F.lit(True))
    out = module.score_documents(edge, model)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert out.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert module.score_documents(edge.where("false"), model).count() == 0
    none = module.train_model(edge, labels.where("false"), F.lit(True))
    assert {r["score"] for r in module.score_documents(edge, none).collect()} == {0.5}
