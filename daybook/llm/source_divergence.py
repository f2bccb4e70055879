"""How far the sources of a language differ in their terms, with strings materialised late.

Every (lang, source) group and every lang gives each kept term (one in at least
``min_docs`` of the lang's documents) a smoothed integer share. Sources are compared in
pairs by a sum over all kept terms, and each group with its lang by its leading terms.

A task counts its own terms and stores a row a group and term: a 64-bit digest, the
string, occurrences and documents. What is shuffled is the digest with the counts; the
strings stay in their own column of the stored table. One more shuffle, of a row a digest
and task, takes the smallest and the largest string of each digest: where they differ, terms
collide, and those digests alone are counted again by their strings (split). Digests then
stand for terms everywhere; the text is joined back only for the terms of a group's leading
``top`` values and their ties.

The sum of a pair of sources needs only the terms that either of them has: what the rest
add is a number times how many they are; what a term adds that one of them has follows
from how many terms share its count; only terms that both have are met term by term.

Scale: tasks combine before shuffles, so a hot source or term is a row a task. A lang's terms
are dealt by digest. Ranks take the leading rows of each task before rows of a group meet.
Group totals (a row a group) are broadcast only up to ``few`` sources a lang and ``many``
groups; beyond that they are joined. The pairs are as many as the result asks for.
Arithmetic is in longs, exact up to 9e15 terms a group: shares are divided out three digits
at a time.

Defined results: null text, lang or source count as ''; repeated rows are documents of
their own; a lang without kept terms gives its pairs with 0; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import let, materialise, sliced

#: Bytes to terms: what is no part of a term becomes a blank, A-Z become a-z.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def digest(term: bytes, bits: int = 64) -> int:
    """The first ``bits`` of a term's hash, as a signed long."""
    return (xxhash.xxh64_intdigest(term) >> (64 - bits)) - (1 << 63 if bits == 64 else 0)


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64, held: int = 500_000) -> DataFrame:
    """lang, source, digest, term, n, docs: a row a task (or ``held`` terms of it), group and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple, Counter] = defaultdict(Counter)
        docs_of: dict[tuple, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in said.items():
                terms, own = list(counts), docs_of[lang, source]
                columns = [[lang] * len(terms), [source] * len(terms), [digest(t, bits) for t in terms], [t.decode("utf-8", "replace") for t in terms], list(counts.values()), [own[t] for t in terms]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL)], schema=_PARTIAL)
            said.clear()
            docs_of.clear()

        room = held
        for batch in batches:
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts, own, before = said[lang, source], set(), len(said[lang, source])
                for words in sliced(body.as_py(), TERMS):
                    counts.update(words)
                    own.update(words)
                docs_of[lang, source].update(own)
                room -= len(counts) - before
                if room <= 0:
                    yield from rows()
                    room = held
        yield from rows()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang, source)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return plain.mapInArrow(count, "lang string, source string, digest long, term string, n long, docs long")


def split_collisions(partial: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """digest, term of the digests that one term has; digest of those that several have (None: there are none)."""
    ends = materialise(partial.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "ends")
    several = ends.where("term <> last").select("digest")
    return ends.where("term = last").select("digest", "term"), None if several.isEmpty() else several


def group_terms(partial: DataFrame, several: DataFrame | None, min_docs: int) -> DataFrame:
    """lang, digest, term (only where its digest has several), n, held: each kept term with its count in every source that has it."""

    def gather(rows: DataFrame, keys: list[str]) -> DataFrame:
        # rows meet by term once: both groupings follow from that
        met = rows.repartition("lang", "digest").groupBy("lang", *keys, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        terms = met.groupBy("lang", *keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
        return terms.where(F.col("docs") >= min_docs)

    if several is None:
        return gather(partial.drop("term"), ["digest"]).select("lang", "digest", F.lit(None).cast("string").alias("term"), "n", "held")
    alone = gather(partial.drop("term").join(several, "digest", "left_anti"), ["digest"]).withColumn("term", F.lit(None).cast("string"))
    split = gather(partial.join(several, "digest", "left_semi"), ["digest", "term"])
    names = ["lang", "digest", "term", "n", "held"]
    return alone.select(*names).unionByName(split.select(*names))


def share(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * count / total), for 0 <= count <= total."""

    def more(state: Column) -> Column:
        left = state["rest"] * 1000
        return F.struct((state["out"] * 1000 + _div(left, total)).alias("out"), (left % total).alias("rest"))

    start = F.struct(_div(count, total).alias("out"), (count % total).alias("rest"))
    large = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, lambda a, _: more(a))["out"]
    return 1 + F.when(count <= 9_000_000_000, _div(count * 1_000_000_000, total)).otherwise(large)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)² / q)"""
    return _div((p - q) * (p - q), q)


def compare_sources(
    docs: DataFrame, min_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64, few: int = 256, many: int = 100_000
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (a source or a term), value, rank."""
    partial = materialise(count_terms(docs, text, lang, source, bits), "partial")
    names, several = split_collisions(partial)
    terms = materialise(group_terms(partial, several, min_docs), "terms")

    # a row a lang, a row a group: groups without a kept term too
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    counted = terms.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("n_group"))
    every = docs.select(*[F.coalesce(F.col(a).cast("string"), F.lit("")).alias(b) for a, b in ((lang, "lang"), (source, "source"))]).distinct()
    groups = every.join(counted, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "n_lang", "n_group"])
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(1).cast("long"), F.col("n_group") + F.col("v"))))
    groups = materialise(groups, "groups")
    widest, n_groups = groups.groupBy("lang").agg(F.count("*").alias("k")).agg(F.max("k"), F.sum("k")).first()
    small = (widest or 0) <= few and (n_groups or 0) <= many
    sized = F.broadcast if small else (lambda frame: frame)

    # each kept term with its share in every source that has it
    if small:
        totals = groups.where("v > 0").groupBy("lang", "v", "n_lang").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("n_group", "p0")))).alias("of"))
        shared = lambda h: let(F.element_at("of", h["source"]), lambda g: F.struct(h["source"].alias("source"), share(h["n"] + 1, g["n_group"] + F.col("v")).alias("p"), g["p0"].alias("p0")))
        met = terms.join(F.broadcast(totals), "lang").select("lang", "digest", "term", share(F.col("n") + 1, F.col("n_lang") + F.col("v")).alias("q"), F.transform("held", shared).alias("held"))
    else:
        rows = terms.select("lang", "digest", "term", "n", F.explode("held").alias("h")).withColumn("source", F.col("h.source")).join(groups, ["lang", "source"])
        rows = rows.select("lang", "digest", "term", share(F.col("n") + 1, F.col("n_lang") + F.col("v")).alias("q"), F.struct("source", share(F.col("h.n") + 1, F.col("n_group") + F.col("v")).alias("p"), "p0").alias("h"))
        met = rows.groupBy("lang", "digest", "term", "q").agg(F.collect_list("h").alias("held"))
    met = materialise(met, "shares")

    order = [F.col("value").desc(), F.col("item")]
    pair = _pairs(met, groups, sized).withColumn("part", F.lit("pair"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    lead = met.select("lang", "digest", "term", "q", F.explode("held").alias("h")).where("h.p > q")
    lead = lead.select("lang", F.col("h.source").alias("source"), "digest", "term", gain(F.col("h.p"), F.col("q")).alias("value"))
    # rank() keeps all ties of the last place: their strings decide
    lead = lead.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))).where(F.col("r") <= top)
    named = lead.where("term IS NULL").drop("term").join(names, "digest").select("lang", "source", F.col("term").alias("item"), "value")
    if several is not None:
        named = named.unionByName(lead.where("term IS NOT NULL").select("lang", "source", F.col("term").alias("item"), "value"))
    lead = named.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(lead.select(*columns))


def _pairs(met: DataFrame, groups: DataFrame, sized) -> DataFrame:
    """lang, source, item, value: the sum over all kept terms for each ordered pair of sources of a lang."""
    a, b = F.col("a.p"), F.col("b.p")
    a0, b0 = F.col("a.p0"), F.col("b.p0")
    # terms that both have: what they add over what each side adds alone
    both = met.select("lang", "held", F.explode("held").alias("a")).select("lang", "a", F.explode("held").alias("b")).where("a.source <> b.source")
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (gain(a, b) - gain(a, b0) - gain(a0, b) + gain(a0, b0)).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # terms that one side has, by its share: a row a share, not a term
    levels = met.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("one"), F.col("h.p").alias("p"), F.col("h.p0").alias("p0")).agg(F.count("*").alias("times"))
    far = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    meets = levels.join(sized(far), "lang").where("one <> other")
    p, p0, o0 = F.col("p"), F.col("p0"), F.col("o0")
    sides = F.array(
        F.struct(F.col("one").alias("source"), F.col("other").alias("item"), (gain(p, o0) - gain(p0, o0)).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("one").alias("item"), (gain(o0, p) - gain(o0, p0)).alias("value")),
    )
    alone = meets.select("lang", "times", F.explode(sides).alias("s")).groupBy("lang", "s.source", "s.item").agg(F.sum(F.col("times") * F.col("s.value")).alias("value"))
    # and all terms as if neither had them
    left = groups.select("lang", "source", "v", F.col("p0"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    base = left.join(sized(right), "lang").where("source <> item")
    base = base.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * gain(F.col("p0"), F.col("o0"))).otherwise(F.lit(0)).cast("long").alias("value"))
    return base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(CAST((a.p - b.p) * (a.p - b.p) // b.p AS HUGEINT)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT value FROM pair x WHERE x.lang = a.lang AND x.source = a.source AND x.item = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""
