"""Exact removal of lines that documents share.

Lines are exploded, normalised and hashed to 128 bits; a line found in at least
``min_docs`` documents stays only in the smallest document that holds it; what is left
of each document is put together again by line position. DataFrame operations only.

Scale: each text is split and hashed once, into a table of line hashes in the shared
folder. Counting shuffles a hash and a key a line, made distinct before and after
the shuffle, so a line that every document holds is a row per document spread over all
tasks and then one partial count a task. A line that makes up a thousandth of all shared
lines or more is hot: there are at most a thousand of those, so they are broadcast and their rows never meet in one task; the other lines are
joined by their hash. Where a stage has so many partitions that a thousandth of the lines is
more than a quarter of a partition's share, a line of that quarter is hot: the list
then grows with the partitions, four lines each. The texts move once, to meet their dropped positions.

Defined results: a null or empty text is one empty line; blank and short lines (key under
``min_chars`` code points) always stay; a null key counts as the smallest document; rows
that repeat a key are one document for counting, and each row loses its lines all the
same; an empty table gives no rows; other columns are passed on (columns with the names of
the two counts, in any case, are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import materialise, others, text_or_empty

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIRST = -(1 << 63)
_HOT = 1000  # a line is hot at this part of all lines, or at a quarter of a partition's share; so many lines at most can be


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def hot_part(partitions: int) -> int:
    """A line is hot from one in so many of all shared lines."""
    return max(_HOT, 4 * partitions)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Documents with shared lines dropped, and how many lines each had and lost (columns ``counts``)."""
    number = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST))
    body = text_or_empty(text)
    own = [number.alias("_k"), F.xxhash64(body).alias("_t")]  # which row, up to equal rows

    lines = docs.select(*own, F.posexplode(F.split(body, "\n")).alias("_pos", "_line"))
    lines = lines.select("_k", "_t", "_pos", line_key(F.col("_line")).alias("_line")).where(F.char_length("_line") >= min_chars)
    # two seeds of the same hash: 128 bits
    lines = materialise(lines.select("_k", "_t", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), F.col("_line")).alias("_h2")), "lines")
    counted = (
        lines.groupBy("_h1", "_h2", "_k").agg(F.count("*").alias("_n"))
        .groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.min("_k").alias("_first"), F.sum("_n").alias("_n"))
        .where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_first", "_n")
    )
    shared = materialise(counted, "shared-lines")
    total = shared.agg(F.sum("_n")).first()[0] or 0
    part = hot_part(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(shared.where(F.col("_n") * part >= total).drop("_n"))
    cold = shared.where(F.col("_n") * part < total).drop("_n")
    met = lines.join(hot, ["_h1", "_h2"]).unionByName(lines.join(hot, ["_h1", "_h2"], "left_anti").join(cold, ["_h1", "_h2"]))
    gone = met.where(F.col("_k") != F.col("_first")).groupBy("_k", "_t").agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))

    whole = docs.select(*own, F.struct("*").alias("_row"))
    met = whole.join(gone, ["_k", "_t"], "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    met = met.withColumn("_lines", F.split(F.coalesce(F.col(f"_row.`{text}`"), F.lit("")), "\n"))
    n_gone = F.size("_gone")

    def stretch(j: Column) -> Column:
        """The lines between one dropped position and the next."""
        a = F.coalesce(F.get("_gone", j - 1) + 1, F.lit(0))
        b = F.coalesce(F.get("_gone", j), F.size("_lines"))
        return F.slice("_lines", a + 1, b - a)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n_gone), stretch)), "\n")
    added = {text: F.when(n_gone == 0, F.col(f"_row.`{text}`")).otherwise(kept), counts[0]: F.size("_lines").cast("long"), counts[1]: n_gone.cast("long")}
    kept_columns = [F.col(f"_row.`{c}`").alias(c) for c in others(docs, *added)]
    return met.select(*kept_columns, *[value.alias(name) for name, value in added.items()])


def digests(deduped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return deduped.select(F.col(key).alias("doc_id"), "n_lines", "n_dropped", F.sha2(text_or_empty(text).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT a.doc_id, a.pos, a.line, (s.k IS NOT NULL AND a.doc_id <> s.first_doc) AS gone FROM keyed a LEFT JOIN shared s ON a.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
