"""Line-first cleaning and document rules, in DataFrame expressions only.

Every line is judged by itself: punctuation (symbols stuck to its words, shouted
exclamations), navigation (separators between short items, menu words) and boilerplate
(fixed phrases). Lines that fail are removed; a document that loses more than
``max_lost`` of its text, or fails the base measures, is rejected.

There is no shuffle: a document is judged within its row, in time that grows with its
length (its logarithm times that where windows repeat). Repeated five-word windows are
found by hashing words, then five hashes (64 bits, within one document), and sorting, only
where a hash occurs twice.

Defined results: a null or empty text has no words and fails the base rules; repeated rows
are judged each; an empty table gives no rows; other columns are passed on (the names of
measures replace columns so named, in any case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import let, others, text_or_empty

BLANK = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Phrases that mark a line as boilerplate or as navigation.
BOILERPLATE = (
    "cookie policy|privacy policy|all rights reserved|terms of use|terms of service|terms and conditions|click here|"
    "sign up for|subscribe to|enable javascript|powered by|copyright|licensed under|lorem ipsum|share this|read more"
)
NAVIGATION = "home|menu|search|login|log in|sign in|sign up|next|previous|back to top|skip to content|contact us|about us|sitemap"


def _covered(grams: Column) -> Column:
    """Words that windows with a repeated hash cover."""

    def spans(starts: Column) -> Column:
        widths = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1), F.get(ordered, i + 1)
            return F.when((before["h"] == x["h"]) | (after["h"] == x["h"]), x["p"])

        return let(F.array_sort(F.filter(F.transform(ordered, twice), lambda p: p.isNotNull())), spans)

    return let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), repeated)


def bad_line(line: Column) -> Column:
    """True where the line fails a rule.

    No pattern retries a run of characters from each of its places: they look at two
    characters and what ends a word, or are held to the line's start.
    """
    symbols = F.regexp_count(line, F.lit(r"[\p{L}\d.,][#*$%&|<>]{2,}+(?=\s|$)")) >= 3
    shout = line.contains("!!") & (F.regexp_count(line, F.lit(r"\S!!(?=\s|$)")) >= 3)
    bars = (F.regexp_count(line, F.lit(r"\s[|»›·]\s")) >= 2) | line.rlike(r"^[^|]{1,80}\s\|\s?$")
    menu = line.rlike(rf"(?i)^\s*+(?:{NAVIGATION})\s*+$")
    phrase = line.rlike(rf"(?i)(?:{BOILERPLATE})")
    return symbols | shout | bars | menu | phrase


def judge_documents(docs: DataFrame, text: str = "text", max_lost: float = 0.4, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Documents with measures, ``lost`` (share of word characters on failed lines), ``cleaned`` text and ``kept``."""
    body = text_or_empty(text)
    rows = docs.select(F.struct("*").alias("_row"), body.alias("_t"), F.btrim(body, F.lit(BLANK)).alias("_trim"))
    words = F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+"))
    rows = rows.select("_row", "_t", words.alias("_w"), F.split("_t", "\n").alias("_lines"))
    w, n = F.col("_w"), F.size("_w")
    grams = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    )
    rows = rows.select(
        "_row", "_lines", F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_full"),
        grams.alias("_grams"),
    )
    rows = rows.select(
        "_row", "n_words", "word_chars", "n_symbols",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), F.lit(0).cast("long")).otherwise(_covered(F.col("_grams"))).alias("n_repeat_words"),
        F.array_join(F.filter("_lines", lambda x: ~bad_line(x)), "\n").alias("cleaned"),
    )
    left = F.char_length(F.regexp_replace("cleaned", r"[\x20\x09-\x0D]+", ""))
    rows = rows.withColumn("lost", F.when(F.col("word_chars") == 0, F.lit(1.0)).otherwise(1 - left / F.col("word_chars")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= max_lost))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost", "cleaned", "base_failed", "kept"]
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in others(docs, *added)], *added)


def verdicts(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    return judged.select(F.col(key).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
