"""Similar names: pairs of different strings whose matching blocks make up a share of both.

The ratio of two strings is twice the characters in their matching blocks over both
lengths. It is never more than twice the letters that both have (counted with repeats) over
both lengths, so two names that reach it share one of each one's first letters in a fixed
order of letters with their repeats (as many first letters as may be missing, and one). The join
is on those; lengths and letters are held to the bound before any ratio is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut

#: The names of a block; the names of a project that one row holds; the pairs of similar names that every task may hold.
BLOCK, HELD, BROADCAST_PAIRS = 500, 1000, 2_000_000


def letters(name: Column) -> Column:
    """Each character with how many of it came before, repeats and rare ones first (by number of repeats, then by code)."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    counted = F.transform(F.sort_array(chars), lambda c: c)
    numbered = F.transform(counted, lambda c, i: F.struct((-(i - F.array_position(counted, c) + 1)).alias("k"), (-F.ascii(c)).alias("a"), c.alias("c")))
    return F.transform(F.sort_array(numbered), lambda x: F.concat(x["c"], (-x["k"]).cast("string")))


def _shared_at_least(n: Column, other: Column, ratio: float) -> Column:
    """How many letters two names of these lengths must share."""
    return F.ceil(ratio * (n + other) / 2 - 1e-9)


def _letter_counts(names: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each character of either list stands in each name: a row a name."""
    both = names + others
    codes = np.frombuffer("".join(both).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    chars, of = np.unique(codes, return_inverse=True)
    counts = np.zeros((len(both), len(chars)), dtype=np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(both)), [len(n) for n in both]), of), 1)
    return counts[: len(names)], counts[len(names) :]


def _block_pairs(ratio: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The similar names of two blocks that have the first letter ``_t``: all pairs' shared letters at once, blocks of letters matched for those with enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, olds, news in zip(batch["_t"], batch["_a"], batch["_b"]):
                old, new = [x["name"] for x in olds], [x["name"] for x in news]
                firsts, others = [list(x["first"]) for x in olds], [set(x["first"]) for x in news]
                x, y = _letter_counts(old, new)
                shared = sum(np.minimum.outer(x[:, c], y[:, c]) for c in range(x.shape[1]))
                n, m = x.sum(1)[:, None], y.sum(1)[None, :]
                need = np.ceil(ratio * (n + m) / 2 - 1e-9)
                found, match = [], SequenceMatcher(None)
                for j, rows in enumerate(((shared >= need) & (np.minimum(n, m) >= need)).T):
                    match.set_seq2(new[j])
                    for i in np.flatnonzero(rows):
                        # a pair that shares several first letters is met once, at the first of them
                        if old[i] != new[j] and next(f for f in firsts[i] if f in others[j]) == t:
                            match.set_seq1(old[i])
                            if (r := match.ratio()) >= ratio:
                                found.append((old[i], new[j], r))
                yield pd.DataFrame(found, columns=["old_name", "new_name", "similarity"])

    return run


def similar_names(old: DataFrame, new: DataFrame, ratio: float = 0.6) -> DataFrame:
    """old_name, new_name, similarity: the pairs of different names that reach ``ratio``, each once.

    ``old`` has old_name, ``new`` has new_name; null and empty names are in no pair. ``ratio`` is over 0.
    """

    def shaped(df: DataFrame, name: str, tag: str) -> tuple[DataFrame, int]:
        d = cut(df.select(F.col(name).alias("name")).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct())
        blocks = d.count() // BLOCK + 1
        n = F.char_length("name")
        shortest = F.ceil(n * ratio / (2 - ratio) - 1e-9)  # the shortest partner
        first = n - _shared_at_least(n, shortest, ratio) + 1
        d = d.select("name", F.slice(letters(F.col("name")), 1, F.greatest(first, F.lit(1)).cast("int")).alias("first"))
        d = d.select("name", "first", F.explode("first").alias("_t"), F.pmod(F.xxhash64("name"), F.lit(blocks)).alias(f"_{tag}_block"))
        return d.groupBy("_t", f"_{tag}_block").agg(F.collect_list(F.struct("name", "first")).alias(f"_{tag}")), blocks

    (a, many), (b, more) = shaped(old, "old_name", "a"), shaped(new, "new_name", "b")
    pairs = a.join(b, "_t").select("_t", "_a", "_b").repartition(min(many * more, 2000))
    return pairs.mapInPandas(_block_pairs(ratio), "old_name string, new_name string, similarity double")


def rename_candidates(symbols: DataFrame, ratio: float = 0.6) -> DataFrame:
    """project, old_name, new_name, similarity, day, source: renames said outright, and added names that look like deleted ones.

    ``symbols``: project, name, day, change (ADDED, DELETED, RENAMED). A pair counts in a project where the new name was added on
    or after the day on which the old one was deleted; its day is the first such.
    """
    said = symbols.where("change = 'RENAMED'").groupBy("project", "name").agg(F.min("day").alias("day"))
    said = said.select("project", F.col("name").alias("old_name"), F.col("name").alias("new_name"), F.lit(1.0).alias("similarity"), "day", F.lit("explicit_rename").alias("source"))
    gone = symbols.where("change = 'DELETED'").groupBy("project", F.col("name").alias("old_name")).agg(F.min("day").alias("_gone"))
    come = symbols.where("change = 'ADDED'").select("project", F.col("name").alias("new_name"), "day").distinct()
    alike = cut(similar_names(gone, come, ratio))  # names once, whatever the number of projects
    if alike.count() <= BROADCAST_PAIRS:
        # what a project has of a name's similar ones is found in a row: only pairs that it has are made
        place = F.row_number().over(Window.partitionBy("project").orderBy("new_name"))
        own = come.select("project", "new_name").distinct().withColumn("_part", F.floor((place - 1) / HELD))
        own = own.groupBy("project", "_part").agg(F.collect_list("new_name").alias("_own"))
        like = alike.groupBy("old_name").agg(F.collect_list("new_name").alias("_like"))
        met = gone.join(own, "project").join(F.broadcast(like), "old_name")
        met = met.select("project", "old_name", "_gone", F.explode(F.array_intersect("_like", "_own")).alias("new_name"))
        met = met.join(F.broadcast(alike), ["old_name", "new_name"])
    else:
        met = gone.join(alike, "old_name")
    met = met.join(come, ["project", "new_name"]).where("day >= _gone")
    met = met.groupBy("project", "old_name", "new_name").agg(F.first("similarity").alias("similarity"), F.min("day").alias("day"))
    return said.unionByName(met.withColumn("source", F.lit("similar_name")).select(said.columns))
