"""Names of a registry in free text, all of them in one pass over a text, and what a graph's texts and links add up to."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.sources import shared
from daybook.sources.shared import cut, dealt

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, every run of blanks one space: how names and texts are compared."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")


def _part_of_word(c: str) -> bool:
    return c.isalnum() or c in "_-"


def names_in(text: Column, names: list[str], bounded: bool = True) -> Column:
    """Places in ``names`` of those that stand in a (folded) text, in order; ``bounded``: not inside a longer word or a hyphenated one.

    One automaton holds all names, so a text is read once however many there are, and names of several words are no
    different. ``names`` travels to every task: the caller bounds it.
    """

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            automaton.add_word(name, (i, len(name)))
        if names:
            automaton.make_automaton()
        for texts in batches:
            found = []
            for text in texts.to_pylist():
                met = set()
                for end, (i, n) in automaton.iter(text) if names and text else ():
                    if i in met:
                        continue
                    before, after = text[end - n : end - n + 1] if end >= n else "", text[end + 1 : end + 2]
                    if not bounded or not (before and _part_of_word(before) or after and _part_of_word(after)):
                        met.add(i)
                found.append(sorted(met))
            yield pa.array(found, pa.list_(pa.int32()))

    return find(text)


def mentions(texts: DataFrame, key: str, text: str, registry: DataFrame, name: str = "name", canonical: str = "canonical", portion: int = 20_000) -> DataFrame:
    """key, canonical: each canonical name that a text mentions under any of its names, once.

    The registry is read in portions of ``portion`` names (in the order of the names), one pass over the texts each, so any
    number of names is looked for and a task never holds more than a portion. Null and empty names are none.
    """
    known = registry.select(folded(F.col(name)).alias("_name"), F.col(canonical).alias(canonical)).where("_name <> '' AND _name <> ' '").distinct()
    body = texts.select(key, folded(F.col(text)).alias("_text"))
    found, last = None, None
    while True:
        rows = known.select("_name").distinct() if last is None else known.select("_name").distinct().where(F.col("_name") > last)
        names = [r["_name"] for r in rows.orderBy("_name").limit(portion).collect()]  # a portion
        if not names:
            break
        held = F.array(*[F.lit(n) for n in names]) if len(names) <= 64 else None
        met = body.select(key, F.explode(names_in(F.col("_text"), names)).alias("_i"))
        if held is not None:
            met = met.select(key, F.get(held, F.col("_i")).alias("_name"))
        else:
            order = texts.sparkSession.createDataFrame(list(enumerate(names)), "_i int, _name string")
            met = met.join(F.broadcast(order), "_i").select(key, "_name")
        found = met if found is None else found.unionByName(met)
        last = names[-1]
        if len(names) < portion:
            break
    if found is None:
        return texts.select(key, F.lit(None).cast("string").alias(canonical)).where("false")
    return found.join(known, "_name").select(key, canonical).distinct()


#: What marks a text, its category, label and confidence.
TEXT_TAGS = (
    ("decision", "decision_signal", ("decided", "decision", "will move", "settled"), 0.72),
    ("blocker", "blocker_signal", ("blocked", "stuck", "annoyance", "broken", "fails", "failure"), 0.66),
    ("question", "open_question", ("?", "uncertain", "not sure", "whether", "should i", "idk"), 0.58),
    ("risk", "risk_signal", ("risk", "worry", "concern", "danger", "misleading"), 0.6),
    ("intent", "intent_signal", ("want", "need", "goal", "should", "priority", "critical path"), 0.62),
    ("energy", "energy_context", ("sleep", "tired", "energy", "stress", "substance", "dose"), 0.55),
)
#: Labels and kinds of node that make a cluster weigh more, the relations that hold it together, and the least score of a moment.
HEAVY_LABELS = ("decision_signal", "recorded_decision", "blocker_signal", "github_executed", "github_pr_closed", "open_tension")
HEAVY_KINDS = ("commit", "ai_session", "machine_pressure_incident")
CLUSTER_RELATIONS = ("references", "temporal_overlap", "temporal_proximity", "same_project_day")
MOMENT_SCORE = 1.5


def text_tags(texts: DataFrame, key: str, text: str, tags=TEXT_TAGS) -> DataFrame:
    """key, category, label, confidence: a row for each tag of which a needle stands anywhere in the text."""
    needles = [(n, t) for t, tag in enumerate(tags) for n in tag[2]]
    # not folded to single spaces: needles are sought as they are
    body = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(label).alias("label"), F.lit(p).alias("confidence")) for c, label, _, p in tags])
    of = F.array(*[F.lit(t) for _, t in needles])
    met = F.array_distinct(F.transform(names_in(body, [n for n, _ in needles], bounded=False), lambda i: F.get(of, i)))
    return texts.select(key, F.explode(met).alias("_t")).select(key, F.get(rows, F.col("_t")).alias("_r")).select(key, "_r.*")


def score_clusters(nodes: DataFrame, annotations: DataFrame, members: DataFrame, rows: int | None = None) -> DataFrame:
    """cluster, day, project, n, sources, labels, score, moment: what each component of a graph holds.

    ``nodes``: id, kind, source, project, day; ``annotations``: id, label; ``members``: id, component; ``rows``: of nodes (counted where
    not given). Nodes and labels meet their component in tasks of TASK_ROWS nodes, are summed by component and a share of the ids, and
    then by component, so neither one of any size nor very many small ones fill a task.
    """
    rows = nodes.count() if rows is None else rows
    none = F.lit(None).cast("string")
    held = nodes.select("id", F.lit(1).alias("k"), "source", "project", "day", none.alias("label"), *[(F.col("kind") == k).cast("int").alias(f"_{k}") for k in HEAVY_KINDS])
    held = held.unionByName(annotations.select("id", F.lit(0).alias("k"), "label"), allowMissingColumns=True)
    held = dealt(held, rows, "id").join(members.select("id", F.col("component").alias("cluster")), "id")
    summed = lambda *more: [F.sum("k").alias("k"), F.min("day").alias("day"), *[F.max(f"_{k}").alias(f"_{k}") for k in HEAVY_KINDS], *more]
    held = held.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(rows // shared.TASK_ROWS + 1)))
    held = dealt(held, rows, "cluster", "_share").groupBy("cluster", "_share", "project", "source", "label").agg(*summed())
    held = dealt(held, rows, "cluster").groupBy("cluster", "project").agg(*summed(F.collect_set("source").alias("_sources"), F.collect_set("label").alias("_labels")))
    every = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    most = F.min(F.when(F.col("project").isNotNull(), F.struct((-F.col("k")).alias("k"), "project"))).alias("_p")
    c = held.groupBy("cluster").agg(*summed(every("_sources"), every("_labels"), most)).where("k > 0")
    weighty = F.size(F.array_intersect("_labels", F.array(*[F.lit(x) for x in HEAVY_LABELS])))
    score = F.size("_sources") * 0.8 + F.least("k", F.lit(12)) * 0.12 + weighty * 0.9 + sum(F.col(f"_{k}") * 0.35 for k in HEAVY_KINDS)
    c = c.withColumn("score", F.round(score, 3)).withColumn("moment", (F.col("score") >= MOMENT_SCORE) | (F.size("_sources") >= 2))
    return c.select("cluster", "day", F.col("_p.project").alias("project"), F.col("k").alias("n"), F.array_join("_sources", ",").alias("sources"), F.array_join("_labels", ",").alias("labels"), "score", "moment")


def weak_clusters(nodes: DataFrame, edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """The clusters of a graph under the relations that hold one together; edges to unknown nodes hold nothing.

    ``edges``: source, target, relation.
    """
    from daybook.operators.graph import connected

    rows = nodes.count()
    own = edges.where(F.col("relation").isin(*CLUSTER_RELATIONS)).select("source", "target")
    known = dealt(nodes.select("id"), rows, "id").distinct()
    for end in ("source", "target"):
        own = dealt(own, rows, end).join(known.withColumnRenamed("id", end), end, "left_semi")
    return score_clusters(nodes, annotations, connected(own, known, rows=rows), rows)


def group_edges(rows: DataFrame, keys: list[str], node: str, relation: str) -> DataFrame:
    """source, target, relation: each node of a group linked to the least one. As a component the same as all pairs, a row a node.

    Up to 1,000,000 groups are looked up where the rows lie; with more, rows meet their group in tasks of TASK_ROWS.
    """
    first = cut(rows.groupBy(*keys).agg(F.min(node).alias("source")))
    if first.count() <= 1_000_000:
        met = rows.join(F.broadcast(first), keys)
    else:
        n = rows.count()
        met = dealt(rows, n, *keys).join(dealt(first, n, *keys), keys)
    return met.where(F.col(node) != F.col("source")).select("source", F.col(node).alias("target"), F.lit(relation).alias("relation"))
