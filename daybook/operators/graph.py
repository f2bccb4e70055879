"""Walks, components and ranks over node and edge frames, a job a step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators import blocks
from daybook.sources.shared import cut, dealt, heavy, stored


def walk(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """Breadth-first reach: start, node, depth (least). Each step joins only the new frontier."""
    edges = cut(edges.select("source", "target").distinct())  # read by every step
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("start", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def _apart(pairs: DataFrame, hot: DataFrame | None, end: str) -> list[DataFrame]:
    """The pairs whose ``end`` is not hot, and (where anything is) those whose ``end`` is."""
    if hot is None:
        return [pairs]
    return [pairs.join(F.broadcast(hot), F.col(end) == F.col("_hot"), how) for how in ("left_anti", "left_semi")]


def _both_stars(pairs: DataFrame, rows: int) -> DataFrame:
    """v, u (the smaller): the pairs after a large and a small star, each once.

    Pairs meet by their ends in tasks of TASK_ROWS. Ends that more pairs share are combined before they move, and looked up where the pairs lie.
    """
    hot = heavy(pairs, rows, "v", "u")
    least_of = lambda p: p.groupBy("v").agg(F.min("u").alias("m"))
    # large star: every larger neighbour moves to the least of the neighbourhood, which is a smaller end's own least or itself
    few, *many = _apart(pairs, hot, "v")
    least = [least_of(dealt(few, rows, "v")), *(F.broadcast(least_of(p)) for p in many)]
    few, *many = _apart(pairs, hot, "u")
    met = [p.join(m.withColumnRenamed("v", "at"), F.col("u") == F.col("at"), "left") for p, m in zip([dealt(few, rows, "u"), *many], least)]
    large = reduce(DataFrame.unionByName, [p.select("v", F.coalesce("m", "u").alias("u")) for p in met])
    # small star: smaller neighbours, and the vertex, move to the least of them
    few, *many = _apart(large, hot, "v")
    moved = []
    for p in [dealt(few, rows, "v"), *many]:
        least = least_of(p)
        small = p.join(F.broadcast(least) if moved else least, "v").where("u <> m")
        moved += [small.select(F.col("u").alias("v"), F.col("m").alias("u")), least.select("v", F.col("m").alias("u"))]
    return dealt(reduce(DataFrame.unionByName, moved), rows, "v", "u").distinct()


def connected(edges: DataFrame, nodes: DataFrame, limit: int = 200, rows: int | None = None) -> DataFrame:
    """id, component (the least id reachable), by alternating large and small stars until the state repeats, a checkpoint a round.

    Long chains need few rounds (the logarithm of the size, squared, at worst); a run that has not settled after ``limit`` rounds raises.
    The result lies by id in tasks of TASK_ROWS of the ``rows`` nodes (counted where not given).
    """
    pairs = cut(edges.select(F.greatest("source", "target").alias("v"), F.least("source", "target").alias("u")).where("u <> v"))
    state = pairs.count(), None
    for _ in range(limit):
        before, pairs = state, cut(_both_stars(pairs, state[0]))
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if state == before:
            rows = nodes.count() if rows is None else rows
            found = dealt(pairs.select(F.col("v").alias("id"), F.col("u").alias("root")), rows, "id")
            return dealt(nodes, rows, "id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    raise RuntimeError(f"components have not settled after {limit} rounds")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """id, rank; mass of nodes without out-edges is spread over all."""
    n = nodes.count()
    edges = edges.join(edges.groupBy("source").agg(F.count("*").alias("out")), "source").select("source", "target", "out")
    edges = cut(edges)  # read by every iteration
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        given = edges.join(ranks, edges["source"] == ranks["id"]).groupBy("target").agg(F.sum(F.col("rank") / F.col("out")).alias("in"))
        held = ranks.join(given, ranks["id"] == given["target"], "left").select("id", F.coalesce("in", F.lit(0.0)).alias("in"))
        held = cut(held)  # read twice below, and by the next step
        lost = 1 - (held.agg(F.sum("in")).first()[0] or 0.0)
        ranks = held.select("id", ((1 - damping) / n + damping * (F.col("in") + lost / n)).alias("rank"))
    return ranks


def betweenness(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """id, score: the share of shortest directed paths that pass through a node, over (n - 1)(n - 2) where there are more than two nodes.

    Links are stored once in blocks, along and against them; a task walks from some of the sources and reads the blocks that it comes to,
    so none need hold the graph and only sums by node move. The state of a source is a few numbers for each node between those that it reaches;
    ``sources`` (default: all nodes) bounds it, and scores are then sums over these sources.
    """
    edges = stored(edges.select("source", "target").where("source <> target").distinct(), "links")  # read often
    starts = nodes if sources is None else sources
    ids = nodes.select("id").unionByName(starts.select("id"))
    places = blocks.numbered(ids.unionByName(edges.select(F.col("source").alias("id"))).unionByName(edges.select(F.col("target").alias("id"))))
    known = places.count()
    begun = cut(starts.select("id").distinct().join(places, "id").select("at"))
    totals = blocks.through_nodes(begun, *blocks.store_links(edges, places, known), known)
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = totals.groupBy("at").agg(F.sum("through").alias("s")).join(places, "at").select("id", "s")
    return nodes.select("id").join(sums, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)) * scale, 6).alias("score"))


#: Nodes whose marks are sent to every task; beyond these, links and marks are joined.
SENT_NODES = 1_000_000


def _marked(links: DataFrame, marks: DataFrame, end: str, mark: str, small: bool, how: str = "inner") -> DataFrame:
    """``links`` with the mark (as ``mark``) of the node at their ``end``; where there are few nodes links stay where they are."""
    found = marks.select(F.col("id").alias(end), *([F.col("mark").alias(mark)] if how == "inner" else []))
    return links.join(F.broadcast(found) if small else found, end, how)


def _spread(marks: DataFrame, edges: DataFrame, limit: int, small: bool) -> DataFrame:
    """id, mark: the least mark that reaches each node along source -> target, by rounds until no mark falls.

    Where few nodes let marks travel to the links, only those that lower the mark of their target leave the task, the least a target.
    """
    before = None
    for _ in range(limit):
        sent = _marked(edges, marks, "source", "mark", small)
        if small:
            own = marks.select(F.col("id").alias("target"), F.col("mark").alias("_own"))
            sent = sent.join(F.broadcast(own), "target", "left").where("_own IS NULL OR mark < _own")
        marks = cut(marks.unionByName(sent.groupBy("target").agg(F.min("mark").alias("mark")).select(F.col("target").alias("id"), "mark")).groupBy("id").agg(F.min("mark").alias("mark")))
        state = marks.agg(F.sum(F.xxhash64("id", "mark").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return marks
        before = state
    raise RuntimeError(f"marks have not settled after {limit} rounds")


def strong_components(edges: DataFrame, nodes: DataFrame, limit: int = 200) -> DataFrame:
    """id, component (the least id of the strongly connected component), by colouring.

    Each turn, the least id that reaches a node is its colour; what reaches the colour's own node back inside the colour is its
    component and leaves the graph. Nodes without an edge in or out are components alone and go first. Turns grow with the
    length of chains of components, rounds with the diameter; either raises beyond ``limit``. Where up to SENT_NODES nodes are left,
    links stay where they are. ``edges`` are read by every round of the first turn.
    """
    left, edges = cut(nodes.select("id").distinct()), edges.select("source", "target").where("source <> target")
    done = None
    for _ in range(limit):
        ends = [edges.select(F.col(end).alias("id")).distinct() for end in ("source", "target")]
        through = cut(ends[0].join(ends[1], "id", "left_semi"))
        small = through.count() <= SENT_NODES
        found = left.join(through, "id", "left_anti").select("id", F.col("id").alias("component"))
        inner = _marked(_marked(edges, through, "source", "", small, "left_semi"), through, "target", "", small, "left_semi").select("source", "target")
        inner = inner if small else cut(inner.distinct())
        colours = _spread(through.select("id", F.col("id").alias("mark")), inner, limit, small)
        within = _marked(_marked(inner, colours, "source", "source_mark", small), colours, "target", "target_mark", small)
        within = within.where("source_mark = target_mark").select(F.col("target").alias("source"), F.col("source").alias("target"))
        # backwards from the node that gave the colour: only marks equal to the colour matter
        back = _spread(colours.where("id = mark"), within if small else cut(within), limit, small)
        found = cut(found.unionByName(back.select("id", F.col("mark").alias("component"))))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        if left.isEmpty():
            return done
        small = found.count() <= SENT_NODES
        for end in ("source", "target"):
            edges = _marked(edges, found, end, "", small, "left_anti")
        edges = cut(edges.select("source", "target"))
    raise RuntimeError(f"components have not settled after {limit} turns")


def longest_chain(edges: DataFrame, components: DataFrame) -> int:
    """Components on the longest path of the graph of components (which has no cycle); 0 without components."""
    marks, small = components.select("id", F.col("component").alias("mark")), components.count() <= SENT_NODES
    dag = _marked(_marked(edges, marks, "source", "source_part", small), marks, "target", "target_part", small)
    dag = cut(dag.where("source_part <> target_part").select("source_part", "target_part").distinct())
    depth, ends = 0, components.select(F.col("component").alias("part")).distinct()
    while not ends.isEmpty():
        depth += 1
        ends = cut(ends.join(dag, F.col("part") == F.col("source_part")).select(F.col("target_part").alias("part")).distinct())
    return depth


HARD_DEPTH, HARD_NODES = 5, 1000


def walk_evidence(
    edges: DataFrame, nodes: DataFrame, starts: DataFrame, relations: list[str] | None = None, max_depth: int = 3, max_nodes: int = 200, direction: str = "out", keep=None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walks from many starts at once, held to a depth and a number of nodes.

    ``edges``: source_id, target_id, relation; ``nodes``: id and what ``keep`` (a Column over nodes, for the output only: the walk goes
    through nodes that it leaves out) needs. First frame: start, node, depth, parent, relation, direction (of the edge that reached the
    node: the least parent, relation and direction of those that did). Second: start, visited, truncated, reason.
    Where a level has more nodes than there is room for, those with the least ids are kept. Depth is at most 5, nodes 1,000.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction {direction}")
    max_depth, max_nodes = min(max_depth, HARD_DEPTH), min(max_nodes, HARD_NODES)
    known = cut(nodes.select("id").distinct())
    e = edges.select("source_id", "target_id", "relation").distinct()
    if relations is not None:
        e = e.where(F.col("relation").isin(*relations)) if relations else e.where("false")
    ways = {"out": e.select(F.col("source_id").alias("parent"), F.col("target_id").alias("node"), "relation", F.lit("out").alias("direction")), "in": e.select(F.col("target_id").alias("parent"), F.col("source_id").alias("node"), "relation", F.lit("in").alias("direction"))}
    steps = ways[direction] if direction != "both" else ways["out"].unionByName(ways["in"])
    steps = cut(steps.join(known.withColumnRenamed("id", "node"), "node", "left_semi"))  # read by every level
    asked = starts.select(F.col("id").alias("start")).distinct()
    found = asked.join(known.withColumnRenamed("id", "start"), "start", "left_semi")
    none = F.lit(None)
    level = cut(found.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), none.cast("string").alias("relation"), none.cast("string").alias("direction"), none.cast(nodes.schema["id"].dataType).alias("parent")))
    levels = [level]
    for depth in range(1, max_depth + 1):
        seen = levels[0].select("start", "node")
        for one in levels[1:]:
            seen = seen.unionByName(one.select("start", "node"))
        room = seen.groupBy("start").agg((F.lit(max_nodes) - F.count("*")).alias("_room")).where("_room > 0")
        ahead = level.join(room.select("start"), "start", "left_semi").select("start", F.col("node").alias("parent")).join(steps, "parent").join(seen, ["start", "node"], "left_anti")
        ahead = ahead.groupBy("start", "node").agg(F.min(F.struct("parent", "relation", "direction")).alias("_by"))
        rank = F.row_number().over(Window.partitionBy("start").orderBy("node"))
        # the limit that is the same for all starts first: tasks keep that many rows of a start before they meet
        ahead = ahead.withColumn("_rank", rank).where(F.col("_rank") <= max_nodes).join(room, "start").where("_rank <= _room")
        level = cut(ahead.select("start", "node", F.lit(depth).alias("depth"), "_by.relation", "_by.direction", "_by.parent"))
        levels.append(level)
        if level.isEmpty():
            break
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    summary = out.groupBy("start").agg(F.count("*").alias("visited"), F.max("depth").alias("_deep"))
    full, deep = F.col("visited") >= max_nodes, F.col("_deep") == max_depth
    full = full & (F.col("visited") > 1)
    reason = F.when(full, f"max_nodes cap ({max_nodes}) reached").when(deep, f"max_depth cap ({max_depth}) reached")
    summary = asked.join(summary, "start", "left").select("start", F.coalesce("visited", F.lit(0)).alias("visited"), F.coalesce(full | deep, F.lit(False)).alias("truncated"), F.when(F.col("visited").isNull(), "start is not in the graph").otherwise(reason).alias("reason"))
    if keep is not None:
        out = out.join(nodes.where(keep).select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return out.select("start", "node", "depth", "parent", "relation", "direction"), summary
