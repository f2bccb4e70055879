"""Coverage, freshness, label audits and snapshot integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.plans.registry import registry
from daybook.sources.snapshots import drop_dangling, keep_latest, replace_tail
from daybook.sources.tables import changes, events, sql, table, whole_months

REGISTRY, query = registry()


@query(sql("""WITH b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM ev GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day),
n AS (SELECT user_id, day, count(*) AS n FROM ev GROUP BY ALL) SELECT b.user_id, s.day, CASE WHEN s.day BETWEEN lo AND hi THEN coalesce(n.n, 0) END AS n FROM b, s LEFT JOIN n ON n.user_id = b.user_id AND n.day = s.day""", "ev"))
def covered_days(spark, sf_dir):
    """Zero inside a source's bounds, null outside; the spine (the whole months with events, a week before and five days after) is exploded, not crossed."""
    e = events(spark, sf_dir)
    lo, hi = (F.to_date(F.timestamp_micros(F.lit(at))) for at in whole_months(e))
    b = e.groupBy("user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = b.withColumn("day", F.explode(F.sequence(F.date_sub(lo, 7), F.date_add(hi, 4))))
    n = e.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return spine.join(n, ["user_id", "day"], "left").select("user_id", "day", F.when(F.col("day").between(F.col("lo"), F.col("hi")), F.coalesce("n", F.lit(0))).alias("n"))


@query(sql("""WITH g AS (SELECT event_type, user_id, day - lag(day) OVER (PARTITION BY event_type, user_id ORDER BY day) AS gap FROM (SELECT DISTINCT event_type, user_id, day FROM ev))
SELECT event_type, count(*) AS days, max(gap) AS largest_gap, count(*) FILTER (WHERE gap BETWEEN 2 AND 3) AS short_gaps, count(*) FILTER (WHERE gap > 3) AS long_gaps FROM g GROUP BY event_type""", "ev"))
def coverage_gaps(spark, sf_dir):
    """Gaps between covered days, with a histogram."""
    d = events(spark, sf_dir).select("event_type", "user_id", "day").distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("event_type", "user_id").orderBy("day"))).cast("long")
    g = d.withColumn("gap", gap)
    return g.groupBy("event_type").agg(F.count("*").alias("days"), F.max("gap").alias("largest_gap"), F.count_if(F.col("gap").between(2, 3)).alias("short_gaps"), F.count_if(F.col("gap") > 3).alias("long_gaps"))


@query("""SELECT lang, quality, toxic, count(*) AS n, round(avg(n_chars), 2) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def label_audit(spark, sf_dir):
    """Confusion of two labels by language."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))


@query("""SELECT 'orders' AS name, count(*) AS n, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem
UNION ALL SELECT 'labels', count(*), count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) FROM labels""")
def consistency_audit(spark, sf_dir):
    """Q07, Q09: row counts and rows whose parent is missing."""
    out = None
    for child, key, parent, target in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")):
        c = table(spark, sf_dir, child).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("m"))
        p = table(spark, sf_dir, parent).select(F.col(target).alias("k")).distinct().withColumn("seen", F.lit(1))
        one = c.join(p, "k", "left").agg(F.lit(child).alias("name"), F.sum("m").alias("n"), F.coalesce(F.sum(F.when(F.col("seen").isNull(), F.col("m"))), F.lit(0)).alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("""SELECT sha, count(*) AS n FROM (SELECT sha, day FROM changes WHERE day < DATE '1997-01-01' UNION ALL SELECT sha, day FROM changes WHERE day >= DATE '1997-01-01' AND change <> 'R') GROUP BY sha""", "changes"))
def tail_replacement(spark, sf_dir):
    """The predecessor's rows before a date and recomputed ones from it."""
    c = changes(spark, sf_dir).select("sha", "day", "change")
    return replace_tail(c, c.where("change <> 'R'"), "day", "1997-01-01").groupBy("sha").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT l_suppkey AS target, l_partkey AS source FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def surviving_edges(spark, sf_dir):
    """Edges whose both ends survive."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return drop_dangling(e, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query("""SELECT month, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders) WHERE month IN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders ORDER BY m DESC LIMIT 3) GROUP BY month""")
def pruned_history(spark, sf_dir):
    """Rows of the latest three snapshots."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return keep_latest(o, 3, "month").groupBy("month").agg(F.count("*").alias("n"))


@query(sql("""SELECT event_type, count(*) AS n, CAST(max("at") // 1000000 AS BIGINT) AS newest_s, CAST((1706745600000000 - max("at")) // 3600000000 AS BIGINT) AS lag_hours FROM ev GROUP BY event_type""", "ev"))
def promotion_freshness(spark, sf_dir):
    """Lag of each stream's newest row."""
    g = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("at").alias("m"))
    return g.select("event_type", "n", F.floor(F.col("m") / 1_000_000).alias("newest_s"), F.floor((1_706_745_600_000_000 - F.col("m")) / 3_600_000_000).alias("lag_hours"))


@query("""SELECT source, count(*) AS n, round(count(*) FILTER (WHERE l.doc_id IS NULL) * 1.0 / count(*), 4) AS unlabelled, CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) * 1.0 / count(*) > 0.7 THEN 'low' WHEN count(*) < 30 THEN 'medium' ELSE 'high' END AS tier
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def evidence_confidence(spark, sf_dir):
    """Q13: tiers from size and missing share (Q16, Q17, A19, G17 and M49 have more than these tiers)."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("n"), (F.count_if(F.col("l").isNull()) / F.count("*")).alias("u"))
    return g.select("source", "n", F.round("u", 4).alias("unlabelled"), F.when(F.col("u") > 0.7, "low").when(F.col("n") < 30, "medium").otherwise("high").alias("tier"))
