"""Project-day rollups, hotspots, shares, quantiles and rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.operators.dedup import last_revision, latest_rows, merge_repeats, normalise_edges, union_preferring
from daybook.plans.registry import registry
from daybook.sources.tables import changes, commits, events, sql, table

REGISTRY, query = registry()


def r(column, digits: int = 4):
    return F.round(column, digits)


@query(sql("""
SELECT project, day, n_commits, round(avg(n_commits) OVER (PARTITION BY project ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_mean,
  CAST(sum(n_commits) OVER (PARTITION BY project ORDER BY day) AS BIGINT) AS cumulative
FROM (SELECT project, day, count(*) AS n_commits FROM commits GROUP BY project, day)""", "commits"))
def velocity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits a project-day with a 7-row mean and a running total."""
    days = commits(spark, sf_dir).groupBy("project", "day").agg(F.count("*").alias("n_commits"))
    w = Window.partitionBy("project").orderBy("day")
    return days.select("project", "day", "n_commits", r(F.avg("n_commits").over(w.rowsBetween(-6, 0))).alias("rolling_mean"), F.sum("n_commits").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


@query(sql("SELECT project, day, n_commits FROM (SELECT project, day, count(*) AS n_commits FROM commits GROUP BY project, day) ORDER BY n_commits DESC, day, project LIMIT 1", "commits"))
def velocity_peak(spark, sf_dir):
    """The single busiest project-day."""
    days = commits(spark, sf_dir).groupBy("project", "day").agg(F.count("*").alias("n_commits"))
    return days.orderBy(F.desc("n_commits"), "day", "project").limit(1)


@query(sql("""SELECT project, count(*) AS n_commits, count(DISTINCT day) AS active_days, round(sum(lines), 2) AS lines, round(count(*) * 1.0 / count(DISTINCT day), 4) AS per_day
FROM commits GROUP BY project""", "commits"))
def velocity_project_summary(spark, sf_dir):
    """Totals and active days of a project."""
    return commits(spark, sf_dir).groupBy("project").agg(
        F.count("*").alias("n_commits"), F.countDistinct("day").alias("active_days"), r(F.sum("lines"), 2).alias("lines"), r(F.count("*") / F.countDistinct("day")).alias("per_day")
    )


@query(sql("""SELECT project, date_trunc('month', first_day)::DATE AS period, count(*) AS threads, CAST(sum(n) AS BIGINT) AS n_commits, round(sum(lines), 2) AS lines
FROM (SELECT project, thread, min(day) AS first_day, count(*) AS n, sum(lines) AS lines FROM commits GROUP BY project, thread) GROUP BY ALL""", "commits"))
def throughput_by_period(spark, sf_dir):
    """Commits collapse to their thread first, threads roll up by month."""
    threads = commits(spark, sf_dir).groupBy("project", "thread").agg(F.min("day").alias("first_day"), F.count("*").alias("n"), F.sum("lines").alias("lines"))
    return threads.groupBy("project", F.to_date(F.date_trunc("month", "first_day")).alias("period")).agg(
        F.count("*").alias("threads"), F.sum("n").alias("n_commits"), r(F.sum("lines"), 2).alias("lines")
    )


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL")
def hourly_distribution(spark, sf_dir):
    """Events by hour."""
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, count(*) AS n FROM events GROUP BY ALL")
def weekday_distribution(spark, sf_dir):
    """Events by weekday, Sunday 0."""
    return table(spark, sf_dir, "events").groupBy((F.dayofweek("ts") - 1).alias("weekday")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (WHERE hour(ts) BETWEEN 5 AND 11) AS morning, count(*) FILTER (WHERE hour(ts) BETWEEN 12 AND 16) AS afternoon,
count(*) FILTER (WHERE hour(ts) BETWEEN 17 AND 21) AS evening, count(*) FILTER (WHERE hour(ts) < 5 OR hour(ts) > 21) AS night,
count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend FROM events GROUP BY event_type""")
def rhythm_fingerprint(spark, sf_dir):
    """Share of a day's parts and of weekends."""
    h = F.hour("ts")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(h.between(5, 11)).alias("morning"), F.count_if(h.between(12, 16)).alias("afternoon"), F.count_if(h.between(17, 21)).alias("evening"),
        F.count_if((h < 5) | (h > 21)).alias("night"), F.count_if(F.dayofweek("ts").isin(1, 7)).alias("weekend"),
    )


@query(sql("""SELECT path, n_commits, n_changes, n_owners, top_owner FROM (
SELECT path, count(DISTINCT sha) AS n_commits, count(*) AS n_changes, count(DISTINCT owner) AS n_owners FROM changes GROUP BY path)
JOIN (SELECT path, owner AS top_owner FROM (SELECT path, owner, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, owner) AS k FROM changes GROUP BY path, owner) WHERE k = 1) USING (path)
ORDER BY n_commits DESC, path LIMIT 50""", "changes"))
def file_churn_hotspots(spark, sf_dir):
    """Most changed paths with their most frequent owner (ties to the smaller)."""
    c = changes(spark, sf_dir)
    stats = c.groupBy("path").agg(F.countDistinct("sha").alias("n_commits"), F.count("*").alias("n_changes"), F.countDistinct("owner").alias("n_owners"))
    top = stats.orderBy(F.desc("n_commits"), "path").limit(50)  # fifty rows: the mode is only needed for these
    owners = c.join(F.broadcast(top.select("path")), "path").groupBy("path", "owner").agg(F.count("*").alias("n"))
    mode = owners.groupBy("path").agg(F.min_by("owner", F.struct(-F.col("n"), "owner")).alias("top_owner"))
    return top.join(mode, "path")


@query(sql("""SELECT project, kind, n, round(n * 1.0 / sum(n) OVER (PARTITION BY project), 4) AS share FROM (SELECT project, kind, count(*) AS n FROM commits GROUP BY project, kind)""", "commits"))
def conventional_distribution(spark, sf_dir):
    """Kind counts and their share inside the project."""
    n = commits(spark, sf_dir).groupBy("project", "kind").agg(F.count("*").alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("project"))))


@query(sql("""WITH last AS (SELECT owner, path, change, day, row_number() OVER (PARTITION BY owner, path ORDER BY day DESC, sha DESC, line DESC) AS k FROM changes)
SELECT owner, count(*) AS symbols, count(*) FILTER (WHERE change <> 'R') AS alive, round(count(*) FILTER (WHERE change <> 'R') * 1.0 / count(*), 4) AS survival
FROM last WHERE k = 1 GROUP BY owner HAVING count(*) >= 5""", "changes"))
def symbol_survival(spark, sf_dir):
    """Share of symbols whose latest change is no removal, owners with five or more."""
    last = last_revision(changes(spark, sf_dir).select("owner", "path", "day", "sha", "line", "change"), ["owner", "path"], ["day", "sha", "line"])
    alive = F.count_if(F.col("change") != "R")
    return last.groupBy("owner").agg(F.count("*").alias("symbols"), alive.alias("alive"), r(alive / F.count("*")).alias("survival")).where("symbols >= 5")


@query("""SELECT o_orderpriority AS kind, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.75), 4) AS p75, round(quantile_cont(d, 0.95), 4) AS p95, round(avg(d), 4) AS mean_days, count(*) AS n
FROM (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_orderpriority""")
def frontier_slo(spark, sf_dir):
    """Exact quantiles of the days to merge (what A25, A57, A58, M32 and M41 report besides is not here)."""
    d = changes(spark, sf_dir).join(commits(spark, sf_dir).select("sha", "kind", F.col("day").alias("opened")), "sha").select("kind", F.datediff("day", "opened").alias("d"))
    q = F.percentile("d", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    return d.groupBy("kind").agg(q.alias("q"), F.avg("d").alias("m"), F.count("*").alias("n")).select(
        "kind", r(F.col("q")[0]).alias("p50"), r(F.col("q")[1]).alias("p75"), r(F.col("q")[2]).alias("p95"), r("m").alias("mean_days"), "n"
    )


@query(sql("""SELECT c.sha, project, count(*) AS rounds, max(date_diff('day', c.day, h.day)) AS days FROM commits c JOIN changes h USING (sha) GROUP BY ALL
HAVING count(*) >= 7 OR max(date_diff('day', c.day, h.day)) >= 119 ORDER BY days DESC, rounds DESC, sha LIMIT 50""", "commits", "changes"))
def review_bottlenecks(spark, sf_dir):
    """Many rounds or a long wait, worst first."""
    j = commits(spark, sf_dir).select("sha", "project", F.col("day").alias("opened")).join(changes(spark, sf_dir).select("sha", "day"), "sha")
    g = j.groupBy("sha", "project").agg(F.count("*").alias("rounds"), F.max(F.datediff("day", "opened")).cast("long").alias("days"))
    return g.where("rounds >= 7 OR days >= 119").orderBy(F.desc("days"), F.desc("rounds"), "sha").limit(50)


@query("""SELECT role, count(DISTINCT conv_id) AS conversations, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars,
CAST(sum(len(regexp_split_to_array(trim(text), '\\s+'))) AS BIGINT) AS words FROM conversations GROUP BY role""")
def token_economy(spark, sf_dir):
    """Sizes by role; a conversation counts once."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("turns"), F.sum(F.char_length("text").cast("long")).alias("chars"), F.sum(F.size(F.split(F.trim("text"), r"\s+")).cast("long")).alias("words"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS verifies, count(*) FILTER (WHERE event_type = 'click') AS edits,
round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) FILTER (WHERE event_type = 'click'), 4) AS ratio FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'click') >= 5""")
def verify_vs_edit_ratio(spark, sf_dir):
    """Ratio of two kinds of event a session owner, with a floor."""
    g = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("verifies"), F.count_if(F.col("event_type") == "click").alias("edits"))
    return g.where("edits >= 5").withColumn("ratio", r(F.col("verifies") / F.col("edits")))


@query("""SELECT host, count(*) AS visits, count(DISTINCT url) AS urls FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) GROUP BY host ORDER BY visits DESC, host LIMIT 20""")
def domain_breakdown(spark, sf_dir):
    """Top hosts."""
    p = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("visits"), F.countDistinct("url").alias("urls")).orderBy(F.desc("visits"), "host").limit(20)


@query("""SELECT url, count(*) AS mentions, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM (
SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+[.][a-z]+')) AS url FROM documents) GROUP BY url""")
def url_mentions(spark, sf_dir):
    """Mail addresses in texts with mention and document counts; extracted_urls has the links of pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9.]+@[A-Za-z0-9.]+[.][a-z]+"), F.lit(0))).alias("url"))
    return d.groupBy("url").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


@query(sql("""WITH s AS (SELECT day, event_type, count(*) AS n FROM ev GROUP BY ALL),
p AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY day) AS p, row_number() OVER (PARTITION BY day ORDER BY n, event_type) AS i, count(*) OVER (PARTITION BY day) AS k FROM s)
SELECT day, round(-sum(p * log2(p)), 4) AS entropy, round(sum((2 * i - k - 1) * p) / max(k), 4) AS gini FROM p GROUP BY day""", "ev"))
def attention(spark, sf_dir):
    """Entropy (bits) and Gini index of a day's shares."""
    s = events(spark, sf_dir).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    day = Window.partitionBy("day")
    p = s.select("day", (F.col("n") / F.sum("n").over(day)).alias("p"), F.row_number().over(day.orderBy("n", "event_type")).alias("i"), F.count("*").over(day).alias("k"))
    return p.groupBy("day").agg(r(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), r(F.sum((2 * F.col("i") - F.col("k") - 1) * F.col("p")) / F.max("k")).alias("gini"))


@query(sql("""SELECT event_type, user_id, weight, rank FROM (SELECT event_type, user_id, round(sum(value), 4) AS weight, CAST(row_number() OVER (PARTITION BY event_type ORDER BY round(sum(value), 4) DESC, user_id) AS INTEGER) AS rank
FROM ev GROUP BY event_type, user_id) WHERE rank <= 5""", "ev"))
def weighted_top_n(spark, sf_dir):
    """The five heaviest members of each group."""
    g = events(spark, sf_dir).groupBy("event_type", "user_id").agg(r(F.sum("value")).alias("weight"))
    w = Window.partitionBy("event_type").orderBy(F.desc("weight"), "user_id")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query(sql("""SELECT h.day, round(sum(h.lines * c.lines) / sum(c.lines), 4) AS mean_lines, count(*) AS n FROM changes h JOIN commits c USING (sha) WHERE c.status <> 'P' GROUP BY h.day""", "changes", "commits"))
def weighted_daily_mean(spark, sf_dir):
    """Weighted mean a day over the rows that have a weight."""
    j = changes(spark, sf_dir).select("sha", "day", "lines").join(commits(spark, sf_dir).where("status <> 'P'").select("sha", F.col("lines").alias("w")), "sha")
    return j.groupBy("day").agg(r(F.sum(F.col("lines") * F.col("w")) / F.sum("w")).alias("mean_lines"), F.count("*").alias("n"))


@query(sql("""SELECT event_type, day, count(*) AS visits, CAST(sum(dwell) AS BIGINT) AS dwell_s FROM (
SELECT event_type, day, least(coalesce((lead("at") OVER (PARTITION BY user_id ORDER BY "at", event_id) - "at") // 1000000, 300), 300) AS dwell FROM ev) GROUP BY ALL""", "ev"))
def category_dwell(spark, sf_dir):
    """Visits and estimated seconds a category and day; dwell is the gap to the next visit, capped."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    gap = F.floor((F.lead("at").over(w) - F.col("at")) / 1_000_000)
    e = events(spark, sf_dir).withColumn("dwell", F.least(F.coalesce(gap, F.lit(300)), F.lit(300)))
    return e.groupBy("event_type", "day").agg(F.count("*").alias("visits"), F.sum("dwell").cast("long").alias("dwell_s"))


@query(sql("""SELECT change, count(*) AS n, count(*) FILTER (WHERE rework) AS rework FROM (
SELECT change, coalesce(day - lag(day) OVER (PARTITION BY path ORDER BY day, sha, line) <= 14, false) AS rework FROM changes) GROUP BY change""", "changes"))
def churn_rework(spark, sf_dir):
    """Changes of a path touched in the 14 days before."""
    w = Window.partitionBy("path").orderBy("day", "sha", "line")
    c = changes(spark, sf_dir).withColumn("rework", F.coalesce(F.datediff("day", F.lag("day").over(w)) <= 14, F.lit(False)))
    return c.groupBy("change").agg(F.count("*").alias("n"), F.count_if("rework").alias("rework"))


@query(sql("""SELECT c.sha, round(exp((ln(count(*)) + ln(count(DISTINCT path)) + ln(count(DISTINCT owner))) / 3), 4) AS scope FROM commits c JOIN changes h USING (sha) GROUP BY c.sha ORDER BY scope DESC, sha LIMIT 100""", "commits", "changes"))
def package_scope(spark, sf_dir):
    """Geometric mean of changes, paths and owners."""
    g = changes(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("n"), F.countDistinct("path").alias("p"), F.countDistinct("owner").alias("o"))
    g = g.join(commits(spark, sf_dir).select("sha"), "sha", "left_semi")
    return g.select("sha", r(F.exp((F.log("n") + F.log("p") + F.log("o")) / 3)).alias("scope")).orderBy(F.desc("scope"), "sha").limit(100)


@query(sql("""WITH w AS (SELECT event_type, user_id, sum(abs(value)) AS w FROM ev GROUP BY ALL), p AS (SELECT event_type, w / sum(w) OVER (PARTITION BY event_type) AS p,
row_number() OVER (PARTITION BY event_type ORDER BY w DESC, user_id) AS k FROM w WHERE w > 0)
SELECT event_type, count(*) AS n, round(max(p), 4) AS top1, round(sum(p) FILTER (WHERE k <= 5), 4) AS top5, round(-sum(p * log2(p)), 4) AS entropy, round(sum(p * p), 6) AS hhi FROM p GROUP BY event_type""", "ev"))
def distribution_stats(spark, sf_dir):
    """Concentration of weights."""
    w = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.sum(F.abs("value")).alias("w")).where("w > 0")
    t = Window.partitionBy("event_type")
    p = w.select("event_type", (F.col("w") / F.sum("w").over(t)).alias("p"), F.row_number().over(t.orderBy(F.desc("w"), "user_id")).alias("k"))
    return p.groupBy("event_type").agg(
        F.count("*").alias("n"), r(F.max("p")).alias("top1"), r(F.sum(F.when(F.col("k") <= 5, F.col("p")))).alias("top5"), r(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), r(F.sum(F.col("p") * F.col("p")), 6).alias("hhi")
    )


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def tool_usage(spark, sf_dir):
    """Counts and distinct users of a window; the bounds reach the scan."""
    e = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(sql("""SELECT month, path_group, added, CAST(sum(added) OVER (PARTITION BY path_group ORDER BY month) AS BIGINT) AS size FROM (
SELECT date_trunc('month', day)::DATE AS month, owner % 10 AS path_group, CAST(sum(lines) AS BIGINT) AS added FROM changes GROUP BY ALL)""", "changes"))
def module_growth(spark, sf_dir):
    """Additions a month and module and the running size."""
    g = changes(spark, sf_dir).groupBy(F.to_date(F.date_trunc("month", "day")).alias("month"), (F.col("owner") % 10).alias("path_group")).agg(F.sum("lines").cast("long").alias("added"))
    w = Window.partitionBy("path_group").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("size", F.sum("added").over(w))


@query(sql("""WITH a AS (SELECT day, count(*) AS n_events FROM ev GROUP BY day), b AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' GROUP BY 1),
c AS (SELECT day, round(sum(value), 2) AS error_value FROM ev WHERE event_type = 'error' GROUP BY day)
SELECT coalesce(a.day, b.day, c.day) AS day, n_events, users, error_value FROM a FULL JOIN b ON a.day = b.day FULL JOIN c ON coalesce(a.day, b.day) = c.day""", "ev"))
def daily_summary(spark, sf_dir):
    """Independent daily signals in one wide row; absent stays null."""
    e = events(spark, sf_dir)
    a = e.groupBy("day").agg(F.count("*").alias("n_events"))
    b = e.where("event_type = 'purchase'").groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    c = e.where("event_type = 'error'").groupBy("day").agg(r(F.sum("value"), 2).alias("error_value"))
    return a.join(b, "day", "full_outer").join(c, "day", "full_outer")


@query(sql("""SELECT day, metric, v FROM (SELECT day, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY day)
UNPIVOT (v FOR metric IN (mean_value, max_value, n))""", "ev"))
def long_signals(spark, sf_dir):
    """Wide daily rows to long signals."""
    d = events(spark, sf_dir).groupBy("day").agg(r(F.avg("value")).alias("mean_value"), r(F.max("value")).alias("max_value"), F.count("*").cast("double").alias("n"))
    return d.unpivot("day", ["mean_value", "max_value", "n"], "metric", "v")


@query("""SELECT l_partkey AS part, l_suppkey AS supplier, l_orderkey AS ord FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1""")
def latest_machine_rows(spark, sf_dir):
    """The latest row of each natural key."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("ord"), "l_shipdate", "l_linenumber")
    return last_revision(l, ["part"], ["l_shipdate", "ord", "l_linenumber"]).select("part", "supplier", "ord")


@query(sql("""WITH f AS (SELECT user_id, event_type, start, max("end") AS "end" FROM spans GROUP BY ALL),
g AS (SELECT *, max("end") OVER (PARTITION BY user_id, event_type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY start, "end") AS island FROM g)
SELECT user_id, event_type, CAST(island AS BIGINT) AS island, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY ALL""", "spans"))
def dedup_and_merge(spark, sf_dir):
    """Keep the latest end of equal starts, then merge within an hour."""
    from daybook.sources.tables import spans

    return merge_repeats(spans(spark, sf_dir).select("user_id", "event_type", "start", "end"), ["user_id", "event_type"], 3_600_000_000)


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def canonical_entries(spark, sf_dir):
    """One row a key by class, then size, then arrival."""
    o = table(spark, sf_dir, "orders")
    return latest_rows(o, ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT user_id, 'live' AS origin, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id
UNION ALL SELECT user_id, 'export' AS origin, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id""")
def merged_bookmarks(spark, sf_dir):
    """The live source wins, the export fills in."""
    e = table(spark, sf_dir, "events")
    live = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit("live").alias("origin"), "n")
    export = e.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit("export").alias("origin"), "n")
    return union_preferring(live, export, "user_id")


@query("""SELECT DISTINCT l_partkey % 500 AS source, l_suppkey AS target FROM lineitem WHERE l_partkey % 500 <> l_suppkey AND l_partkey % 500 IN (SELECT s_suppkey FROM supplier)
AND l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def normalize_graph(spark, sf_dir):
    """Distinct edges without loops and unknown ends."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("source"), F.col("l_suppkey").alias("target"))
    return normalise_edges(edges, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
