"""Rules on texts, names, paths and dates, and the daily and windowed summaries that rest on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.plans.registry import registry
from daybook.sources.tables import commits, events, spans, sql, table

REGISTRY, query = registry()
MINUTE, HOUR = 60_000_000, 3_600_000_000

#: Shapes in which a day is written, by the order's number.
WRITTEN = "CASE l_orderkey % 5 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d.%m.%Y') WHEN 2 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN 3 THEN strftime(l_shipdate, '%Y%m%d') ELSE 'on some day' END"


@query(f"""WITH w AS (SELECT l_orderkey, l_linenumber, {WRITTEN} AS raw FROM lineitem) SELECT l_orderkey, l_linenumber,
CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d.%m.%Y'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%Y%m%d')) AS DATE) AS day FROM w""")
def parsed_dates(spark, sf_dir):
    """days written in several formats, null where none fits."""
    shapes = ["yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd", "yyyyMMdd"]
    raw = reduce(lambda rest, i: F.when(F.col("l_orderkey") % 5 == i, F.date_format("l_shipdate", shapes[i])).otherwise(rest), range(4), F.lit("on some day"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return l.select("l_orderkey", "l_linenumber", F.to_date(F.coalesce(*[F.try_to_timestamp("raw", F.lit(s)) for s in shapes])).alias("day"))


@query("""WITH w AS (SELECT event_id, ts, event_id % 4 AS shape FROM events) SELECT event_id, CASE WHEN shape = 3 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000000 + CASE WHEN shape = 1 THEN -7200 ELSE 0 END END AS epoch_s FROM w""")
def parsed_times(spark, sf_dir):
    """times with an offset, with a Z, in epoch seconds or unreadable, as instants."""
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    n, iso = F.col("event_id") % 4, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(n == 0, F.concat(iso, F.lit("Z"))).when(n == 1, F.concat(iso, F.lit("+02:00"))).when(n == 2, F.unix_seconds(t).cast("string")).otherwise(F.lit("soon"))
    w = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    read = F.coalesce(F.unix_seconds(F.try_to_timestamp("raw", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))), F.expr("try_cast(raw AS bigint)"))
    return w.select("event_id", read.alias("epoch_s"))


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders), m AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b) SELECT DISTINCT strftime(m, '%Y-%m') AS month, year(m) || '-Q' || quarter(m) AS quarter FROM m""")
def period_keys_in_range(spark, sf_dir):
    """every month key and its quarter's from the first order to the last, those without orders too."""
    b = table(spark, sf_dir, "orders").agg(F.trunc(F.min("o_orderdate"), "month").alias("lo"), F.trunc(F.max("o_orderdate"), "month").alias("hi")).where("lo IS NOT NULL")
    m = b.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return m.select(F.date_format("m", "yyyy-MM").alias("month"), F.concat(F.year("m"), F.lit("-Q"), F.quarter("m")).alias("quarter")).distinct()


@query(r"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html || ' see ' || url || '.', 'https?://[^\s"''<>)]+')) AS raw FROM pages), c AS (SELECT page_id, regexp_replace(raw, '[.,;:!?]+$', '') AS link FROM u) SELECT page_id, link, count(*) AS n FROM c GROUP BY ALL""")
def extracted_urls(spark, sf_dir):
    """all URLs in the raw text of pages and their own addresses, without the marks that end a sentence."""
    u = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.concat("html", F.lit(" see "), "url", F.lit(".")), F.lit(r"""(https?://[^\s"'<>)]+)"""))).alias("raw"))
    return u.groupBy("page_id", F.regexp_replace("raw", "[.,;:!?]+$", "").alias("link")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS alias, c_mktsegment AS project FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' || upper(c_name) || ' ' ELSE c_name END AS said, c_name FROM customer)
SELECT c_custkey, coalesce(a.project, lower(trim(said))) AS project, a.project IS NOT NULL AS known FROM n LEFT JOIN (SELECT lower(c.c_name) AS alias, a.project FROM a JOIN customer c ON c.c_custkey = CAST(split_part(a.alias, '#', 2) AS BIGINT)) a ON lower(trim(said)) = a.alias""")
def canonical_names(spark, sf_dir):
    """aliases in any case and spacing to the canonical name by an alias table; unknown ones to their own plain form."""
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.lower("c_name").alias("alias"), F.col("c_mktsegment").alias("project"))
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
    n = c.select("c_custkey", F.lower(F.trim(said)).alias("alias"))
    return n.join(a, "alias", "left").select("c_custkey", F.coalesce("project", "alias").alias("project"), F.col("project").isNotNull().alias("known"))


#: Topics with their words and weights.
TOPICS = {"terms": {"license": 3, "copyright": 2, "rights": 1}, "contact": {"email": 2, "phone": 2, "address": 1}, "study": {"study": 2, "data": 1, "results": 1}, "home": {"house": 1, "garden": 2, "water": 1}}
_RULES = ", ".join(f"('{t}', '{w}', {k})" for t, words in TOPICS.items() for w, k in words.items())


@query(f"""WITH t(topic, word, weight) AS (VALUES {_RULES}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT doc_id, topic, CAST(sum(least(n, 5) * weight) AS BIGINT) AS score FROM c JOIN t USING (word) GROUP BY ALL) SELECT doc_id, topic, score FROM s WHERE score >= 2""")
def document_topics(spark, sf_dir):
    """topics of a text by weighted keywords, a word counting five times at most, scores of two and more."""
    t = spark.createDataFrame([(t, w, k) for t, words in TOPICS.items() for w, k in words.items()], "topic string, word string, weight int")
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"))).alias("word"))
    c = w.join(F.broadcast(t), "word").groupBy("doc_id", "topic", "word", "weight").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id", "topic").agg(F.sum(F.least("n", F.lit(5)) * F.col("weight")).alias("score")).where("score >= 2")


@query(r"""WITH t AS (SELECT doc_id, '(' || (doc_id % 7) || ') ' || lang || ' - ' || source || ' ' || doc_id || '%  — Browser' AS title FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '^\(\d+\)\s*', ''), '\s+[—-]\s+browser$', ''), '\d+%?', '#', 'g')) AS title_key FROM t""")
def title_keys(spark, sf_dir):
    """a title's stable key: no unread counter, no application's name, numbers as one mark."""
    title = F.lower(F.concat(F.lit("("), (F.col("doc_id") % 7).cast("string"), F.lit(") "), "lang", F.lit(" - "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit("%  — Browser")))
    rules = [(r"^\(\d+\)\s*", ""), (r"\s+[—-]\s+browser$", ""), (r"\d+%?", "#")]
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(reduce(lambda c, r: F.regexp_replace(c, *r), rules, title)).alias("title_key"))


OVERLAY = """SELECT event_id, user_id, event_type AS source_kind, CASE WHEN event_id % 6 = 0 THEN 'testing' WHEN value > 80 THEN 'implementation' WHEN event_type = 'error' THEN 'debugging' ELSE event_type END AS overlay_kind,
CASE WHEN event_id % 6 = 0 THEN 'high' WHEN value > 80 THEN 'medium' ELSE 'low' END AS tier FROM events"""


@query(OVERLAY.replace(" AS tier FROM", " AS tier, CASE WHEN event_id % 6 = 0 THEN event_type = 'testing' WHEN value > 80 THEN event_type = 'implementation' ELSE event_type <> 'error' END AS agrees FROM"))
def overlay_labels(spark, sf_dir):
    """an event's own label kept beside the one that its paths, tools and length give, with agreement and tier."""
    e = events(spark, sf_dir)
    rules = [(F.col("event_id") % 6 == 0, "testing", "high"), (F.col("value") > 80, "implementation", "medium"), (F.col("event_type") == "error", "debugging", "low")]
    kind = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.col("event_type"))
    tier = reduce(lambda rest, r: F.when(r[0], r[2]).otherwise(rest), reversed(rules), F.lit("low"))
    return e.select("event_id", "user_id", F.col("event_type").alias("source_kind"), kind.alias("overlay_kind"), tier.alias("tier"), (kind == F.col("event_type")).alias("agrees"))


@query("WITH o AS (" + OVERLAY + """) SELECT overlay_kind, count(*) AS n, round(sum(CASE tier WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.7e0 ELSE 0.4e0 END), 1) AS weight FROM o GROUP BY 1""")
def tier_weights(spark, sf_dir):
    """labels weighted by their tier from a fixed map."""
    weight = F.element_at(F.create_map(F.lit("high"), F.lit(1.0), F.lit("medium"), F.lit(0.7), F.lit("low"), F.lit(0.4)), F.col("tier"))
    return overlay_labels(spark, sf_dir).groupBy("overlay_kind").agg(F.count("*").alias("n"), F.round(F.sum(weight), 1).alias("weight"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)
SELECT user_id, CASE WHEN kinds = 1 THEN 'action' WHEN errors * 4 > n THEN 'bot' WHEN days <= 3 THEN 'guest' ELSE 'human' END AS speaker FROM s""")
def speaker_classes(spark, sf_dir):
    """each speaker as human, bot, guest or action from their own totals."""
    s = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("day").alias("days"))
    return s.select("user_id", F.when(F.col("kinds") == 1, "action").when(F.col("errors") * 4 > F.col("n"), "bot").when(F.col("days") <= 3, "guest").otherwise("human").alias("speaker"))


@query("""WITH d AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages), r(suffix, category, sensitive) AS (VALUES ('org', 'reference', false), ('net', 'work', false), ('com', 'shop', false), ('example', 'private', true))
SELECT page_id, host, coalesce(category, 'other') AS category, coalesce(sensitive, false) AS sensitive FROM d LEFT JOIN r ON suffix = split_part(host, '.', -1)""")
def domain_categories(spark, sf_dir):
    """hosts to categories with a flag for sensitive ones, by a small rule table."""
    r = spark.createDataFrame([("org", "reference", False), ("net", "work", False), ("com", "shop", False), ("example", "private", True)], "suffix string, category string, sensitive boolean")
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/?#:]*)", 1)), r"^www\.", "")
    d = table(spark, sf_dir, "pages").select("page_id", host.alias("host")).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    return d.join(F.broadcast(r), "suffix", "left").select("page_id", "host", F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("sensitive", F.lit(False)).alias("sensitive"))


#: Paths made of a part's columns: sources, tests, lockfiles, vendored trees.
PATHS = """paths AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'pkg/' || p_size || '/__init__.py' WHEN 2 THEN 'vendor/' || p_brand || '/a.c' WHEN 3 THEN 'crate/' || lower(p_brand) || '/src/lib.rs' WHEN 4 THEN 'tests/test_' || p_size || '.py' ELSE 'crate/' || lower(p_brand) || '/src/m' || p_size || '.rs' END AS path FROM part)"""


def paths(spark, sf_dir):
    n, brand, size = F.col("p_partkey") % 6, F.col("p_brand"), F.col("p_size").cast("string")
    crate = F.concat(F.lit("crate/"), F.lower(brand), F.lit("/src/"))
    made = [F.lit("Cargo.lock"), F.concat(F.lit("pkg/"), size, F.lit("/__init__.py")), F.concat(F.lit("vendor/"), brand, F.lit("/a.c")), F.concat(crate, F.lit("lib.rs")), F.concat(F.lit("tests/test_"), size, F.lit(".py"))]
    path = reduce(lambda rest, i: F.when(n == i, made[i]).otherwise(rest), range(5), F.concat(crate, F.lit("m"), size, F.lit(".rs")))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


HIGH_FANOUT = r"(^|/)([^/]*\.lock|__init__\.py)$|^vendor/"


@query("WITH " + PATHS + f""", k AS (SELECT l_orderkey AS sha, path FROM lineitem JOIN paths ON p_partkey = l_partkey) SELECT sha, count(*) FILTER (WHERE NOT regexp_matches(path, '{HIGH_FANOUT}')) AS n_kept, count(*) FILTER (WHERE regexp_matches(path, '{HIGH_FANOUT}')) AS n_dropped FROM k GROUP BY sha""")
def low_fanout_paths(spark, sf_dir):
    """a commit's paths without lockfiles, package markers and vendored trees."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("p_partkey")).join(paths(spark, sf_dir), "p_partkey")
    wide = F.col("path").rlike(HIGH_FANOUT)
    return l.groupBy("sha").agg(F.count_if(~wide).alias("n_kept"), F.count_if(wide).alias("n_dropped"))


@query("WITH " + PATHS + """ SELECT CASE WHEN split_part(path, '/', 1) = 'crate' THEN 'crate/' || split_part(path, '/', 2) WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS module, count(*) AS n, count(DISTINCT path) AS n_paths FROM paths GROUP BY 1""")
def module_keys(spark, sf_dir):
    """paths to module keys by their first folders."""
    p, first = paths(spark, sf_dir), F.split_part("path", F.lit("/"), F.lit(1))
    key = F.when(first == "crate", F.concat(F.lit("crate/"), F.split_part("path", F.lit("/"), F.lit(2)))).when(F.contains("path", F.lit("/")), first).otherwise("(root)")
    return p.groupBy(key.alias("module")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


@query("WITH " + PATHS + """, c AS (SELECT l_orderkey // 100 AS cluster, path FROM lineitem JOIN paths ON p_partkey = l_partkey) SELECT cluster, count(DISTINCT path) AS n_paths, count(DISTINCT CASE WHEN path LIKE 'tests/%' THEN path END) AS n_tests, count(DISTINCT CASE WHEN path LIKE 'crate/%' THEN split_part(path, '/', 2) END) AS n_modules FROM c GROUP BY 1""")
def change_surface(spark, sf_dir):
    """The modules and tests that each cluster of commits touches."""
    l = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("cluster"), F.col("l_partkey").alias("p_partkey")).join(paths(spark, sf_dir), "p_partkey")
    held = l.select("cluster", "path").distinct()
    return held.groupBy("cluster").agg(F.count("*").alias("n_paths"), F.count_if(F.startswith("path", F.lit("tests/"))).alias("n_tests"), F.countDistinct(F.when(F.startswith("path", F.lit("crate/")), F.split_part("path", F.lit("/"), F.lit(2)))).alias("n_modules"))


@query("""SELECT project, status, count(*) AS n FROM (SELECT c_mktsegment AS project, o_orderstatus AS status, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)) GROUP BY ALL""")
def selected_projects(spark, sf_dir):
    """Rows of the selected projects (here the two with most customers); an empty selection takes all."""
    chosen = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(2)
    return include_projects(commits(spark, sf_dir), [r["c_mktsegment"] for r in chosen.collect()]).groupBy("project", "status").agg(F.count("*").alias("n"))


def include_projects(df, selection: list[str]):
    return df.where(F.col("project").isin(selection)) if selection else df


@query("""WITH r AS (SELECT l_orderkey, list(DISTINCT l_returnflag) FILTER (WHERE l_discount >= 0.08) AS friction FROM lineitem GROUP BY 1) SELECT o_orderkey, CAST(len(friction) AS INTEGER) AS n_signals FROM orders JOIN r ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND len(friction) > 0""")
def review_rows(spark, sf_dir):
    """Reviews of a state whose array of friction signals isn't empty."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.when(F.col("l_discount") >= 0.08, F.col("l_returnflag"))).alias("friction"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(r, "o_orderkey").where(F.size("friction") > 0).select("o_orderkey", F.size("friction").alias("n_signals"))


@query(sql("""WITH m AS (SELECT day, count(*) FILTER (WHERE event_type = 'view') AS messages, count(*) FILTER (WHERE event_type = 'purchase') AS commits FROM ev GROUP BY 1) SELECT day, messages, commits, round(messages * 1.0 / commits, 3) AS ratio FROM m WHERE commits > 0 AND messages * 1.0 / commits > 1.1""", "ev"))
def cleanup_periods(spark, sf_dir):
    """Periods whose messages a commit pass a threshold (days and 1.1 here)."""
    m = events(spark, sf_dir).groupBy("day").agg(F.count_if(F.col("event_type") == "view").alias("messages"), F.count_if(F.col("event_type") == "purchase").alias("commits"))
    return m.where("commits > 0 AND messages / commits > 1.1").select("day", "messages", "commits", F.round(F.col("messages") / F.col("commits"), 3).alias("ratio"))


@query(sql("""WITH d AS (SELECT user_id, event_type AS project, unnest(range((start - 21600000000) // 86400000000, (greatest("end", start + 1) - 1 - 21600000000) // 86400000000 + 1)) AS d, start, "end" FROM spans)
SELECT project, DATE '1970-01-01' + CAST(d AS INTEGER) AS logical_day, CAST(sum(least("end", (d + 1) * 86400000000 + 21600000000) - greatest(start, d * 86400000000 + 21600000000)) // 1000000 AS BIGINT) AS seconds FROM d GROUP BY ALL""", "spans"))
def project_focus_days(spark, sf_dir):
    """Focus seconds by project and logical day, spans clipped at 06:00."""
    day, six = 24 * HOUR, 6 * HOUR
    s = spans(spark, sf_dir).withColumn("d", F.explode(F.sequence(F.floor((F.col("start") - six) / day), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1 - six) / day))))
    part = F.least(F.col("end"), (F.col("d") + 1) * day + six) - F.greatest(F.col("start"), F.col("d") * day + six)
    return s.groupBy(F.col("event_type").alias("project"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).alias("logical_day")).agg(F.floor(F.sum(part) / 1_000_000).alias("seconds"))


@query(sql("""WITH g AS (SELECT user_id, unnest(['g' || user_id % 3, 'h' || user_id % 5]) AS genre FROM (SELECT DISTINCT user_id FROM ev)) SELECT e.day, genre, CAST(sum(floor(value)) AS BIGINT) AS minutes FROM ev e JOIN g USING (user_id) WHERE event_type = 'view' GROUP BY ALL""", "ev"))
def genre_minutes(spark, sf_dir):
    """A stream's full minutes go to each genre of its artist; only covered days appear."""
    e = events(spark, sf_dir)
    g = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")))).alias("genre"))
    m = e.where("event_type = 'view'").groupBy("user_id", "day").agg(F.sum(F.floor("value")).alias("m"))  # before the genres multiply rows
    return m.join(g, "user_id").groupBy("day", "genre").agg(F.sum("m").alias("minutes"))


@query(sql("""WITH c AS (SELECT day, event_type || ':' || (user_id % 4) AS command, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, command) AS place FROM c)
SELECT day, CAST(sum(n) AS BIGINT) AS commands, round(sum(bad) * 1.0 / sum(n), 4) AS error_share, string_agg(command, ',' ORDER BY place) FILTER (WHERE place <= 3) AS top_commands FROM r GROUP BY day""", "ev"))
def terminal_activity(spark, sf_dir):
    """Commands, share of errors and the three commonest commands of each day."""
    c = events(spark, sf_dir).groupBy("day", F.concat("event_type", F.lit(":"), (F.col("user_id") % 4).cast("string")).alias("command")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    r = c.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "command")))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "command")))), lambda x: x["command"]), ",")
    return r.groupBy("day").agg(F.sum("n").alias("commands"), F.round(F.sum("bad") / F.sum("n"), 4).alias("error_share"), top.alias("top_commands"))


@query("""WITH t AS (SELECT 'chat' AS channel, role AS who, length(coalesce(text, '')) AS n FROM conversations UNION ALL SELECT 'page', regexp_extract(url, '^https?://([^/]*)', 1), length(html) FROM pages UNION ALL SELECT 'text', source, length(coalesce(text, '')) FROM documents)
SELECT channel, who, count(*) AS messages, CAST(sum(n) AS BIGINT) AS chars FROM t GROUP BY ALL""")
def public_text(spark, sf_dir):
    """Messages and characters by channel, one union of three shapes."""
    n = lambda c: F.char_length(F.coalesce(c, F.lit(""))).alias("n")
    t = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("channel"), F.col("role").alias("who"), n("text"))
    t = t.unionByName(table(spark, sf_dir, "pages").select(F.lit("page").alias("channel"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("who"), n("html")))
    t = t.unionByName(table(spark, sf_dir, "documents").select(F.lit("text").alias("channel"), F.col("source").alias("who"), n("text")))
    return t.groupBy("channel", "who").agg(F.count("*").alias("messages"), F.sum("n").alias("chars"))


@query(sql("""WITH p AS (SELECT thread, project, max(day) AS landed FROM commits WHERE status = 'F' GROUP BY ALL), o AS (SELECT sha, thread, project, day, status FROM commits WHERE status <> 'F'), l AS (SELECT o.*, CASE WHEN status = 'P' THEN 'in review' WHEN p.landed >= o.day THEN 'superseded' WHEN p.landed IS NULL THEN 'new' ELSE 'open' END AS lifecycle FROM o LEFT JOIN p USING (thread, project))
SELECT project, lifecycle, count(*) AS n, min(day) AS oldest FROM l GROUP BY ALL""", "commits"))
def frontier_items(spark, sf_dir):
    """Open items by lifecycle, linked to the landed work of their thread."""
    c = commits(spark, sf_dir)
    p = c.where("status = 'F'").groupBy("thread", "project").agg(F.max("day").alias("landed"))
    life = F.when(F.col("status") == "P", "in review").when(F.col("landed") >= F.col("day"), "superseded").when(F.col("landed").isNull(), "new").otherwise("open")
    return c.where("status <> 'F'").join(p, ["thread", "project"], "left").groupBy("project", life.alias("lifecycle")).agg(F.count("*").alias("n"), F.min("day").alias("oldest"))


@query(sql("""SELECT sha, CAST(sum(lines) FILTER (WHERE change <> 'R') AS BIGINT) AS added, CAST(coalesce(sum(lines) FILTER (WHERE change = 'R'), 0) AS BIGINT) AS deleted, count(DISTINCT path) AS files FROM changes WHERE owner % 10 <> 3 GROUP BY sha""".replace("CAST(sum(lines) FILTER (WHERE change <> 'R') AS BIGINT)", "CAST(coalesce(sum(lines) FILTER (WHERE change <> 'R'), 0) AS BIGINT)").replace("WHERE owner % 10 <> 3 ", "WHERE owner IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) "), "changes"))
def commit_stats(spark, sf_dir):
    """A row a commit: lines added and deleted and files, of the authors of an allow-list (suppliers in credit)."""
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("owner"))
    from daybook.sources.tables import changes

    c = changes(spark, sf_dir).join(allowed, "owner", "left_semi")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("lines"))), F.lit(0)).cast("long")
    return c.groupBy("sha").agg(total(F.col("change") != "R").alias("added"), total(F.col("change") == "R").alias("deleted"), F.countDistinct("path").alias("files"))


@query("""WITH t AS (SELECT 'search' AS source, lang AS interest FROM documents UNION ALL SELECT 'bookmark', regexp_extract(url, '^https?://([^/]*)', 1) FROM pages UNION ALL SELECT 'dialogue', role FROM conversations), c AS (SELECT source, interest, count(*) AS n FROM t WHERE interest IS NOT NULL GROUP BY ALL)
SELECT source, interest, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, interest) AS INTEGER) AS place FROM c QUALIFY place <= 5""")
def interest_trace(spark, sf_dir):
    """The five strongest interests of each source over searches, bookmarks and dialogues."""
    t = table(spark, sf_dir, "documents").select(F.lit("search").alias("source"), F.col("lang").alias("interest"))
    t = t.unionByName(table(spark, sf_dir, "pages").select(F.lit("bookmark").alias("source"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("interest")))
    t = t.unionByName(table(spark, sf_dir, "conversations").select(F.lit("dialogue").alias("source"), F.col("role").alias("interest")))
    c = t.where("interest IS NOT NULL").groupBy("source", "interest").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "interest"))).where("place <= 5")


@query(sql("""WITH r AS (SELECT day, project, count(*) AS n, sum(lines) AS churn FROM commits GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, project) AS place FROM r) SELECT day, CAST(sum(n) AS BIGINT) AS commits, round(sum(churn), 2) AS churn, max(project) FILTER (WHERE place = 1) AS top_repo FROM p GROUP BY day""", "commits"))
def git_days(spark, sf_dir):
    """Commits, churn and the busiest repository of each day."""
    r = commits(spark, sf_dir).groupBy("day", "project").agg(F.count("*").alias("n"), F.sum("lines").alias("churn"))
    return r.groupBy("day").agg(F.sum("n").alias("commits"), F.round(F.sum("churn"), 2).alias("churn"), F.min_by("project", F.struct(-F.col("n"), "project")).alias("top_repo"))


@query(sql("""SELECT day, count(*) AS n, round(min(value), 3) AS quietest, round(max(value), 3) AS loudest, round(avg(value), 4) AS mean, CAST(count(*) FILTER (WHERE value > 80) AS BIGINT) AS loud FROM ev WHERE event_type = 'view' GROUP BY day HAVING count(*) >= 5""", "ev"))
def ambient_days(spark, sf_dir):
    """Daily loudness; days with fewer than five samples are absent, not zero."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    return e.groupBy("day").agg(F.count("*").alias("n"), F.round(F.min("value"), 3).alias("quietest"), F.round(F.max("value"), 3).alias("loudest"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") > 80).alias("loud")).where("n >= 5")


@query(sql("""WITH w AS (SELECT user_id, "at" // 21600000000 AS slot, avg(value) AS mean, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS peak FROM ev GROUP BY ALL)
SELECT user_id, slot, CASE WHEN errors * 2 >= n AND n >= 2 THEN 'incident' WHEN peak > 90 THEN 'pressure' WHEN n >= 4 THEN 'busy' ELSE 'calm' END AS state, CASE WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM w""", "ev"))
def work_states(spark, sf_dir):
    """One state label and its confidence for each window of six hours."""
    w = events(spark, sf_dir).groupBy("user_id", F.expr(f"at div {6 * HOUR}").alias("slot")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("peak"))
    state = F.when((F.col("errors") * 2 >= F.col("n")) & (F.col("n") >= 2), "incident").when(F.col("peak") > 90, "pressure").when(F.col("n") >= 4, "busy").otherwise("calm")
    return w.select("user_id", "slot", state.alias("state"), F.when(F.col("n") >= 4, "high").when(F.col("n") >= 2, "medium").otherwise("low").alias("confidence"))


#: Signature rules over a day's aggregates: name and condition, in fixed order.
SIGNATURES = [
    ("cache-thrash", "views >= 30 AND peak > 95"), ("swap-thrash", "errors >= 15"), ("io-livelock-risk", "errors >= 8 AND clicks * 2 < views"), ("kill-storm", "errors * 5 > n"),
    ("burst-alloc-starvation", "peak > 2 * mean AND purchases >= 20"), ("leak-candidates", "mean > 52"), ("writeback-pressure", "signups * 10 > n"),
]


@query(sql("""WITH w AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'signup') AS signups, max(value) AS peak, avg(value) AS mean FROM ev GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT day, {i} AS place, '{name}' AS signature, {rule} AS fires FROM w" for i, (name, rule) in enumerate(SIGNATURES)), "ev"))
def signatures(spark, sf_dir):
    """Seven fixed rules over each window's aggregates, all reported, in their order."""
    n = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    w = events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), n("view", "views"), n("error", "errors"), n("click", "clicks"), n("purchase", "purchases"), n("signup", "signups"), F.max("value").alias("peak"), F.avg("value").alias("mean"))
    rules = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("signature"), F.expr(rule).alias("fires")) for i, (name, rule) in enumerate(SIGNATURES)]
    return w.select("day", F.inline(F.array(*rules)))


@query(sql("""WITH d AS (SELECT day, user_id % 5 AS device, value, lag(value) OVER (PARTITION BY user_id % 5, day ORDER BY "at", event_id) AS before FROM ev), g AS (SELECT day, device, sum(CASE WHEN value >= before THEN floor(value) - floor(before) ELSE floor(value) END) AS written FROM d WHERE before IS NOT NULL GROUP BY ALL)
SELECT day, CAST(device AS INTEGER) AS device, CAST(written AS BIGINT) AS written, written > 1200 AS over_budget FROM g""", "ev"))
def wear_status(spark, sf_dir):
    """Bytes written a day by counter differences (a counter that falls begins anew), against a daily budget."""
    w = Window.partitionBy("device", "day").orderBy("at", "event_id")
    d = events(spark, sf_dir).withColumn("device", (F.col("user_id") % 5).cast("int")).withColumn("before", F.lag("value").over(w)).where("before IS NOT NULL")
    grown = F.when(F.col("value") >= F.col("before"), F.floor("value") - F.floor("before")).otherwise(F.floor("value"))
    return d.groupBy("day", "device").agg(F.sum(grown).alias("written")).withColumn("over_budget", F.col("written") > 1200)


@query(sql("""WITH c AS (SELECT day, user_id AS process, sum(CAST(floor(value * 100) AS BIGINT)) AS used FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY used DESC, process) AS place FROM c) SELECT day, process, CAST(used AS BIGINT) AS used, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""", "ev"))
def capture_leaders(spark, sf_dir):
    """The three heaviest processes of each capture."""
    c = events(spark, sf_dir).groupBy("day", F.col("user_id").alias("process")).agg(F.sum(F.floor(F.col("value") * 100)).alias("used"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("used"), "process"))).where("place <= 3")


@query("""WITH c AS (SELECT o_custkey AS id, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, sum(o_totalprice) AS size FROM orders GROUP BY 1)
SELECT id, n >= 5 AND kinds >= 3 AND size >= 500000 AS supported, array_to_string(list_filter([CASE WHEN n < 5 THEN 'few' END, CASE WHEN kinds < 3 THEN 'narrow' END, CASE WHEN size < 500000 THEN 'small' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def support_assessment(spark, sf_dir):
    """Each candidate supported or refused, with the gates that it fails."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds"), F.sum("o_totalprice").alias("size"))
    gates = F.array(*[F.when(F.expr(test), reason) for test, reason in (("n < 5", "few"), ("kinds < 3", "narrow"), ("size < 500000", "small"))])
    return c.select("id", F.expr("n >= 5 AND kinds >= 3 AND size >= 500000").alias("supported"), F.array_join(gates, ",").alias("reasons"))


@query("""WITH v(place, rule) AS (VALUES (0, 'no customer'), (1, 'no price'), (2, 'bad state'), (3, 'future')), f AS (SELECT o_orderkey, unnest([CASE WHEN o_custkey % 3 = 0 THEN 0 END, CASE WHEN o_totalprice <= 1000 THEN 1 END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 2 END, CASE WHEN o_orderdate > TIMESTAMP '1998-06-01' THEN 3 END]) AS place FROM orders)
SELECT rule, count(o_orderkey) AS n, min(o_orderkey) AS first_row FROM v LEFT JOIN f USING (place) GROUP BY 1""")
def manifest_diagnostics(spark, sf_dir):
    """Rows of a manifest that fail each validation rule; a rule that none fails is listed with zero."""
    tests = [("no customer", "o_custkey % 3 = 0"), ("no price", "o_totalprice <= 1000"), ("bad state", "o_orderstatus NOT IN ('F', 'O')"), ("future", "o_orderdate > TIMESTAMP '1998-06-01'")]
    o = table(spark, sf_dir, "orders")
    one = o.agg(*[F.struct(F.lit(name).alias("rule"), F.count_if(F.expr(test)).alias("n"), F.min(F.when(F.expr(test), F.col("o_orderkey"))).alias("first_row")).alias(f"r{i}") for i, (name, test) in enumerate(tests)])
    return one.select(F.inline(F.array(*[f"r{i}" for i in range(len(tests))])))


@query(sql("""WITH k(contract, lo, hi) AS (VALUES ('click', DATE '2024-01-01', DATE '2024-02-05'), ('error', DATE '2023-12-28', DATE '2024-01-10'), ('voice', DATE '2024-01-01', DATE '2024-01-07')), s AS (SELECT contract, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM k), c AS (SELECT DISTINCT event_type AS contract, day, 1 AS held FROM ev)
SELECT contract, count(*) AS n_days, count(held) AS n_held, min(s.day) FILTER (WHERE held IS NULL) AS first_gap FROM s LEFT JOIN c USING (contract, day) GROUP BY 1""", "ev"))
def contract_coverage(spark, sf_dir):
    """Q06: what each contract asks of its days against what is held."""
    k = spark.createDataFrame([("click", "2024-01-01", "2024-02-05"), ("error", "2023-12-28", "2024-01-10"), ("voice", "2024-01-01", "2024-01-07")], "contract string, lo string, hi string")
    s = k.select("contract", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("day"))
    c = events(spark, sf_dir).select(F.col("event_type").alias("contract"), "day", F.lit(1).alias("held")).distinct()
    return s.join(c, ["contract", "day"], "left").groupBy("contract").agg(F.count("*").alias("n_days"), F.count("held").alias("n_held"), F.min(F.when(F.col("held").isNull(), F.col("day"))).alias("first_gap"))


@query(sql("""WITH l AS (SELECT max(day) AS last FROM ev), s AS (SELECT event_type AS source, max(day) AS seen, count(*) AS n FROM ev WHERE user_id % 2 = 0 OR event_type <> 'signup' GROUP BY 1) SELECT source, n, seen, date_diff('day', seen, last) AS age, CASE WHEN seen = last THEN 'fresh' WHEN date_diff('day', seen, last) <= 2 THEN 'late' ELSE 'stale' END AS status FROM s, l""", "ev"))
def source_status(spark, sf_dir):
    """Q08: each source of a snapshot with its newest day, age and status."""
    e = events(spark, sf_dir)
    last = e.agg(F.max("day").alias("last"))  # one row
    s = e.where("user_id % 2 = 0 OR event_type <> 'signup'").groupBy(F.col("event_type").alias("source")).agg(F.max("day").alias("seen"), F.count("*").alias("n"))
    age = F.datediff("last", "seen").cast("long")
    return s.join(F.broadcast(last), F.lit(True)).select("source", "n", "seen", age.alias("age"), F.when(age == 0, "fresh").when(age <= 2, "late").otherwise("stale").alias("status"))


@query(sql("""WITH d AS (SELECT event_type AS product, day, count(*) AS n FROM ev GROUP BY ALL) SELECT product, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS busiest, min(day) FILTER (WHERE n = top) AS busiest_day FROM (SELECT *, max(n) OVER (PARTITION BY product) AS top FROM d) GROUP BY product""", "ev"))
def product_days(spark, sf_dir):
    """Daily counts by product, and each product's busiest day."""
    d = events(spark, sf_dir).groupBy(F.col("event_type").alias("product"), "day").agg(F.count("*").alias("n"))
    return d.groupBy("product").agg(F.count("*").alias("n_days"), F.sum("n").alias("n_events"), F.max("n").alias("busiest"), F.min_by("day", F.struct(-F.col("n"), "day")).alias("busiest_day"))


@query(sql("""WITH a AS (SELECT event_type AS experiment, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treated' END AS arm, CAST(floor(value * 100) AS BIGINT) AS v FROM ev), s AS (SELECT experiment, arm, count(*) AS n, sum(v) / 100.0 / count(*) AS mean FROM a GROUP BY ALL)
SELECT c.experiment, c.n AS n_control, t.n AS n_treated, round(c.mean, 3) AS control, round(t.mean, 3) AS treated, round(t.mean - c.mean, 3) AS effect FROM s c JOIN s t ON c.experiment = t.experiment AND c.arm = 'control' AND t.arm = 'treated'""", "ev"))
def experiment_arms(spark, sf_dir):
    """The arms of M24: size and mean of both arms of each experiment group and the effect; bootstrap_deltas has the intervals."""
    v = F.floor(F.col("value") * 100)
    a = events(spark, sf_dir).withColumn("treated", F.col("user_id") % 2 != 0)
    s = a.groupBy(F.col("event_type").alias("experiment")).agg(*[F.struct(F.count_if(test).alias("n"), (F.sum(F.when(test, v)) / 100 / F.count_if(test)).alias("mean")).alias(n) for n, test in (("c", ~F.col("treated")), ("t", F.col("treated")))])
    s = s.where("c.n > 0 AND t.n > 0")
    return s.select("experiment", F.col("c.n").alias("n_control"), F.col("t.n").alias("n_treated"), F.round("c.mean", 3).alias("control"), F.round("t.mean", 3).alias("treated"), F.round(F.col("t.mean") - F.col("c.mean"), 3).alias("effect"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations), s AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS own FROM t GROUP BY 1)
SELECT conv_id, total, own, CASE WHEN total = 0 THEN NULL ELSE own * 100 // total END AS own_percent FROM s""")
def session_composition(spark, sf_dir):
    """The shares of J41: how much of each session falls to one lane."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("own"))
    return s.withColumn("own_percent", F.when(F.col("total") > 0, F.expr("own * 100 div total")))
