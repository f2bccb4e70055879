"""Scans of exports: the given tables written in the formats of their kind and read back as their readers do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.plans.registry import registry
from daybook.sources.exports import export_path, read_csv, read_json, write_lines
from daybook.sources.shared import cut
from daybook.sources.snapshots import read_ndjson, replace_slice
from daybook.sources.tables import commits, events, sql, table

REGISTRY, query = registry()


@query("""WITH e AS (SELECT event_type AS name, count(*) FILTER (WHERE event_type <> 'signup') AS n FROM events GROUP BY 1 UNION ALL SELECT 'absent', NULL)
SELECT name, coalesce(n, 0) AS n_lines, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'ready' END AS status FROM e""")
def file_status(spark, sf_dir):
    """Lines that are not blank of each expected file: ready, empty or missing."""
    e = events(spark, sf_dir)
    lines = e.select("event_type", F.when(F.col("event_type") == "signup", F.lit("   ")).otherwise(F.col("event_id").cast("string")).alias("value"))
    path = write_lines(lines, "status", "event_type")
    found = spark.read.text(path).groupBy(F.col("event_type").alias("name")).agg(F.count_if(F.trim("value") != "").alias("n"))
    expected = e.select(F.col("event_type").alias("name")).distinct().unionByName(spark.createDataFrame([("absent",)], "name string"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").otherwise("ready")
    return expected.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_lines"), status.alias("status"))


@query("""WITH r AS (SELECT sha256('t' || (doc_id % 97)) AS title_hash, lang AS label, doc_id % 11 AS confidence, doc_id FROM documents) SELECT title_hash, label, CAST(confidence AS INTEGER) AS confidence FROM r
QUALIFY row_number() OVER (PARTITION BY title_hash ORDER BY confidence DESC, doc_id) = 1""")
def title_classifications(spark, sf_dir):
    """An NDJSON bulk load whose best row a title replaces the snapshot's slice."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.concat(F.lit("t"), (F.col("doc_id") % 97).cast("string")), 256).alias("title_hash"), F.col("lang").alias("label"), (F.col("doc_id") % 11).cast("int").alias("confidence"), "doc_id")
    path = write_lines(d.select(F.to_json(F.struct("*")).alias("value")), "titles")
    rows, _ = read_ndjson(spark, path, d.schema)
    best = Window.partitionBy("title_hash").orderBy(F.desc("confidence"), "doc_id")
    kept = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("title_hash", "label", "confidence")
    store = export_path(spark, "classified")
    replace_slice(kept, store, "r1")
    return spark.read.parquet(store).select("title_hash", "label", "confidence")


BINNED = ("error", "view", "click")  # stand for stress, variability and heart rate


@query(sql(f"""SELECT event_type AS kind, user_id, day, count(*) AS n_bins, round(min(value), 4) AS low, round(max(value), 4) AS high FROM ev WHERE event_type IN {BINNED} GROUP BY ALL""", "ev"))
def nested_bins(spark, sf_dir):
    """CSV rows whose column holds a JSON array of bins, exploded, for each of three kinds."""
    bins = F.to_json(F.collect_list(F.struct(F.col("at").alias("start_time"), F.col("value").alias("score")))).alias("binning")
    day = events(spark, sf_dir).where(F.col("event_type").isin(*BINNED)).groupBy(F.col("event_type").alias("kind"), "user_id", "day").agg(bins)
    path = export_path(spark, "bins")
    day.write.partitionBy("kind").options(header=True, quote='"', escape='"').csv(path)
    rows = read_csv(spark, path, "user_id long, day date, binning string, kind string")
    bin_ = F.explode(F.from_json("binning", "array<struct<start_time:long,score:double>>")).alias("b")
    return rows.select("kind", "user_id", "day", bin_).groupBy("kind", "user_id", "day").agg(F.count("*").alias("n_bins"), F.round(F.min("b.score"), 4).alias("low"), F.round(F.max("b.score"), 4).alias("high"))


#: Readers by kind: the fields of an NDJSON lane and the expression of its reading.
READINGS = {"click": ("id long, bpm double", "bpm"), "view": ("id long, steps double", "steps"), "purchase": ("id long, weight struct<kg:double>", "weight.kg"), "signup": ("id long, spo2 array<double>", "spo2[0]"), "error": ("id long, mood string", "CAST(mood AS DOUBLE)")}


@query(sql("""SELECT event_type AS kind, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total, count(*) FILTER (WHERE event_id % 100 = 7) AS n_malformed FROM ev GROUP BY 1""", "ev"))
def typed_readings(spark, sf_dir):
    """C11: one table-driven reader of typed NDJSON lanes of five shapes; lines that are no JSON are counted apart."""
    e = events(spark, sf_dir)
    shapes = {"click": F.struct(F.col("event_id").alias("id"), F.col("value").alias("bpm")), "view": F.struct(F.col("event_id").alias("id"), F.col("value").alias("steps")), "purchase": F.struct(F.col("event_id").alias("id"), F.struct(F.col("value").alias("kg")).alias("weight")),
        "signup": F.struct(F.col("event_id").alias("id"), F.array("value").alias("spo2")), "error": F.struct(F.col("event_id").alias("id"), F.col("value").cast("string").alias("mood"))}
    out = None
    for kind, (schema, reading) in READINGS.items():
        own = e.where(F.col("event_type") == kind)
        lines = own.select(F.to_json(shapes[kind]).alias("value")).unionByName(own.where("event_id % 100 = 7").select(F.concat(F.lit('{"id": '), "event_id").alias("value")))
        rows, bad = read_json(spark, write_lines(lines, kind), schema)
        both = rows.select(F.expr(reading).alias("v"), F.lit(0).alias("bad")).unionByName(bad.select(F.lit(None).cast("double").alias("v"), F.lit(1).alias("bad")))
        got = both.agg(F.count_if(F.col("bad") == 0).alias("n"), F.sum(F.floor("v")).alias("total"), F.sum("bad").cast("long").alias("n_malformed")).select(F.lit(kind).alias("kind"), "*")
        out = got if out is None else out.unionByName(got)
    return out.where("n > 0")


@query(sql("""SELECT day, event_type AS kind, count(*) AS n, min("at") AS first_at FROM ev WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' AND event_type IN ('view', 'error') GROUP BY ALL""", "ev"))
def dated_envelopes(spark, sf_dir):
    """Envelope files named by their date, pruned by it, filtered by kind, oldest first."""
    e = events(spark, sf_dir).select("day", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("at").alias("ts"), F.struct("value").alias("payload"))).alias("value"))
    rows, _ = read_json(spark, write_lines(e, "lane", "day"), "kind string, ts long, payload struct<value:double>")
    return rows.where("day BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' AND kind IN ('view', 'error')").groupBy("day", "kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_at")).orderBy("day", "kind")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'takeout' WHEN page_id % 3 = 1 THEN 'extension' ELSE 'store' END AS source, url, CAST(page_id * 1000 AS BIGINT) AS visited_ms FROM pages""")
def history_visits(spark, sf_dir):
    """History exports of three shapes (NDJSON, JSON array, CSV) brought into one visit shape with its source."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    part = lambda k: p.where(f"page_id % 3 = {k}")
    first, _ = read_json(spark, write_lines(part(0).select(F.to_json(F.struct("page_id", F.col("url").alias("titleUrl"), (F.col("page_id") * 1000).alias("time_ms"))).alias("value")), "takeout"), "page_id long, titleUrl string, time_ms long")
    path = export_path(spark, "extension")
    arrays = part(1).groupBy((F.col("page_id") % 7).alias("file")).agg(F.collect_list(F.struct("page_id", "url", F.col("page_id").alias("visit_s"))).alias("v"))
    arrays.select(F.to_json("v").alias("value")).write.text(path)
    second = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<page_id:long,url:string,visit_s:long>>")).alias("v")).select("v.*")
    path = export_path(spark, "store")
    part(2).select("page_id", F.col("url").alias("link"), (F.col("page_id") * 1_000_000).alias("visit_us")).write.options(header=True, quote='"', escape='"').csv(path)
    third = read_csv(spark, path, "page_id long, link string, visit_us long")
    shapes = [(first, "takeout"), (second, "extension"), (third, "store")]
    union = None
    for rows, name in shapes:
        rows = rows.withColumn("source", F.lit(name))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    return union.select("page_id", "source", F.coalesce("titleUrl", "url", "link").alias("url"), F.coalesce(F.col("time_ms"), F.col("visit_s") * 1000, F.expr("visit_us div 1000")).alias("visited_ms"))


@query(sql("""WITH b AS (SELECT min(day) AS lo, max(day) AS hi FROM commits), s AS (SELECT CAST(unnest(generate_series(lo - 30, hi + 30, INTERVAL 1 DAY)) AS DATE) AS day FROM b), c AS (SELECT DISTINCT day FROM commits)
SELECT CASE WHEN s.day < lo THEN 'before' WHEN s.day > hi THEN 'after' ELSE 'inside' END AS part, count(*) AS n_days, count(c.day) AS n_covered, min(s.day) FILTER (WHERE c.day IS NULL) AS first_gap FROM s LEFT JOIN c USING (day), b GROUP BY 1""", "commits"))
def baseline_commits(spark, sf_dir):
    """Baseline commits from NDJSON and the days of an asked window, thirty days wider, that they don't cover."""
    c = commits(spark, sf_dir).select(F.to_json(F.struct("sha", "project", F.col("day").cast("string").alias("day"))).alias("value"))
    rows, _ = read_json(spark, write_lines(c, "commits"), "sha long, project string, day date")
    days = cut(rows.groupBy("day").agg(F.count("*").alias("n")))  # a row a day
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    window = bounds.where("lo IS NOT NULL").withColumn("day", F.explode(F.sequence(F.date_sub("lo", 30), F.date_add("hi", 30))))
    part = F.when(F.col("day") < F.col("lo"), "before").when(F.col("day") > F.col("hi"), "after").otherwise("inside").alias("part")
    return window.join(days, "day", "left").groupBy(part).agg(F.count("*").alias("n_days"), F.count("n").alias("n_covered"), F.min(F.when(F.col("n").isNull(), F.col("day"))).alias("first_gap"))


@query("""SELECT CAST(ts - INTERVAL 6 HOURS AS DATE) AS logical_day, count(*) AS n, CAST(sum(floor(value * 1000)) AS BIGINT) AS ms_played FROM events WHERE event_type = 'view' AND CAST(ts - INTERVAL 6 HOURS AS DATE) >= DATE '2024-01-05' AND CAST(ts - INTERVAL 6 HOURS AS DATE) < DATE '2024-01-25' GROUP BY 1""")
def stream_rows(spark, sf_dir):
    """C20: exports of one JSON array a file, exploded, within half-open bounds of logical days."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    row = F.struct(F.timestamp_micros(F.col("at")).cast("string").alias("endTime"), F.floor(F.col("value") * 1000).alias("msPlayed"))
    path = write_lines(e.groupBy("user_id").agg(F.to_json(F.collect_list(row)).alias("value")).select("value"), "streams")
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<endTime:timestamp,msPlayed:long>>")).alias("r")).select("r.*")
    day = F.to_date(F.col("endTime") - F.expr("INTERVAL 6 HOURS"))
    rows = rows.withColumn("logical_day", day).where("logical_day >= DATE '2024-01-05' AND logical_day < DATE '2024-01-25'")
    return rows.groupBy("logical_day").agg(F.count("*").alias("n"), F.sum("msPlayed").alias("ms_played"))


@query("""SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(conv_id) AS first_conv FROM conversations WHERE text IS NOT NULL AND text <> '' AND conv_id BETWEEN 10 AND 200 GROUP BY role""")
def comment_rows(spark, sf_dir):
    """Comments from CSV with a header, quoted texts over several lines, within bounds."""
    path = export_path(spark, "comments")
    table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''").select("conv_id", "role", F.base64(F.encode("text", "UTF-8")).alias("raw"), F.regexp_replace("text", "[\\r\\n]+", "\n").alias("body")).write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    rows = read_csv(spark, path, "conv_id long, role string, raw string, body string")
    return rows.where("conv_id BETWEEN 10 AND 200").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.char_length(F.decode(F.unbase64("raw"), "UTF-8"))).alias("chars"), F.min("conv_id").alias("first_conv"))


@query("""SELECT page_id, url, CAST(page_id % 5 AS INTEGER) AS folder FROM pages WHERE page_id % 5 <> 4 AND page_id >= 20""")
def bookmark_rows(spark, sf_dir):
    """Bookmarks from CSV within bounds; records whose fields don't fit the types are left apart."""
    path = export_path(spark, "bookmarks")
    p = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 5 == 4, F.concat(F.lit("no."), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string")).alias("id"), "url", (F.col("page_id") % 5).alias("folder"))
    p.write.options(header=True, quote='"', escape='"').csv(path)
    rows = read_csv(spark, path, "id long, url string, folder int")
    return rows.where("id >= 20").select(F.col("id").alias("page_id"), "url", "folder")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount FROM lineitem) SELECT l_returnflag AS claim_type, count(*) AS n, count(DISTINCT l_orderkey) AS n_artifacts, round(max(l_discount), 4) AS top_score FROM c GROUP BY 1""")
def artifact_claims(spark, sf_dir):
    """Claim rows out of JSON artifacts with an array of claims each."""
    claim = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("score"))
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(claim).alias("claims")).select(F.to_json(F.struct(F.col("l_orderkey").alias("artifact"), "claims")).alias("value"))
    rows, _ = read_json(spark, write_lines(a, "claims"), "artifact long, claims array<struct<n:int,type:string,score:double>>")
    c = rows.select("artifact", F.explode("claims").alias("c"))
    return c.groupBy(F.col("c.type").alias("claim_type")).agg(F.count("*").alias("n"), F.countDistinct("artifact").alias("n_artifacts"), F.round(F.max("c.score"), 4).alias("top_score"))


@query(sql("""SELECT event_type AS product, day, count(*) AS n, max("at") AS last_at FROM ev WHERE event_type IN ('purchase', 'signup') AND "at" >= epoch_us(TIMESTAMP '2024-01-10') AND "at" < epoch_us(TIMESTAMP '2024-01-20') GROUP BY ALL""", "ev"))
def product_events(spark, sf_dir):
    """Typed rows of chosen products within half-open bounds, from a lake partitioned by product and day: folders and row groups are pruned."""
    path = export_path(spark, "products")
    events(spark, sf_dir).withColumn("product", F.col("event_type")).select("event_id", "at", "value", "product", "day").repartition("product", "day").write.partitionBy("product", "day").parquet(path)
    lo, hi = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("2024-01-10", "2024-01-20"))
    kept = spark.read.parquet(path).where(F.col("product").isin("purchase", "signup") & F.col("day").between("2024-01-10", "2024-01-19") & (F.col("at") >= lo) & (F.col("at") < hi))
    return kept.groupBy("product", "day").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


@query(sql("""WITH l AS (SELECT event_type AS source, day AS date, unnest(['n', 'total']) AS metric, unnest([CAST(count(*) AS DOUBLE), round(sum(value), 3)]) AS value FROM ev GROUP BY event_type, day) SELECT source, date, metric, value FROM l WHERE source <> 'error' AND date >= DATE '2024-01-15'""", "ev"))
def personal_signals(spark, sf_dir):
    """C17: the long scan of daily signals: source, date, metric, value, with a dimension map in JSON."""
    d = events(spark, sf_dir).groupBy(F.col("event_type").alias("source"), F.col("day").alias("date")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    long = d.select("source", "date", F.explode(F.create_map(F.lit("n"), "n", F.lit("total"), "total")).alias("metric", "value"), F.to_json(F.create_map(F.lit("unit"), F.lit("day"))).alias("dimensions"))
    path = export_path(spark, "signals")
    long.write.partitionBy("source").parquet(path)
    return spark.read.parquet(path).where("source <> 'error' AND date >= DATE '2024-01-15' AND from_json(dimensions, 'map<string,string>')['unit'] = 'day'").select("source", "date", "metric", "value")


@query("""SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS idx FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '1', '2') OR o_orderstatus = 'P'""")
def issue_rows(spark, sf_dir):
    """Issues of chosen states and projects, numbered in order within each project."""
    o = table(spark, sf_dir, "orders").where(F.expr("o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '1', '2') OR o_orderstatus = 'P'"))
    idx = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"), idx.alias("idx"))


@query("""SELECT 'nodes' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'edges', count(*), CAST(sum(l_partkey) AS BIGINT) FROM lineitem WHERE l_returnflag <> 'N'""")
def promoted_graph(spark, sf_dir):
    """Nodes, edges and their build promoted as slices of a snapshot by one generic writer; a second promotion replaces the first."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    out = None
    for kind, first, whole in (("nodes", n.where("id < 100"), n), ("edges", e.where("l_returnflag = 'N'"), e.where("l_returnflag <> 'N'"))):
        path = export_path(spark, kind)
        replace_slice(first, path, "r1")
        replace_slice(whole, path, "r1")
        got = spark.read.parquet(path).where("refresh_id = 'r1'").agg(F.count("*").alias("n"), F.sum("id").alias("keys")).select(F.lit(kind).alias("kind"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query(sql("""SELECT day, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value) FILTER (WHERE event_type = 'purchase'), 3) AS spent FROM ev GROUP BY day""", "ev"))
def promoted_days(spark, sf_dir):
    """The wide daily matrix promoted as a slice and read back; what a day lacks stays null, not zero."""
    d = events(spark, sf_dir).groupBy("day").pivot("event_type", ["click", "view", "error", "purchase"]).agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    wide = d.select("day", *[F.coalesce(f"{k}_n", F.lit(0)).alias(n) for k, n in (("click", "clicks"), ("view", "views"), ("error", "errors"))], F.col("purchase_total").alias("spent"))
    path = export_path(spark, "days")
    replace_slice(wide, path, "r2")
    return spark.read.parquet(path).where("refresh_id = 'r2'").select("day", "clicks", "views", "errors", "spent")
