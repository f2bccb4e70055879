"""Filters, dates and text expressions applied to whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.functions.text import TRACKING, commit_refs, compression_ratio, conventional_subject, degrade_confidence, logical_date, normalize_url
from daybook.plans.registry import registry
from daybook.sources.tables import sql, table

REGISTRY, query = registry()


def query_spec(df: DataFrame, spec: dict) -> DataFrame:
    """Select, equality where, inclusive time range, order_by, limit (1 to 10,000); names are checked."""
    named = [*spec.get("select", []), *spec.get("where", {}), *[c.lstrip("-") for c in spec.get("order_by", [])], *([spec["time"][0]] if spec.get("time") else [])]
    unknown = [c for c in named if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    tests = [F.col(k) == v for k, v in spec.get("where", {}).items()]
    if spec.get("time"):
        column, first, last = spec["time"]
        tests.append(F.to_date(column).between(first, last))
    if tests:
        df = df.where(reduce(lambda a, b: a & b, tests))
    if spec.get("order_by"):
        df = df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in spec["order_by"]])
    return df.select(*spec.get("select") or df.columns).limit(max(1, min(10_000, spec.get("limit", 1000))))


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def query_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01-P07, P15, P17."""
    spec = {"select": ["o_orderkey", "o_totalprice", "o_orderpriority"], "where": {"o_orderstatus": "F"}, "time": ("o_orderdate", "1994-01-01", "1995-12-31"), "order_by": ["-o_totalprice", "o_orderkey"], "limit": 200}
    return query_spec(table(spark, sf_dir, "orders"), spec)


@query("""SELECT doc_id, lang, source FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND lang IN ('en', 'de')""")
def text_search(spark, sf_dir):
    """Substring search over several columns with an IN list."""
    d = table(spark, sf_dir, "documents")
    hit = F.lower("text").contains("license") | F.lower("source").contains("license")
    return d.where(hit & F.col("lang").isin("en", "de")).select("doc_id", "lang", "source")


@query("""SELECT CAST(ts - INTERVAL 6 HOURS AS DATE) AS logical_day, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1""")
def logical_days(spark, sf_dir):
    """Days that begin at 06:00."""
    return table(spark, sf_dir, "events").groupBy(logical_date(F.col("ts")).alias("logical_day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY ALL""")
def month_quarter_keys(spark, sf_dir):
    """Month and quarter keys."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


#: The rule by its cases: hosts of the pages keep no parameter of their own, so short video links and kept parameters are held by the tests.
@query("""WITH p AS (SELECT page_id, trim(url) AS url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^(https?:)?//([^/?#]*)', 2)), '^www\\.', ''), ':.*', '') AS host,
regexp_extract(url, '^(https?:)?//[^/?#]*([^?#]*)', 2) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(""" + "|".join(TRACKING) + """)')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS kept FROM p)
SELECT page_id, CASE WHEN host <> '' THEN 'https://' || host || CASE WHEN path IN ('', '/') THEN '/' WHEN suffix(path, '/') THEN path[:-2] ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE url END AS url FROM k""")
def normalized_urls(spark, sf_dir):
    """canonical URLs of all pages."""
    return table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("""WITH s AS (SELECT p_partkey, lower(split_part(p_type, ' ', 1)) || '(' || p_brand || '): ' || p_name || ' (#' || p_size || ') fixes #' || p_partkey AS subject FROM part)
SELECT p_partkey, nullif(regexp_extract(subject, '^([a-z]+)(?:\\(([^)]*)\\))?(!)?: (.*)$', 1), '') AS kind, nullif(regexp_extract(subject, '^([a-z]+)(?:\\(([^)]*)\\))?(!)?: (.*)$', 2), '') AS scope,
CAST(regexp_extract(subject, '\\(#(\\d+)\\)', 1) AS INTEGER) AS pr, CAST(regexp_extract(subject, 'fixes #(\\d+)', 1) AS INTEGER) AS issue FROM s""")
def commit_subjects(spark, sf_dir):
    """Conventional subject and references, of subjects made from the part table's columns."""
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("("), "p_brand", F.lit("): "), "p_name", F.lit(" (#"), "p_size", F.lit(") fixes #"), "p_partkey").alias("subject"))
    s = s.withColumn("c", conventional_subject(F.col("subject"))).withColumn("r", commit_refs(F.col("subject")))
    return s.select("p_partkey", "c.kind", "c.scope", F.get("r.prs", 0).alias("pr"), F.get("r.issues", 0).alias("issue"))


@query("""SELECT l_orderkey, round(CASE WHEN max(l_discount) = 0 THEN 0 ELSE greatest(0.02, max(l_discount) * coalesce(list_product(list_distinct(list(CASE l_returnflag WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.8 ELSE 1.0 END))), 1)) END, 6) AS confidence
FROM lineitem GROUP BY l_orderkey""")
def degraded_confidence(spark, sf_dir):
    """Confidence times a factor for each distinct caveat, with a floor."""
    factor = F.when(F.col("l_returnflag") == "R", 0.5).when(F.col("l_returnflag") == "A", 0.8).otherwise(1.0)
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("base"), F.array_sort(F.collect_set(factor)).alias("f"))
    return g.select("l_orderkey", F.round(degrade_confidence(F.col("base"), F.col("f"), 0.02), 6).alias("confidence"))


@query("""WITH l AS (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 3 GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_unique, round(1 - count(*) * 1.0 / sum(n), 4) AS duplicate_share FROM c GROUP BY doc_id""")
def repetition_metrics(spark, sf_dir):
    """F32, the shares of F33: repeated normalised lines of a text."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("line")).where(F.char_length("line") >= 3)
    c = l.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_unique"), F.round(1 - F.count("*") / F.sum("n"), 4).alias("duplicate_share"))


@query()
def text_compression(spark, sf_dir):
    """The rest of F33: compression ratio of a text's normalised lines, and its eight most repeated lines; held to zlib in the tests."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "at", F.lower(F.trim("line")).alias("line")).where(F.char_length("line") >= 3)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])  # the lines of one text
    ratios = l.groupBy("doc_id").agg(F.concat_ws("\n", lines).alias("blob")).select("doc_id", compression_ratio(F.col("blob")).alias("compression_ratio"))
    c = l.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n > 1")
    ranked = c.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at"))).where("_n <= 8")
    top = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "n", "line"))), lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"))).alias("top_lines"))
    return ratios.join(top, "doc_id", "left").select("doc_id", F.round("compression_ratio", 6).alias("compression_ratio"), F.coalesce("top_lines", F.expr("CAST(array() AS array<struct<line:string,n:bigint>>)")).alias("top_lines"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'error' AND value > 50 THEN 'incident'
WHEN event_type = 'error' THEN 'noise' ELSE 'commerce' END AS mode FROM events""")
def rule_cascade(spark, sf_dir):
    """ordered rules, first match wins; a tolerant JSON number."""
    t = F.col("event_type")
    rules = [(t.isin("click", "view"), "browse"), ((t == "error") & (F.col("value") > 50), "incident"), (t == "error", "noise")]
    mode = reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit("commerce"))
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS int)").alias("k"), mode.alias("mode"))


@query(sql("""WITH h AS (SELECT event_id, start, "end", unnest(range(start // 3600000000, (greatest("end", start + 1) - 1) // 3600000000 + 1)) AS hour FROM spans)
SELECT hour, count(*) AS n, CAST(sum(least("end", (hour + 1) * 3600000000) - greatest(start, hour * 3600000000)) // 1000000 AS BIGINT) AS seconds FROM h GROUP BY hour""", "spans"))
def split_by_hour(spark, sf_dir):
    """Spans clipped to the hours that they touch."""
    from daybook.sources.tables import spans

    hour = 3_600_000_000
    last = F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / hour)
    h = spans(spark, sf_dir).withColumn("hour", F.explode(F.sequence(F.floor(F.col("start") / hour), last)))
    clipped = F.least("end", (F.col("hour") + 1) * hour) - F.greatest("start", F.col("hour") * hour)
    return h.groupBy("hour").agg(F.count("*").alias("n"), F.floor(F.sum(clipped) / 1_000_000).alias("seconds"))
