"""Column expressions for URLs, commit subjects, titles and caveats."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Prefixes of query parameters that only track, and parameters that a host keeps all the same.
TRACKING = ["utm_", "fbclid", "gclid", "igshid", "yclid", "dclid", "ref_", "spm", "sc_", "mc_", "mkt_", "pk_campaign", "pk_kwd", "ga_", "gs_", "ved", "ei", "sa", "rlz", "dpr", "biw", "bih"]
KEPT = {"youtube.com": ["v", "list", "t"], "youtu.be": ["v", "t"], "github.com": ["ref", "sha"], "reddit.com": ["sort", "type", "t"], "twitter.com": ["s", "q"]}


def normalize_url(url: Column) -> Column:
    """https, lower-case host without www. and port, no trailing slash but a root page's, no fragment, no tracking parameters but those that
    the host keeps; a short video link becomes the long one. What has no host, or another scheme, stays. Parameters stay as they were written.
    """
    url = F.trim(url)
    form = r"^(?:[hH][tT][tT][pP][sS]?:)?//([^/?#]+)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, form, 1)), r"^www\.", ""), ":.*$", "")
    path = F.regexp_replace(F.regexp_extract(url, form, 2), r"(.)/$", "$1")
    path = F.when(path == "", "/").otherwise(path)
    own = F.coalesce(*[F.when(host == h, F.array(*map(F.lit, names))) for h, names in KEPT.items()], F.array().cast("array<string>"))
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    query = F.filter(F.split(F.regexp_extract(url, form, 3), "&"), lambda p: (p != "") & (F.array_contains(own, name(p)) | ~p.rlike("^(" + "|".join(TRACKING) + ")")))
    query = F.transform(query, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    clip = F.regexp_replace(path, "^/+", "")
    short = (host == "youtu.be") & (clip != "")
    named = F.when(F.exists(query, lambda p: name(p) == "v"), query).otherwise(F.concat(query, F.array(F.concat(F.lit("v="), clip))))
    host, path, query = F.when(short, "youtube.com").otherwise(host), F.when(short, "/watch").otherwise(path), F.when(short, named).otherwise(query)
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit(""))
    return F.when(url.rlike(form), F.concat(F.lit("https://"), host, path, tail)).otherwise(url)


def conventional_subject(subject: Column) -> Column:
    """kind(scope)!: description as a struct; nulls where the form isn't met."""
    form = r"^([a-z]+)(?:\(([^)]*)\))?(!)?: (.*)$"
    part = lambda i: F.nullif(F.regexp_extract(subject, form, i), F.lit(""))
    return F.struct(part(1).alias("kind"), part(2).alias("scope"), part(3).isNotNull().alias("breaking"), part(4).alias("description"))


def commit_refs(text: Column) -> Column:
    """Pull requests ``(#N)`` and issues that the text closes or fixes."""
    number = lambda form: F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(number(r"\(#(\d+)\)").alias("prs"), number(r"(?i)\b(?:closes|fixes) #(\d+)").alias("issues"))


def degrade_confidence(base: Column, factors: Column, floor: float) -> Column:
    """Base times each distinct factor, not under the floor; zero stays zero."""
    cut = F.aggregate(F.array_distinct(factors), base, lambda a, x: a * x)
    return F.when(base == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(floor), cut))


def logical_date(at: Column) -> Column:
    """The day that began at 06:00 wall clock."""
    return F.to_date(at - F.expr("INTERVAL 6 HOURS"))


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """Bytes of the text under zlib at level 9 over its own bytes; no built-in function compresses."""
    raw = texts.map(lambda t: t.encode("utf-8"))
    return raw.map(lambda b: len(zlib.compress(b, 9)) / max(len(b), 1)).astype(float)
