"""URL rules, compression, and the rules of nights, on hand-made cases."""

import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.functions.text import normalize_url
from daybook.plans import exposures, scalars

URLS = {
    "http://WWW.Example.com:8080/a/b/?utm_source=x&page=2#top": "https://example.com/a/b?page=2",
    "https://example.com": "https://example.com/",
    "https://example.com/?ref=1&ref_src=2": "https://example.com/?ref=1",
    "https://youtu.be/abc?t=5&si=1": "https://youtube.com/watch?t=5&si=1&v=abc",
    "https://youtu.be/": "https://youtu.be/",
    "https://example.com/a//": "https://example.com/a/",
    "https://example.com/?a": "https://example.com/?a=",
    "//example.com/x": "https://example.com/x",
    " ftp://example.com/x/ ": "ftp://example.com/x/",
    "no url": "no url",
    "": "",
}


def test_url_rules(spark):
    got = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", normalize_url(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in got} == URLS
    assert spark.createDataFrame([(None,)], "u string").select(normalize_url(F.col("u"))).first()[0] is None


def test_compression_and_top_lines(spark, tmp_path):
    texts = {1: "Again \nonce\nagain\nab\nAGAIN\nonce\nthird", 2: "alone", 3: "", 4: None}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}).to_parquet(tmp_path / "documents.parquet")
    got = {r["doc_id"]: r for r in scalars.text_compression(spark, str(tmp_path)).collect()}
    blob = b"again\nonce\nagain\nagain\nonce\nthird"
    assert set(got) == {1, 2} and got[1]["compression_ratio"] == round(len(zlib.compress(blob, 9)) / len(blob), 6)
    assert [(x["line"], x["n"]) for x in got[1]["top_lines"]] == [("again", 3), ("once", 2)] and got[2]["top_lines"] == []


def write_events(folder, rows):
    """Rows of (minute of 2024-01-02, user, type, value)."""
    start = pd.Timestamp("2024-01-02")
    frame = pd.DataFrame([{"event_id": i, "ts": start + pd.Timedelta(minutes=m), "user_id": u, "event_type": t, "value": float(v), "props": "{}"} for i, (m, u, t, v) in enumerate(rows)])
    frame.to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return start.value // 1000


@pytest.mark.parametrize("disputed, shift, basis, moved", [(60, -40, "asleep", -40), (90, -40, "awake", 0), (71, -40, "weighted", -12), (60, -200, "asleep_capped", -120), (60, -5, "agree", 0)])
def test_boundary_rules(spark, tmp_path, disputed, shift, basis, moved):
    """One recorder begins at 400, the other ``shift`` minutes off; both end at 900."""
    rows = [(400, 0, "view", 1), (900, 0, "view", 1), (400 + shift, 0, "click", 1), (900, 0, "click", 1)]
    rows += [(500 + i, 0, "error", 60) for i in range(6)] + [(399 - i * (abs(shift) - 2) / 6, 0, "purchase", disputed) for i in range(6)]
    zero = write_events(tmp_path, rows)
    r = exposures.boundary_estimates(spark, str(tmp_path)).first()
    assert (r["basis1"], r["basis2"]) == (basis, "agree")
    assert (r["start"] - zero) // 60_000_000 == 400 + moved and (r["end"] - zero) // 60_000_000 == 900


def test_evenings_gaps_and_sessions(spark, tmp_path):
    rows = [(1370, 1, "view", 30), (1385, 1, "view", 20), (1420, 1, "error", 1), (1430, 2, "error", 1)]
    zero = write_events(tmp_path, rows)
    got = {r["event_id"]: (r["active_s"], r["late_s"], r["gap_s"]) for r in exposures.evening_exposures(spark, str(tmp_path)).collect()}
    assert got == {2: (35 * 60, 25 * 60, 15 * 60), 3: (0, 0, None)}
    rows = [(0, 1, "view", 10), (30, 1, "view", 10), (100, 1, "view", 10), (60, 1, "error", 1), (900, 1, "view", 5)]
    zero = write_events(tmp_path, rows)
    got = sorted(((r["start"] - zero) // 60_000_000, (r["end"] - zero) // 60_000_000) for r in exposures.validated_intervals(spark, str(tmp_path)).collect())
    assert got == [(0, 40), (100, 110), (900, 905)]
    rows = [(0, 1, "view", 60), (10, 1, "click", 10), (45, 1, "click", 5), (5, 1, "purchase", 7), (55, 1, "purchase", 8), (56, 1, "purchase", 9)]
    zero = write_events(tmp_path, rows)
    got = [((r["start"] - zero) // 60_000_000, (r["end"] - zero) // 60_000_000, r["commits"], r["lines"]) for r in exposures.coding_sessions(spark, str(tmp_path)).collect()]
    assert got == [(10, 50, 2, 15)]
