"""Stages of the pipeline on the small tables, each against a plain version of its decision."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from daybook.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf):
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        out[name] = (docs, materialise(stage(spark, docs, sf), name))
        docs = out[name][1]
    return out


def test_stages_keep_columns_and_only_drop(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= before.count()


def test_near_copies_leave_one(stages):
    from tests.llm.test_operators import plain_components, plain_simhash

    before, after = stages["simhash_near_dedup"]
    rows = [(r["doc_id"], plain_simhash(r["text"])) for r in before.collect()]
    groups, least = plain_components({f for _, f in rows}), {}
    for k, f in rows:
        least[groups[f]] = min(k, least.get(groups[f], k))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(least.values())


def test_run_packs_all_that_is_left(spark, sf, stages):
    docs, packed = stages["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert cp.run(spark, sf).count() == packed.count()


def test_null_texts_pass(spark, sf):
    docs = spark.createDataFrame([(900, None, "en"), (901, "", "en"), (902, "", None)], "doc_id long, text string, lang string")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() <= 3, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name


def test_columns_with_clashing_names_pass_untouched(spark, sf):
    names = ["_label", "_score", "_score_", "n_lines", "n_dropped", "_n_lines", "_text", "_hash", "_first", "fp", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{i}-"), F.col("doc_id")))
    docs = materialise(docs, "clash")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{i}-{r['doc_id']}" for r in rows for i, n in enumerate(names)), name
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= 60
