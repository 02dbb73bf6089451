"""What jobs leave on disk: shuffle files go with the job that made them, relations are small and go when replaced."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np

import corpus_pipeline
import panelcast.llm.collocations as co
from panelcast.llm.tables import BATCH_LIMIT, SHUFFLE_CLEANUP


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def left(spark, before, seconds=20):
    """Shuffle files that are new and stay; Spark deletes in the background."""
    end = time.time() + seconds
    while (new := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return new


def test_pipeline_stages_keep_no_shuffle_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.unset(SHUFFLE_CLEANUP)
    before = shuffle_files(spark)
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001")
        assert not left(spark, before)
        rows = {r.doc_id for r in kept.select("doc_id").collect()}
        assert rows and rows < {r.doc_id for r in docs.select("doc_id").collect()}
        assert not left(spark, before)
    finally:
        spark.conf.unset(BATCH_LIMIT)
        spark.conf.unset(SHUFFLE_CLEANUP)


def test_relations_are_small_and_go_when_replaced(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spark.conf.unset(SHUFFLE_CLEANUP)
    steps, size, written, deleted = [], {}, co.written, co.deleted

    def noted(df, path, *options):
        out, name = written(df, path, *options), path.rsplit("/", 1)[1]
        steps.append(name)
        size[name] = sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(co, "written", noted)
    monkeypatch.setattr(co, "deleted", lambda session, path: steps.append("no " + path.rsplit("/", 1)[1]) or deleted(session, path))
    before = shuffle_files(spark)
    found = co.collocations(docs)
    assert not left(spark, before) and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    words = {r.lang: r.n for r in found.select("lang", "n").distinct().collect()}
    assert size["r1"] < 3 * sum(words.values())
    assert steps.index("no r1") < steps.index("l2")


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 2**31 - 1, 255, 256], range(70_000)):
        assert co._numbers(co._packed(np.array(list(values), np.int64))).tolist() == list(values)
