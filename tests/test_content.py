"""Content neighbours without copies of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import layers, tfidf


@pytest.mark.parametrize("heavy", [0.0, 0.04, 2.0])
def test_neighbours_move_no_rows(spark, monkeypatch, heavy):
    for name, value in (("BLOCK_ROWS", 16), ("STRIP_ROWS", 20), ("SEARCHING", 8), ("HEAVY", heavy)):
        monkeypatch.setattr(layers, name, value, raising=False)
    rng = np.random.default_rng(3)
    a = (rng.random((150, 40)) < 0.1) * np.round(rng.random((150, 40)), 2)
    a[20:60] = a[19]  # more equal rows than neighbours
    a[7] = rng.random(40)  # a row with all terms
    a[8] = 0
    a[9], a[10:13, 5] = np.eye(40)[5], -0.5
    rows = [(f"{i:03d}", [int(j) for j in np.flatnonzero(r)][::-1], [float(z) for z in r[r != 0]][::-1]) for i, r in enumerate(a)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(150)], "id string, idx array<int>, val array<double>").repartition(5)
    found = layers.sparse_neighbours(df, 4, 40)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.u, r.v): round(r.w, 9) for r in found.collect()}
    s = np.round(a @ a.T, 9)
    np.fill_diagonal(s, 0)
    assert got == {(f"{i:03d}", f"{j:03d}"): s[i, j] for i in range(150) for j in np.argsort(-s[i], kind="stable")[:4] if s[i, j] > 0}


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([("a", [], [])], "id string, idx array<int>, val array<double>")
    assert layers.sparse_neighbours(df, 4, 40).count() == layers.sparse_neighbours(df.limit(0), 4, 0).count() == 0


def test_tokens_made_normal_once(spark):
    df = spark.createDataFrame([("a", "cats cat"), ("b", "dogs cats"), ("a", "of cat")], "doc string, text string")
    counts = tfidf.raw_counts(df, "doc", "text", lambda t: F.regexp_replace(t, "s$", ""), lambda t: t != "of")
    assert "regexp_replace" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc, r.term): r.tf for r in counts.collect()} == {("a", "cat"): 3, ("b", "cat"): 1, ("b", "dog"): 1}


def test_tables_leave_no_shuffle_files(spark):
    from threadloom.runtime import CLEANUP, Stage

    stage, before = Stage(spark, "shuffles"), spark.conf.get(CLEANUP, None)
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark._jvm.System.gc()
    was = held()
    assert stage.put(spark.range(1000).repartition(7, "id").groupBy("id").count()).count() == 1000
    assert held() <= was + 1 and spark.conf.get(CLEANUP, None) == before  # the last count's own
    stage.clear()
