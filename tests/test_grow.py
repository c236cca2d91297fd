"""The forest grown from histograms against Spark ML's, and what its jobs depend on."""

import uuid

import numpy as np
import pytest
from pyspark.ml import classification as ml
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailsignal.operators import grow
from mailsignal.operators import models as H


def made(spark, n=400, size=30, seed=3, dense=False):
    """Sparse rows with negative, absent and wide-ranging values; two classes, one weight each."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = sorted(rng.choice(size, rng.integers(1, 9), replace=False).tolist())
        values = rng.normal(0, 2, len(at)).round(2)
        x = np.zeros(size)
        x[at] = values
        y = int((x[0] + x[3] - x[5] + rng.normal(0, 0.7)) > 0.2)
        rows.append((i, y, 1.25 if y else 0.75, Vectors.dense(x) if dense and i % 3 else Vectors.sparse(size, at, values.tolist())))
    return spark.createDataFrame(rows, ["id", "label", "class_weight", "features"]).repartition(3).checkpoint()


def nodes(spark, model):
    return sorted(map(tuple, H.forest_nodes(model).select("tree", "node", "left", "right", "feature", F.round("threshold", 9), F.round("zero", 9), F.round("one", 9), "n",
                                                          F.round("weight", 6), F.round("gain", 9)).collect()))


@pytest.mark.parametrize("dense, parts", [(False, 3), (True, 3), (True, 1)])
def test_one_tree_on_all_features_is_spark_mls(spark, dense, parts):
    rows = made(spark, dense=dense).coalesce(parts)
    own = H.random_forest(num_trees=1, max_depth=6, min_instances=3).setFeatureSubsetStrategy("all").setBootstrap(False)
    theirs = own.copy()
    theirs.__class__ = ml.RandomForestClassifier
    a, b = own.fit(rows), theirs.fit(rows)
    assert nodes(spark, a) == nodes(spark, b) and a.totalNumNodes > 15
    assert a.getNumTrees == 1 and a.getMaxDepth() == 6 and a.numFeatures == 30 and a.numClasses == 2
    both = a.transform(rows).select("id", vector_to_array("rf_prob")[1].alias("p")).join(b.transform(rows).select("id", vector_to_array("rf_prob")[1].alias("q")), "id")
    assert both.where(F.abs(F.col("p") - F.col("q")) > 1e-9).isEmpty()


def test_jobs_depend_on_depth_not_on_nodes(spark):
    """A level of all trees is one job, whatever memory a node's statistics take; Spark ML needs one for every few nodes."""
    rows, group = made(spark, n=600), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "forest")
    try:
        model = H.random_forest(num_trees=30, max_depth=8).setMaxMemoryInMB(0).fit(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.totalNumNodes > 600
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 60


def test_draws_bags_and_small_jobs(spark, monkeypatch):
    """Draws are distinct, even and repeatable; jobs and groups of few nodes, and sorted counts, give the same forest."""
    got = grow.drawn(np.arange(4000), 40, 7, 42)
    assert all(len(set(r)) == 7 for r in got.tolist()) and (got == grow.drawn(np.arange(4000), 40, 7, 42)).all() and (got != grow.drawn(np.arange(4000), 40, 7, 43)).any()
    share = np.bincount(got.ravel(), minlength=40) / 4000
    assert abs(share - 7 / 40).max() < 0.03
    assert grow._bag(1.0).mean() == pytest.approx(1, abs=1e-3) and (grow._bag(1.0) == 0).mean() == pytest.approx(np.exp(-1), abs=1e-3)
    rows = made(spark)
    forest = H.random_forest(num_trees=6, max_depth=7)
    want = nodes(spark, forest.fit(rows))
    assert {r[0] for r in want} == set(range(6)) and len({str([x[1:] for x in want if x[0] == t]) for t in range(6)}) == 6
    for name, value in (("JOB_NODES", 5), ("SHARD_NODES", 2), ("DENSE_CELLS", 0), ("BUFFER", 50)):
        monkeypatch.setattr(grow, name, value)
    assert nodes(spark, forest.fit(rows)) == want


def test_rows_of_one_part_take_a_fixed_number_of_jobs(spark):
    rows, group = made(spark, n=600).coalesce(1).checkpoint(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "forest")
    try:
        model = H.random_forest(num_trees=30, max_depth=12).fit(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.totalNumNodes > 600 and len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 24


def test_what_histograms_do_not_cover_is_spark_mls(spark):
    rows = made(spark, n=120).withColumn("class_weight", F.rand(1) + 0.5)
    assert H.random_forest(num_trees=2, max_depth=3).fit(rows).totalNumNodes >= 2      # weights of its own for every row
    three = made(spark, n=120).withColumn("label", F.col("id") % 3)
    assert H.random_forest(num_trees=2, max_depth=3).fit(three).numClasses == 3
    assert H.random_forest(num_trees=2, max_depth=3).setImpurity("entropy").fit(made(spark, n=120)).getImpurity() == "entropy"
