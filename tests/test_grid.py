"""The tuning grids: whole by default, small ones only from tests; forest parts against Spark ML."""

import inspect
from math import prod

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailsignal.operators import forest
from mailsignal.operators import models as H


def test_default_grids_are_whole():
    at = inspect.signature(H.grid_search).parameters
    grown, svm = at["forest_grid"].default, at["svm_grid"].default
    assert prod(len(v) for v in grown.values()) == 162 and at["k"].default == 3
    assert set(svm["kernel"]) == {"rbf", "linear"} and len(svm["c"]) * (len(svm["gamma"]) + 1) == 15
    used = inspect.signature(H.random_forest).parameters       # the setting train() uses is one of the grid's
    for name in ("num_trees", "max_depth", "min_instances"):
        assert used[name].default in grown[name]
    wide = H.WIDE_SVM_GRID
    assert prod(len(v) for v in H.WIDE_FOREST_GRID.values()) == 243 and prod(len(v) for v in wide.values()) == 72 and H.WIDE_FOLDS == 5


@pytest.fixture(scope="module")
def trained(spark):
    words = ["urgent prize winner claim account", "meeting agenda notes project lunch"]
    rng = np.random.default_rng(4)
    data = []
    for i in range(300):
        y = i % 2
        picks = rng.choice(words[y if rng.random() < 0.8 else 1 - y].split(), 4)
        data.append((i, f"{' '.join(picks)} item{rng.integers(9)} x{rng.integers(40)}", 1 - y))
    mails = spark.createDataFrame(data, "email_id long, raw_text string, label int")
    return H.train(mails, num_trees=12, max_depth=8)


def test_node_scorer_equals_spark_ml(spark, trained, monkeypatch):
    t, size = trained, trained.n_features + 8
    nodes = H.forest_nodes(t.forest.stages[-1])
    want = {r.email_id: (r.a, r.b, r.y) for r in t.forest.transform(t.every).select(
        "email_id", vector_to_array("rf_raw")[0].alias("a"), vector_to_array("rf_raw")[1].alias("b"), F.col("rf_pred").alias("y")).collect()}
    rows = H.stored_vectors(t.every, "email_id", "features")
    for limit in (forest.GROUP_BYTES, 1):      # one group, one tree a group
        monkeypatch.setattr(forest, "GROUP_BYTES", limit)
        got = {r.id: (r.zero[0], r.one[0]) for r in forest.votes(rows, nodes, size, [forest.Setting()]).collect()}
        assert got.keys() == want.keys()
        for i, (a, b, y) in want.items():
            assert got[i] == pytest.approx((a, b), abs=1e-12) and (got[i][1] > got[i][0]) == (y == 1)


def test_a_part_is_the_forest_cut(spark, trained):
    """Depth 0 leaves the root's majority; the first trees are those of Spark's model; a brute-force walk agrees on every cut."""
    t, size = trained, trained.n_features + 8
    model = t.forest.stages[-1]
    nodes = H.forest_nodes(model)
    settings = [forest.Setting(5, None, 2), forest.Setting(12, 2, 2), forest.Setting(7, 4, 30), forest.Setting(12, 0, 2)]
    got = {r.id: (r.zero, r.one) for r in forest.votes(H.stored_vectors(t.every, "email_id", "features"), nodes, size, settings).collect()}
    table = {}
    for r in nodes.collect():
        table.setdefault(r.tree, {})[r.node] = r

    def stop(tree, x, s):
        def leaf(i, depth):
            r = tree[i]
            if r.left < 0 or depth >= (99 if s.depth is None else s.depth) or r.n < s.min_split:
                return True
            both = leaf(r.left, depth + 1) and leaf(r.right, depth + 1)
            return both and (tree[r.left].one > tree[r.left].zero) == (tree[r.right].one > tree[r.right].zero)
        i, depth = 0, 0
        while not leaf(i, depth):
            i, depth = (tree[i].left if x[tree[i].feature] <= tree[i].threshold else tree[i].right), depth + 1
        return tree[i]

    for r in t.every.select("email_id", vector_to_array("features").alias("x")).limit(25).collect():
        for k, s in enumerate(settings):
            ends = [stop(table[m], r.x, s) for m in range(s.trees)]
            assert got[r.email_id][0][k] == pytest.approx(sum(e.zero for e in ends)) and got[r.email_id][1][k] == pytest.approx(sum(e.one for e in ends))


def test_cut_forests_score_like_direct_fits(spark, trained):
    t, size = trained, trained.n_features + 8
    train, test = t.train, t.test
    rows = H.stored_vectors(test, "email_id", "features")
    label = test.select(F.col("email_id").alias("id"), "label")
    big = H.random_forest(num_trees=40, max_depth=20, min_instances=1).fit(train)
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="rf_pred", metricName="fMeasureByLabel", metricLabel=1.0)
    cut = forest.f1_by_setting(forest.votes(rows, H.forest_nodes(big), size, [forest.Setting(20, 4, 2)]), label, [forest.Setting()]).first().f1
    direct = [ev.evaluate(H.random_forest(num_trees=20, max_depth=4, min_instances=1, seed=s).fit(train).transform(test)) for s in (1, 2, 3)]
    assert abs(cut - np.mean(direct)) <= 0.1 + np.ptp(direct)


def test_tensor_sketch_estimates_the_polynomial_kernel(spark):
    rng = np.random.default_rng(8)
    size, gamma = 40, 0.5
    vectors = [(sorted(rng.choice(size, 6, replace=False).tolist()), rng.normal(0, 1, 6).tolist()) for _ in range(40)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(vectors)], "id int, i array<int>, v array<double>")
    z = np.array([r.z for r in df.select("id", H.tensor_sketch(size, gamma, d=4096)("i", "v").alias("z")).orderBy("id").collect()])
    x = np.zeros((40, size))
    for k, (i, v) in enumerate(vectors):
        x[k, i] = v
    exact = (gamma * x @ x.T) ** 3
    norm = np.sqrt(np.outer(np.diag(exact), np.diag(exact)))
    assert np.abs(z @ z.T - exact).max() < 0.25 * norm.max() and np.abs((z @ z.T - exact) / norm).mean() < 0.03


def test_both_models_are_tuned(spark, trained, monkeypatch):
    svc = H.LinearSVC
    monkeypatch.setattr(H, "LinearSVC", lambda **settings: svc(**{**settings, "maxIter": 3}))     # each step is a job
    grown = {"num_trees": (2, 5), "max_depth": (2, None), "min_split": (2, 10), "min_instances": (1,), "max_features": ("sqrt", "all")}
    svm = {"kernel": ("rbf", "linear", "poly"), "c": (0.1,), "gamma": ("auto", 0.1)}
    got = H.grid_search(trained, forest_grid=grown, svm_grid=svm, k=2).collect()
    assert {(r.num_trees, r.max_depth, r.min_split, r.max_features) for r in got if r.model_name == "random_forest"} == {
        (n, d, s, f) for n in (2, 5) for d in (2, None) for s in (2, 10) for f in ("sqrt", "all")}
    assert {(r.kernel, r.c, r.gamma) for r in got if r.kernel in ("rbf", "poly")} == {(k, 0.1, g) for k in ("rbf", "poly") for g in ("auto", "0.1")}
    assert [r.c for r in got if r.kernel == "linear"] == [0.1] and len(got) == 16 + 5
    assert all(0 <= r.mean_f1 <= 1 and r.std_f1 >= 0 for r in got) and max(r.mean_f1 for r in got) > 0.7


@pytest.mark.parametrize("job", ["cv_scores", "grid_search"])
def test_fits_side_by_side_share_the_slots(spark, trained, monkeypatch, job):
    """Each of six fits has few parts, not two a task slot, and still one for every MOST_PER_TASK rows; forests keep their rows' nodes."""
    assert [H.fit_parts(n, 12, 6) for n in (0, 1, 41_000, 410_000, 2_460_000)] == [1, 1, 2, 13, 76]
    svc, grow, compact, shares, cached = H.LinearSVC, H.random_forest, H._compact, [], []
    monkeypatch.setattr(H, "LinearSVC", lambda **settings: svc(**{**settings, "maxIter": 3}))

    class Seen(H.RandomForestClassifier):
        def fit(self, rows, params=None):
            cached.append(self.getCacheNodeIds())
            return super().fit(rows, params)

    def small(*a, **b):
        made = grow(*a, **b).setNumTrees(3)
        made.__class__ = Seen
        return made

    def stored(df, rows, at_once=1):
        shares.append((rows, at_once))
        return compact(df, rows, at_once)
    monkeypatch.setattr(H, "random_forest", small)
    monkeypatch.setattr(H, "_compact", stored)
    if job == "cv_scores":
        got = {r.model_name: r for r in H.cv_scores(trained, k=2).collect()}
        assert set(got) == {"random_forest", "svm"} and all(len(r.fold_f1) == 2 and r.mean_f1 > 0.5 for r in got.values())
        assert len(cached) == 2
    else:
        grown = {"num_trees": (3,), "max_depth": (3,), "min_split": (2,), "min_instances": (1,), "max_features": ("sqrt",)}
        got = H.grid_search(trained, forest_grid=grown, svm_grid={"kernel": ("linear",), "c": (0.1,), "gamma": ("auto",)}, k=2).collect()
        assert len(got) == 2 and len(cached) == 2
    assert shares and set(shares) == {(trained.train.count(), 6)} and all(cached)
