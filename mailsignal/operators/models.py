"""Spark ML layer.

Features: the relational TF-IDF long form is packed into one sparse vector per mail by built-in
expressions (the vector's own struct, stored in the shared folder and read back under the vector
type) and assembled with the 8 metadata columns. Training data is the training split
only; TF-IDF is fitted on it (no leakage). Both models train with balanced class
weights. The linear SVM gets standardised input without centring so vectors
stay sparse; its margin is calibrated to a probability by Platt scaling fitted on
a held-out fold.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mailsignal import lexicon as L
from mailsignal.functions import features as E
from mailsignal.operators import forest, scorers
from mailsignal.operators import split as G
from mailsignal.operators import vectorize as V
from mailsignal.operators.grow import RandomForestClassifier
from mailsignal.session import ensure_checkpoint_dir, scratch_path, ship_package


def packed_weights(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str, n_features: int) -> DataFrame:
    """(id, tfidf) with the struct a sparse vector is stored as; a mail with no vocabulary term gets empty arrays."""
    packed = V.weight_lists(docs, vocab, id_col, text_col)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n_features).cast("int").alias("size"),
                      F.coalesce("idx", F.array().cast("array<int>")).alias("indices"), F.coalesce("weight", F.array().cast("array<double>")).alias("values"))
    return docs.select(id_col).join(packed, id_col, "left").select(id_col, vector.alias("tfidf"))


def tfidf_vectors(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str, n_features: int) -> DataFrame:
    """(id, tfidf) sparse vectors, read back from the shared folder under the vector type."""
    path = scratch_path(docs.sparkSession, "vectors", uuid.uuid4().hex)
    packed_weights(docs, vocab, id_col, text_col, n_features).write.parquet(path)
    schema = StructType([docs.schema[id_col], StructField("tfidf", VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def assembled_rows(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str, n_features: int) -> DataFrame:
    """F6 in long form: (id, idx, value) of the non-zero TF-IDF weights and of all metadata columns."""
    tf = V.tfidf(docs, vocab, id_col, text_col, digits=None).select(id_col, "idx", F.col("weight").alias("value"))
    meta = F.array(*[F.struct(F.lit(n_features + i).cast("bigint").alias("idx"), c.cast("double").alias("value"))
                     for i, c in enumerate(E.metadata_vector_columns(text_col))])
    return tf.unionByName(docs.select(id_col, F.inline(meta)))


def align(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """(id, name, value) rows of any frame under the saved (idx, name) schema: extra names go, missing
    ones are absent, which is zero in the sparse form, and the order is the schema's."""
    return rows.join(F.broadcast(schema.select("idx", "name")), "name", "inner").drop("name")   # the schema is max_features + 8 rows


def feature_frame(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str, label_col: str,
                  n_features: int) -> DataFrame:
    """id, label, tfidf vector, 8 metadata columns and the assembled ``features`` vector."""
    kept = [c for c in docs.columns if c not in (id_col, label_col, text_col)]
    meta = docs.select(id_col, label_col, *kept, *[c.cast("double").alias(c_name) for c, c_name in
                                            zip(E.metadata_vector_columns(text_col), E.METADATA_NAMES)])
    vec = tfidf_vectors(docs, vocab, id_col, text_col, n_features)
    j = meta.join(vec, id_col, "inner")
    return VectorAssembler(inputCols=["tfidf"] + E.METADATA_NAMES, outputCol="features").transform(j)


def feature_names(vocab: DataFrame) -> DataFrame:
    """Ordered feature schema (idx, name): vocabulary terms, then the metadata columns."""
    spark = vocab.sparkSession
    n = vocab.count()
    meta = spark.createDataFrame([(n + i, m) for i, m in enumerate(E.METADATA_NAMES)], "idx long, name string")
    return vocab.select(F.col("idx").cast("long"), F.col("term").alias("name")).unionByName(meta)


def random_forest(label_col: str = "label", weight_col: str = "class_weight", num_trees: int = 100,
                  max_depth: int = 20, min_instances: int = 2, seed: int = L.SEED) -> RandomForestClassifier:
    """H1: live-stack forest (100 trees, depth 20, min leaf 2, sqrt features, balanced)."""
    return RandomForestClassifier(labelCol=label_col, featuresCol="features", weightCol=weight_col,
                                  numTrees=num_trees, maxDepth=min(max_depth, 30), minInstancesPerNode=min_instances,
                                  featureSubsetStrategy="sqrt", seed=seed, predictionCol="rf_pred",
                                  probabilityCol="rf_prob", rawPredictionCol="rf_raw")


def linear_svm(n_rows: int, c: float = 0.1, label_col: str = "label", weight_col: str = "class_weight") -> Pipeline:
    """H2: standardised (no centring) linear SVM; C maps to regParam = 1 / (C * n)."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True)
    svm = LinearSVC(labelCol=label_col, featuresCol="scaled", weightCol=weight_col,
                    regParam=1.0 / (c * max(n_rows, 1)), maxIter=100, predictionCol="svm_pred",
                    rawPredictionCol="svm_raw")
    return Pipeline(stages=[scaler, svm])


@dataclass
class Trained:
    vocab: DataFrame
    n_features: int
    forest: PipelineModel
    svm: PipelineModel
    platt: PipelineModel
    train: DataFrame
    test: DataFrame
    every: DataFrame


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("margin", vector_to_array("svm_raw")[1])


def fit_features(corpus: DataFrame, id_col: str = "email_id", text_col: str = "raw_text", label_col: str = "label"):
    """(corpus with its split, vocabulary fitted on the training part, number of terms)."""
    ensure_checkpoint_dir(corpus.sparkSession)
    s = G.stratified_split(corpus, id_col, label_col)
    vocab = V.fit_vocabulary(s.filter(F.col("split") == "train"), id_col, text_col).checkpoint(eager=True)
    return s, vocab, vocab.count()


def train(corpus: DataFrame, id_col: str = "email_id", text_col: str = "raw_text", label_col: str = "label",
          num_trees: int = 100, max_depth: int = 20, fitted=None) -> Trained:
    """H8: split -> fit TF-IDF on train -> features -> forest + SVM (+ Platt on a held-out fold)."""
    s, vocab, n_terms = fitted or fit_features(corpus, id_col, text_col, label_col)
    every = feature_frame(s, vocab, id_col, text_col, label_col, n_terms).checkpoint(eager=True)
    tr = G.class_weights(every.filter(F.col("split") == "train"), label_col)
    n = tr.count()
    tr = _compact(G.stratified_folds(tr, id_col, label_col, k=5), n)
    te = every.filter(F.col("split") == "test")
    grown = random_forest(label_col, num_trees=num_trees, max_depth=max_depth).setMaxMemoryInMB(FOREST_MEMORY_MB)
    # Platt scaling without leakage: SVM on folds 1-4, calibrator on fold 0's margins
    forest, svm_cal, svm = _side_by_side([lambda: Pipeline(stages=[grown]).fit(tr), lambda: linear_svm(n).fit(tr.filter(F.col("fold") != 0)),
                                          lambda: linear_svm(n).fit(tr)], 3)
    held = _margin(svm_cal.transform(tr.filter(F.col("fold") == 0)))
    platt = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="m_vec"),
                             LogisticRegression(featuresCol="m_vec", labelCol=label_col, predictionCol="platt_pred",
                                                probabilityCol="svm_prob", rawPredictionCol="platt_raw")]).fit(held)
    return Trained(vocab, n_terms, forest, svm, platt, tr, te, every)


def score(t: Trained, feats: DataFrame, id_col: str = "email_id") -> DataFrame:
    """Both models on a feature frame -> per-model columns and the ensemble.
    The SVM's class is its own decision; its confidence is the calibrated probability of that class."""
    from mailsignal.operators import score as S
    f = t.platt.transform(_margin(t.svm.transform(t.forest.transform(feats))))
    p_rf = vector_to_array("rf_prob")[1]
    p_svm = vector_to_array("svm_prob")[1]
    svm_pred = F.col("svm_pred").cast("int")
    out = f.select(id_col, "label", *S.model_result(p_rf, "rf"),
                   svm_pred.alias("svm_prediction"), S.label_text(svm_pred).alias("svm_label"),
                   F.when(svm_pred == 1, p_svm).otherwise(F.lit(1.0) - p_svm).alias("svm_confidence"),
                   (F.lit(1.0) - p_svm).alias("svm_probability_legitimate"), p_svm.alias("svm_probability_phishing"))
    return S.ensemble(out)


#: The grids of the reference's tuning: 162 forest settings and, as the linear kernel has no gamma, 15 SVM settings.
#: Unlimited depth (None) is Spark's limit of 30.
FOREST_GRID = {"num_trees": (50, 100, 200), "max_depth": (10, 20, None), "min_split": (2, 5, 10), "min_instances": (1, 2, 4), "max_features": ("sqrt", "log2")}
SVM_GRID = {"kernel": ("rbf", "linear"), "c": (0.1, 1.0, 10.0), "gamma": ("scale", "auto", 0.01, 0.1)}
#: The older stack's wider grids (its folds: 5): all features, a larger C, two more gammas and the polynomial kernel.
WIDE_FOREST_GRID = {**FOREST_GRID, "max_features": ("sqrt", "log2", "all")}
WIDE_SVM_GRID = {"kernel": ("rbf", "linear", "poly"), "c": (0.1, 1.0, 10.0, 100.0), "gamma": ("scale", "auto", 0.001, 0.01, 0.1, 1.0)}
GRID_FOLDS, WIDE_FOLDS = 3, 5
DEPTH_LIMIT = 30
#: Spark's memory for the statistics of the nodes of one job. Every task that runs holds that much beside the cached rows and outside of Spark's
#: own accounting: with four cores it must be a small share of an executor.
FOREST_MEMORY_MB = 128
ROWS_PER_TASK, MOST_PER_TASK = 4096, 32768   # iterative fits run one job a step: a task of fewer rows costs more to start than to run
_GRID_SCHEMA = ("model_name string, num_trees int, max_depth int, min_split int, min_instances int, max_features string, kernel string, "
                "c double, gamma string, mean_f1 double, std_f1 double")


def _side_by_side(jobs: list, parallelism: int) -> list:
    """Results of argument-free functions, some at a time, in order."""
    with ThreadPool(max(1, min(parallelism, len(jobs) or 1))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(j) for j in jobs], chunksize=1)


def _beside_others(forest_: RandomForestClassifier) -> RandomForestClassifier:
    """A forest fitted beside others: every row keeps its node in every tree, so that the driver need not send all trees with every step."""
    return forest_.setMaxMemoryInMB(FOREST_MEMORY_MB).setCacheNodeIds(True)


def fit_parts(rows: int, slots: int, at_once: int = 1) -> int:
    """Parts of the rows of an iterative fit: each sends its statistics of every node or weight at every step, so beyond two a task slot there are
    more only to keep a part small. Of several fits ``at_once`` each has its share of the slots, and a part for each of them: the fits fill the
    slots, and a part more only repeats the statistics."""
    wanted = 2 * slots if at_once == 1 else slots // at_once
    return max(1, min(-(-rows // ROWS_PER_TASK), max(wanted, -(-rows // MOST_PER_TASK))))


def _compact(df: DataFrame, rows: int, at_once: int = 1) -> DataFrame:
    """Stored once, in as many parts as its rows need."""
    return df.coalesce(fit_parts(rows, df.sparkSession.sparkContext.defaultParallelism, at_once)).checkpoint(eager=True)


def stored_vectors(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, vector): a vector column as the struct it is stored as."""
    path = scratch_path(df.sparkSession, "vectors", uuid.uuid4().hex)
    df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("vector")).write.parquet(path)
    return df.sparkSession.read.schema("id long, vector struct<type:tinyint,size:int,indices:array<int>,values:array<double>>").parquet(path)


def forest_nodes(model) -> DataFrame:
    """The node table of a fitted forest, saved under the shared folder."""
    spark = SparkSession.active()
    path = scratch_path(spark, "forests", uuid.uuid4().hex)
    model.write().save(path)
    return forest.nodes(spark, path)


def _forest_scores(folds: DataFrame, size: int, grid: dict, label_col: str, id_col: str, k: int, parallelism: int) -> DataFrame:
    """F1 of every forest setting on every fold, from one fit a fold for each (min_instances, max_features): the largest number of trees,
    grown to the largest depth; all other settings are parts of it."""
    spark = folds.sparkSession
    settings = [forest.Setting(*c) for c in product(grid["num_trees"], grid["max_depth"], grid["min_split"])]
    deepest = DEPTH_LIMIT if None in grid["max_depth"] else max(grid["max_depth"])
    vectors = stored_vectors(folds, id_col, "features")
    label = folds.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), "fold")
    parts = [folds.filter(F.col("fold") != f) for f in range(k)]

    def job(fold: int, least: int, features: str):
        def run():
            rf = random_forest(label_col, num_trees=max(grid["num_trees"]), max_depth=deepest, min_instances=least)
            fitted = _beside_others(rf.setFeatureSubsetStrategy(features)).fit(parts[fold])
            held = label.filter(F.col("fold") == fold)
            f1 = forest.f1_by_setting(forest.votes(vectors.join(held.select("id"), "id", "left_semi"), forest_nodes(fitted), size, settings), held, settings)
            # one number a setting; a setting without rows in this fold scores 0
            found = {r["setting"]: r["f1"] for r in f1.collect()}
            return [(s.trees, s.depth, s.min_split, least, features, fold, float(found.get(i, 0.0))) for i, s in enumerate(settings)]
        return run

    rows = _side_by_side([job(*c) for c in product(range(k), grid["min_instances"], grid["max_features"])], parallelism)
    return spark.createDataFrame([r for part in rows for r in part], "num_trees int, max_depth int, min_split int, min_instances int, max_features string, fold int, f1 double")


def _svm_f1(rows: DataFrame, features: str, c: float, label_col: str, fold: int) -> float:
    fit = rows.filter(F.col("fold") != fold)
    model = _svc(features, label_col, 1.0 / (c * max(fit.count(), 1))).fit(fit)
    ev = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol="svm_pred", metricName="fMeasureByLabel", metricLabel=1.0)
    return float(ev.evaluate(model.transform(rows.filter(F.col("fold") == fold))))


def _gammas(scaled: DataFrame, size: int, names) -> dict:
    """gamma by name: 'auto' is 1 / size, 'scale' divides that by the mean variance of the scaled columns."""
    var = scaled.select(Summarizer.variance(F.col("scaled")).alias("v")).first()["v"].toArray().mean()
    known = {"auto": 1.0 / size, "scale": 1.0 / (size * var) if var > 0 else 1.0}
    return {g: known[g] if isinstance(g, str) else float(g) for g in names}


def grid_search(t: Trained, label_col: str = "label", id_col: str = "email_id", forest_grid: dict = FOREST_GRID,
                svm_grid: dict = SVM_GRID, k: int = GRID_FOLDS, parallelism: int = 6) -> DataFrame:
    """H5/H6: forest and SVM grids with F1 of class 1 over ``k`` stratified folds; per setting mean and population std
    of the fold scores. The scaler is fitted on the whole training part, as in the reference. Forest settings are read from one large
    forest a fold for each (min_instances, max_features): equal in distribution to fits of their own, not bit for bit. Gaussian
    kernels are linear ones on random Fourier features, polynomial ones on tensor sketches; equal gammas are fitted once and
    reported under each of their names."""
    spark, size = t.train.sparkSession, t.n_features + len(E.METADATA_NAMES)
    n = t.train.count()
    folds = _compact(G.stratified_folds(t.train.drop("fold"), id_col, label_col, k=k), n, parallelism)
    none = lambda kind: F.lit(None).cast(kind)
    scores = _forest_scores(folds, size, forest_grid, label_col, id_col, k, parallelism) if all(forest_grid.values()) else None

    scaler = t.svm.stages[0]
    scaled = scaler.transform(folds)
    spaces = {}   # (kernel, gamma) -> its rows
    if "linear" in svm_grid["kernel"]:
        spaces["linear", None] = (_compact(scaled.select(label_col, "class_weight", "fold", "scaled"), n, parallelism), "scaled")
    gammas = _gammas(scaled, size, svm_grid["gamma"])
    for kernel, mapped in (("rbf", kernel_features), ("poly", poly_features)):
        if kernel in svm_grid["kernel"]:
            for gamma in dict.fromkeys(gammas.values()):
                rows = mapped(folds, scaler, size, id_col, gamma).select(label_col, "class_weight", "fold", "features")
                spaces[kernel, gamma] = (_compact(rows, n, parallelism), "features")
    runs = list(product(spaces, svm_grid["c"], range(k)))
    f1 = _side_by_side([lambda r=r: _svm_f1(*spaces[r[0]], r[1], label_col, r[2]) for r in runs], parallelism)
    found = {r: x for r, x in zip(runs, f1)}
    rows = []
    for (kernel, gamma), c, fold in runs:
        names = [None] if kernel == "linear" else [str(g) for g, value in gammas.items() if value == gamma]
        rows += [(kernel, float(c), name, found[(kernel, gamma), c, fold]) for name in names]
    svm = spark.createDataFrame(rows, "kernel string, c double, gamma string, f1 double")
    stats = [F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1")]
    order = [c.split()[0] for c in _GRID_SCHEMA.split(", ")]
    out = (svm.groupBy("kernel", "c", "gamma").agg(*stats).withColumn("model_name", F.lit("svm"))
           .withColumns({c: none("int") for c in ("num_trees", "max_depth", "min_split", "min_instances")}).withColumn("max_features", none("string")).select(order))
    if scores is None:
        return out
    grown = scores.groupBy("num_trees", "max_depth", "min_split", "min_instances", "max_features").agg(*stats)
    return grown.withColumn("model_name", F.lit("random_forest")).withColumns({"kernel": none("string"), "c": none("double"), "gamma": none("string")}).select(order).union(out)


def cv_scores(t: Trained, label_col: str = "label", k: int = 5, parallelism: int = 6) -> DataFrame:
    """H6: F1 of class 1 on each of the k stratified folds, their mean and population std, for the forest and the SVM."""
    n = t.train.count()
    train_rows = _compact(t.train.select(label_col, "class_weight", "fold", "features"), n, parallelism)

    def job(name: str, fold: int):
        def run():
            ev = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol="rf_pred" if name == "random_forest" else "svm_pred",
                                                   metricName="fMeasureByLabel", metricLabel=1.0)
            fit = train_rows.filter(F.col("fold") != fold)
            model = _beside_others(random_forest(label_col)) if name == "random_forest" else linear_svm(fit.count())
            return float(ev.evaluate(model.fit(fit).transform(train_rows.filter(F.col("fold") == fold))))
        return run

    names = ("random_forest", "svm")
    found = _side_by_side([job(*c) for c in product(names, range(k))], parallelism)
    rows = []
    for i, name in enumerate(names):
        scores = found[i * k:(i + 1) * k]
        mean = sum(scores) / k
        rows.append((name, scores, mean, (sum((x - mean) ** 2 for x in scores) / k) ** 0.5))
    return t.train.sparkSession.createDataFrame(rows, "model_name string, fold_f1 array<double>, mean_f1 double, std_f1 double")


FOURIER, GAMMA_SEED = 256, 17


def fourier_features(size: int, seed: int = GAMMA_SEED, d: int = FOURIER, gamma: float | None = None):
    """Arrow-batched column function: scaled sparse vectors (indices, values) -> ``d`` random Fourier features of the
    Gaussian kernel; gamma is 1 / size (the 'scale' setting for features of unit variance) unless given."""
    spread = np.sqrt(2.0 / size if gamma is None else 2.0 * gamma)
    @F.pandas_udf("array<double>")
    def features(indices: pd.Series, values: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, spread, (size, d)), rng.uniform(0, 2 * np.pi, d)
        out = [np.sqrt(2.0 / d) * np.cos(np.asarray(v, float) @ w[np.asarray(i, int)] + b) for i, v in zip(indices, values)]
        return pd.Series(out)
    return features


POLY_DEGREE, POLY_WIDTH, POLY_SEED = 3, 512, 23


def tensor_sketch(size: int, gamma: float, degree: int = POLY_DEGREE, d: int = POLY_WIDTH, seed: int = POLY_SEED):
    """Arrow-batched column function: sparse vectors (indices, values) -> tensor sketch of the kernel (gamma x.y) ** degree:
    one count sketch a factor, multiplied in the Fourier domain, so inner products of sketches estimate the kernel."""
    @F.pandas_udf("array<double>")
    def features(indices: pd.Series, values: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        cell, sign = rng.integers(0, d, (degree, size)), rng.choice([-1.0, 1.0], (degree, size))
        out = []
        for i, v in zip(indices, values):
            i, v, product_ = np.asarray(i, int), np.sqrt(gamma) * np.asarray(v, float), 1.0
            for f in range(degree):
                product_ = product_ * np.fft.rfft(np.bincount(cell[f, i], sign[f, i] * v, d))
            out.append(np.fft.irfft(product_, d))
        return pd.Series(out)
    return features


def _mapped_features(df: DataFrame, scaler, size: int, id_col: str, function) -> DataFrame:
    """``df`` with its ``features`` scaled and mapped by a column function of (indices, values)."""
    ship_package(df.sparkSession)
    raw = stored_vectors(scaler.transform(df), id_col, "scaled")   # read back as the struct a vector is stored as
    s = F.col("vector")
    z = function(F.when(s["type"] == 1, F.sequence(F.lit(0), F.lit(size - 1))).otherwise(s["indices"]), s["values"])
    return df.drop("features").join(raw.select(F.col("id").alias(id_col), array_to_vector(z).alias("features")), id_col)


def kernel_features(df: DataFrame, scaler, size: int, id_col: str, gamma: float | None = None) -> DataFrame:
    """``df`` with its ``features`` scaled and mapped to random Fourier features."""
    return _mapped_features(df, scaler, size, id_col, fourier_features(size, gamma=gamma))


def poly_features(df: DataFrame, scaler, size: int, id_col: str, gamma: float) -> DataFrame:
    """``df`` with its ``features`` scaled and mapped to tensor sketches of the polynomial kernel of degree 3."""
    return _mapped_features(df, scaler, size, id_col, tensor_sketch(size, gamma))


def _svc(features: str, label_col: str, reg: float = 0.0) -> LinearSVC:
    return LinearSVC(labelCol=label_col, featuresCol=features, weightCol="class_weight", regParam=reg, maxIter=100,
                     predictionCol="svm_pred", rawPredictionCol="svm_raw")


@dataclass
class KernelSvm:
    svm: LinearSVCModel
    platt: PipelineModel
    every: DataFrame


def fit_rbf(t: Trained, c: float = 1.0, label_col: str = "label", id_col: str = "email_id") -> KernelSvm:
    """H3: Gaussian-kernel SVM as a linear one on random Fourier features of the scaled vectors, with Platt
    scaling fitted on fold 0."""
    size = t.n_features + len(E.METADATA_NAMES)
    scaler = t.svm.stages[0]
    n = t.train.count()
    train_rows = _compact(kernel_features(t.train, scaler, size, id_col), n)
    svm = _svc("features", label_col, 1.0 / (c * max(n, 1)))
    held = _margin(svm.fit(train_rows.filter(F.col("fold") != 0)).transform(train_rows.filter(F.col("fold") == 0)))
    platt = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="m_vec"),
                             LogisticRegression(featuresCol="m_vec", labelCol=label_col, predictionCol="platt_pred",
                                                probabilityCol="svm_prob", rawPredictionCol="platt_raw")]).fit(held)
    return KernelSvm(svm.fit(train_rows), platt, kernel_features(t.every, scaler, size, id_col).checkpoint(eager=True))


def rbf_svm(t: Trained, c: float = 1.0, label_col: str = "label", id_col: str = "email_id", fitted: KernelSvm | None = None) -> DataFrame:
    """H3: predictions of the kernel SVM for every mail."""
    k = fitted or fit_rbf(t, c, label_col, id_col)
    out = k.platt.transform(_margin(k.svm.transform(k.every)))
    return out.select(id_col, label_col, "split", F.col("svm_pred").cast("int").alias("prediction"), vector_to_array("svm_prob")[1].alias("probability_phishing"))


def table_scores(t: Trained, feats: DataFrame, id_col: str = "email_id") -> DataFrame:
    """(id, rf_p, svm_margin, svm_p) of a feature frame from the models' tables alone."""
    size = t.n_features + len(E.METADATA_NAMES)
    rows = stored_vectors(feats, id_col, "features")
    scaler, svm = t.svm.stages
    grown = scorers.forest_probability(rows, forest_nodes(t.forest.stages[-1]), size).withColumnRenamed("p", "rf_p")
    linear = scorers.margins(rows, scorers.linear_weights(svm, scaler), svm.intercept).withColumnRenamed("margin", "svm_margin")
    return grown.join(linear, "id").withColumn("svm_p", scorers.calibrated(F.col("svm_margin"), t.platt.stages[-1])).withColumnRenamed("id", id_col)


def same_scores(t: Trained, feats: DataFrame, id_col: str = "email_id") -> DataFrame:
    """(id, label, rf_same, svm_same, platt_same, ensemble_same): whether Spark ML's results are those of the models' tables."""
    from mailsignal.operators import score as S
    ml = score(t, feats, id_col)
    own = table_scores(t, feats, id_col)
    svm = (F.col("svm_margin") > 0).cast("int")
    again = S.ensemble(own.select("*", *S.model_result(F.col("rf_p"), "rf"), svm.alias("svm_prediction"), S.label_text(svm).alias("svm_label"),
                                  F.when(svm == 1, F.col("svm_p")).otherwise(1 - F.col("svm_p")).alias("svm_confidence"),
                                  (1 - F.col("svm_p")).alias("svm_probability_legitimate"), F.col("svm_p").alias("svm_probability_phishing")))
    names = [c for c in again.columns if c in ml.columns and c != id_col]
    j = ml.join(again.select(id_col, *[F.col(c).alias(f"own_{c}") for c in names]), id_col)

    def alike(prefix: str, some=None) -> Column:
        checks = [scorers.close(c, f"own_{c}") if c.endswith(("confidence", "legitimate", "phishing")) else F.col(c).eqNullSafe(F.col(f"own_{c}"))
                  for c in names if c.startswith(prefix) and (some is None or c in some)]
        return reduce(lambda a, b: a & b, checks)
    return j.select(id_col, "label", alike("rf_").alias("rf_same"), alike("svm_", ("svm_prediction", "svm_label")).alias("svm_same"),
                    alike("svm_").alias("platt_same"), alike("ensemble_").alias("ensemble_same"))


def same_kernel_scores(k: KernelSvm, id_col: str = "email_id") -> DataFrame:
    """(id, label, split, same) for the kernel SVM: its class and probability against the weight table's."""
    ml = rbf_svm(None, id_col=id_col, fitted=k)
    own = scorers.margins(stored_vectors(k.every, id_col, "features"), scorers.linear_weights(k.svm), k.svm.intercept)
    j = ml.join(own, F.col(id_col) == F.col("id"))
    p = scorers.calibrated(F.col("margin"), k.platt.stages[-1])
    return j.select(id_col, "label", "split", ((F.col("prediction") == (F.col("margin") > 0).cast("int")) & scorers.close("probability_phishing", p)).alias("same"))


def same_importances(t: Trained) -> DataFrame:
    """(idx, name, same) for every feature: Spark ML's importance against the node table's."""
    size = t.n_features + len(E.METADATA_NAMES)
    ml = feature_importance(t, size).select("idx", "name", "importance")
    own = scorers.importances(forest_nodes(t.forest.stages[-1])).select(F.col("idx").alias("i"), F.col("importance").alias("own"))
    return ml.join(own, F.col("idx") == F.col("i"), "left").select("idx", "name", scorers.close("importance", F.coalesce("own", F.lit(0.0))).alias("same"))


def majority(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: n, share (accuracy of always guessing the larger class) and f1 (of class 1, when guessing so)."""
    ones = F.count(F.when(F.col(label_col) == 1, 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), ones.alias("ones")).select(
        "n", (F.greatest("ones", F.col("n") - F.col("ones")) / F.col("n")).alias("share"),
        F.when(2 * F.col("ones") > F.col("n"), 2 * F.col("ones") / (F.col("n") + F.col("ones"))).otherwise(0.0).alias("f1"))


def feature_importance(t: Trained, top_n: int = 20) -> DataFrame:
    """H7: forest importances joined to the feature names, top n (n = min(20, width))."""
    imp = t.forest.stages[-1].featureImportances
    spark = t.train.sparkSession
    rows = [(int(i), float(v)) for i, v in zip(imp.indices, imp.values)]
    imps = spark.createDataFrame(rows, "idx long, importance double")
    names = feature_names(t.vocab)
    j = names.join(imps, "idx", "left").fillna(0.0, subset=["importance"])
    return j.orderBy(F.desc("importance"), "idx").limit(min(top_n, t.n_features + len(E.METADATA_NAMES)))
