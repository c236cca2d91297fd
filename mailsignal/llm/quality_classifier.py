"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters are run over chunks of ``WIDTH`` bytes that overlap by half and cover the
whole text (the last is padded). Each filter's responses are max-pooled over all chunks; a hidden layer
combines them into one probability. Nothing but the text's bytes goes in.

Training fits a bounded sample (``SAMPLE`` labelled documents, the least hashes of their ids) of whole texts by Adam,
in one task on an executor; its weights are a few thousand numbers, returned as one row and sent along with the
scoring function. A fixed seed and order make reruns agree.

Scoring takes every whole text in its own row, at any length, no shuffle; an empty table gives no rows. The sample is bounded in rows, its texts are
held whole by the task that fits. Null and empty texts are one padded chunk. With no labels to learn
from, or only one class, the score is the smoothed share of label 1. Rows are scored one by one; extra
columns never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.textscan import slices
from mailsignal.session import ship_package

WIDTH, STEP, EMBED, FILTERS, HIDDEN = 16, 8, 4, 64, 16
SAMPLE, EPOCHS, RATE, BATCH_BYTES = 2000, 8, 0.004, 1 << 17
THRESHOLD = 0.3
PAD = 256


def chunks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[chunks, WIDTH] byte numbers (PAD past a text's end) and the chunk offsets of the texts."""
    size = np.diff(offs)
    count = 1 + -(-np.maximum(size - WIDTH, 0) // STEP)
    first = np.concatenate(([0], np.cumsum(count)))
    start = offs[:-1].repeat(count) + (np.arange(first[-1]) - first[:-1].repeat(count)) * STEP
    at = start[:, None] + np.arange(WIDTH)
    past = at >= offs[1:].repeat(count)[:, None]
    out = np.append(buf, 0)[np.minimum(at, len(buf))].astype(np.int64)
    out[past] = PAD
    return out, first


class Network:
    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, weights: dict[str, np.ndarray] | None = None, prior: float = 0.5):
        rng = np.random.default_rng(7)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = weights or {
            "embed": normal(PAD + 1, EMBED) * 8, "filters": normal(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1),
            "out_bias": np.array([np.log(prior / (1 - prior))], np.float32)}

    def pooled(self, buf: np.ndarray, offs: np.ndarray):
        w = self.w
        index, first = chunks(buf, offs)
        x = w["embed"][index].reshape(len(index), -1)
        r = np.maximum(x @ w["filters"] + w["bias"], 0)
        return index, first, x, r, np.maximum.reduceat(r, first[:-1])

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        w = self.w
        h = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
        return 1 / (1 + np.exp(-np.clip((h @ w["out"])[:, 0] + w["out_bias"][0], -30, 30).astype(float)))

    def gradient(self, buf, offs, label) -> dict[str, np.ndarray]:
        w = self.w
        index, first, x, r, pooled = self.pooled(buf, offs)
        h = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
        p = 1 / (1 + np.exp(-np.clip((h @ w["out"])[:, 0] + w["out_bias"][0], -30, 30)))
        d_out = ((p - label) / len(label)).astype(np.float32)[:, None]
        d_h = (d_out @ w["out"].T) * (h > 0)
        d_pool = d_h @ w["hidden"].T
        n = np.diff(first)
        best = pooled.repeat(n, axis=0) == r   # equal responses share
        d_r = d_pool.repeat(n, axis=0) * best / np.add.reduceat(best, first[:-1]).repeat(n, axis=0)
        d_r *= r > 0
        d_x = (d_r @ w["filters"].T).reshape(-1, EMBED)
        flat = index.reshape(-1)
        d_e = np.stack([np.bincount(flat, d_x[:, j], PAD + 1) for j in range(EMBED)], axis=1).astype(np.float32)
        return {"embed": d_e, "filters": x.T @ d_r, "bias": d_r.sum(0), "hidden": pooled.T @ d_h, "hidden_bias": d_h.sum(0),
                "out": h.T @ d_out, "out_bias": d_out.sum(0)}

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        power = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order, group, held = rng.permutation(len(texts)), [], 0
            rate = RATE * (1 - epoch / epochs) + RATE / 50
            for rank, i in enumerate(order):
                group.append(i)
                held += len(texts[i])
                if held < BATCH_BYTES and rank < len(order) - 1:
                    continue
                buf = np.frombuffer(b"".join(texts[j] for j in group), np.uint8)
                offs = np.concatenate(([0], np.cumsum([len(texts[j]) for j in group]))).astype(np.int64)
                step += 1
                for k, g in self.gradient(buf, offs, labels[group]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    power[k] = 0.999 * power[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(power[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
                group, held = [], 0


def _fit_rows(batches):
    rows = [(h, d, t or "", q) for batch in batches for h, d, t, q in zip(*(batch.column(i).to_pylist() for i in range(4)))]
    rows.sort()
    texts, labels = [r[2].encode() for r in rows], np.array([float(r[3]) for r in rows])
    prior = (labels.sum() + 1) / (len(labels) + 2)
    names, values = ["prior"], [np.array([prior], np.float32)]
    if 0 < labels.sum() < len(labels):
        net = Network(prior=float(prior))
        net.fit(texts, labels)
        names, values = names + list(Network.NAMES), values + [net.w[k] for k in Network.NAMES]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([list(map(int, v.shape)) for v in values], pa.list_(pa.int32())),
                                      pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())], names=["name", "shape", "value"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights fitted to a bounded sample of (doc, text, label) rows, label 0 or 1."""
    ship_package(labelled.sparkSession)
    known = labelled.where("doc is not null and label in (0, 1)")
    ids = known.select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(sample)
    taken = known.join(F.broadcast(ids), "doc")  # at most ``sample`` ids
    one = F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"), "label"))  # a repeated id counts once
    taken = taken.withColumn("one", one).where("one = 1").select(F.xxhash64("doc").alias("h"), F.col("doc").cast("long").alias("doc"), "text", F.col("label").cast("int").alias("label"))
    rows = taken.repartition(1).mapInArrow(_fit_rows, "name string, shape array<int>, value binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["value"]), np.float32).reshape(r["shape"]) for r in rows}


def _score_rows(weights: dict[str, np.ndarray]):
    def run(batches):
        net = Network({k: weights[k] for k in Network.NAMES}) if "filters" in weights else None
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), 1 << 19):
                p = np.full(hi - lo, float(weights["prior"][0]) if "prior" in weights else 0.5)
                if net is not None:
                    p = net.probability(net.pooled(buf, offs)[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], names=["key", "score"])
    return run


def score(docs: DataFrame, weights: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the score of each whole text."""
    ship_package(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t"))
    return taken.mapInArrow(_score_rows(weights), f"key {taken.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    ids = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # ids only: the sample is of documents that are there
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    labelled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").alias("doc"), "text", "label")
    out = score(docs.select("doc_id", "text"), train(labelled))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
