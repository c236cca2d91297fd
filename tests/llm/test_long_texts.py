"""Texts longer than a slice, ties between languages, and the classifier's score recomputed with plain loops."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mailsignal.llm import bpe_codec, language_id, minhash, mixing, quality_classifier, quality_rules, substring_dedup, textscan, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij éß") for _ in range(rng.randrange(1, 9))).strip() or "x" for _ in range(3000)]
    parts = []
    while sum(map(len, parts)) < 2.4 * textscan.SLICE_BYTES:
        parts.append(" ".join(rng.choices(vocabulary, k=2000)) + rng.choice(["\n", ". ", "  "]))
    return "".join(parts)


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text, "en", "a"), (2, long_text + " tail", "en", "a"), (3, "short one", "en", "a"), (4, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_shingles(docs, long_text):
    w = [x.lower() for x in words(long_text)]
    sizes = {r["doc_id"]: r["size"] for r in mixing.op9_mixing(docs).collect()}
    assert sizes == {1: len(w), 2: len(w) + 1, 3: 2, 4: 0}
    got = {r["doc_id"]: r for r in minhash.op4_minhash_near_dedup(docs).collect()}
    assert got[1]["n_shingles"] == len({tuple(w[i:i + 5]) for i in range(len(w) - 4)}) and got[2]["component_id"] == 1 and got[3]["kept"]
    cut = {r["doc_id"]: r for r in substring_dedup.op3_substring_dedup(docs).collect()}
    assert cut[1]["n_removed"] == 0 and (cut[2]["n_words"], cut[2]["n_removed"]) == (len(w) + 1, len(w))
    assert cut[2]["kept_sha256"] == hashlib.sha256(b"tail").hexdigest()
    rules = {r["doc_id"]: r for r in quality_rules.op10_quality_rules(docs).collect()}
    assert rules[1]["n_words"] == len(w) and rules[1]["word_chars"] == sum(map(len, words(long_text)))


def test_tokens(docs, long_text):
    tok = Tokenizer.from_file(BPE)
    ids = tok.encode(long_text, add_special_tokens=False).ids
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.op5_token_counts(docs, BPE).collect()}[1] == len(ids)
    got = {r["doc_id"]: r for r in bpe_codec.op6_bpe_codec(docs, BPE).collect()}[1]
    assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_languages(spark, docs, long_text):
    """A long text is read whole; equal trees tie, and the first language in code-point order wins."""
    rows = [(i, f"same words in every text {i % 3}", lang, "s") for i, lang in enumerate(["fr", "de", "en"] * 20)] + [(999, long_text, None, None)]
    got = language_id.op2_language_id(spark.createDataFrame([(i, "same words in every text", g, s) for i, _, g, s in rows[:-1]] + rows[-1:], "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got if r["doc_id"] != 999}) == 1
    learned = sorted({g for i, _, g, _ in rows[:-1]})
    assert {r["lang_pred"] for r in got} <= {*learned} and {r["lang_pred"] for r in got if r["doc_id"] != 999} == {learned[0]}


def plain_score(net, raw):
    w = net.w
    responses = []
    at = 0
    while True:
        chunk = [raw[i] if i < len(raw) else quality_classifier.PAD for i in range(at, at + quality_classifier.WIDTH)]
        x = [float(v) for c in chunk for v in w["embed"][c]]
        responses.append([max(0.0, sum(a * float(b) for a, b in zip(x, w["filters"][:, f])) + float(w["bias"][f])) for f in range(w["filters"].shape[1])])
        if at + quality_classifier.WIDTH >= len(raw):
            break
        at += quality_classifier.STEP
    pooled = [max(r[f] for r in responses) for f in range(len(responses[0]))]
    if w["hidden"].shape[0] == 2 * len(pooled):
        pooled += [sum(r[f] for r in responses) / len(responses) for f in range(len(responses[0]))]
    hidden = [max(0.0, sum(p * float(v) for p, v in zip(pooled, w["hidden"][:, h])) + float(w["hidden_bias"][h])) for h in range(w["hidden"].shape[1])]
    z = sum(a * float(b) for a, b in zip(hidden, w["out"][:, 0])) + float(w["out_bias"][0])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_score_equals_plain_loops(spark):
    net = quality_classifier.Network(prior=0.7)
    rng = np.random.default_rng(5)
    net.w = {k: (v + rng.normal(0, 0.05, v.shape)).astype(np.float32) for k, v in net.w.items()}
    texts = ["", "a", "exactly sixteen.", "seventeen letters", "some longer text with é and 漢字, " * 9, None, "x" * 24, "x" * 25]
    weights = {**net.w, "prior": np.array([0.7], np.float32)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, weights).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(net, (t or "").encode()), abs=1e-4)
