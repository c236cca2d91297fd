"""Every operator against a brute-force version or its library, with nulls, empty texts, ties, repeated rows,
empty tables and extra columns whose names clash with inner ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mailsignal.llm import (bpe_codec, chat_format, graph, language_id, minhash, mixing, quality_classifier, quality_rules,
                            substring_dedup, token_counts, topk)
from mailsignal.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ("row", "t", "d", "key", "v", "copy", "n_words", "kept", "size", "total", "root", "leader", "block", "rank")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, extra=CLASHING):
    """(doc_id, text, lang, source) rows with clashing extra columns."""
    full = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(extra)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(seed, n, vocabulary=300, parts=12):
    """Texts that share passages of 5 to 40 words with others, with nulls, copies and short ones."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocabulary)
    shared = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(parts)]
    rows = [(None, "null id " + " ".join(shared[0]), None, None), (3, None, None, "s1"), (4, "", "en", None), (5, " \n\t", "en", "s2"), (6, "one two", "en", "s1"), (7, "One  TWO", "en", "s1")]
    for i in range(10, 10 + n):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(3, 30))]
        rows.append((i, " ".join(text), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    rows += [(900 + i, rows[20 + i][1], "en", "a") for i in range(8)] + [rows[15]] * 2 + [(12, "same id " + rows[16][1], "en", "b"), (None, rows[0][1], None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[key](spark, SMALL)
    want = con.execute(ORACLE[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    plain = lambda rows: Counter(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(want[cols].itertuples(index=False))


# 1
def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 7) / 8]) for i in range(230)]
    rows += [(300, [1.0] * 7), (301, [1.0] * 7), (302, None), (400, [float("nan")] * 7), (303, [None] * 7), (None, [9.0] * 7), (500, [1.0, 2.0]), (501, [3.0, -1.0]),
             (304, [float("inf")] * 7), (300, [1.0] * 7), (305, [1e6] * 7), (600, [])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, v int")
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    want = []
    for q, a in fine:
        if q % 100 == 0:
            code = lambda v: [int(np.floor(1024 * x)) for x in v]
            scored = sorted((-sum(x * y for x, y in zip(code(a), code(b))), c) for c, b in fine if c != q and len(a) == len(b))
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:10])]
    got = [tuple(r) for r in topk.top_k(vectors, F.col("v") % 100 == 0, chunk=40, block=2).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(map(tuple, topk.op1_top_k(vectors).collect())) == sorted(want)
    assert topk.op1_top_k(vectors.limit(0)).count() == 0


def test_threshold_decides_what_is_resolved():
    """Exact against all sums, with fewer entries looked up than the candidates have, and lists that cannot reach the threshold left out."""
    rng = np.random.default_rng(8)
    v = rng.integers(-500, 500, (3000, 32))
    v[:, 24:] //= 400
    for q in rng.integers(-500, 500, (20, 32)):
        cuts = topk._cuts(32)
        full = [v[:, a:b] @ q[a:b] for a, b in cuts]
        total, other = sum(full), np.ones(len(v), bool)
        cut = int(np.sort(total)[-10])
        reach = topk._norms(v, cuts).max(axis=1) * topk._norms(q[None], cuts)[:, 0]
        lists = [x if r >= -(-cut // topk.LISTS) else None for x, r in zip(full, reach)]
        asked = []
        at, score, resolved = topk._sufficient(lists, other, cut, lambda c, at: asked.append(len(at)) or full[c][at])
        assert sorted(zip(at, score)) == [(i, total[i]) for i in np.flatnonzero(total >= cut)]
        assert resolved == sum(asked) < topk.LISTS * len(v) / 2 and lists[3] is None


# 2
def test_code_lengths():
    rng = random.Random(1)
    texts = {"xx": "".join(rng.choice("abc ") for _ in range(900)), "yy": "".join(rng.choice("bcdé ") for _ in range(900))}
    rows, tree = [], {}
    for lang, text in texts.items():
        raw = text.encode()
        for size in range(1, language_id.ORDER + 2):
            for s, n in Counter(raw[i:i + size] for i in range(len(raw) - size + 1)).items():
                if n > 1 or size == 1:
                    rows.append((lang, size, int.from_bytes(s, "big"), n))
                    tree.setdefault((lang, s[:-1]), {})[s[-1]] = n

    def cost(lang, context, byte):
        seen = tree.get((lang, context), {})
        n, q = sum(seen.values()), len(seen)
        if byte in seen:
            return -np.log2(seen[byte] / (n + q))
        return (-np.log2(q / (n + q)) if seen else 0) + (cost(lang, context[1:], byte) if context else 8)

    model = language_id.Model(rows)
    for text in ("abc cab", "é", "zz top É", "", "b"):
        raw = text.lower().encode()
        want = [sum(cost(lang, raw[max(0, i - language_id.ORDER):i], raw[i]) for i in range(len(raw))) for lang in model.langs]
        got = model.lengths(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        assert np.allclose(got, want, atol=1e-3)


def test_language_id(spark):
    got = QUERIES["op2_language_id"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    both = got.merge(docs, on="doc_id")
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both["doc_id"]]).all()
    test = both[both["held_out"] & both["lang"].notna()]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.97
    learn, out = ([i for i in range(10, 60) if (zlib.crc32(str(i).encode()) % 3 == 1) == h] for h in (False, True))
    odd = frame(spark, [(1, None, "en", None), (2, "", "en", None), (3, "12 !?", None, None), (learn[0], "the word and this", "en", None), (None, "das Wort", "de", None),
                        (out[0], "le mot", "fr", None)] * 2)
    rows = Counter((r["doc_id"], r["held_out"], r["lang_pred"]) for r in language_id.op2_language_id(odd).collect())
    assert {(i, p) for i, _, p in rows} == {(1, "und"), (2, "und"), (3, "und"), (learn[0], "en"), (None, "en"), (out[0], "en")}
    assert set(rows.values()) == {2} and (out[0], True, "en") in rows
    assert language_id.op2_language_id(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.op2_language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 3
def brute_repeats(rows, size=13):
    holders = {}
    split = [(i, words(t)) for i, t, *_ in rows]
    for i, w in split:
        for s in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[s:s + size])
                holders[g] = min(holders.get(g, i), i)
    out = []
    for i, w in split:
        gone = {s + j for s in range(len(w) - size + 1) if i is not None and holders[tuple(w[s:s + size])] < i for j in range(size)}
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("run_bytes", [700, 1 << 22])
def test_substring_dedup(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", run_bytes)
    rows = passages(run_bytes, 150)
    got = substring_dedup.op3_substring_dedup(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)
    assert substring_dedup.op3_substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_spans_and_columns(spark):
    rows = passages(5, 60)
    docs = frame(spark, rows)
    for r in substring_dedup.remove_repeats(docs).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(s["end"] - s["start"] >= 13 for s in r["spans"])
    cut = substring_dedup.without_repeats(docs)
    assert cut.dtypes == docs.dtypes
    assert all(words(r["text"]) and r["n_chars"] == len(r["text"]) for r in cut.collect())
    alone = frame(spark, [(1, " two\n lines\t", "en", "a"), (2, "x", None, None)])
    assert sorted(r["text"] for r in substring_dedup.without_repeats(alone).collect()) == [" two\n lines\t", "x"]


# 4
def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (both and 100 * both >= 75 * len(sets[a] | sets[b])) or (rows[a][0] is not None and rows[a][0] == rows[b][0]):
                label[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[find(a)] = min(least.get(find(a), r[0]), r[0])
    return sorted(((r[0], len(sets[a]), least.get(find(a))) for a, r in enumerate(rows)), key=str)


def check_one_of_each(rows, kept):
    """One row of each component of texts: the smallest id's; texts without words once an id."""
    texts = [(i, t) for i, t, *_ in rows]
    sets = [shingle_set(t) for _, t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    groups = {}
    for a, r in enumerate(texts):
        groups.setdefault(find(a) if sets[a] else ("bare", r[0] if r[0] is not None else r[1]), []).append(r)
    assert len(kept) == len(groups)
    for members in groups.values():
        held = [k for k in kept if k in members]
        known = [m[0] for m in members if m[0] is not None]
        assert len(held) >= 1 and (not known or min(known) in [h[0] for h in held])


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, "en", "x"), (7, a, "en", "x"), (7, b, "en", "x"), (9, b + " more", "en", "x")]
    got = minhash.op4_minhash_near_dedup(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (7, 3, False), (9, 3, False)} and len(got) == 4
    assert {(r["doc_id"], r["text"]) for r in minhash.one_of_each(frame(spark, rows)).collect()} == {(3, a), (7, b)}


@pytest.mark.parametrize("seed", [21, 22])
def test_random_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), t, g, s) for _, t, g, s in families(seed, 8, 10) + passages(seed, 40)]
    rows += rng.choices(rows, k=20) + [(5, None, "en", "x"), (5, "", "en", "x"), (77, " ", "en", "x"), (77, None, "en", "x")] + [(8, rows[0][1].upper(), "en", "x")] * 3
    got = minhash.op4_minhash_near_dedup(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_near(rows)
    of_id = {}
    for r in got:
        of_id.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert all(len(v) == 1 for v in of_id.values())
    check_one_of_each(rows, [(r["doc_id"], r["text"]) for r in minhash.one_of_each(frame(spark, rows)).collect()])


def families(seed, groups, copies):
    """Groups of near copies at all distances around the limit, so that many members miss each other or the centre."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = ["g%dw%d" % (g, rng.randrange(4000)) for _ in range(rng.randrange(40, 160))]
        for c in range(copies):
            text = list(base)
            for _ in range(int(rng.random() * len(base) * 0.07)):
                text[rng.randrange(len(text))] = "x%d" % rng.randrange(10 ** 6)
            rows.append((rng.randrange(10 ** 9), " ".join(w.upper() if rng.random() < 0.1 else w for w in text), "en", "a"))
    return rows


def test_near_duplicates(spark):
    rows = passages(9, 80) + families(2, 6, 30)
    got = minhash.op4_minhash_near_dedup(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    kept = minhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    check_one_of_each(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])
    assert minhash.op4_minhash_near_dedup(frame(spark, rows).limit(0)).count() == 0


def test_sketch_concentration():
    rng = np.random.default_rng(4)
    for n in (2, 30, 400):
        a = rng.integers(1, 1 << 62, (40, n), dtype=np.uint64)
        b = a.copy()
        b[:, : n // 4] = rng.integers(1, 1 << 62, (40, n // 4), dtype=np.uint64)
        s = minhash.sketches(np.concatenate([a, b]).reshape(-1), np.repeat(np.arange(80), n), 80)
        j = (n - n // 4) / (n + n // 4)
        assert (s != 0).all() and abs((s[:40] == s[40:]).mean() - j) < 0.03


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(7, 7)] + [(500, i) for i in range(501, 560)]
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 and 6
TRICKY = [None, "", " ", "  a", "a  ", "it's we'll 'sa ''s x'Ve", "<|endoftext|>", " <|endoftext|>  b<|endoftext|><|endof", "aaaa" * 700, "=" * 3000, "\n\n\r\n x\t\ty", "漢字とé ²½ 🙂",
          "\x1c\x85  z", "á ǅ ª", "日本語" * 900, "\\u0000 \x00"]


def test_tokens_and_codec(spark):
    rng = random.Random(8)
    alphabet = ["a", "s", "t", "'", "re", "ll", "'s", " ", "  ", "\n", "é", "漢", "1", "²", "!", " the", "THE", "<|endoftext|>", "Hello", "ÿ", "🙂"]
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "x", None, None), (0, None, None, None)])
    tok = Tokenizer.from_file(BPE)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for r in token_counts.op5_token_counts(docs, BPE).collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), len(want[r["doc_id"]]), len(want[r["doc_id"]]) > 1024)
    for r in bpe_codec.op6_bpe_codec(docs, BPE).collect():
        if r["doc_id"] is not None:
            ids = want[r["doc_id"]]
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
            assert r["decoded_sha256"] == sha(tok.decode(ids, skip_special_tokens=False))
    encoded = bpe_codec.encode(docs, BPE)
    assert {r["row"]["doc_id"]: r["ids"] for r in encoded.where("row.doc_id > 0").collect()} == {i: x for i, x in want.items() if i}
    assert {r["row"]["doc_id"]: r["text"] for r in bpe_codec.decode(encoded, BPE).where("row.doc_id > 0").collect()} == {i: t for i, t in enumerate(texts) if i}
    assert token_counts.op5_token_counts(docs.limit(0), BPE).count() == bpe_codec.op6_bpe_codec(docs.limit(0), BPE).count() == 0


def test_states_start_afresh():
    from mailsignal.llm import bpe
    words_ = token_counts.WordTransducer(bpe.load(BPE), max_states=20)
    tok = Tokenizer.from_file(BPE)
    for w in ["hello", " world", "hello", "antidisestablishment", "zzzzzzzz", " the"] * 3:
        assert words_.count(w.encode()) == len(tok.encode(w).ids)


# 7
@pytest.mark.parametrize("part", [7, 1024])
def test_chat(spark, monkeypatch, part):
    monkeypatch.setattr(chat_format, "PART", part)
    rows = [(1, 0, "system", "a<b>\\"), (1, 1, "user", "</turn>\n<turn assistant>"), (1, 2, "assistant", "ok \\< 漢"), (1, 3, "user", None), (1, 4, "assistant", ""),
            (1, 5, "user", "bye"), (2, 0, "user", "x"), (None, 1, "assistant", "n"), (None, None, None, None), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup")]
    rows += [(9, i, "assistant" if i % 2 else "user", "w" * (i % 7)) for i in range(300)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, example int, n_turns int")
    got = {r["conv_id"]: r for r in chat_format.op7_chat_format(turns).collect()}
    whole = rows + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert set(got) == {r[0] for r in whole}
    for conv, r in got.items():
        mine = sorted((x for x in whole if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))
    for r in chat_format.expand(turns).where("conv_id = 1").collect():
        read = chat_format.read_turns(r["text"])
        assert read == [(x[2], x[3] or "") for x in rows[:len(read)]]
    assert chat_format.op7_chat_format(turns.limit(0)).count() == 1


def test_a_long_conversation_is_many_parts(spark, monkeypatch):
    """A third of all rows in one conversation: no task but the one of its digest gets more than its part and what leads up to it."""
    rows = [(1, i, "assistant" if i % 5 == 4 else "user", f"t{i} " + "y" * (200_000 if i == 8 else 3)) for i in range(500)] + [(2 + i // 4, i % 4, "assistant" if i % 2 else "user", "z") for i in range(1000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "PART", 100)
    t = chat_format.numbered(turns)
    assert sorted(r["place"] for r in t.where("conv = 1").collect()) == list(range(500))
    out = chat_format.expand(turns)
    places = out.where("conv_id = 1").groupBy(F.spark_partition_id().alias("p"), F.expr("example div 100").alias("part")).count().groupBy("part").count().collect()
    assert len(places) == 5 and all(r["count"] == 1 for r in places)
    assert out.where("conv_id = 1").count() == 100 and out.where("last").count() == 251
    last = out.where("conv_id = 1 and last").first()
    assert chat_format.read_turns(last["text"]) == [(r, x) for _, _, r, x in rows[:500]]


# 8
def test_gradient():
    net = quality_classifier.Network(prior=0.7)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    buf = np.frombuffer(b"some text here, and more of it!!" * 3 + b"short", np.uint8)
    offs, label = np.array([0, 96, 96, 101]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.probability(net.pooled(buf, offs)[-1])
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))
    grad = net.gradient(buf, offs, label)
    rng = np.random.default_rng(0)
    for name in net.NAMES:
        flat = net.w[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - grad[name].reshape(-1)[i]) < 2e-4


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    test = both[both["held_out"]]
    good, bad = test[test["quality"] == 1]["score"].to_numpy(), test[test["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.85
    odd = frame(spark, [(i, t, None, None) for i, t in enumerate([None, "", "x", "a b c", "a b c"])] + [(None, "n", None, None), (1, "", None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.op8_quality_classifier(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.op8_quality_classifier(odd, some).count() == 7
    assert quality_classifier.op8_quality_classifier(odd.limit(0), some).count() == 0


# 9
def brute_targets(totals, share=1.5, most=2.0):
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(totals.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * totals[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * totals[s] for s in above}
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(int(rng.lognormvariate(4, 1)))), None, rng.choice(["a", "b", "B", "é", "z", "tiny", None][: 5 + (i % 50 == 0) * 2])) for i in range(3000)]
    rows += [(4000, None, None, "a"), (4001, "", None, "blank"), (None, "x y", None, "a"), (5, rows[5][1], None, rows[5][3])]
    docs = frame(spark, rows)
    got = mixing.op9_mixing(docs).collect()
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += len(words(t))
    target = brute_targets(dict(totals))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, t, *_ in rows)
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]] if r["doc_id"] is not None else "a"
        assert r["source_size"] == totals[s] and abs(r["target"] - target[s]) < 1e-6 * (1 + target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in totals:
        assert abs(taken[s] - target[s]) <= max(3, 0.002 * target[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.op9_mixing(docs.repartition(7)).collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(out.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))).rdd.map(tuple).collectAsMap()) == +taken
    assert mixing.op9_mixing(docs.limit(0)).count() == 0


def test_dual_solution(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 400), None, rng.choice("abc")) for i in range(900)]
    mixed = mixing.mix(frame(spark, rows))
    h = mixed.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = mixed.groupBy("source").agg(F.first("total").alias("total"), F.first("target").alias("target"))
    for r in mixing.multipliers(h, totals).where("free").collect():
        sizes = np.array([len(words(t)) for _, t, _, s in rows if s == r["source"]], float)
        assert abs((2 / (1 + np.exp(-r["multiplier"] * sizes / r["mean"])) * sizes).sum() - r["target"]) < 1e-4 * r["target"]


def test_mixing_hot_rows_and_many_sources(spark, monkeypatch):
    """A third of all rows alike in id and text, and one source a host."""
    monkeypatch.setattr(mixing, "SPREAD", 50)
    rng = random.Random(12)
    rows = [(5, "same words here again " * 3, "en", "s007")] * 500 + [(None, None, "en", None)] * 3
    rows += [(100 + i, " ".join(["w"] * rng.randrange(1, 60)), "en", f"s{rng.randrange(300):03d}") for i in range(1000)]
    docs = frame(spark, rows)
    got = mixing.op9_mixing(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += len(words(t))
    want = brute_targets(dict(totals))
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 60 for s, t in want.items())
    mine = [r["taken"] // 12 for r in got if r["doc_id"] == 5]
    assert max(mine) - min(mine) <= 1
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert out == Counter({r["doc_id"]: 0 for r in got}) + sum((Counter({r["doc_id"]: r["taken"] // r["size"]}) for r in got if r["size"]), Counter())
    assert max(r["alike"] for r in mixing.mix(docs).select("alike").collect()) == 500


def test_newton_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.op9_mixing(frame(spark, [(i, "a b c " * (i + 1), "en", "ab"[i % 2]) for i in range(40)])).collect()


# 10
def brute_quality(text, k):
    w = words(text)
    n = len(w)
    grams = lambda m: Counter(tuple(w[i:i + m]) for i in range(n - m + 1))
    three = grams(3)
    repeat = {i + j for i in range(n - 2) if three[tuple(w[i:i + 3])] > 1 for j in range(3)}
    cover, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            m = 0
            while i != j and max(i, j) + m < n and w[i + m] == w[j + m]:
                m += 1
            best = max(best, m)
        if best >= k:
            longest = max(longest, best)
            cover |= set(range(i, i + best))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat), "covered_words": len(cover), "longest_repeat": longest}


def test_quality_rules(spark):
    rng = random.Random(3)
    texts = [None, "", "\n \n", "x\n\ny\nx\n x\r\nx\r\nx", "ab " * 70, "é# " * 3]
    texts += [" ".join(rng.choice(["a", "b", "é", "|", "c\n"]) for _ in range(rng.randrange(1, 70))) for _ in range(120)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "n", None, None), (7, texts[7], None, None)]
    docs = frame(spark, rows)
    for r in quality_rules.measure(docs, ["doc_id"], 4).collect():
        want = brute_quality("n" if r["doc_id"] is None else texts[r["doc_id"]], 4)
        assert {k: r[k] for k in want} == want
    kept = quality_rules.keep_good(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == quality_rules.op10_quality_rules(docs).where("kept").count()
    assert quality_rules.op10_quality_rules(docs.limit(0)).count() == 0


# pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(graph.stored(stage(spark, tables[-1], SMALL), "stage"))
    assert all(t.columns == docs.columns for t in tables[:5])
    rows = [[(r["doc_id"], r["text"], r["lang"], r["source"]) for r in t.collect()] for t in tables[:5]]
    good = lambda b: b["n_words"] >= 50 and 2 * b["n_repeat_words"] <= b["n_words"] and b["covered_words"] <= 0.3 * b["n_words"] and b["longest_repeat"] <= 150
    short = lambda t: len(words(t)) < 50 or len(words(t)) > 900  # noqa: E731 the brute force is cubic
    judged = [r for r in rows[0] if len(words(r[1])) < 50 or not short(r[1])]
    assert {r[0] for r in judged if good(brute_quality(r[1], quality_rules.MIN_REPEAT))} == {r[0] for r in rows[1]} & {r[0] for r in judged}
    assert {r[0] for r in rows[2]} == {r[2] for r in brute_near(rows[1])}
    cut = {i: (h, n - m) for i, n, m, h in brute_repeats(rows[2])}
    assert {r[0]: sha(" ".join(words(r[1]))) for r in rows[3]} == {i: h for i, (h, left) in cut.items() if left}
    totals = Counter()
    for r in rows[3]:
        totals[r[3]] += len(words(r[1]))
    taken = Counter()
    for r in rows[4]:
        taken[r[3]] += len(words(r[1]))
    longest = max(len(words(r[1])) for r in rows[3])
    for s, t in brute_targets(dict(totals)).items():
        assert abs(taken[s] - t) <= longest
    assert max(Counter(r[0] for r in rows[4]).values()) <= 2
    tok = Tokenizer.from_file(BPE)
    want = Counter((r[0], tuple(tok.encode(r[1], add_special_tokens=False).ids)) for r in rows[4])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tables[5].collect()) == want
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
