"""Collocations, URL filters and structure repair against brute force, with nulls, ties, repeated rows, empty tables,
very long values and clashing extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailsignal.llm import collocations, structure_repair, url_filter

CLASHING = ("row", "t", "d", "key", "v", "n", "a", "l", "r", "rank", "score", "at", "conv", "host", "path", "rule", "tokens", "x", "y", "theta")


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


# 11
def brute_phrases(rows, least, limit, drop):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    gone = set()
    for (lang, p), (_, a, _, _) in found.items():
        for q in (p[:2], p[1:]) if len(p) == 3 else ():
            if (lang, q) in found and 100 * a >= drop * found[lang, q][1]:
                gone.add((lang, q))
    out = []
    for lang in {g for g, _ in found}:
        rank = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in found.items() if g == lang and (g, p) not in gone)
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rank[:limit])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(25)] + ["É", "x-y", "it's", "\u00a0b", "Zed", "日本"]
    fixed = ["New york city", "a priori", "in  the\tend", "Ha ha ha ha"]
    rows = [(None, "en"), ("", None), (" \t\n", "en"), ("...;", None), ("one", "de"), (None, None), ("z z " * 40, "xx")]
    for _ in range(n):
        t = []
        for _ in range(rng.randrange(1, 14)):
            t.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(names))
            t.append(rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "!", " \r\n"]))
        rows.append(("".join(t), rng.choice(["en", "en", "en", "de", None])))
    return rows + rows[20:40] * 3


@pytest.mark.parametrize("limit", [3, 12, 10**6])
def test_collocations(spark, limit):
    rows = texts(1, 400)
    docs = clashing(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    got = sorted(map(tuple, collocations.collocations(docs, 5, limit).collect()))
    assert got == brute_phrases(rows, 5, limit, 50)
    assert collocations.op11_collocations(docs.limit(0)).count() == 0


def test_collocations_over_many_slices(spark, monkeypatch):
    rows = texts(2, 150) + [(" ".join(random.Random(3).choices(["red", "green", "blue", "a priori"], k=30_000)), "en")]
    monkeypatch.setattr(collocations, "SLICE", 500)
    docs = spark.createDataFrame(rows, "text string, lang string")
    batches = list(collocations._count_rows(2, type("S", (), {"value": {"word": collocations.np.full(1 << (collocations.BITS - 6), 2**64 - 1, "uint64")}}))(
        docs.select("lang", "text").where("lang is not null and text <> ''").toArrow().to_batches()))
    seen = Counter()
    for b in batches:
        for g, p, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            seen[g, p] += n
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if lang else ():
            w = re.findall("[^\x20\x09]+", piece)
            want.update((lang, f"{a} {b}") for a, b in zip(w, w[1:]))
    assert seen == want


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 10**13 - 7, 10**13 + 9, 10**13 - 3
    got = spark.sql(f"select {a}L a, {l}L l, {r}L r").select(collocations._score("a", "l", "r")).first()[0]
    assert got == 10**6 * a * a // (l * r)


# 12
def brute_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def brute_rule(host, path, rules=url_filter.RULES):
    fits = [(len(h + p), len(h), h + p, what) for what, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def brute_mine(urls, least, percent, longest):
    sets = Counter()
    bad = Counter()
    for tokens, is_bad in urls:
        for k in range(1, longest + 1):
            for s in itertools.combinations(sorted(tokens), k):
                sets[s] += 1
                bad[s] += is_bad
    strong = {s: (n, bad[s]) for s, n in sets.items() if bad[s] >= least and 100 * bad[s] >= percent * n}
    return {s: v for s, v in strong.items() if not any(o != s and set(o) < set(s) and strong[o][1] * v[0] >= v[1] * strong[o][0] for o in strong)}


def some_urls(seed, n):
    rng = random.Random(seed)
    rows = [(None, None), (1, None), (2, ""), (3, "no scheme/here"), (4, "HTTP://EXAMPLE.com"), (5, "http://Example.COM/en/1?q=1#x"), (6, "http://www.example.com/en/"),
            (7, "x://net/es/"), (8, "x://a.net/fr/b"), (9, "x://notexample.com/en/a"), (10, "http://com/"), (11, "http://.net/es/"), (12, "a://b://c.net/fr/"),
            (13, "http://h.org/" + "seg/" * 5000), (14, "http://h.org/p\nq?x=1&x=2&y")]
    for i in range(n):
        top = rng.choice(["org", "org", "net", "com", "info"])
        url = f"http{rng.choice(['', 's'])}://{rng.choice(['www', 'm', 'shop'])}.{rng.choice(['alpha', 'beta', 'casino', 'delta'])}.{top}/{rng.choice(['en', 'es', 'win', 'pics'])}/{rng.randrange(99)}{rng.choice(['', '?ref=1', '#top', '?win=2'])}"
        rows.append((100 + i, url))
    return rows + rows[40:60] + [(100, "http://other.org/en/")]


def test_url_filter(spark):
    rows = some_urls(4, 600)
    marks, rng = [(None, 0, 1)], random.Random(5)
    for i, u in rows[15:500]:
        evil = "casino" in u or ("win" in u and "/pics" in u)
        marks.append((i, 0 if evil and rng.random() < 0.9 else 1, 1 if evil and rng.random() < 0.3 else 0))
    marks += [(100_000, 0, 1), (120, None, None)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string").repartition(3))
    labels = clashing(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    known = url_filter.labelled(pages, labels)
    mined = url_filter.mine(known)
    pairs = [(tuple(r["tokens"]), r["bad"]) for r in known.collect()]
    total = len(pairs)
    want = brute_mine(pairs, max(10, -(-total * 2 // 1000)), 60, 3)
    assert {tuple(r["tokens"]): (r["n"], r["bad"]) for r in mined.collect()} == want and ("host=casino",) in want and any(len(s) > 1 for s in want)
    tokens = {r["u"]: set(r["t"]) for r in spark.createDataFrame(rows, "page_id long, u string").select("u", url_filter.host("u").alias("host"), url_filter.path("u").alias("path")).select("u", url_filter.tokens("u").alias("t")).collect()}
    expected = []
    for i, u in rows:
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        expected.append((i, host, path, rule, verdict or ("block" if any(set(s) <= tokens[u] for s in want) else "allow")))
    got = url_filter.op12_url_filter(pages, labels)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert {x[4] for x in expected if x[3] is None} == {"allow", "block"}
    assert url_filter.op12_url_filter(pages.limit(0), labels).count() == 0
    bare = url_filter.op12_url_filter(pages, labels.limit(0))
    assert bare.count() == len(rows) and bare.where("rule is null and verdict = 'block'").count() == 0


def test_urls_of_many_tokens_give_every_rule(spark):
    rng, known = random.Random(11), []
    for i in range(300):
        some = [f"t{j:02d}" for j in range(18) if rng.random() < 0.8] + ["always"] + ["twin1", "twin2"] * (rng.random() < 0.4)
        evil = {"t03", "t11"} <= set(some) and "t07" not in some or "twin1" in some and rng.random() < 0.7
        known.append((i, sorted([*some, *["evil"] * (evil and rng.random() < 0.2)]), evil))
    want = brute_mine([(t, b) for _, t, b in known], 10, 60, 3)
    urls = spark.createDataFrame(known, "id long, tokens array<string>, bad boolean")
    assert {tuple(r["tokens"]): (r["n"], r["bad"]) for r in url_filter.mine(urls).collect()} == want
    assert {len(s) for s in want} == {1, 2, 3}


def test_long_urls_do_not_explode_the_mining(spark):
    rows = [(i, "http://" + ".".join(f"l{j}" for j in range(40)) + ".org/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert url_filter.op12_url_filter(pages, labels).where("verdict = 'block'").count() == 60


# 13
def brute_repair(rows):
    """Cheapest edits of (role, text) rows by exhaustive forward search over best strings; report and lines."""
    seen, faults = set(), []
    for role, text in rows:
        if not re.search("[^\x20\x09-\x0d]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))

    def closed(states):
        for _ in range(3):
            for (cost, edits, lines) in list(states.values()):
                for role in ("user", "assistant"):
                    add(states, cost + 3, edits + "I", lines + [(role, "")])
        return states

    def add(states, cost, edits, lines):
        made = "".join(r[:1] if r[:1] else "-" for r, _ in lines)
        if not re.fullmatch("s?(ua)*u?", made):
            return
        # what can follow depends on the end only
        end = "0" if not made else made[-1]
        if end not in states or (cost, edits) < states[end][:2]:
            states[end] = (cost, edits, lines)

    states = closed({"0": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        new = {}
        for cost, edits, lines in states.values():
            add(new, cost + 4, edits + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                add(new, cost + more, edits + "K", lines + [(role, text)])
                for other in ("user", "assistant"):
                    add(new, cost + 3 + more, edits + "R", lines + [(other, text)])
        states = closed(new)
    cost, edits, lines = min(states[e] for e in ("0", "a") if e in states)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = Counter(faults)
    return (count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits), "\n".join(f"{r}:{t}" for r, t in lines)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", None), (-3, None, None, "what?"), (-4, 5, "", "x."), (-5, 1, "user", "")]
    for c in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", None])
            rows.append((c, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No!", "why ?\n", "cut off", "Café…", " ", "", None, f"t{rng.randrange(4)}."])))
    return rows


def brute_op13(rows):
    out = {}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        (blank, dup, cut, illegal, cost, edits), lines = brute_repair([r[1:] for r in turns])
        real = [t for t, _, _ in turns if t is not None]
        gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
        out[c] = (gaps, blank, dup, cut, illegal, cost, edits, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.mark.parametrize("least_segment", [2, 1024])
def test_structure_repair(spark, monkeypatch, least_segment):
    monkeypatch.setattr(structure_repair, "LEAST_SEGMENT", least_segment)
    rows = conversations(least_segment, 150)
    rng = random.Random(7)  # one conversation holds a third of all rows
    rows += [(10_000, i, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.choice('abc')}{i // 3} {rng.choice(['.', '', '!'])}") for i in range(len(rows) // 2)]
    rng.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = {r["conv_id"]: tuple(r)[1:] for r in structure_repair.op13_structure_repair(df).collect()}
    assert got == brute_op13(rows)
    assert structure_repair.op13_structure_repair(df.limit(0)).count() == 0


def test_segments_are_bounded(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}." + "y" * (100_000 if i == 5 else 0) + ".") for i in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = structure_repair._numbered(df)
    assert structure_repair._segments(numbered).agg(F.max(F.size("codes"))).first()[0] <= structure_repair.LEAST_SEGMENT
    report, lines = structure_repair.repair(df)
    assert [tuple(r) for r in report.select("cost", "audit").collect()] == [(0, "K" * 9000)]
    assert [r.text for r in lines.orderBy("at", "place").select("text").collect()] == [r[3] for r in rows]


def test_walk_keeps_checkpoints_only():
    rng = random.Random(9)
    for n in (1, 2, 7, 100):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 9, 13, 14]) for _ in range(n))
        state, edits = structure_repair.walk(codes, structure_repair._inserted(structure_repair.AT_END), structure_repair.START, True)
        end = structure_repair._inserted(structure_repair.AT_END)
        assert state in (structure_repair.START, structure_repair.A) and sum(e != "I" for e in edits) == n
        cost = {"D": 4, "I": 3, "K": 0, "R": 3}
        spent = sum(cost[e] for e in edits)
        kept = [e for e in edits if e != "I"]
        spent += sum(3 for e, c in zip(kept, codes) if e != "D" and c >> 2 == structure_repair.CUT)
        assert spent == structure_repair._backward(codes, end)[structure_repair.START]
