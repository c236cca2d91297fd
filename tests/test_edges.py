"""Hand-made edge frames per operator (null, empty, limits, bin edges, ties)."""

from pyspark.sql import functions as F

from mailsignal.functions import features as E
from mailsignal.functions import text as T
from mailsignal.operators import analytics as K
from mailsignal.operators import evaluate as J
from mailsignal.operators import parse as C
from mailsignal.operators import retention as R
from mailsignal.operators import score as S


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(cols[0]).collect()]


def test_admission_edges(spark):
    data = [(1, None), (2, ""), (3, "   \n\t "), (4, "x" * 10000), (5, " " + "y" * 10001), (6, "ok")]
    df = spark.createDataFrame(data, "id int, text string")
    got = dict(rows(df.withColumn("r", S.reject_reason("text")), "id", "r"))
    assert got[1] == got[2] == got[3] == "empty"
    assert got[4] is None and got[6] is None
    assert got[5] == "too_long"
    assert sorted(r.id for r in S.admissible(df).collect()) == [4, 6]
    assert sorted(r.id for r in S.not_blank(df).collect()) == [4, 5, 6]      # scoring has no length limit


def test_clean_text_edges(spark):
    data = [(1, None), (2, ""), (3, "<p>Hello&amp;Bye</p> http://x.y/z a@b.c 123 É ok 😀"), (4, "only 123 456")]
    df = spark.createDataFrame(data, "id int, text string")
    got = dict(rows(df.withColumn("c", T.clean_text("text")), "id", "c"))
    assert got[1] == "" and got[2] == "" and got[4] == "only"
    assert got[3] == "hello bye ok"


def test_url_edges(spark):
    t = "see http://a.com/x?y=1 and http://b.orghttp://c.net <http://d.io> HTTP://E.COM xhttp://f.g 1.2.3.4 t.com"
    df = spark.createDataFrame([(t,)], "text string")
    r = df.select(E.url_list("text").alias("u"), E.url_count_escaped("text").alias("b"),
                  E.url_count_http("text").alias("c"), E.has_shortener_in_text("text").alias("s")).first()
    assert r.u[0] == "http://a.com/x?y=1"
    assert "http://b.orghttp://c.net" in r.u           # the range class swallows ':' and '/'
    assert r.b == 4                                     # escaped class stops at "/" and ":"
    assert r.c == 5 and r.s is True                     # 't.com' hits 't.co'


def test_sender_edges(spark):
    data = [(1, "Name <a@b.c>"), (2, "a@b.c"), (3, ""), (4, "noreply@x.org"), (5, "joe99@x.org"), (6, "x@1.2")]
    df = spark.createDataFrame(data, "id int, s string")
    got = rows(df.select("id", C.address_name("s").alias("n"), C.address_email("s").alias("e"),
                         E.sender_suspicious("s").alias("k")), "id", "n", "e", "k")
    assert got[0] == (1, "Name", "a@b.c", False)
    assert got[1] == (2, "", "a@b.c", False)
    assert got[2] == (3, "", "", False)
    assert [g[3] for g in got[3:]] == [True, True, True]


def test_header_edges(spark):
    data = [(1, "Subject: hi\nfrom: A <a@b.c>\nSubject: second\n\nbody text"),
            (2, "no header here\n\nbody"),
            (3, "\nSubject: hidden?\n\nbody"),
            (4, "From: x@y.z\nnot a header line\nmore"),
            (5, "Subject: one\n two\n\tthree\nTo: a@b.c\n\nbody")]
    df = spark.createDataFrame(data, "id int, raw_text string")
    got = {r.id: r for r in C.split_headers(df).collect()}
    assert got[1].subject == "hi" and got[1].sender == "A <a@b.c>" and got[1].body == "body text"
    assert got[2].subject == "" and got[2].body == "no header here\n\nbody"
    assert got[3].subject == "hidden?"                  # the leading newline is trimmed first
    assert got[5].subject == "one two three" and got[5].receiver == "a@b.c" and got[5].body == "body"
    assert got[4].sender == "x@y.z" and got[4].body == "not a header line\nmore"


def test_risk_and_band_edges(spark):
    df = spark.createDataFrame([(40,), (70,), (71,), (100,), (41,)], "risk_score int")
    got = dict(rows(df.withColumn("b", S.risk_band("risk_score")), "risk_score", "b"))
    assert got == {40: "success", 41: "warning", 70: "warning", 71: "danger", 100: "danger"}
    txt = "urgent verify suspended click here limited time act now congratulations winner lottery prize " \
          "http://a http://b"
    a = S.analyze(spark.createDataFrame([(txt,)], "text string")).first()
    assert a.risk_score == 100 and a.suspicious_indicators[0] == "Contains 2 URL(s)"
    assert a.suspicious_indicators[1] == "Suspicious keywords: urgent, verify, suspended, click here, limited time"


def test_confidence_bins_and_cutoff(spark):
    ts = "2024-01-31 00:00:00"
    data = [(0.7, "2024-01-30 00:00:00"), (0.9, "2024-01-30 00:00:00"), (0.69, "2024-01-30 00:00:00"),
            (0.95, "2024-01-29 23:59:59")]
    df = spark.createDataFrame(data, "confidence double, t string").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    b = K.confidence_bins(df, ts, hours=24).first()
    assert (b.high_confidence, b.medium_confidence, b.low_confidence) == (1, 1, 1)   # cutoff row included


def test_empty_log_statistics(spark):
    df = spark.createDataFrame([], "model_name string, prediction int, confidence double, risk_score double, "
                                   "timestamp timestamp_ntz")
    r = K.prediction_statistics(df, "2024-04-30 00:00:00").first()
    assert (r.total_predictions, r.phishing_rate, r.average_confidence) == (0, 0.0, 0.0)


def test_feedback_ties_unknown_and_idempotence(spark):
    tr = spark.createDataFrame(
        [(1, "h", 1, 0.9, None, None, "2024-01-01 00:00:00"), (2, "h", 0, 0.8, None, None, "2024-01-01 00:00:00"),
         (3, "g", 1, 0.7, 1, "initial", "2024-01-01 00:00:00")],
        "id long, email_hash string, prediction int, confidence double, actual_label int, user_feedback string, t string"
    ).withColumn("created_at", F.col("t").cast("timestamp_ntz")).withColumn("timestamp", F.col("created_at")).drop("t")
    fb = spark.createDataFrame([(10, "h", 1, "user_correction", "2024-01-02 00:00:00"),
                                (11, "zz", 0, "user_correction", "2024-01-02 00:00:00")],
                               "feedback_id long, email_hash string, actual_label int, feedback string, t string") \
        .withColumn("feedback_at", F.col("t").cast("timestamp_ntz")).drop("t")
    once = R.feedback_apply(tr, fb)
    got = {r.id: (r.actual_label, r.correct) for r in once.collect()}
    assert got[2] == (1, 0) and got[1] == (None, None)          # equal time: the higher id is the latest
    twice = R.feedback_apply(once, fb)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert [r.email_hash for r in R.feedback_unmatched(tr, fb).collect()] == ["zz"]


def test_orphans_with_null_ids(spark):
    e = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (2, "2020-01-01 00:00:00")], "id long, t string") \
        .withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    p = spark.createDataFrame([(None,), (1,)], "email_id long")
    assert [r.id for r in R.orphan_emails(e, p, "2024-01-01 00:00:00").collect()] == [2]
    assert R.orphan_predictions(e, p).count() == 1


def test_metric_edges(spark):
    df = spark.createDataFrame([("m", 1, 0, 0.5), ("m", 1, 0, 0.5), ("m", 0, 0, 0.5)],
                               "model_name string, label int, prediction int, score double")
    m = J.binary_metrics(df, "model_name").first()
    assert (m.precision, m.recall, m.f1_score) == (0.0, 0.0, 0.0)
    assert J.roc_auc(df, "model_name").first().roc_auc == 0.5         # all scores tied
    single = spark.createDataFrame([("m", 1, 1, 0.2)], "model_name string, label int, prediction int, score double")
    assert J.roc_auc(single, "model_name").first().roc_auc is None


def test_patterns_on_long_inputs(spark):
    url = "http://" + "a1%20b/" * 30_000
    data = [(1, url), (2, "\n".join(f"X-{i}: v" for i in range(20_000)) + "\n\nbody"), (3, "x" * 1_000_000), (4, "a@" + "b" * 1_000_000 + " ok")]
    df = spark.createDataFrame(data, "id int, raw_text string")
    got = {r.id: r for r in df.select("id", E.url_list("raw_text").alias("u"), E.url_count_escaped("raw_text").alias("n"),
                                      T.clean_text("raw_text").alias("c")).collect()}
    assert got[1].u == [url] and got[1].n == 1 and got[4].c == "ok" and got[3].c == "x" * 1_000_000
    heads = {r.id: r for r in C.split_headers(df).collect()}
    assert heads[2].body == "body" and heads[2].header_block.count("X-") == 20_000


def test_safe_patterns_equal_the_originals(spark):
    import random
    import re
    from mailsignal import lexicon as L
    rng = random.Random(5)
    parts = ["http://", "https://", "a.b", "/x?y=1", "%2f", "%zz", "%", "$-_", "!*\\(),", " ", "~", "#", "é", "x@y.z", "@", "@a", "b@"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", E.url_list("t").alias("a"), E.url_count_escaped("t").alias("b"), F.regexp_replace("t", T.EMAIL_TOKEN, " ").alias("c")).collect():
        t = texts[r.id]
        assert r.a == re.findall(L.URL_PATTERN_RANGE, t) and r.b == len(re.findall(L.URL_PATTERN_ESCAPED, t))
        assert r.c == re.sub("[^ ]+@[^ ]+", " ", t)


def test_null_labels_stay(spark):
    from mailsignal.operators import split as G
    df = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(30)], "id int, label int")
    assert G.stratified_split(df, "id").count() == G.class_weights(df).count() == G.stratified_folds(df, "id").count() == 30
    assert {r.label: r["count"] for r in G.stratified_split(df, "id").filter("split = 'test'").groupBy("label").count().collect()} == {0: 2, 1: 2, None: 2}


def test_porter_worked_examples(spark):
    from plain_porter import stem
    from mailsignal.functions import stemming
    examples = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
                "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
                "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper",
                "formaliti": "formal", "triplicate": "triplic", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
                "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat",
                "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in examples} == examples
    odd = ["", "a", "is", "yyy", "yyyyyyyy", "syzygy", "ayyyyying", "toyed", "flying", "dying", "sayings", "CVCied", "naïveness", "x" * 5000 + "ational", "ing", "ions", "ties", "eeded",
           "oed", "aeiou", "ylyyly", "byyyyyyyyyyyyyyyyyyyyyyyying", "playfulness", "employabiliti", "hissing", "fizzed", "tryst", "gypsies", "ya", "yay"]
    import random
    rng = random.Random(5)
    odd += ["".join(rng.choice("aeiouyybtsnl") for _ in range(rng.randrange(3, 9))) + rng.choice(["", "ed", "ing", "ational", "iviti", "ly", "e", "ll", "ness", "sion", "ies"]) for _ in range(1500)]
    df = spark.createDataFrame([(0, [*examples, *odd]), (1, []), (2, None)], "id int, t array<string>")
    got = {r.id: r.s for r in df.select("id", stemming.stems("t").alias("s")).collect()}
    assert got == {0: [stem(w) for w in [*examples, *odd]], 1: [], 2: None}
    assert "Python" not in df.select(stemming.stems("t"))._jdf.queryExecution().executedPlan().toString()


def test_stem_job_gives_the_expressions_stems(spark, monkeypatch):
    """The job stems a word once for all rows of a slice; null lists, empty lists and null words as in the expressions."""
    import random
    from plain_porter import stem
    from mailsignal.functions import stemming
    from mailsignal.operators import stem as J
    rng = random.Random(11)
    words = ["", "a", "is", "yyyyyyyy", "syzygy", "ayyyyying", "CVCied", "naïveness", "x" * 5000 + "ational", "ions", "eeded", "ylyyly", "e", "ee", "feed", "agreed", "sky"]
    words += ["".join(rng.choice("aeiouyybtsnlz") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "ed", "ing", "ational", "iviti", "ly", "e", "ll", "ness", "sion", "ies", "eed", "at", "s"])
              for _ in range(4000)]
    assert [stemming.word_stem(w) for w in words] == [stem(w) for w in words]
    rows = [(7, words), (7, words[:40]), (None, ["flying", None, "flying"]), (1, []), (2, None)] + [(i, ["relational", words[i]]) for i in range(1300)]
    df = spark.createDataFrame(rows, "id long, t array<string>").coalesce(1)
    key = lambda r: (str(r[0]), str(r[1]))
    want = sorted(map(tuple, df.select("id", stemming.stems("t")).collect()), key=key)
    job = J.stem_tokens(df, "t", "id")
    assert job.dtypes == [("id", "bigint"), ("lemmas", "array<string>")] and sorted(map(tuple, job.collect()), key=key) == want
    assert (None, [stem("flying"), "", stem("flying")]) in want
    import pyarrow as pa
    stemmed = []
    monkeypatch.setattr(J, "_known_stem", lambda w: stemmed.append(w) or stem(w))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([["cats", "cats", "ponies"]] * 400)], names=["id", "t"])
    assert [b.column(1).to_pylist() for b in J._stem_batches(iter([batch]))] == [[["cat", "cat", "poni"]] * 400] and sorted(stemmed) == ["cats", "ponies"]
