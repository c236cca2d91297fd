"""File sources and sinks on hand-made inputs."""

import os
import tempfile

from pyspark.sql import functions as F

from mailsignal.sources import files

from conftest import SMALL


def test_mail_file_scan(spark):
    d = tempfile.mkdtemp(prefix="mails-")
    with open(os.path.join(d, "a.TXT"), "wb") as f:
        f.write("Subject: hi\n\nbody é".encode() + b"\xff\xfe")
    with open(os.path.join(d, "b.eml"), "wb") as f:
        f.write(b"   \n ")
    with open(os.path.join(d, "c.pdf"), "wb") as f:
        f.write(b"ignored")
    with open(os.path.join(d, "archive.tar.msg"), "wb") as f:
        f.write(b"From: x@y.z\n\nhello")
    got = {os.path.basename(r.path): (r.text, r.reject_reason) for r in files.read_mail_files(spark, d, max_bytes=24).collect()}
    assert set(got) == {"a.TXT", "b.eml", "archive.tar.msg"}
    assert got["a.TXT"] == ("Subject: hi\n\nbody é", None) and got["b.eml"][1] == "empty"
    assert {r.reject_reason for r in files.read_mail_files(spark, d, max_bytes=3).collect()} == {"too_large"}


def test_csv_roundtrip_equals_direct(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    a = q["csv_corpus_roundtrip"](spark, SMALL)
    b = q["corpus_preprocess"](spark, SMALL)
    cols = sorted(b.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_json_result_has_nested_fields(spark):
    import json
    from mailsignal.sources import files, logs
    s = logs.scored_mails(spark, SMALL)
    doc = json.loads(s.select(files.result_json(s).alias("result_json")).first().result_json)
    assert set(doc) == {"individual_predictions", "ensemble_prediction", "email_analysis", "timestamp"}
    assert set(doc["individual_predictions"]) == {"random_forest", "svm"}
