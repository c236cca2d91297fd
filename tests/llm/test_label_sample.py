"""op8_quality_classifier: labels of ids without a document take no place of the sample."""

from mailsignal.llm import quality_classifier


def test_sample_is_of_present_documents(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality_classifier, "SAMPLE", 10)
    monkeypatch.setattr(quality_classifier, "train", lambda labelled: taken.append(labelled.count()) or {})
    labels = spark.range(2000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    docs = spark.range(0, 2000, 50).selectExpr("id as doc_id", "concat('text ', id) as text")     # 40 of 2,000 labelled ids
    assert quality_classifier.op8_quality_classifier(docs, labels).count() == 40
    assert taken == [10]
