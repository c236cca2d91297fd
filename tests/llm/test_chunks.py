"""op1_top_k: chunks and blocks stay small where one id carries many vectors."""

from pyspark.sql import functions as F

from mailsignal.llm import topk


def test_one_id_with_many_vectors(spark, monkeypatch):
    def sizes(k, gather):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                n, q = ([len(x) for x in batch.column(i).to_pylist()] for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (n, q, n)], names=["query_id", "vec_id", "score"])
        return run
    monkeypatch.setattr(topk, "_meet", sizes)
    vectors = spark.range(400).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    got = topk.top_k(vectors, F.col("v") == 7, chunk=20, block=20).collect()
    assert got and max(r.query_id for r in got) <= 60 and max(r.vec_id for r in got) <= 60     # 20 expected, 400 by id alone
