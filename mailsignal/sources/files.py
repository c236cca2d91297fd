"""File sources and sinks: labelled CSV corpora (A1, A2), uploaded mail files (A3),
JSON request/result text (A11, A12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsignal import lexicon as L

CORPUS_SCHEMA = "email_id long, text string, label int"


def write_corpus_csv(df: DataFrame, path: str) -> None:
    """A2: ``text,label`` corpus as CSV with a header (quoted multi-line texts)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True)
     .csv(path))


def read_corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """A1: explicit schema, header, multi-line quoted fields (no inference pass)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path))


def read_mail_files(spark: SparkSession, path: str, max_bytes: int = L.MAX_UPLOAD_BYTES) -> DataFrame:
    """A3: one mail per file with an extension (text after the last dot, any case) of txt/eml/msg; bytes decoded
    as UTF-8 with invalid sequences dropped. ``reject_reason`` says why a file is refused (blank, or more
    than ``max_bytes``, then without text); null where it is taken."""
    from mailsignal.operators.parse import strip_ws
    ext = "|".join(L.ALLOWED_EXTENSIONS)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .filter(F.lower("path").rlike(r"\.(" + ext + r")$")))
    # bytes -> string, invalid sequences -> U+FFFD (make_valid_utf8), then the replacements dropped
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "\uFFFD", "")
    out = files.select("path", "length", F.when(F.col("length") <= max_bytes, text).alias("text"))
    return out.withColumn("reject_reason", F.when(F.col("length") > max_bytes, F.lit(L.REJECT_LARGE))
                          .when(F.length(strip_ws("text")) == 0, F.lit(L.REJECT_EMPTY)))


_MODEL = "struct<prediction:int,label:string,confidence:double,probabilities:struct<legitimate:double,phishing:double>>"
#: Schema of ``result_json``, for readers.
RESULT = (f"individual_predictions map<string,{_MODEL}>, ensemble_prediction struct<prediction:int,label:string,confidence:double,agreement:boolean>, "
          "email_analysis struct<suspicious_indicators:array<string>,risk_score:long,statistics:struct<character_count:long,word_count:long,"
          "url_count:long,suspicious_keyword_count:long>>, timestamp string")


def result_json(df: DataFrame) -> Column:
    """The nested scoring result as one JSON text per mail."""
    def model(prefix: str) -> Column:
        return F.struct(F.col(f"{prefix}_prediction").alias("prediction"), F.col(f"{prefix}_label").alias("label"),
                        F.col(f"{prefix}_confidence").alias("confidence"),
                        F.struct(F.col(f"{prefix}_probability_legitimate").alias("legitimate"),
                                 F.col(f"{prefix}_probability_phishing").alias("phishing")).alias("probabilities"))
    individual = F.create_map(F.lit("random_forest"), model("rf"), F.lit("svm"), model("svm"))
    ens = F.struct(F.col("ensemble_prediction").alias("prediction"), F.col("ensemble_label").alias("label"),
                   F.col("ensemble_confidence").alias("confidence"), F.col("ensemble_agreement").alias("agreement"))
    analysis = F.struct(F.col("suspicious_indicators"), F.col("risk_score"),
                        F.struct("character_count", "word_count", "url_count", "suspicious_keyword_count")
                        .alias("statistics"))
    return F.to_json(F.struct(individual.alias("individual_predictions"), ens.alias("ensemble_prediction"),
                              analysis.alias("email_analysis"),
                              F.date_format("predicted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))
