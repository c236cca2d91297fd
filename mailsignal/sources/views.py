"""Deterministic mail and log views derived from the driver tables.

The driver tables hold invented prose and click events, not mail. These views
turn them into the inputs the operators expect, keeping every row and the whole
text of every document: a header block and one closing sentence are added, and
labels, scores and log fields are pure functions of the row's own ids. The SQL
oracle builds the same views independently (``mailsignal.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsignal.sources.tables import load

# Test-fixture values (own wording) -----------------------------------------
SENDERS = [
    "Account Services <noreply@account-services.example>",
    "Alice Martin <alice.martin@example.org>",
    "billing2024@payments-center.example",
    "Rob Chen <rob.chen@example.com>",
    "Helpdesk <support@203.0.113.7>",
    "newsletter@example.net",
    "Prize Team <donotreply@lucky-draw.example>",
]
RECEIVERS = ["you@example.com", "Jordan Lee <jordan.lee@example.com>", "team@example.org"]
SUBJECTS = [
    "URGENT: Account Suspended!!",
    "You are a WINNER!",
    "Security alert for your account",
    "Exclusive offer - $1000 guaranteed",
    "Action required: mailbox quota?",
    "Meeting notes",
    "Quarterly report",
    "Call on Thursday?",
    "Office closure",
    "Team lunch",
]
CLOSINGS = [
    "URGENT! This mailbox is suspended as of today: click here, verify who you are on "
    "http://secure-login.example-verify.com/account?id=7 and do it before your access expires!!",
    "Congratulations, you are the WINNER of our lottery prize! Claim $5,000 now at "
    "http://bit.ly/claim-prize and http://192.168.10.44/claim",
    "Security alert: confirm identity and update payment within 24 hours via "
    "https://paypal-verify.account-check.tk/login, act now - limited time offer.",
    "Dear customer, free money is guaranteed, risk free and no obligation. Reply ASAP to "
    "http://tinyurl.com/free-cash or hurry to https://t.co/x9Y2 now!",
    "Your mailbox is almost full. Visit http://mail4help7desk.com/restore immediately, "
    "don't delay, the deadline is today and access expires quickly.",
    "Thanks for the notes from Tuesday; I have attached the revised agenda for the planning meeting.",
    "The quarterly report is on the intranet at https://intranet.example.org/reports/q3 for anyone who missed it.",
    "Could we move our call to Thursday afternoon? Let me know what works for you.",
    "Reminder: the office will be closed on Monday for maintenance of the heating system.",
    "Best regards, and see you at the team lunch next week.",
]
MAIL_EPOCH = "2024-01-01 00:00:00"
MAIL_AS_OF = "2024-04-30 00:00:00"
TRACKER_AS_OF = "2024-01-31 00:00:00"
USER_AGENTS = ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Macintosh)", "curl/8.4.0"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def ts_lit(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(email_id, raw_text, label, received_at): one mail per document, whole text."""
    return mails_from_documents(load(spark, sf_dir, "documents"))


def mails_from_documents(documents: DataFrame) -> DataFrame:
    """The mail view over a batch or streaming ``documents`` frame."""
    d = documents.select("doc_id", "text")
    i = F.col("doc_id")
    nl = F.lit("\n")
    raw = F.concat(
        F.lit("From: "), _pick(SENDERS, i % 7), nl,
        F.lit("To: "), _pick(RECEIVERS, i % 3), nl,
        F.lit("Subject: "), _pick(SUBJECTS, i % 10), nl, nl,
        F.coalesce(F.col("text"), F.lit("")), nl,
        _pick(CLOSINGS, i % 10),
    )
    base = F.when(i % 10 < 5, F.lit(1)).otherwise(F.lit(0))
    label = F.when(i % 37 == 0, F.lit(1) - base).otherwise(base)
    received = ts_lit(MAIL_EPOCH) + F.make_dt_interval(days=(i % 120).cast("int"), hours=(i % 24).cast("int"))
    return d.select(i.alias("email_id"), raw.alias("raw_text"), label.cast("int").alias("label"),
                    received.alias("received_at"))


def stand_in_scores(id_col: Column) -> list[Column]:
    """Stand-in model outputs: phishing probability per model as a function of the id."""
    return [
        ((id_col * 37) % 1000).cast("double") / 1000.0,
        ((id_col * 53) % 1000).cast("double") / 1000.0,
    ]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    p_rf, p_svm = stand_in_scores(i)
    return load(spark, sf_dir, "documents").select(i.alias("email_id"), p_rf.alias("p_rf"), p_svm.alias("p_svm"))


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy-tracker log (one row per scored request) from ``events``."""
    return tracker_from_events(load(spark, sf_dir, "events"))


def tracker_from_events(events: DataFrame) -> DataFrame:
    """The tracker view over a batch or streaming ``events`` frame."""
    e = events.select("event_id", "ts", "user_id", "event_type")
    i = F.col("event_id")
    pred = F.when(F.col("event_type").isin("error", "click"), F.lit(1)).otherwise(F.lit(0))
    actual = (F.when(i % 3 == 0, F.lit(None).cast("int"))
              .when(i % 11 == 0, F.lit(1) - pred).otherwise(pred))
    t = e.select(
        i.alias("id"),
        F.col("ts").alias("timestamp"),
        pred.cast("int").alias("prediction"),
        ((F.lit(500) + (i * 7919) % 501).cast("double") / 1000.0).alias("confidence"),
        actual.cast("int").alias("actual_label"),
        F.when(actual.isNotNull(), F.lit("initial")).alias("user_feedback"),
        F.substring(F.md5(F.col("user_id").cast("string")), 1, 10).alias("email_hash"),
        F.col("ts").alias("created_at"),
    )
    return t.withColumn("correct", F.when(F.col("actual_label").isNotNull(),
                                          (F.col("prediction") == F.col("actual_label")).cast("int")))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User corrections: every sign-up event is a feedback request (some for unknown mails)."""
    return feedback_from_events(load(spark, sf_dir, "events"))


def feedback_from_events(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type")
    i = F.col("event_id")
    key = F.when(i % 13 == 0, F.concat(F.lit("unknown-"), F.col("user_id").cast("string"))) \
        .otherwise(F.col("user_id").cast("string"))
    return e.filter(F.col("event_type") == "signup").select(
        i.alias("feedback_id"),
        F.substring(F.md5(key), 1, 10).alias("email_hash"),
        (i % 2).cast("int").alias("actual_label"),
        F.lit("user_correction").alias("feedback"),
        F.col("ts").alias("feedback_at"),
    )


def activity_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request facts behind the activity log (before session/IP derivation)."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    i = F.col("event_id")
    u = F.col("user_id")
    fwd = (F.when(i % 4 == 0, F.lit(""))
           .otherwise(F.concat(F.lit(" 198.51.100."), (u % 250).cast("string"), F.lit(", 10.0.0."),
                               (i % 250).cast("string"))))
    return e.select(
        i.alias("id"),
        u.alias("user_id"),
        F.col("event_type").alias("action"),
        F.col("ts").alias("timestamp"),
        fwd.alias("x_forwarded_for"),
        F.when(i % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("192.0.2."), (u % 200).cast("string"))).alias("remote_addr"),
        _pick(USER_AGENTS, i % 3).alias("user_agent"),
        F.substring(F.md5(u.cast("string")), 1, 10).alias("email_hash"),
    )
