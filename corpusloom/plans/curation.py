"""The curation chain as one plan: contexts, reject reasons, deduplication, types, numbered accepted records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, curation
from .storage import materialise


def curate(records: DataFrame, question_rules: bool = True) -> DataFrame:
    """All records (record_id, source, text, landed_at) with `reject_reason`, null where accepted, and what accepted ones need.

    Rows delivered again count in the order of landed_at and record_id. Accepted records are numbered in that order.
    """
    placed = corpus.ranked(records.select("record_id", "source", "text", "landed_at").distinct(), "landed_at", "record_id", "source", "text").withColumnRenamed("rank", "pos")
    cut = materialise(placed.withColumn("text", X.question_context(F.col("text"))), "contexts")
    reason = curation.reject_reason(F.col("text")) if question_rules else F.when(F.coalesce(X.strip(F.col("text")), F.lit("")) == "", "empty")
    first = cut.withColumn("reason", reason)
    dup = curation.greedy_dedup(first.where("reason is null").select("pos", "source", "text"))
    out = first.join(dup, "pos", "left").withColumn("reject_reason", F.coalesce("reason", "reject")).drop("reason", "reject")
    out = materialise(out, "curated")
    numbered = corpus.ranked(out.where("reject_reason is null").select("pos"), "pos")
    t = F.col("text")
    return out.join(numbered, "pos", "left").select(
        F.when(F.col("rank").isNotNull(), F.format_string("v2q_%06d", F.col("rank"))).alias("accepted_id"), "record_id", "source", "text", "reject_reason",
        X.count_of(t, "?").alias("question_count"), X.word_count(t).alias("word_count"), curation.question_type(t).alias("question_type"),
        X.count_of(t, X.KURMANJI_LETTERS).alias("kmr_special_char_count"), (X.count_of(t, X.TURKISH_LETTERS) >= 3).alias("turkish_review_flag"), "pos",
    )
