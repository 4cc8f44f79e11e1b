"""Manual review queue and operator judgements."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
JUDGEMENTS = ["Allow", "Block", "Escalate"]
QUEUE = ["id", "transaction_id", "user_id", "device_id", "amount", "detection_path", "level1_score",
         "level2_score", "created_at"]
# ----------------------------------------------------------------------------


def pending_reviews(reviews: DataFrame) -> DataFrame:
    """Queue of unjudged reviews, oldest first."""
    return reviews.filter(F.col("status") == "pending").orderBy("created_at", "id").select(*QUEUE)


def valid_judgements(judgements: DataFrame) -> DataFrame:
    return judgements.filter(F.col("verdict").isin(*JUDGEMENTS))


def invalid_judgements(judgements: DataFrame) -> DataFrame:
    return judgements.filter(~F.coalesce(F.col("verdict").isin(*JUDGEMENTS), F.lit(False)))


def match_reviews(judgements: DataFrame, reviews: DataFrame) -> DataFrame:
    """Judgements of an existing review."""
    known = reviews.select(F.col("id").alias("review_id"))
    return judgements.join(known, "review_id", "left_semi")


def unmatched_judgements(judgements: DataFrame, reviews: DataFrame) -> DataFrame:
    known = reviews.select(F.col("id").alias("review_id"))
    return judgements.join(known, "review_id", "left_anti")


def feedback_rows(judgements: DataFrame, reviews: DataFrame) -> DataFrame:
    """One label per valid judgement of an existing review."""
    known = reviews.select(F.col("id").alias("review_id"), "transaction_id")
    return _feedback(judgements, known).select(
        "id", "review_id", "transaction_id", "operator_id", "verdict", "comment", "created_at")


def _feedback(judgements: DataFrame, known: DataFrame) -> DataFrame:
    return valid_judgements(judgements).join(known, "review_id").withColumns({
        "id": F.md5(F.concat_ws("|", "review_id", "operator_id", "verdict", "comment", F.unix_micros("judged_at")).cast("binary")),
        "created_at": F.col("judged_at"),
    })


def feedback_messages(feedback: DataFrame) -> DataFrame:
    return feedback.select("review_id", "transaction_id", "operator_id", "verdict", "comment")


def judge_reviews(reviews: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshot of the reviews, and the feedback to append.

    Resolved reviews may be judged again: a later judgement moves updated_at.
    Judgements are reduced to one time per review before the join; one without a
    time counts as made now.
    """
    feedback = feedback_rows(judgements, reviews)
    judged = valid_judgements(judgements).groupBy(F.col("review_id").alias("id")).agg(
        F.max(F.coalesce("judged_at", F.current_timestamp())).alias("_judged_at")
    )
    hit = F.col("_judged_at").isNotNull()
    snapshot = reviews.join(judged, "id", "left").withColumns({
        "status": F.when(hit, F.lit("resolved")).otherwise(F.col("status")),
        "updated_at": F.when(hit, F.greatest("updated_at", "_judged_at")).otherwise(F.col("updated_at")),
    }).select(*reviews.columns)
    return snapshot, feedback


def labelled_reviews(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Feedback with the features of its review; the review's transaction_id is kept."""
    return feedback.drop("transaction_id").join(_features(reviews), "review_id")


def _features(reviews: DataFrame) -> DataFrame:
    return reviews.select(
        F.col("id").alias("review_id"), "transaction_id", "user_id", "amount", "device_id", "detection_path",
        "level1_score", "level2_score",
    )


def labelled_judgements(judgements: DataFrame, reviews: DataFrame) -> DataFrame:
    """labelled_reviews of the feedback_rows of judgements, in one join: what both read of a review is found once."""
    return _feedback(judgements, _features(reviews)).drop("judged_at")


def training_features(labelled: DataFrame, *keep: str) -> DataFrame:
    label = F.when(F.col("verdict") == "Block", 1).otherwise(0)
    return labelled.select(*keep, "amount", "level1_score", "level2_score", label.alias("label"))


def drop_incomplete(features: DataFrame) -> DataFrame:
    return features.dropna(subset=["amount", "level1_score", "level2_score", "label"])


def extract_features(feedback: DataFrame, reviews: DataFrame, *keep: str) -> DataFrame:
    return drop_incomplete(training_features(labelled_reviews(feedback, reviews), *keep))


def judged_features(judgements: DataFrame, reviews: DataFrame, *keep: str) -> DataFrame:
    """extract_features of judgements that were not written as feedback."""
    return drop_incomplete(training_features(labelled_judgements(judgements, reviews), *keep))
