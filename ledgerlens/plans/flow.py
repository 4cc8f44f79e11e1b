"""Operators put together: from transactions to decisions, reviews and training rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import decisions, level1, level2, parse, reviews, trailing


def features(tx: DataFrame) -> DataFrame:
    return trailing.trailing_features(parse.time_features(tx))


def score_transactions(tx: DataFrame) -> DataFrame:
    """Features, fast score and verdict of every transaction."""
    return level1.fast_scores(features(tx))


def level1_messages(tx: DataFrame) -> DataFrame:
    return level1_of(features(tx))


def level1_of(featured: DataFrame) -> DataFrame:
    return level1.l1_actions(level1.fast_scores(featured))


def level2_messages(tx: DataFrame) -> DataFrame:
    """Every transaction goes through the heavy payload to level 2."""
    return level2_of(features(tx))


def level2_of(featured: DataFrame) -> DataFrame:
    return level2.level2_from_messages(parse.to_value(level2.heavy_payload(featured)))


def level_messages(tx: DataFrame) -> DataFrame:
    """Messages of both levels with their topic, as the decision job reads them."""
    return parse.to_value(level1_messages(tx)).withColumn("topic", F.lit(decisions.LEVEL1_TOPIC)).unionByName(
        parse.to_value(level2_messages(tx)).withColumn("topic", F.lit(decisions.LEVEL2_TOPIC))
    )


def combined_decisions(tx: DataFrame) -> DataFrame:
    return decisions.decisions_combined(level1_messages(tx), level2_messages(tx))


def final_decision_table(tx: DataFrame) -> DataFrame:
    """Audit rows of the combined decisions, created at the event time of their messages."""
    made = combined_decisions(tx)
    return decisions.final_decision_rows(made, at=decisions.message_instant(made))


def review_table(tx: DataFrame) -> DataFrame:
    return decisions.open_reviews(combined_decisions(tx))


def training_table(tx: DataFrame, judgements: DataFrame) -> DataFrame:
    """review_id, amount, level scores and label of every judged review."""
    return reviews.judged_features(judgements, review_table(tx), "review_id")
