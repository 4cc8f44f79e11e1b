"""Level 2: heavy payload, score and verdict."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scoring
from ledgerlens.operators.parse import message_time, parse_level2


def heavy_payload(df: DataFrame) -> DataFrame:
    """Level 2 message. Graph features default to 0 unless the frame carries real ones."""
    def given(name, default):
        return F.coalesce(F.col(name), default) if name in df.columns else default

    recent = F.col("recent_amounts") if "recent_amounts" in df.columns else F.array().cast("array<double>")
    return df.select(
        "transaction_id", "user_id", "device_id", "amount", message_time(F.col("timestamp")).alias("timestamp"),
        F.struct(
            F.coalesce(F.col("transactions_last_hour"), F.lit(0)).alias("session_length"),
            recent.alias("recent_amounts"),
        ).alias("session_features"),
        F.struct(
            given("neighbor_count", F.lit(0)).alias("neighbor_count"),
            given("graph_score", F.lit(0.0)).alias("graph_score"),
        ).alias("graph_features"),
    )


def extract_graph_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "neighbor_count": scoring.map_number(F.col("graph_features"), "neighbor_count"),
        "graph_score": scoring.map_number(F.col("graph_features"), "graph_score"),
    })


def heavy_scores(df: DataFrame) -> DataFrame:
    scored = extract_graph_features(df).withColumn(
        "heavy_score", scoring.heavy_score(F.col("neighbor_count"), F.col("graph_score"), F.col("amount"))
    ).withColumn("heavy_score_clamped", scoring.clamp01(F.col("heavy_score")))
    return scored.withColumn("verdict", scoring.policy_decision(F.col("heavy_score_clamped")))


def l2_verdicts(scored: DataFrame) -> DataFrame:
    return scored.select(
        "transaction_id", "user_id", "device_id", "amount", "timestamp", "heavy_score_clamped", "verdict"
    )


def level2_inputs(payloads: DataFrame, l1_quarantined: DataFrame, l0_quarantined: DataFrame,
                  lift_payload: bool = True) -> DataFrame:
    """The three differently shaped producers of the level 2 topic as one message stream of JSON `value`.

    Level 0 events carry the amount inside their payload, where the level 2 job
    does not look for it: it would score every blacklisted transaction 0. By
    default the amount is lifted out; `lift_payload=False` keeps the events as sent.
    """
    if lift_payload:
        l0_quarantined = l0_quarantined.withColumn(
            "amount", F.get_json_object("payload", "$.amount").try_cast("double")
        )
    merged = payloads.unionByName(l1_quarantined, allowMissingColumns=True).unionByName(
        l0_quarantined, allowMissingColumns=True
    )
    return merged.select("transaction_id", F.to_json(F.struct(*[F.col(c) for c in merged.columns])).alias("value"))


def level2_from_messages(messages: DataFrame) -> DataFrame:
    """Parse, score and judge level 2 messages."""
    return l2_verdicts(heavy_scores(parse_level2(messages)))
