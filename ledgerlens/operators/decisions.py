"""Final decisions from level 1 and level 2 results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, times
from ledgerlens.functions.barrier import evaluate_once
from ledgerlens.operators.parse import drop_undecodable
from ledgerlens.schemas import LEVEL1_ACTION, LEVEL2_VERDICT

POSITION = ("broker_time", "partition", "offset")  # place of a message in its topic, where the source tells it
LEVEL1_TOPIC = "level1.actions"
LEVEL2_TOPIC = "level2.verdicts"


def has_level1(column: Column) -> Column:
    return scoring.has_content(column, LEVEL1_ACTION.names)


def has_level2(column: Column) -> Column:
    return scoring.has_content(column, LEVEL2_VERDICT.names)


def apply_business_rules(df: DataFrame) -> DataFrame:
    """Add final_verdict and reason to rows with nullable level1 and level2 structs."""
    l1, l2 = F.col("level1"), F.col("level2")
    outcome = scoring.final_verdict_and_reason(has_level1(l1), l1["verdict"], has_level2(l2), l2["verdict"])
    return evaluate_once(df, outcome)


def _position(df: DataFrame) -> list[str]:
    return [c for c in POSITION if c in df.columns]


def _parsed_levels(messages: DataFrame) -> DataFrame:
    """level1 and level2 structs, one of them null: `topic` routes the JSON `value` to its level."""
    text = F.col("value").cast("string")
    parsed = F.struct(
        F.when(F.col("topic") == LEVEL1_TOPIC, F.from_json(text, LEVEL1_ACTION)).alias("level1"),
        F.when(F.col("topic") == LEVEL2_TOPIC, F.from_json(text, LEVEL2_VERDICT)).alias("level2"),
    )
    routed = messages.filter(F.col("topic").isin(LEVEL1_TOPIC, LEVEL2_TOPIC))
    return routed.select(*_position(messages), F.inline(F.array(parsed)))


def decisions_per_message(messages: DataFrame) -> DataFrame:
    """One decision per message. No state, no shuffle.

    Messages that cannot be read or have no transaction id are skipped.
    """
    keyed = _parsed_levels(messages).withColumn(
        "transaction_id", F.coalesce(F.col("level1.transaction_id"), F.col("level2.transaction_id")))
    return apply_business_rules(drop_undecodable(keyed))


def levels_from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level 1 and level 2 messages of a frame of topics, with their places, to be correlated."""
    parsed = _parsed_levels(messages)
    return tuple(parsed.filter(F.col(level).isNotNull()).select(f"{level}.*", *_position(messages)) for level in ("level1", "level2"))


def latest_message(df: DataFrame, name: str) -> DataFrame:
    """Latest message per transaction as a struct column; copies collapse before the shuffle.

    Latest by instant: ISO texts with and without fractions or offsets do not sort as text.
    Of messages of one instant the last in its topic counts, if their places are known.
    """
    return _with_place(df, name, "_place").groupBy("transaction_id").agg(F.max_by(name, "_place").alias(name))


def _with_place(df: DataFrame, name: str, place: str) -> DataFrame:
    """transaction_id, the message as a struct, and what tells which of two messages is later."""
    content = [c for c in df.columns if c not in POSITION]
    later = F.struct(F.col("timestamp").try_cast("timestamp"), *_position(df), "timestamp", F.xxhash64(*content))
    return drop_undecodable(df).select("transaction_id", F.struct(*content).alias(name), later.alias(place))


def correlate_levels(l1: DataFrame, l2: DataFrame) -> DataFrame:
    """The latest level 1 and level 2 message of each transaction, as of a full outer join.

    Both kinds go through one aggregate, each in its own columns: one shuffle, no join.
    """
    left = l1.select(*[F.col(c) if c in l1.columns else F.lit(None).cast(LEVEL1_ACTION[c].dataType).alias(c)
                       for c in LEVEL1_ACTION.names], *_position(l1))
    right = l2.select(*[F.col(c) if c in l2.columns else F.lit(None).cast(LEVEL2_VERDICT[c].dataType).alias(c)
                        for c in LEVEL2_VERDICT.names], *_position(l2))
    both = _with_place(left, "level1", "_place1").unionByName(
        _with_place(right, "level2", "_place2"), allowMissingColumns=True)
    return both.groupBy("transaction_id").agg(
        F.max_by("level1", "_place1").alias("level1"), F.max_by("level2", "_place2").alias("level2"))


def decisions_combined(l1: DataFrame, l2: DataFrame) -> DataFrame:
    """One decision per transaction, level 2 winning over level 1."""
    return apply_business_rules(correlate_levels(l1, l2))


def detection_path(df: DataFrame) -> DataFrame:
    return df.withColumn("detection_path", F.struct("level1", "level2"))


def final_decision(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Envelope that is published; `at` is the decision time."""
    return df.select(
        "transaction_id", "final_verdict", "reason",
        times.iso_utc(F.current_timestamp() if at is None else at).alias("timestamp"), "level1", "level2",
    )


def final_decision_rows(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of the audit table. The key is derived from the decision, so a repeated write repeats the key."""
    created = F.current_timestamp() if at is None else at
    return detection_path(df).select(
        F.md5(F.concat_ws("|", "transaction_id", "final_verdict", "reason", F.to_json("detection_path"))
              .cast("binary")).alias("id"),
        "transaction_id", "final_verdict", "reason", "detection_path", created.alias("created_at"),
    )


def only_escalated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("final_verdict") == "Escalate")


def level_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "level1_score": F.col("level1.score"),
        "level2_score": scoring.level2_score(F.col("level2.heavy_score_clamped"), F.col("level2.score")),
    })


def message_instant(df: DataFrame) -> Column:
    """Event time carried by the decision's messages."""
    return F.coalesce(F.col("level1.timestamp"), F.col("level2.timestamp")).try_cast("timestamp")


def open_reviews(decisions: DataFrame, existing: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """One pending review per transaction, from its first escalation.

    The first escalation is picked by an aggregate that combines before the
    shuffle; transactions in `existing` already have their review. Transaction
    fields come from level 1, or level 2 if there is no level 1.
    """
    created = message_instant(decisions) if at is None else at
    escalated = level_scores(only_escalated(decisions)).withColumn("created_at", created)
    l1 = has_level1(F.col("level1"))

    def field(name):
        return F.when(l1, F.col(f"level1.{name}")).otherwise(F.col(f"level2.{name}"))

    place = _position(decisions)
    rows = detection_path(escalated).select(
        *place, F.col("transaction_id").alias("id"), "transaction_id",
        field("user_id").alias("user_id"), field("device_id").alias("device_id"), field("amount").alias("amount"),
        "detection_path", "level1_score", "level2_score", F.lit("pending").alias("status"),
        "created_at", F.col("created_at").alias("updated_at"),
    )
    # At the same instant the synchronous level 1 message comes before level 2, then the place in the topic decides.
    first = F.struct("created_at", has_level2(F.col("detection_path.level2")), *place,
                     F.xxhash64("detection_path.level1.verdict", "detection_path.level2.verdict"))
    columns = [c for c in rows.columns if c not in place]
    opened = rows.groupBy("transaction_id").agg(
        F.min_by(F.struct(*[c for c in columns if c != "transaction_id"]), first).alias("r")
    ).select("r.id", "transaction_id", *[f"r.{c}" for c in columns if c not in ("id", "transaction_id")])
    if existing is not None:
        opened = opened.join(existing.select("transaction_id"), "transaction_id", "left_anti").select(*columns)
    return opened
