"""Score, verdict and label expressions. All are plain Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CHALLENGE_FROM = 0.2
QUARANTINE_FROM = 0.6
FAST_COUNT_SCALE = 10.0
FAST_AMOUNT_LIMIT = 1000
FAST_AMOUNT_SCORE = 0.5
HEAVY_NEIGHBOR_SCALE = 10.0
HEAVY_AMOUNT_SCALE = 10000.0
# ----------------------------------------------------------------------------


def clamp01(score: Column) -> Column:
    """Clamp to [0, 1]. A null stays null: least/greatest would turn it into 0."""
    return F.when(score < 0, 0.0).when(score > 1, 1.0).otherwise(score)


def policy_decision(score: Column) -> Column:
    """Three-way verdict; an unknown score is treated as the riskiest."""
    return (
        F.when(score < CHALLENGE_FROM, "Allow")
        .when(score < QUARANTINE_FROM, "Challenge")
        .otherwise("Quarantine")
    )


def fast_score(amount: Column, tx_count_1min: Column) -> Column:
    frequency = F.coalesce(tx_count_1min, F.lit(0)) / F.lit(FAST_COUNT_SCALE)
    size = F.when(amount > FAST_AMOUNT_LIMIT, FAST_AMOUNT_SCORE).otherwise(0.0)
    return F.least(F.lit(1.0), frequency + size)


def map_number(features: Column, key: str) -> Column:
    """Number held under `key`: 0 without a map, null when missing or not a number."""
    return F.when(features.isNotNull(), features[key].try_cast("double")).otherwise(F.lit(0.0))


def heavy_score(neighbor_count: Column, graph_score: Column, amount: Column) -> Column:
    return (
        neighbor_count / HEAVY_NEIGHBOR_SCALE
        + graph_score
        + F.when(amount > 0, amount / HEAVY_AMOUNT_SCALE).otherwise(0.0)
    )


def zscore(amount: Column, mean: Column, stddev: Column) -> Column:
    """Distance from the mean in deviations; 0 when there is no spread to measure by."""
    return F.when(stddev.isNull() | (stddev == 0), F.lit(0.0)).otherwise((amount - mean) / stddev)


def default_count(count: Column) -> Column:
    return F.coalesce(count, F.lit(1).cast("bigint"))


def has_content(message: Column, fields) -> Column:
    """True for a struct with at least one field set: `{}` counts as absent."""
    present = F.lit(False)
    for name in fields:
        present = present | message[name].isNotNull()
    return message.isNotNull() & present


def final_verdict_and_reason(has_level1, level1_verdict, has_level2, level2_verdict) -> Column:
    """Business rules as one struct<final_verdict, reason>; level 2 wins over level 1."""

    def outcome(verdict, reason):
        return F.struct(F.lit(verdict).alias("final_verdict"), F.lit(reason).alias("reason"))

    return (
        F.when(has_level2 & (level2_verdict == "Quarantine"), outcome("Block", "level2_quarantine"))
        .when(has_level2 & (level2_verdict == "Challenge"), outcome("Escalate", "level2_challenge"))
        .when(has_level2, outcome("Allow", "level2_allow"))
        .when(has_level1 & (level1_verdict == "Allow"), outcome("Allow", "level1_allow"))
        .when(has_level1 & (level1_verdict == "Challenge"), outcome("Escalate", "level1_challenge"))
        .when(has_level1, outcome("Escalate", "level1_quarantine"))
        .otherwise(outcome("Allow", "no_info"))
    )


def level2_score(heavy: Column, score: Column) -> Column:
    """Heavy score, falling through to the plain score when it is missing or exactly 0."""
    return F.coalesce(F.nullif(heavy, F.lit(0.0)), score)


def detection_level(has_level1: Column, has_level2: Column) -> Column:
    return F.when(has_level2, 2).when(has_level1, 1).otherwise(0)
