"""User profiles, and flags for the known fraud patterns."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import times
from ledgerlens.operators.trailing import trailing_features

# --- fixed values: thresholds of the patterns -------------------------------------
HIGH_AMOUNT = 1000
UNUSUAL_CATEGORY_AMOUNT = 800
PREFERRED_CATEGORIES = 3
RAPID_FIRE_COUNT = 2
# ----------------------------------------------------------------------------


def user_profile(df: DataFrame) -> DataFrame:
    """Home location, usual device, preferred categories, amount range and history of each user.

    The habits are counted per (user, kind, value) first, so a busy user shrinks
    to a few rows on the map side; ties go to the smaller text.
    """
    known = df.filter(F.col("user_id").isNotNull())
    habits = known.select("user_id", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"))
        for kind in ("location", "device_id", "merchant_category")
    ]))).filter(F.col("value").isNotNull()).groupBy("user_id", "kind", "value").agg(F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(F.desc("uses"), "value"))
    top = habits.withColumn("place", place).filter(F.col("place") <= PREFERRED_CATEGORIES)

    def pick(kind, n):
        return F.max(F.when((F.col("kind") == kind) & (F.col("place") == n), F.col("value")))

    favourites = top.groupBy("user_id").agg(
        pick("location", 1).alias("home_location"), pick("device_id", 1).alias("device_id"),
        F.array_compact(F.array(*[pick("merchant_category", n) for n in range(1, PREFERRED_CATEGORIES + 1)]))
        .alias("preferred_categories"),
    )
    history = known.groupBy("user_id").agg(
        F.min("amount").alias("lowest_amount"), F.max("amount").alias("highest_amount"),
        F.count("*").alias("transaction_count"), F.max("timestamp").alias("last_transaction_time"),
        F.coalesce(F.bool_or("is_fraud"), F.lit(False)).alias("is_fraudster"),
    )
    return history.join(favourites, "user_id", "left")


def previous_location(df: DataFrame) -> DataFrame:
    """Add the location of the user's previous transaction.

    A lag over all rows of a user would be one task per user. Rows look back
    within their (user, hour); the first of an hour takes the last location of
    the user's hour before, from one pre-aggregated row per hour.
    """
    usable = F.col("user_id").isNotNull() & F.col("timestamp").isNotNull()
    hour = times.slot(times.micros(F.col("timestamp")), times.HOUR)
    hours = df.filter(usable).groupBy("user_id", hour.alias("_hour")).agg(
        F.max_by(F.struct("location"), F.struct("timestamp", "transaction_id")).alias("_last")
    )
    before = hours.select(
        "user_id", "_hour",
        F.lag("_last").over(Window.partitionBy("user_id").orderBy("_hour")).alias("_before"),
    )
    placed = df.withColumn("_hour", times.slot_or_spread(usable, hour)).join(before, ["user_id", "_hour"], "left")
    inside = Window.partitionBy("user_id", "_hour").orderBy("timestamp", "transaction_id")
    previous = F.coalesce(F.lag(F.struct("location")).over(inside), F.col("_before"))["location"]
    return placed.select(*df.columns, previous.alias("_previous")).select(
        *df.columns, F.when(usable, F.col("_previous")).alias("previous_location")
    )


def fraud_pattern_flags(df: DataFrame) -> DataFrame:
    """Add one flag per pattern: high amount, rapid fire, location jump, new device, unusual category."""
    featured = trailing_features(df).drop("mean_amount", "stddev_amount", "amount_zscore", "transactions_last_hour")
    located = previous_location(featured)

    this = F.struct("timestamp", "transaction_id")
    first_uses = df.filter(F.col("user_id").isNotNull() & F.col("device_id").isNotNull()) \
        .groupBy("user_id", "device_id").agg(F.min(this).alias("_first_use"))
    profile = user_profile(df).select("user_id", F.col("preferred_categories").alias("_preferred"))
    starts = df.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min(this).alias("_start"))

    # Right sides hold one row per key, so a hot user or device is a skewed left side only.
    joined = located.join(first_uses, ["user_id", "device_id"], "left") \
        .join(profile.join(starts, "user_id"), "user_id", "left")
    flags = {
        "high_amount": F.col("amount") >= HIGH_AMOUNT,
        "rapid_fire": F.col("tx_count_1min") >= RAPID_FIRE_COUNT,
        "location_jump": F.col("location") != F.col("previous_location"),
        "new_device": (this == F.col("_first_use")) & (F.col("_first_use") != F.col("_start")),
        "unusual_category": ~F.array_contains("_preferred", F.col("merchant_category"))
        & (F.col("amount") >= UNUSUAL_CATEGORY_AMOUNT),
    }
    return joined.select(
        *df.columns, *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in flags.items()]
    )
