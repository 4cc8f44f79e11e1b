"""Trailing features: what a user did in the last 24 hours, hour and minute before each transaction."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, times
from ledgerlens.functions.times import DAY, HOUR, MINUTE
from ledgerlens.operators.hopping import amount_zscore, direct_moments, mean_of, merge_moments, stddev_of


def trailing_features(df: DataFrame) -> DataFrame:
    """One row per transaction with trailing 24 h mean, deviation and z-score, 1 h and 1 min counts.

    Frames include the transaction itself and others of the user at the same
    instant. Rows without user or time have both counts 1 and no statistics.

    Users are cut by day, so the group of a hot user is a day of it. What a frame
    takes from the day before comes as narrow (user, time, amount) copies whose time is
    moved forward by the frame's width. With t the time of a transaction in its
    group of one day,
      - [t - 24 h, t] is the rows of the day up to t and the rows moved by 24 h at or after t;
      - [t - 1 h, t] is the rows of the day up to t, less those of them moved by 1 h to before t,
        and with the rows of the day before that were moved by 1 h to t or later.
    So all frames only grow along one of two orders, and the cost of a row depends
    neither on its user nor on the width of a frame.
    """
    usable = F.col("user_id").isNotNull() & F.col("timestamp").isNotNull()
    none, every = F.array(F.lit(0).cast("bigint")), F.array(*[F.lit(w).cast("bigint") for w in (0, MINUTE, HOUR, DAY)])
    moved = df.select(
        "user_id", "amount", F.struct(*df.columns).alias("row"), usable.alias("usable"),
        times.micros(F.col("timestamp")).alias("us"), F.explode(F.when(usable, every).otherwise(none)).alias("shift"),
    )
    at = F.col("us") + F.col("shift")
    copies = moved.select(
        "user_id", "amount", "usable", "shift", at.alias("at"),
        times.slot_or_spread(F.col("usable"), times.slot(at, DAY)).alias("day"),
        (times.slot(F.col("us"), DAY) == times.slot(at, DAY)).alias("same_day"),
        F.when(F.col("shift") == 0, F.col("row")).alias("row"),
    )

    group = Window.partitionBy("user_id", "day")
    rising, falling = group.orderBy("at"), group.orderBy(F.desc("at"))
    until = rising.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rising.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    since = falling.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def count_over(frame, which):
        return F.count(F.when(which, 1)).over(frame)

    def moments_over(frame, shift):
        x = F.when(F.col("shift") == shift, F.col("amount"))
        return F.struct(
            F.count(x).over(frame).alias("n"), F.avg(x).over(frame).alias("mean"), F.var_pop(x).over(frame).alias("variance"),
            F.min(x).over(frame).alias("lowest"), F.max(x).over(frame).alias("highest"),
        )

    def moved_by(width):
        return F.col("shift") == width

    framed = copies.select(
        "row", "usable", "shift", count_over(until, moved_by(0)).alias("n_until"),
        *[count_over(since, moved_by(w)).alias(f"since_{w}") for w in (MINUTE, HOUR)],
        *[count_over(whole, moved_by(w) & F.col("same_day")).alias(f"moved_{w}") for w in (MINUTE, HOUR)],
        moments_over(until, 0).alias("today"), moments_over(since, DAY).alias("yesterday"),
    ).filter(moved_by(0))

    def trailing_count(width):
        return F.when(F.col("usable"), F.col("n_until") - F.col(f"moved_{width}") + F.col(f"since_{width}")).otherwise(1)

    moments = F.col("moments")
    pooled = framed.withColumn("moments", merge_moments([direct_moments(F.col("today")), direct_moments(F.col("yesterday"))]))
    return amount_zscore(pooled.select(
        "row.*", F.when(F.col("usable"), mean_of(moments)).alias("mean_amount"),
        F.when(F.col("usable"), stddev_of(moments)).alias("stddev_amount"),
        trailing_count(HOUR).alias("transactions_last_hour"), trailing_count(MINUTE).alias("tx_count_1min"),
    ))


# --- fixed values: order of the enriched message ------------------------------
ENRICHED = [
    "transaction_id", "user_id", "amount", "merchant_category", "timestamp", "location", "device_id",
    "is_fraud", "hour_of_day", "day_of_week", "amount_zscore", "transactions_last_hour", "tx_count_1min",
]
# ----------------------------------------------------------------------------


def enriched_projection(df: DataFrame) -> DataFrame:
    return df.select(*ENRICHED)


def hot_features(df: DataFrame) -> DataFrame:
    """Latest 1-minute count per user; the transaction id breaks ties in time."""
    newest = F.struct("timestamp", "transaction_id")
    return df.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max_by("tx_count_1min", newest).alias("tx_count_1min"), F.max("timestamp").alias("updated_at")
    )


def lookup_hot_feature(df: DataFrame, features: DataFrame, ttl_seconds: int = 120) -> DataFrame:
    """As-of join: newest feature of the user at or before each transaction, 0 on a miss or past its TTL.

    `features` has user_id, tx_count_1min and updated_at, in any number of versions.
    A feature can only be seen in the TTL-wide bucket it falls in and the next
    one, so it is sent to both and each (user, bucket) is resolved by itself.
    """
    ttl = ttl_seconds * times.SECOND
    usable = F.col("user_id").isNotNull() & F.col("timestamp").isNotNull()

    wanted = df.select(
        "user_id", times.micros(F.col("timestamp")).alias("at"), F.lit(1).alias("kind"), usable.alias("usable"),
        F.struct(*df.columns).alias("row"),
    ).withColumn("bucket", times.slot_or_spread(F.col("usable"), times.slot(F.col("at"), ttl)))
    known = features.filter(F.col("user_id").isNotNull() & F.col("updated_at").isNotNull()).select(
        "user_id", times.micros(F.col("updated_at")).alias("at"), F.lit(0).alias("kind"), "tx_count_1min",
    )
    first = times.slot(F.col("at"), ttl)
    offered = known.withColumn("bucket", F.explode(F.array(first, first + 1)))

    past = Window.partitionBy("user_id", "bucket").orderBy("at", "kind", F.col("tx_count_1min").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col("kind") == 0, F.struct("at", "tx_count_1min"))
    resolved = wanted.unionByName(offered, allowMissingColumns=True).withColumn(
        "newest", F.last(seen, ignorenulls=True).over(past)
    ).filter(F.col("kind") == 1)
    fresh = F.col("usable") & (F.col("at") - F.col("newest.at") < ttl)
    return resolved.select(
        "row.*",
        F.coalesce(F.when(fresh, F.col("newest.tx_count_1min")), F.lit(0)).cast("bigint").alias("hot_tx_count_1min"),
    )
