"""Hopping-window features as streams."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators import hopping, parse, trailing

# --- fixed value: how late a transaction may be and still count ---------------------
LATENESS = "10 minutes"
CLOSING_TIME = dt.datetime(9999, 12, 31, tzinfo=dt.UTC)
# ----------------------------------------------------------------------------

WINDOWS = {
    "stats_24h": (hopping.user_stats_24h, hopping.STATS_24H),
    "count_1h": (hopping.tx_count_1h, hopping.COUNT_1H),
    "count_1min": (hopping.tx_count_1min, hopping.COUNT_1MIN),
}


def watermarked(tx: DataFrame) -> DataFrame:
    """Transactions with event time; rows without one can join no window."""
    return tx.filter(F.col("timestamp").isNotNull()).withWatermark("timestamp", LATENESS)


def closing_row(spark: SparkSession, schema: StructType) -> DataFrame:
    """A transaction that ends a stream: all its columns but time and user are null.

    It has a user because a join leaves out rows without one before it looks at
    their times. Windows are emitted once the watermark has passed their end, so the last ones
    need a later event. The windows of this one stay open: it is emitted nowhere.
    It must arrive after all others, which would be late behind it, and with it the
    watermark of a checkpoint is the end of time for good. So it is for streams that are
    drained once; one that goes on emits its last windows when later events come.
    """
    known = {"timestamp": CLOSING_TIME, "user_id": "closing"}
    return spark.range(1).select(*(F.lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def window_aggregate(tx: DataFrame, name: str) -> DataFrame:
    """The batch aggregate over a watermarked stream.

    The windows that begin in one block of slots are emitted together, once the watermark passes the
    end of the last of them: up to a window's width less one slide after their own. A late row counts
    in all windows that are not emitted yet.
    """
    aggregate, _ = WINDOWS[name]
    return aggregate(watermarked(tx))


def window_join(tx: DataFrame, name: str) -> DataFrame:
    """Each transaction with the windows that hold it, as a stream.

    Streams can only join on equal, watermarked keys, so the row is given its two
    spans first and both sides meet on (user, span); its windows are unfolded from
    what the join emits, so state holds a row twice, not once per window. One query per
    window: a chain of two windows would carry two event-time columns. Only the spans
    are watermarked, not the rows: a row later than the watermark finds its spans
    closed and is emitted without statistics. A row without time has no window and
    is emitted once, without statistics.
    """
    _, (size, slide) = WINDOWS[name]
    hops, source = size // slide, watermarked(tx)
    if name == "stats_24h":
        found, values = hopping.span_stats(source), ["mean_amount", "stddev_amount"]
        held = [F.col(f"_windows.{v}").alias(f"_{v}") for v in values]
    else:
        found, values = hopping.span_counts(source, (size, slide)), ["tx_count" if name == "count_1h" else "tx_count_1min"]
        held = [F.col("_windows").alias(f"_{values[0]}")]
    rows = tx.filter(F.col("timestamp").isNotNull()).withColumn("span", hopping.span((size, slide)))
    joined = rows.join(found.select("user_id", "span", *held), ["user_id", "span"], "left")
    place = hopping.place_in_span(slide)
    starts = F.sequence(F.greatest(place - (hops - 1), F.lit(0)), F.least(place, F.lit(hops - 1)))
    unfolded = joined.withColumn("_i", F.explode_outer(starts)).select(
        *tx.columns, hopping.window_in_span(F.col("_i"), (size, slide)).alias("window"),
        *[F.get(f"_{v}", F.col("_i").cast("int")).alias(v) for v in values],
    ).unionByName(tx.filter(F.col("timestamp").isNull()), allowMissingColumns=True)
    return hopping.amount_zscore(unfolded) if name == "stats_24h" else hopping.default_counts(unfolded, *values)


def parsed_transactions(messages: DataFrame) -> DataFrame:
    """Raw topic to transactions with their time features."""
    return parse.time_features(parse.drop_undecodable(parse.parse_transactions(messages)))


def features_of_batch(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Trailing features of a batch of transactions, given earlier ones of the same users."""
    fresh = batch.withColumn("_fresh", F.lit(True))
    past = history.select("user_id", "timestamp", "amount").withColumn("_fresh", F.lit(False))
    both = fresh.unionByName(past, allowMissingColumns=True)
    return trailing.trailing_features(both).filter("_fresh").drop("_fresh")
