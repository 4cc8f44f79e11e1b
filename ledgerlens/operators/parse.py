"""Messages to columns and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import times
from ledgerlens.schemas import HEAVY_PAYLOAD, LEVEL1_ACTION, LEVEL2_VERDICT, RAW_TRANSACTION


def from_value(df: DataFrame, schema) -> DataFrame:
    """Columns of the JSON text in `value`; an unreadable message becomes an all-null row.

    Inlined so that each message is parsed once, whatever is done with its fields.
    """
    return df.select(F.inline(F.array(F.from_json(F.col("value").cast("string"), schema))))


def parse_transactions(df: DataFrame) -> DataFrame:
    """Raw messages to typed transactions; a bad timestamp becomes null."""
    return from_value(df, RAW_TRANSACTION).withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def parse_level2(df: DataFrame) -> DataFrame:
    """Heavy payload messages; the timestamp stays text."""
    return from_value(df, HEAVY_PAYLOAD)


def parse_level1_actions(df: DataFrame) -> DataFrame:
    return from_value(df, LEVEL1_ACTION)


def parse_level2_verdicts(df: DataFrame) -> DataFrame:
    return from_value(df, LEVEL2_VERDICT)


def to_value(df: DataFrame, *keep: str) -> DataFrame:
    """Whole row as JSON text in `value` (nulls are left out); `keep` stays beside it."""
    return df.select(*keep, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def drop_undecodable(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Messages that could not be read have no id; an empty id counts as missing."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def time_features(df: DataFrame) -> DataFrame:
    """hour_of_day 0-23 and day_of_week with 0 = Monday."""
    return df.withColumns({
        "hour_of_day": F.hour("timestamp"),
        "day_of_week": F.weekday("timestamp"),
    })


def message_time(timestamp: Column) -> Column:
    """Timestamps inside messages are text."""
    return times.iso_utc(timestamp)
