"""Time helpers on microseconds since the epoch."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp)


def slot(us: Column, width: int) -> Column:
    """Number of the epoch-aligned interval of `width` micros that holds `us` (exact, floors)."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("bigint")


def slot_start(number: Column, width: int) -> Column:
    return F.timestamp_micros(number * F.lit(width))


def iso_utc(timestamp: Column) -> Column:
    """ISO text with a trailing Z, whatever the session's time zone is."""
    return F.date_format(F.to_utc_timestamp(timestamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def slot_or_spread(usable: Column, number: Column) -> Column:
    """Group of a row by its time slot; rows that are not `usable` belong to no user's time.

    Those are spread by the input partition they come from, which bounds their
    group and stays the same when a task is repeated. The offset keeps the groups
    apart from all real slots.
    """
    return F.when(usable, number).otherwise(F.lit(-(2**40)) - F.spark_partition_id())
