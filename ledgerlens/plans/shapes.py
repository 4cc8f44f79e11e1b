"""Flat, engine-neutral result shapes: rounded doubles, plain timestamps, no nested columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

_SCALE = 1e6  # six places


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Summation order differs between engines, so computed doubles are compared to six places.

    Scaled and floored, halves away from zero: the built-in round of doubles goes
    through decimals, which costs more than most of the queries.
    """
    def six_places(c):
        return F.signum(c) * F.floor(F.abs(c) * _SCALE + 0.5) / _SCALE + F.lit(0.0)

    return df.withColumns({n: six_places(F.col(n)) for n in names}) if names else df


def plain_times(df: DataFrame) -> DataFrame:
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps}) if stamps else df


def joined_text(column: Column) -> Column:
    return F.concat_ws(",", column)


def with_window_bounds(df: DataFrame) -> DataFrame:
    """window struct to window_start and window_end."""
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def decision_columns(df: DataFrame) -> list[Column]:
    """Scores and verdicts held in the level structs."""
    return [
        F.col("level1.score").alias("level1_score"), F.col("level1.verdict").alias("level1_verdict"),
        F.col("level2.heavy_score_clamped").alias("level2_score"), F.col("level2.verdict").alias("level2_verdict"),
    ]
