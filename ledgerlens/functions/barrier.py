"""Keep a costly expression from being repeated."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, fields: Column, *keep: str) -> DataFrame:
    """`keep` (default: all columns) plus the fields of a struct expression, evaluated once per row.

    The optimizer copies projected expressions into every filter and field access
    above them; for parsed JSON that means parsing again and again. A generator
    of one row stops the copies and stays inside generated code.
    """
    return df.select(*(keep or ["*"]), F.inline(F.array(fields)))
