"""Running totals over a global order, without a single-task window."""

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST = -(2**63)
_PART_ROWS = 100_000  # rows without a bucket that one task sorts, about
_BYTES = 6  # of a text, behind what all have in common, that its place is read from


def running_totals(
    df: DataFrame,
    order: list[Column],
    bucket: Column,
    totals: dict[str, Column],
    within: tuple[str, ...] = (),
    unplaced: Column | None = None,
    part_rows: int = _PART_ROWS,
) -> DataFrame:
    """Add for every name in `totals` its inclusive running sum under `order`, and `<name>_all`.

    A window over the whole table would sort it in one task. Instead `bucket`, an
    integer that never decreases along `order`, cuts the order into ranges: sums
    per bucket are pre-aggregated on the map side, only those few rows are summed
    across buckets, and the rows themselves are sorted bucket by bucket in
    parallel. `within` holds non-null columns that start the order afresh.
    Rows with a null bucket sort first. If `unplaced`, a text, orders those rows, they
    are cut into ranges of it, so that any number of them is sorted in parallel, too.
    """
    keys = [*within, "_bucket", "_part"]
    part = F.lit(0) if unplaced is None else _part_of(df.filter(bucket.isNull()), unplaced, part_rows)
    rows = df.withColumns({
        "_bucket": F.coalesce(bucket.cast("bigint"), F.lit(_FIRST)),
        "_part": F.when(bucket.isNull(), part).otherwise(0).cast("bigint"),
    })
    per_bucket = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])

    # One row per bucket: the caller's bucket width bounds this table, not the data.
    across = Window.partitionBy(*within)
    before = across.orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(f"_sum_{n}").over(across).alias(f"{n}_all") for n in totals],
    )

    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()],
        *[f"{n}_all" for n in totals],
    )


def _part_of(rows: DataFrame, text: Column, part_rows: int) -> Column:
    """Number of the range of a text between the least and the greatest one; it never decreases along the order of texts.

    Texts sort by their bytes. The ranges are even in the first bytes behind the prefix that all share.
    """
    found = rows.agg(F.min(text).alias("low"), F.max(text).alias("high"), F.count(F.lit(1)).alias("n")).first()
    parts = min(-(-found["n"] // part_rows), 1 << 12)
    if parts <= 1 or found["low"] is None:
        return F.lit(0)
    low, high = found["low"].encode(), found["high"].encode()
    shared = len(os.path.commonprefix([low, high]))

    def number(value: bytes) -> int:
        return int.from_bytes(value[shared:shared + _BYTES].ljust(_BYTES, b"\0"), "big")

    behind = F.substring(F.encode(text, "UTF-8"), shared + 1, _BYTES)
    place = F.conv(F.rpad(F.hex(behind), 2 * _BYTES, "0"), 16, 10).cast("bigint") - number(low)
    return F.coalesce(F.floor(place * parts / F.lit(number(high) - number(low) + 1)), F.lit(0))
