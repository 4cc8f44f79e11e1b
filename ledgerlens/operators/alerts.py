"""Alert feed over the final decisions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, times
from ledgerlens.operators.decisions import has_level1, has_level2
from ledgerlens.operators.running import running_totals

# --- fixed values: labels and display scores by detection level ----------------
LABELS = {2: "Fraud", 1: "Suspicious", 0: "Safe"}
DISPLAY_SCORES = {2: "0.98", 1: "0.65", 0: "0.12"}
NO_REASON = "No anomalies detected"
ID_CHARS = 18
FEED_SIZE = 100
MAX_PAGE_SIZE = 100
# ----------------------------------------------------------------------------

_TOP_K_ROWS = 10_000


def detection_level(decisions: DataFrame) -> DataFrame:
    path = F.col("detection_path")
    level = scoring.detection_level(has_level1(path["level1"]), has_level2(path["level2"]))
    return decisions.withColumn("detection_level", level)


def recent_alerts(decisions: DataFrame, n: int = FEED_SIZE) -> DataFrame:
    """Newest n decisions. Sort and limit become a per-partition top-k."""
    return detection_level(decisions.orderBy(F.desc("created_at"), F.desc("id")).limit(n))


def alert_detail(decisions: DataFrame, transaction_id: str) -> DataFrame:
    one = decisions.filter(F.col("transaction_id") == transaction_id)
    return recent_alerts(one, 1)


def latest_per_transaction(decisions: DataFrame) -> DataFrame:
    """alert_detail for every transaction at once."""
    newest = decisions.groupBy("transaction_id").agg(
        F.max_by(F.struct(*decisions.columns), F.struct("created_at", "id")).alias("d")
    ).select("d.*")
    return detection_level(newest)


def alerts_by_level(alerts: DataFrame, level: str | int = "all") -> DataFrame:
    return alerts if level == "all" else alerts.filter(F.col("detection_level") == int(level))


def alert_stats(alerts: DataFrame) -> DataFrame:
    level = F.col("detection_level")
    return alerts.agg(
        F.count("*").alias("total"), F.count_if(level == 2).alias("high_risk"),
        F.count_if(level == 1).alias("suspicious"), F.count_if(level == 0).alias("safe"),
    )


def alert_view(alerts: DataFrame) -> DataFrame:
    """What one line of the dashboard shows."""
    def by_level(texts):
        pick = F.when(F.lit(False), F.lit(None).cast("string"))
        for level, text in texts.items():
            pick = pick.when(F.col("detection_level") == level, text)
        return pick

    return alerts.select(
        "id", F.concat(F.substring("transaction_id", 1, ID_CHARS), F.lit("...")).alias("short_id"),
        by_level(LABELS).alias("status"),
        F.coalesce(by_level(DISPLAY_SCORES), F.lit(DISPLAY_SCORES[0])).alias("score"),
        F.coalesce(F.nullif("reason", F.lit("")), F.lit(NO_REASON)).alias("reason"),
    )


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def page(df: DataFrame, number: int = 1, page_size: int = 10) -> DataFrame:
    """One page of transactions in the order (timestamp, transaction_id), with total, page and page_size.

    Shallow pages are a top-k. A deep page would make every task keep all rows
    before it, so beyond a million rows positions are counted by running totals
    and the page is a filter.
    """
    if number < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1 and page_size is 1 to {MAX_PAGE_SIZE}")
    order = [F.col("timestamp").asc_nulls_first(), F.col("transaction_id").asc_nulls_first()]
    start = (number - 1) * page_size
    if start + page_size <= _TOP_K_ROWS:
        rows = df.orderBy(*order).offset(start).limit(page_size)
    else:
        minute = times.slot(times.micros(F.col("timestamp")), times.MINUTE)
        placed = running_totals(df, order, minute, {"_position": F.lit(1)}, unplaced=F.col("transaction_id"))
        rows = placed.filter(F.col("_position").between(start + 1, start + page_size)) \
            .orderBy("_position").drop("_position", "_position_all")
    return rows.withColumns({
        "total": df.select(F.count("*")).scalar(), "page": F.lit(number), "page_size": F.lit(page_size),
    })
