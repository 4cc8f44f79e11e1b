"""Request-log reports, running rates and the keyword scan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import times
from ledgerlens.operators.running import running_totals

# --- fixed values ---------------------------------------------------------------
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
SLA_SUCCESS_PCT, SLA_MEAN_MS, SLA_THROUGHPUT = 95, 1000, 10
SENSITIVE_KEYWORDS = ["password", "secret", "token", "key", "credential"]
REPORT_EVERY = 100
# ----------------------------------------------------------------------------


def _response_ranks(log: DataFrame) -> DataFrame:
    """Median and nearest-rank percentiles of successful response times, exact and in one row.

    Equal times are counted together first; the ranks come from running totals
    over 1 ms buckets, so no task sorts all response times.
    """
    times_seen = log.filter("success").groupBy("response_time").agg(F.count("*").alias("requests"))
    ranked = running_totals(
        times_seen, [F.col("response_time")], F.floor("response_time"), {"upto": F.col("requests")}
    )

    def value_at(rank: Column) -> Column:
        """Value at a zero-based rank of the sorted list."""
        return F.min(F.when(F.col("upto") > rank, F.col("response_time")))

    n = F.col("upto_all")
    return ranked.agg(
        ((value_at(F.floor((n - 1) / 2)) + value_at(F.floor(n / 2))) / 2).alias("median"),
        *[value_at((n * F.lit(p)).cast("bigint")).alias(name) for name, p in PERCENTILES.items()],
    )


def latency_report(log: DataFrame) -> DataFrame:
    """Requests, shares, throughput and response-time statistics in one row."""
    ok = F.when(F.col("success"), F.col("response_time"))
    seconds = (times.micros(F.max("requested_at")) - times.micros(F.min("requested_at"))) / times.SECOND
    share = F.lit(100.0) / F.nullif(F.count("*"), F.lit(0))
    totals = log.agg(
        F.count("*").alias("total_requests"),
        F.count_if("success").alias("successful"),
        (F.count("*") - F.count_if("success")).alias("failed"),
        (F.count_if("success") * share).alias("success_pct"),
        ((F.count("*") - F.count_if("success")) * share).alias("failed_pct"),
        seconds.alias("duration_seconds"),
        F.when(seconds > 0, F.count("*") / seconds).otherwise(0.0).alias("throughput"),
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev(ok).alias("stdev"),
    )
    ranks = _response_ranks(log)
    return totals.withColumn("_ranks", ranks.select(F.struct(*ranks.columns)).scalar()).select(
        *totals.columns, "_ranks.*"
    )


def error_breakdown(log: DataFrame) -> DataFrame:
    """Failures by error text, or by HTTP status where there is none, most frequent first."""
    kind = F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    return log.filter(~F.col("success")).groupBy(kind.alias("error")).agg(
        F.count("*").alias("occurrences")
    ).orderBy(F.desc("occurrences"), "error")


def sla_check(log: DataFrame) -> DataFrame:
    """One row per criterion with its value, target and result."""
    ok = F.when(F.col("success"), F.col("response_time"))
    seconds = (times.micros(F.max("requested_at")) - times.micros(F.min("requested_at"))) / times.SECOND
    measured = log.agg(
        F.coalesce(F.count_if("success") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("success"),
        F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean"),
        F.when(seconds > 0, F.count("*") / seconds).otherwise(0.0).alias("throughput"),
    )

    def row(name, value, target, passed):
        return F.struct(F.lit(name).alias("criterion"), value.alias("value"), F.lit(target).alias("target"),
                        passed.alias("passed"))

    success, mean, throughput = F.col("success"), F.col("mean"), F.col("throughput")
    return measured.select(F.inline(F.array(
        row("Success Rate", success, f">= {SLA_SUCCESS_PCT}%", success >= SLA_SUCCESS_PCT),
        row("Average Response Time", mean, f"< {SLA_MEAN_MS}ms", mean < SLA_MEAN_MS),
        row("Throughput", throughput, f"> {SLA_THROUGHPUT} req/sec", throughput > SLA_THROUGHPUT),
    )))


def running_fraud_rate(df: DataFrame, every: int = REPORT_EVERY) -> DataFrame:
    """Cumulative fraud share in time order, one row per `every` transactions."""
    minute = times.slot(times.micros(F.col("timestamp")), times.MINUTE)
    counted = running_totals(
        df.select("timestamp", "transaction_id", "is_fraud"),
        [F.col("timestamp"), F.col("transaction_id")], minute,
        {"sent": F.lit(1), "fraudulent": F.when(F.col("is_fraud"), 1).otherwise(0)},
        unplaced=F.col("transaction_id"),
    )
    return counted.filter(F.col("sent") % every == 0).select(
        "sent", "fraudulent", (F.col("fraudulent") * 100.0 / F.col("sent")).alias("fraud_rate")
    )


def sensitive_keyword_scan(df: DataFrame, column: str) -> DataFrame:
    """Add `keywords`, the sensitive words the lower-cased text contains, and `exposed`."""
    lowered = F.lower(F.col(column))
    found = F.array_compact(F.array(*[F.when(lowered.contains(w), F.lit(w)) for w in SENSITIVE_KEYWORDS]))
    return df.withColumn("keywords", found).withColumn("exposed", F.size("keywords") > 0)
