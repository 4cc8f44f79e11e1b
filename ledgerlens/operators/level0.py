"""Level 0 gate: schema check of incoming bodies and blacklist verdict."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import times
from ledgerlens.functions.barrier import evaluate_once

# --- fixed values: the ingest contract ----------------------------------------
REQUIRED = ["transaction_id", "user_id", "amount", "timestamp", "device_id"]
TEXT_FIELDS = ["transaction_id", "user_id", "device_id", "merchant_category", "timestamp", "location"]
NUMBER_FIELD, NUMBER_MINIMUM = "amount", 0
# ----------------------------------------------------------------------------

_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_FIELDS = [*TEXT_FIELDS, NUMBER_FIELD]


def validate_schema(df: DataFrame, strict_time: bool = False) -> DataFrame:
    """Add `readable`, `violations` (array of text) and the extracted fields to JSON bodies in `value`.

    Unknown extra fields are allowed. The date format of the timestamp is only
    enforced with `strict_time`.
    """
    body = F.col("_body")
    parsed = evaluate_once(df, F.struct(F.try_parse_json(F.col("value").cast("string")).alias("_body")))
    # Type names of the body and its fields; null when a field is missing.
    kinds = evaluate_once(parsed, F.struct(
        F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False)).alias("_is_object"),
        *[F.schema_of_variant(F.try_variant_get(body, f"$.{f}", "variant")).alias(f"_kind_{f}") for f in _FIELDS],
    ))
    is_object = F.col("_is_object")

    def kind(field):
        return F.col(f"_kind_{field}")

    def value(field, wanted, type_name):
        return F.when(is_object & wanted, F.try_variant_get(body, f"$.{field}", type_name)).alias(field)

    is_number = F.coalesce(kind(NUMBER_FIELD).rlike(_NUMBER), F.lit(False))
    typed = evaluate_once(kinds, F.struct(
        *[value(f, kind(f) == "STRING", "string") for f in TEXT_FIELDS], value(NUMBER_FIELD, is_number, "double"),
    ))

    def check(failed: Column, label: str) -> Column:
        return F.when(failed, F.lit(label))

    checks = [check(~is_object, "type:body")]
    checks += [check(is_object & kind(f).isNull(), f"missing:{f}") for f in REQUIRED]
    checks += [check(is_object & (kind(f) != "STRING"), f"type:{f}") for f in TEXT_FIELDS]
    checks += [
        check(is_object & kind(NUMBER_FIELD).isNotNull() & ~is_number, f"type:{NUMBER_FIELD}"),
        check(F.col(NUMBER_FIELD) < NUMBER_MINIMUM, f"minimum:{NUMBER_FIELD}"),
    ]
    if strict_time:
        bad_time = F.col("timestamp").isNotNull() & F.col("timestamp").try_cast("timestamp").isNull()
        checks.append(check(bad_time, "format:timestamp"))
    found = F.when(body.isNotNull(), F.array_compact(F.array(*checks))).otherwise(F.array(F.lit("unparseable")))
    return typed.select(
        *df.columns, body.isNotNull().alias("readable"), found.alias("violations"), *TEXT_FIELDS, NUMBER_FIELD
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") == 0).drop("violations", "readable")


def rejected(validated: DataFrame) -> DataFrame:
    """Readable bodies that break the schema."""
    return validated.filter(F.col("readable") & (F.size("violations") > 0))


def reject_bad_json(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("readable"))


def blacklist_match(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Add user_listed and device_listed from a table of listed values (`value`); empty values never match.

    No broadcast hint: the list may grow, so Spark picks the join from its
    measured size, and splits hot users of the left side if it has to shuffle.
    """
    listed = blacklist.filter(F.col("value").isNotNull() & (F.col("value") != "")).select("value").distinct()

    def flagged(rows, column, flag):
        marks = listed.select(F.col("value").alias(f"_{flag}"))
        return rows.join(marks, F.col(column) == F.col(f"_{flag}"), "left").withColumn(
            flag, F.col(f"_{flag}").isNotNull()
        ).drop(f"_{flag}")

    return flagged(flagged(df, "user_id", "user_listed"), "device_id", "device_listed")


def level0_verdict(df: DataFrame) -> DataFrame:
    """Verdict and reason from the two membership flags; the user check wins."""
    return df.withColumns({
        "verdict": F.when(F.col("user_listed") | F.col("device_listed"), "Quarantine").otherwise("Allow"),
        "reason": F.when(F.col("user_listed"), "user_id_blacklist")
        .when(F.col("device_listed"), "device_id_blacklist").otherwise("passed"),
    })


def gatekeeping_events(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Level 0 event of every accepted body, with the whole body as payload."""
    return df.select(
        F.lit(0).alias("level"), "transaction_id", "user_id", "device_id", "verdict", "reason",
        F.col("value").alias("payload"),
        times.iso_utc(F.current_timestamp() if at is None else at).alias("timestamp"),
    )


def route_l0_quarantined(events: DataFrame) -> DataFrame:
    return events.filter(F.col("verdict") == "Quarantine")
