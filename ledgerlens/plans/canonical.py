"""The pipeline's inputs as views over the supplied tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _transaction_columns(events: DataFrame, nation: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.col("user_id")
    place = F.pmod(user + F.floor(k / 90), F.lit(25))
    named = nation.select(F.col("n_nationkey").cast("bigint").alias("_nation"), F.col("n_name").alias("location"))
    rows = events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        user.cast("string").alias("user_id"),
        (F.col("value") * 20).alias("amount"),
        F.col("event_type").alias("merchant_category"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("device_"), user.cast("string"), F.lit("_"), F.pmod(k, F.lit(4)).cast("string"))
        .alias("device_id"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("is_fraud"),
        k.alias("k"), place.alias("_nation"),
    )
    return rows.join(named, "_nation", "left").drop("_nation")


TRANSACTION = ["transaction_id", "user_id", "amount", "merchant_category", "timestamp", "location", "device_id",
               "is_fraud"]


def transactions(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    rows = _transaction_columns(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))
    return rows.select(*TRANSACTION, *keep)


def transaction_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same transactions as a file stream over the events table."""
    events = table(spark, sf_dir, "events")
    reader = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _transaction_columns(reader.parquet(sf_dir), table(spark, sf_dir, "nation")).select(*TRANSACTION)


def raw_messages(tx: DataFrame) -> DataFrame:
    """Transactions as they travel on the raw topic."""
    text = tx.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return text.select(F.to_json(F.struct(*TRANSACTION)).alias("value"))


# Bodies sent to the gate, valid and broken in every way the schema knows, by the event's k.
# The text is plain SQL that any engine reads the same way.
INGEST_BODY = """
CASE k % 20
  WHEN 0 THEN concat('{"transaction_id":"', transaction_id, '","amount":-100.0}')
  WHEN 4 THEN concat('{"transaction_id":"', transaction_id, '"')
  WHEN 7 THEN concat('["', transaction_id, '"]')
  ELSE concat('{"transaction_id":"', transaction_id, '","user_id":',
    CASE k % 20 WHEN 6 THEN 'null' WHEN 8 THEN user_id ELSE concat('"', user_id, '"') END,
    ',"device_id":"', device_id, '","amount":',
    CASE k % 20 WHEN 1 THEN '-1000' WHEN 2 THEN '"not_a_number"' WHEN 5 THEN 'true'
      WHEN 9 THEN '150' ELSE '150.5' END,
    ',"timestamp":"', CASE k % 20 WHEN 3 THEN 'invalid_date' ELSE '2024-01-01T00:00:00' END,
    '","merchant_category":"', merchant_category, '","note":', CASE k % 20 WHEN 10 THEN '{"a":[1]}' ELSE '1' END, '}')
END"""


def ingest_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir, "k").select(
        F.col("transaction_id").alias("message_id"), F.expr(INGEST_BODY).alias("value")
    )


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users divisible by 37, and the fourth device of users that end in 1."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    text = F.col("user_id").cast("string")
    return users.filter(F.col("user_id") % 37 == 0).select(text.alias("value")).unionByName(
        users.filter(F.col("user_id") % 10 == 1).select(
            F.concat(F.lit("device_"), text, F.lit("_3")).alias("value")
        )
    )


# Level 2 messages with every kind of graph features, by the event's k.
GRAPH_MESSAGE = """
concat('{"transaction_id":"', transaction_id, '","user_id":"', user_id, '","device_id":"', device_id, '"',
  CASE WHEN k % 9 = 0 THEN '' ELSE concat(',"amount":', CAST(k * 37 - 100 AS STRING)) END,
  CASE k % 6
    WHEN 0 THEN ''
    WHEN 1 THEN ',"graph_features":{"neighbor_count":0,"graph_score":0.0}'
    WHEN 2 THEN concat(',"graph_features":{"neighbor_count":', CAST(k % 7 AS STRING), ',"graph_score":"0.25"}')
    WHEN 3 THEN ',"graph_features":{"graph_score":0.5}'
    WHEN 4 THEN ',"graph_features":{"neighbor_count":"many","graph_score":0.1}'
    ELSE ',"graph_features":{"neighbor_count":20,"graph_score":-0.5}'
  END, '}')"""


def graph_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir, "k").select(F.expr(GRAPH_MESSAGE).alias("value"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        (~failed).alias("success"),
        F.when(failed, F.when(F.col("value") > 50, 500).otherwise(422)).otherwise(200).alias("status_code"),
        (F.col("value") * 10).alias("response_time"),
        F.col("event_id").cast("string").alias("transaction_id"),
        F.when(failed & (F.col("value") > 100), F.lit("timeout")).alias("error"),
        F.col("ts").cast("timestamp").alias("requested_at"),
    )


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operator judgement per transaction, a day later; most have no review, and views get an unknown verdict."""
    verdict = (
        F.when(F.col("merchant_category") == "view", "Unsure").when(F.col("is_fraud"), "Block").otherwise("Allow")
    )
    return transactions(spark, sf_dir).select(
        F.col("transaction_id").alias("review_id"), verdict.alias("verdict"),
        F.concat(F.lit("operator_"), F.pmod(F.col("user_id").cast("bigint"), F.lit(5)).cast("string"))
        .alias("operator_id"),
        F.concat(F.lit("seen at "), F.col("location")).alias("comment"),
        F.timestamp_micros(F.unix_micros("timestamp") + F.lit(86_400_000_000)).alias("judged_at"),
    )
