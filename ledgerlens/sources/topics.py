"""Message topics: Kafka, or folders of files that stand in for it.

`where` is either a dict of Kafka options (at least kafka.bootstrap.servers) or
a folder that has one sub-folder per topic. Both give a text column `value`, the
name of the `topic`, and the place of the message in it: `broker_time`, `partition`
and `offset`. For files these are the time the file was written, 0, and the number
of the row in its file.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: topic names ------------------------------------------------------
RAW = "transactions.raw"
PREPROCESSED = "transactions.preprocessed"
LEVEL2 = "transactions.level2"
LEVEL1_ACTIONS = "level1.actions"
LEVEL2_VERDICTS = "level2.verdicts"
FINAL_DECISIONS = "final.decisions"
GATEKEEPING = "gatekeeping.events"
FEEDBACK = "feedback.labels"
# ----------------------------------------------------------------------------

_FILE_SCHEMA = "value string"
POSITION = ("broker_time", "partition", "offset")  # in the order that messages are in


def _folder(where: str, topic: str) -> str:
    return f"{where.rstrip('/')}/{topic}"


def read_topic(spark: SparkSession, topic: str, where, streaming: bool = True,
               fail_on_data_loss: bool = True, **options) -> DataFrame:
    """All messages of a topic from the earliest on."""
    return read_topics(spark, [topic], where, streaming, fail_on_data_loss, **options)


def read_topics(spark: SparkSession, topics: list[str], where, streaming: bool = True,
                fail_on_data_loss: bool = True, **options) -> DataFrame:
    """Messages of several topics in one frame; `topic` says which one each came from."""
    reader = spark.readStream if streaming else spark.read
    if isinstance(where, dict):
        source = reader.format("kafka").options(**where).options(**options).option("subscribe", ",".join(topics)) \
            .option("startingOffsets", "earliest").option("failOnDataLoss", str(fail_on_data_loss).lower()).load()
        return source.select(F.col("value").cast("string").alias("value"), "topic",
                             F.col("timestamp").alias("broker_time"), "partition", "offset")
    parts = [
        reader.schema(_FILE_SCHEMA).options(**options).parquet(_folder(where, topic))
        .select("value", F.lit(topic).alias("topic"), F.col("_metadata.file_modification_time").alias("broker_time"),
                F.lit(0).alias("partition"), F.col("_metadata.row_index").alias("offset")) for topic in topics
    ]
    return reduce(DataFrame.unionByName, parts)


def write_topic(df: DataFrame, topic: str, where, checkpoint: str | None = None, available_now: bool = False):
    """Append messages (`value`, optionally `key`) to a topic.

    A batch frame is written at once. A streaming frame needs a checkpoint folder
    and gives the started query: exactly-once into files, at-least-once into Kafka.
    """
    kafka = isinstance(where, dict)
    messages = df.select(*[c for c in ("key", "value") if c in df.columns]) if kafka else df.select("value")
    if not df.isStreaming:
        writer = messages.write.mode("append")
        if kafka:
            return writer.format("kafka").options(**where).option("topic", topic).save()
        return writer.parquet(_folder(where, topic))
    if checkpoint is None:
        raise ValueError("a streaming write needs a checkpoint folder")
    writer = messages.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if kafka:
        return writer.format("kafka").options(**where).option("topic", topic).start()
    return writer.format("parquet").start(_folder(where, topic))


def read_ingest_json(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw bodies to be validated, one per line."""
    return (spark.readStream if streaming else spark.read).text(path)


def from_json_rows(spark: SparkSession, rows: list[str]) -> DataFrame:
    """Messages made in memory."""
    return spark.createDataFrame([(row,) for row in rows], _FILE_SCHEMA)
