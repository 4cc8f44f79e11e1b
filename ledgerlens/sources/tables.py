"""Tables: Parquet folders, or a database over JDBC.

`where` is a folder with one sub-folder per table, or a dict of JDBC options
(url, driver, user ...). Parquet tables of the pipeline are partitioned by who
wrote them, by the epoch of the writer, and by date. A stream's writer is the id
in its checkpoint: a repeated micro-batch replaces its own rows, and a stream with
a new checkpoint, whose epochs start again, leaves those of others alone. Epochs that
are final are compacted (see segments); readers see rows in either place once.
"""

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, MapType, StringType, StructField, StructType

from ledgerlens import schemas
from ledgerlens.sources import segments

BATCH = "batch"  # writer of rows that no stream wrote
REVIEW_IDS = "review_ids"
BUCKETS = 1024  # of the ids of reviewed transactions

SCHEMAS = {
    "manual_reviews": schemas.MANUAL_REVIEWS,
    "feedback_labels": schemas.FEEDBACK_LABELS,
    "final_decisions": schemas.FINAL_DECISIONS,
}


def _folder(where: str, name: str) -> str:
    return f"{where.rstrip('/')}/{name}"


def read_table(spark: SparkSession, where, name: str, schema=None, split: tuple[str, int] | None = None) -> DataFrame:
    """A table, empty if it has not been written yet.

    A database table is read by one task unless `split` names a number or time column and how many tasks share its range.
    """
    if isinstance(where, dict):
        reader = spark.read.format("jdbc").options(**where)
        if split is None:
            return reader.option("dbtable", name).load()
        ends = spark.read.format("jdbc").options(**where).option("query", range_query(name, split[0])).load().first()
        return reader.options(**split_options(*split, *ends)).option("dbtable", name).load()
    schema = schema or SCHEMAS.get(name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        found = reader.parquet(_folder(where, name))
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    found = segments.live(found, _folder(where, name))
    return found if schema is None else found.select(*schema.names)


def range_query(name: str, column: str) -> str:
    return f"SELECT min({column}) AS low, max({column}) AS high FROM {name}"


def split_options(column: str, parts: int, low, high) -> dict[str, str]:
    """Options that let `parts` tasks read a range each; none for a table without values."""
    if low is None:
        return {}
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def replace_statements(name: str, columns: list[str], stage: str, writer: str, epoch: int) -> list[str]:
    """What turns staged rows into those of a writer's epoch, in one transaction: an earlier attempt's rows go."""
    listed, by = ", ".join(columns), writer.replace("'", "''")
    return [
        f"DELETE FROM {name} WHERE writer = '{by}' AND epoch = {epoch}",
        f"INSERT INTO {name} ({listed}, writer, epoch) SELECT {listed}, '{by}', {epoch} FROM {stage}",
        f"DROP TABLE {stage}",
    ]


def stage_name(name: str, writer: str, epoch: int) -> str:
    """A table for what a writer's epoch stages: a repeated attempt overwrites it."""
    return f"{name}_{hashlib.md5(writer.encode()).hexdigest()[:12]}_{epoch}"


def _in_one_transaction(spark: SparkSession, where: dict, statements: list[str]) -> None:
    properties = spark._jvm.java.util.Properties()
    for key in ("user", "password"):
        if key in where:
            properties.setProperty(key, where[key])
    connection = spark._jvm.java.sql.DriverManager.getConnection(where["url"], properties)
    try:
        connection.setAutoCommit(False)
        for statement in statements:
            connection.createStatement().executeUpdate(statement)
        connection.commit()
    finally:
        connection.close()  # what is not committed is rolled back


def _append_to_database(df: DataFrame, where: dict, name: str, epoch: int | None, writer: str) -> None:
    """Structs and arrays as JSON. With an epoch, rows are staged by all tasks and replace those of the epoch at once."""
    rows = df.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else f.name
                      for f in df.schema.fields])
    if epoch is None:
        rows.write.format("jdbc").options(**where).option("dbtable", name).mode("append").save()
        return
    stage = stage_name(name, writer, epoch)
    rows.write.format("jdbc").options(**where).option("dbtable", stage).mode("overwrite").save()
    _in_one_transaction(df.sparkSession, where, replace_statements(name, rows.columns, stage, writer, epoch))


def compact_table(spark: SparkSession, where, name: str, writer: str, epoch: int, fan: int | None = None) -> None:
    """Compact what a writer wrote before `epoch`, if that is enough. Databases need no such thing."""
    if not isinstance(where, dict):
        segments.compact(spark, _folder(where, name), writer, epoch, "bucket" if name == REVIEW_IDS else "day", fan or segments.FAN)


def append_table(
    df: DataFrame, where, name: str, day: str = "created_at", epoch: int | None = None, writer: str = BATCH
) -> None:
    """Append rows. With `epoch` the write is idempotent: it replaces all that this writer's epoch wrote before.

    Database tables that streams write need columns writer and epoch for that.
    """
    if isinstance(where, dict):
        _append_to_database(df, where, name, epoch, writer)
        return
    rows = df.withColumn("day", F.to_date(day))
    if epoch is None:
        rows.withColumns({"writer": F.lit(writer), "epoch": F.lit(0)}).write.mode("append") \
            .partitionBy("writer", "epoch", "day").parquet(_folder(where, name))
    else:
        # the whole folder is replaced: a repeat may date its rows differently
        rows.write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "static") \
            .parquet(f"{_folder(where, name)}/writer={writer}/epoch={epoch}")


def append_final_decisions(rows: DataFrame, where, epoch: int | None = None, writer: str = BATCH) -> None:
    append_table(rows, where, "final_decisions", epoch=epoch, writer=writer)


def append_manual_reviews(rows: DataFrame, where, epoch: int | None = None, writer: str = BATCH) -> None:
    append_table(rows, where, "manual_reviews", epoch=epoch, writer=writer)


def bucket_of(transaction_id: Column) -> Column:
    return F.pmod(F.xxhash64(transaction_id), F.lit(BUCKETS)).cast("int")


def append_review_ids(spark: SparkSession, where: str, epoch: int, writer: str = BATCH) -> None:
    """Ids of the reviews that an epoch has opened, taken from what it has written. A database has its index instead."""
    if isinstance(where, dict):
        return
    opened = read_epoch(spark, where, "manual_reviews", epoch, "transaction_id string", writer)
    opened.select("transaction_id", bucket_of(F.col("transaction_id")).alias("bucket")).write.mode("overwrite") \
        .parquet(f"{_folder(where, REVIEW_IDS)}/writer={writer}/epoch={epoch}")


def reviewed_ids(spark: SparkSession, where: str, escalated: DataFrame, epoch: int, writer: str = BATCH) -> DataFrame:
    """transaction_id of the reviews of other writers and earlier epochs, in the buckets of the `escalated` transactions.

    Compacted ids lie in folders by bucket, and no other folders are read. The
    numbers of the buckets, BUCKETS at most, go through the driver. Reviews that a
    stream without this table has written are taken over once.
    """
    own = (F.col("writer") == writer) & (F.col("epoch") >= epoch)
    if isinstance(where, dict):
        return read_table(spark, where, "manual_reviews").filter(~own).select("transaction_id")
    folder = _folder(where, REVIEW_IDS)
    if not segments.exists(spark, folder):
        before = read_table_before(spark, where, "manual_reviews", epoch, "transaction_id string", writer)
        segments.seed(before.select("transaction_id", bucket_of(F.col("transaction_id")).alias("bucket")), folder, "seed", "bucket")
    wanted = [r[0] for r in escalated.select(bucket_of(F.col("transaction_id")).alias("b")).distinct().collect()]
    schema = StructType.fromDDL("transaction_id string, bucket int, writer string, epoch int")
    return read_table(spark, where, REVIEW_IDS, schema).filter(F.col("bucket").isin(wanted) & ~own).select("transaction_id")


def append_feedback(rows: DataFrame, where, epoch: int | None = None, writer: str = BATCH) -> None:
    append_table(rows, where, "feedback_labels", epoch=epoch, writer=writer)


def replace_reviews(snapshot: DataFrame, where: str, name: str) -> None:
    """Write a judged snapshot under its own name; a table cannot be overwritten while it is read."""
    snapshot.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day") \
        .parquet(_folder(where, name))


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_hot_features(batch: DataFrame, where: str, epoch: int, writer: str = BATCH) -> None:
    """New version of the users' hot features. Readers take the newest version of a user within its TTL."""
    append_table(batch, where, "hot_features", day="updated_at", epoch=epoch, writer=writer)


def read_hot_features(spark: SparkSession, where: str, days: tuple | None = None) -> DataFrame:
    """All versions, or those of the days from days[0] to days[1]; no other folders are read then."""
    found = read_table(spark, where, "hot_features", _with_partitions(schemas.HOT_FEATURES))
    kept = found if days is None else found.filter(F.col("day").between(*days))
    return kept.select(*schemas.HOT_FEATURES.names)


def _with_partitions(schema) -> StructType:
    base = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StructType([
        *base.fields, StructField("writer", StringType()), StructField("epoch", IntegerType()), StructField("day", DateType()),
    ])


def read_table_before(spark: SparkSession, where: str, name: str, epoch: int, schema, writer: str = BATCH) -> DataFrame:
    """Rows of other writers and of earlier epochs: a repeated batch does not see its own first attempt."""
    own = (F.col("writer") == writer) & (F.col("epoch") >= epoch)
    return read_table(spark, where, name, _with_partitions(schema)).filter(~own)


def read_epoch(spark: SparkSession, where: str, name: str, epoch: int, schema, writer: str = BATCH) -> DataFrame:
    """Rows that one epoch of a writer wrote."""
    return read_table(spark, where, name, _with_partitions(schema)).filter(
        (F.col("writer") == writer) & (F.col("epoch") == epoch)).drop("writer", "epoch", "day")
