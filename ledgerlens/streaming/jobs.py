"""Streaming jobs: thin wrappers that feed micro-batches to the batch operators.

Every job writes from the executors, has a checkpoint folder of its own, and
tags what it writes with the query's id, which lives in that folder, and the epoch of the micro-batch,
so that a repeated batch replaces its tables rows instead of adding to them, and
jobs do not replace each other's. Topics are at-least-once.
"""

import contextlib
import datetime as dt
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import decisions, level0, level1, level2, parse, trailing
from ledgerlens.sources import segments, tables, topics
from ledgerlens.streaming.windows import features_of_batch


# --- fixed value: rows of a batch that one task of its shuffles gets, about ---------
_TASK_ROWS = 100_000
# ----------------------------------------------------------------------------


@contextlib.contextmanager
def shuffle_by_rows(spark, rows: int):
    """As many shuffle partitions as a batch of so many rows needs, at least those set.

    A stream's session sets one per core, and adaptive execution only merges partitions: a task would get ever more rows.
    """
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(max(int(usual), -(-rows // _TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _now():
    """The time of a batch, the same in all of its writes."""
    return F.lit(dt.datetime.now(dt.timezone.utc))


def start(stream: DataFrame, process, checkpoint: str, available_now: bool = False, table_where=None,
          compacted: tuple[str, ...] = ()) -> StreamingQuery:
    """foreachBatch with an own checkpoint.

    `process` gets non-empty batches, cached for its several writes, with their epoch and writer. Every
    segments.FAN epochs, the `compacted` tables lose the epoch folders of all batches before.
    """
    started, writer_ids = threading.Event(), []

    def run(batch: DataFrame, epoch: int):
        held = batch.persist()
        try:
            rows = held.count()
            if rows:
                started.wait()
                for name in compacted if epoch % segments.FAN == 0 else ():
                    tables.compact_table(batch.sparkSession, table_where, name, writer_ids[0], epoch)
                with shuffle_by_rows(batch.sparkSession, rows):
                    process(held, epoch, writer_ids[0])
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append")
    try:
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
        writer_ids.append(query.id)  # survives restarts; a new checkpoint has another
    finally:
        started.set()
    return query


def stream_gate(bodies: DataFrame, blacklist: DataFrame, topic_where, checkpoint: str, **options) -> StreamingQuery:
    """Level 0: every accepted body gives an event; quarantined ones go to level 2 as well."""
    def process(batch: DataFrame, epoch: int, writer: str):
        good = level0.accepted(level0.validate_schema(batch.select("value")))
        events = level0.gatekeeping_events(level0.level0_verdict(level0.blacklist_match(good, blacklist)), _now())
        topics.write_topic(parse.to_value(events), topics.GATEKEEPING, topic_where)
        routed = level0.route_l0_quarantined(events).withColumn(
            "amount", F.get_json_object("payload", "$.amount").try_cast("double")
        )
        topics.write_topic(parse.to_value(routed), topics.LEVEL2, topic_where)

    return start(bodies, process, checkpoint, **options)


def side_effects(features: DataFrame, epoch: int, topic_where, table_where, writer: str = tables.BATCH) -> None:
    """What a batch of features leaves behind: enriched messages, hot features and level 2 payloads."""
    enriched = trailing.enriched_projection(features)
    topics.write_topic(parse.to_value(enriched), topics.PREPROCESSED, topic_where)
    tables.upsert_hot_features(trailing.hot_features(features), table_where, epoch, writer)
    topics.write_topic(parse.to_value(level2.heavy_payload(features)), topics.LEVEL2, topic_where)


def stream_features(tx: DataFrame, topic_where, table_where, checkpoint: str, **options) -> StreamingQuery:
    """One row of trailing features per transaction, emitted with the micro-batch it arrives in.

    The last 24 hours are kept in the features table, partitioned by day, not in
    per-user state: state would put a busy user's whole day into one task. Each
    batch reads the days it can see, only for its own users, and the features of
    a user are computed minute by minute in parallel. A late row gets its true
    trailing frame; rows already emitted are not revised.
    """
    def process(batch: DataFrame, epoch: int, writer: str):
        spark = batch.sparkSession
        rows = parse.time_features(batch)
        span = batch.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
        past = tables.read_table_before(spark, table_where, "features", epoch, _FEATURE_ROW, writer)
        if span["first"] is None:
            history = past.limit(0)
        else:
            since, until = F.lit(span["first"]) - F.expr("INTERVAL 24 HOURS"), F.lit(span["last"])
            history = past.filter(
                F.col("day").between(F.to_date(since), F.to_date(until)) & F.col("timestamp").between(since, until)
            ).join(batch.select("user_id").distinct(), "user_id", "left_semi")
        featured = features_of_batch(rows, history)
        tables.append_table(featured, table_where, "features", day="timestamp", epoch=epoch, writer=writer)
        written = tables.read_epoch(spark, table_where, "features", epoch, featured.schema, writer)
        side_effects(written, epoch, topic_where, table_where, writer)

    return start(tx, process, checkpoint, table_where=table_where, compacted=("features", "hot_features"), **options)


_FEATURE_ROW = "user_id string, timestamp timestamp, amount double"


def stream_level1(tx: DataFrame, topic_where, table_where, checkpoint: str, model=None, **options) -> StreamingQuery:
    """Level 1: score with the user's hot feature as of the transaction; quarantined ones go to level 2."""
    def process(batch: DataFrame, epoch: int, writer: str):
        spark = batch.sparkSession
        span = batch.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
        # a feature is seen within its TTL, so no earlier day than the one before the batch counts
        first, last = F.lit(span["first"]).cast("date"), F.lit(span["last"]).cast("date")
        features = tables.read_hot_features(spark, table_where, (F.date_sub(first, 1), last))
        looked_up = trailing.lookup_hot_feature(batch, features)
        actions = level1.l1_actions(level1.model_scores(looked_up, model, "hot_tx_count_1min"))
        topics.write_topic(parse.to_value(actions), topics.LEVEL1_ACTIONS, topic_where)
        topics.write_topic(parse.to_value(level1.route_quarantined(actions)), topics.LEVEL2, topic_where)

    return start(tx, process, checkpoint, **options)


def stream_level2(messages: DataFrame, topic_where, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Level 2 is stateless: parse, score, judge, publish."""
    verdicts = parse.to_value(level2.level2_from_messages(messages))
    return topics.write_topic(verdicts, topics.LEVEL2_VERDICTS, topic_where, checkpoint, available_now)


def stream_decisions(messages: DataFrame, topic_where, table_where, checkpoint: str, **options) -> StreamingQuery:
    """One decision per level 1 or level 2 message; one review per transaction, ever.

    Decisions are published and appended to the audit table. Reviews are opened
    for escalated transactions that no earlier epoch has opened one for: an anti
    join with the ids of all reviews, of which a batch reads the buckets of its own
    transactions. It is exact and survives restarts: ids follow from the reviews
    an epoch has written, and a repeated epoch replaces both.
    """
    def process(batch: DataFrame, epoch: int, writer: str):
        spark = batch.sparkSession
        made = decisions.decisions_per_message(batch)
        at = F.coalesce(decisions.message_instant(made), _now())
        topics.write_topic(parse.to_value(decisions.final_decision(made, at)), topics.FINAL_DECISIONS, topic_where)
        tables.append_final_decisions(decisions.final_decision_rows(made, at), table_where, epoch, writer)
        existing = tables.reviewed_ids(spark, table_where, decisions.only_escalated(made), epoch, writer)
        opened = decisions.open_reviews(made, existing, at)
        tables.append_manual_reviews(opened, table_where, epoch, writer)
        tables.append_review_ids(spark, table_where, epoch, writer)

    kept = ("final_decisions", "manual_reviews", tables.REVIEW_IDS)
    return start(messages, process, checkpoint, table_where=table_where, compacted=kept, **options)


def await_all(spark) -> None:
    """Wait until any job ends, so that no job fails unseen."""
    spark.streams.awaitAnyTermination()
