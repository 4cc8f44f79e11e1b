"""Named queries that run a stream over the supplied tables to its end and give what it wrote."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import level0, parse, reviews
from ledgerlens.plans import canonical, flow
from ledgerlens.plans.canonical import transactions
from ledgerlens.plans.registered import query
from ledgerlens.plans.shapes import rounded, with_window_bounds
from ledgerlens.schemas import FINAL_DECISION, LEVEL1_ACTION, LEVEL2_VERDICT
from ledgerlens.session import stream_session, work_folder
from ledgerlens.sources import tables, topics
from ledgerlens.streaming import jobs, windows


def _drain(stream: DataFrame, folder: str) -> str:
    """Run an append stream over all input there is into a Parquet folder, and name the folder."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    return f"{folder}/rows"


def _windows(spark, d, name: str, joined: bool, *columns: str) -> DataFrame:
    """All windows: once the input is read to its end, a closing row lets the last ones out."""
    session, folder = stream_session(spark), work_folder(spark, name)
    tx, closing = canonical.transaction_stream(session, d), f"{folder}/closing"
    last = windows.closing_row(session, tx.schema)
    last.limit(0).write.parquet(closing)
    tx = tx.unionByName(session.readStream.schema(tx.schema).parquet(closing))
    stream = (windows.window_join if joined else windows.window_aggregate)(tx, name)
    out = with_window_bounds(stream).select(*columns)
    _drain(out, folder)
    last.write.mode("append").parquet(closing)
    return spark.read.parquet(_drain(out, folder))


@query
def stream_user_stats_24h(spark, d):
    out = _windows(spark, d, "stats_24h", False, "user_id", "window_start", "mean_amount", "stddev_amount")
    return rounded(out, "mean_amount", "stddev_amount")


@query
def stream_tx_count_1h(spark, d):
    return _windows(spark, d, "count_1h", False, "user_id", "window_start", "tx_count")


@query
def stream_tx_count_1min(spark, d):
    return _windows(spark, d, "count_1min", False, "user_id", "window_start", "tx_count_1min")


@query
def stream_join_window_stats(spark, d):
    return rounded(
        _windows(spark, d, "stats_24h", True, "transaction_id", "window_start", "amount_zscore"), "amount_zscore"
    )


@query
def stream_join_hourly_counts(spark, d):
    return _windows(spark, d, "count_1h", True, "transaction_id", "window_start", "tx_count")


@query
def stream_join_minute_counts(spark, d):
    return _windows(spark, d, "count_1min", True, "transaction_id", "window_start", "tx_count_1min")


def _run_features(spark, d) -> str:
    folder = work_folder(spark, "features")
    tx = canonical.transaction_stream(stream_session(spark), d)
    jobs.stream_features(
        tx, f"{folder}/topics", f"{folder}/tables", f"{folder}/checkpoint", available_now=True
    ).awaitTermination()
    return folder


@query
def stream_trailing_features(spark, d):
    out = tables.read_table(spark, f"{_run_features(spark, d)}/tables", "features").select(
        "transaction_id", "mean_amount", "stddev_amount", "amount_zscore", "transactions_last_hour", "tx_count_1min"
    )
    return rounded(out, "mean_amount", "stddev_amount", "amount_zscore")


@query
def stream_hot_features(spark, d):
    return tables.read_hot_features(spark, f"{_run_features(spark, d)}/tables")


@query
def stream_side_effects(spark, d):
    """Level 2 payloads the feature job sent."""
    messages = topics.read_topic(spark, topics.LEVEL2, f"{_run_features(spark, d)}/topics", streaming=False)
    return parse.parse_level2(messages).select(
        "transaction_id", "user_id", "device_id", "amount", "timestamp",
        F.col("session_features.session_length").cast("bigint").alias("session_length"),
        F.col("graph_features.neighbor_count").cast("int").alias("neighbor_count"),
        F.col("graph_features.graph_score").cast("double").alias("graph_score"),
    )


@query
def stream_preprocessed(spark, d):
    """Enriched messages the feature job sent."""
    messages = topics.read_topic(spark, topics.PREPROCESSED, f"{_run_features(spark, d)}/topics", streaming=False)
    out = parse.from_value(messages, """transaction_id string, amount double, hour_of_day int, day_of_week int,
        amount_zscore double, transactions_last_hour bigint, tx_count_1min bigint""")
    return rounded(out, "amount_zscore")


@query
def stream_level0(spark, d):
    """Level 0 events; the bodies are read back from text, one per line."""
    folder = work_folder(spark, "gate")
    canonical.ingest_bodies(spark, d).select("value").write.text(f"{folder}/bodies")
    session = stream_session(spark)
    bodies = topics.read_ingest_json(session, f"{folder}/bodies", streaming=True)
    jobs.stream_gate(
        bodies, canonical.blacklist(session, d), f"{folder}/topics", f"{folder}/checkpoint", available_now=True
    ).awaitTermination()
    events = topics.read_topic(spark, topics.GATEKEEPING, f"{folder}/topics", streaming=False)
    return parse.from_value(
        events, "transaction_id string, user_id string, device_id string, verdict string, reason string"
    )


@query
def stream_level1(spark, d):
    """Level 1 with the hot features the feature job left: the newest of each user."""
    folder = _run_features(spark, d)
    tx = canonical.transaction_stream(stream_session(spark), d)
    jobs.stream_level1(
        tx, f"{folder}/level1", f"{folder}/tables", f"{folder}/checkpoint-level1", available_now=True
    ).awaitTermination()
    actions = topics.read_topic(spark, topics.LEVEL1_ACTIONS, f"{folder}/level1", streaming=False)
    return parse.from_value(actions, LEVEL1_ACTION).select("transaction_id", "amount", "score", "verdict")


@query
def stream_level2(spark, d):
    folder = work_folder(spark, "level2")
    topics.write_topic(canonical.graph_messages(spark, d), topics.LEVEL2, folder)
    messages = topics.read_topic(stream_session(spark), topics.LEVEL2, folder)
    jobs.stream_level2(messages, folder, f"{folder}/checkpoint", available_now=True).awaitTermination()
    verdicts = topics.read_topic(spark, topics.LEVEL2_VERDICTS, folder, streaming=False)
    out = parse.from_value(verdicts, LEVEL2_VERDICT).select(
        "transaction_id", "amount", "heavy_score_clamped", "verdict"
    )
    return rounded(out, "heavy_score_clamped")


def _run_decisions(spark, d) -> str:
    """Both levels' messages through their topics into the decision job; the features are worked out once for both."""
    folder = work_folder(spark, "decisions")
    flow.features(transactions(spark, d)).write.parquet(f"{folder}/features")
    featured = spark.read.parquet(f"{folder}/features")
    topics.write_topic(parse.to_value(flow.level1_of(featured)), topics.LEVEL1_ACTIONS, folder)
    topics.write_topic(parse.to_value(flow.level2_of(featured)), topics.LEVEL2_VERDICTS, folder)
    messages = topics.read_topics(stream_session(spark), [topics.LEVEL1_ACTIONS, topics.LEVEL2_VERDICTS], folder)
    jobs.stream_decisions(
        messages, folder, f"{folder}/tables", f"{folder}/checkpoint", available_now=True
    ).awaitTermination()
    return folder


@query
def stream_decisions(spark, d):
    """Audit rows of the decision job."""
    made = tables.read_table(spark, f"{_run_decisions(spark, d)}/tables", "final_decisions")
    return made.select(
        "transaction_id", "final_verdict", "reason", "created_at",
        F.col("detection_path.level1.score").alias("level1_score"),
        F.col("detection_path.level2.heavy_score_clamped").alias("level2_score"),
    )


@query
def stream_final_decisions(spark, d):
    """Messages of the decision job."""
    messages = topics.read_topic(spark, topics.FINAL_DECISIONS, _run_decisions(spark, d), streaming=False)
    return parse.from_value(messages, FINAL_DECISION).select(
        "transaction_id", "final_verdict", "reason", "timestamp"
    )


@query
def stream_open_reviews(spark, d):
    """Review table of the decision job: one row per escalated transaction, though both levels may escalate."""
    opened = tables.read_table(spark, f"{_run_decisions(spark, d)}/tables", "manual_reviews")
    return opened.drop("detection_path")


@query
def read_topic(spark, d):
    """Raw messages through the raw topic and back as a stream."""
    folder = work_folder(spark, "raw")
    topics.write_topic(canonical.raw_messages(transactions(spark, d)), topics.RAW, folder)
    messages = topics.read_topic(stream_session(spark), topics.RAW, folder, fail_on_data_loss=False)
    return spark.read.parquet(_drain(windows.parsed_transactions(messages), folder))


@query
def read_ingest_json(spark, d):
    folder = work_folder(spark, "bodies")
    canonical.ingest_bodies(spark, d).select("value").write.text(folder)
    checked = level0.validate_schema(topics.read_ingest_json(spark, folder))
    return checked.groupBy(F.concat_ws(",", "violations").alias("violations")).agg(F.count("*").alias("bodies"))


@query
def write_features(spark, d):
    """Training rows through the feature file."""
    folder = work_folder(spark, "training")
    tables.write_features(flow.training_table(transactions(spark, d), canonical.judgements(spark, d)), folder)
    return tables.read_features(spark, folder)


@query
def read_table(spark, d):
    """Reviews and feedback through their tables, then joined to labels."""
    folder = work_folder(spark, "tables")
    tables.append_manual_reviews(flow.review_table(transactions(spark, d)), folder)
    opened = tables.read_table(spark, folder, "manual_reviews")
    tables.append_feedback(reviews.feedback_rows(canonical.judgements(spark, d), opened), folder)
    feedback = tables.read_table(spark, folder, "feedback_labels")
    return reviews.labelled_reviews(feedback, opened).drop("detection_path", "id")


@query
def write_feedback_topic(spark, d):
    """Judgements as messages of the feedback topic."""
    folder = work_folder(spark, "feedback")
    feedback = reviews.feedback_rows(canonical.judgements(spark, d), flow.review_table(transactions(spark, d)))
    topics.write_topic(parse.to_value(reviews.feedback_messages(feedback)), topics.FEEDBACK, folder)
    messages = topics.read_topic(spark, topics.FEEDBACK, folder, streaming=False)
    return parse.from_value(
        messages, "review_id string, transaction_id string, operator_id string, verdict string, comment string"
    )
