import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.operators import decisions, trailing
from ledgerlens.plans import canonical
from ledgerlens.session import stream_session
from ledgerlens.sources import tables, topics
from ledgerlens.streaming import jobs, windows
from tools.check_oracles import compare, connect

SCHEMA = """transaction_id string, user_id string, amount double, merchant_category string, timestamp timestamp,
    location string, device_id string, is_fraud boolean"""


def files(spark, tx, folder, parts):
    """Transactions in time order, one folder of files per part."""
    rows = tx.orderBy("timestamp").collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def one_file_at_a_time(spark, folder):
    return stream_session(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_trailing_stream_equals_batch_over_many_batches(spark, sf_dir, tmp_path):
    tx = canonical.transactions(spark, sf_dir)
    files(spark, tx, f"{tmp_path}/in", 4)
    where = str(tmp_path)
    query = jobs.stream_features(
        one_file_at_a_time(spark, f"{tmp_path}/in"), f"{where}/topics", f"{where}/tables", f"{where}/cp", available_now=True)
    query.awaitTermination()
    names = ["transaction_id", "transactions_last_hour", "tx_count_1min", F.round("amount_zscore", 6).alias("z")]
    streamed = tables.read_table(spark, f"{where}/tables", "features")
    assert streamed.select("epoch").distinct().count() == 4
    got = sorted(tuple(r) for r in streamed.select(*names).collect())
    assert got == sorted(tuple(r) for r in trailing.trailing_features(tx).select(*names).collect())
    payloads = topics.read_topic(spark, topics.LEVEL2, f"{where}/topics", streaming=False)
    assert payloads.count() == tx.count()
    newest = tables.read_hot_features(spark, f"{where}/tables").groupBy("user_id").agg(
        F.max_by("tx_count_1min", "updated_at").alias("n"))
    batch = trailing.hot_features(trailing.trailing_features(tx))
    assert sorted(tuple(r) for r in newest.collect()) == sorted(
        tuple(r) for r in batch.select("user_id", "tx_count_1min").collect())


def test_restart_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    tx = canonical.transactions(spark, sf_dir)
    rows = tx.orderBy("timestamp").collect()
    where = str(tmp_path)

    def run():
        jobs.stream_features(
            one_file_at_a_time(spark, f"{where}/in"), f"{where}/topics", f"{where}/tables", f"{where}/cp",
            available_now=True).awaitTermination()

    for part in (rows[:600], rows[600:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")
        run()
    run()
    got = tables.read_table(spark, f"{where}/tables", "features").select("transaction_id", "tx_count_1min")
    expected = trailing.trailing_features(tx).select("transaction_id", "tx_count_1min")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_repeated_epoch_replaces_its_rows(spark, tmp_path):
    made = decisions.decisions_per_message(spark.createDataFrame(
        [(decisions.LEVEL1_TOPIC, json.dumps({"transaction_id": "a", "verdict": "Challenge", "timestamp": "2024-01-01T00:00:00Z"}))],
        "topic string, value string"))
    at = decisions.message_instant(made)
    for _ in range(2):
        tables.append_final_decisions(decisions.final_decision_rows(made, at), str(tmp_path), epoch=3)
    assert tables.read_table(spark, str(tmp_path), "final_decisions").count() == 1
    before = tables.read_table_before(spark, str(tmp_path), "final_decisions", 3, "transaction_id string")
    assert before.count() == 0


def test_one_review_per_transaction_across_batches(spark, tmp_path):
    where = str(tmp_path)

    def run(topic, *bodies):
        topics.write_topic(topics.from_json_rows(spark, [json.dumps(b) for b in bodies]), topic, where)
        messages = topics.read_topics(
            stream_session(spark), [topics.LEVEL1_ACTIONS, topics.LEVEL2_VERDICTS], where)
        jobs.stream_decisions(messages, where, f"{where}/tables", f"{where}/cp", available_now=True).awaitTermination()

    at = "2024-01-01T00:00:00Z"
    topics.write_topic(topics.from_json_rows(spark, ["broken"]), topics.LEVEL2_VERDICTS, where)
    run(topics.LEVEL1_ACTIONS, {"transaction_id": "a", "user_id": "u1", "verdict": "Challenge", "score": 0.3, "timestamp": at},
        {"transaction_id": "b", "verdict": "Allow", "timestamp": at})
    run(topics.LEVEL2_VERDICTS, {"transaction_id": "a", "user_id": "u2", "verdict": "Challenge", "timestamp": at},
        {"transaction_id": "b", "user_id": "u3", "verdict": "Challenge", "heavy_score_clamped": 0.3, "timestamp": at})
    opened = {r["id"]: r["user_id"] for r in tables.read_table(spark, f"{where}/tables", "manual_reviews").collect()}
    assert opened == {"a": "u1", "b": "u3"}
    assert tables.read_table(spark, f"{where}/tables", "final_decisions").count() == 4


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)

    def tx(i, hours):
        return (i, "u", 10.0, "x", base + dt.timedelta(hours=hours), "N", "d", False)

    (tmp_path / "in").mkdir()
    session = stream_session(spark)
    stream = session.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    counts = windows.window_aggregate(stream, "count_1h").select("user_id", "window.start", "tx_count")

    def run(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append") \
            .trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    run(tx("1", 0.5), tx("2", 30))
    run(tx("late", 0.5), tx("3", 60))
    out = spark.read.parquet(f"{tmp_path}/out").filter(F.col("start") < "2024-01-01 02:00:00")
    assert {r["tx_count"] for r in out.collect()} == {1}
    assert out.count() == 12


def test_a_new_checkpoint_keeps_rows_and_opens_no_second_review(spark, tmp_path):
    where = str(tmp_path)
    message = {"transaction_id": "t1", "user_id": "u", "device_id": "d", "amount": 9.0, "verdict": "Quarantine"}

    def decide(checkpoint, *ids):
        folder = f"{where}/in-{checkpoint}"
        rows = [(topics.LEVEL1_ACTIONS, json.dumps(message | {"transaction_id": i, "score": 0.6, "detection_level": 1}))
                for i in ids]
        spark.createDataFrame(rows, "topic string, value string").coalesce(1).write.parquet(folder)
        stream = stream_session(spark).readStream.schema("topic string, value string").parquet(folder)
        jobs.stream_decisions(
            stream, f"{where}/topics", f"{where}/tables", f"{where}/{checkpoint}", available_now=True).awaitTermination()

    def ids(name):
        return sorted(r[0] for r in tables.read_table(spark, f"{where}/tables", name).select("transaction_id").collect())

    decide("first", "t1", "t2")
    opened = ids("manual_reviews")
    decide("second", "t1", "t3")
    assert ids("final_decisions") == ["t1", "t1", "t2", "t3"]
    assert opened and ids("manual_reviews") == sorted({*opened, "t3"})


def test_a_repeated_epoch_replaces_rows_of_another_day(spark, tmp_path):
    def write(day, epoch, writer):
        rows = spark.createDataFrame([(f"{writer}-{epoch}", day)], "transaction_id string, created_at timestamp")
        tables.append_table(rows, str(tmp_path), "audit", epoch=epoch, writer=writer)

    write(dt.datetime(2024, 1, 1, 23, 59), 0, "a")
    write(dt.datetime(2024, 1, 2, 0, 1), 0, "a")
    write(dt.datetime(2024, 1, 2, 0, 1), 0, "b")
    found = tables.read_table(spark, str(tmp_path), "audit").select("transaction_id", "day").collect()
    assert sorted(map(tuple, found)) == [("a-0", dt.date(2024, 1, 2)), ("b-0", dt.date(2024, 1, 2))]
    before = tables.read_table_before(spark, str(tmp_path), "audit", 0, "transaction_id string", "a").collect()
    assert [r["transaction_id"] for r in before] == ["b-0"]


WHOLE = {
    "stream_user_stats_24h": "user_stats_24h", "stream_tx_count_1h": "tx_count_1h", "stream_tx_count_1min": "tx_count_1min",
    "stream_join_window_stats": "amount_zscore", "stream_join_hourly_counts": "join_hourly_counts",
    "stream_join_minute_counts": "join_minute_counts",
}


@pytest.mark.parametrize("name", WHOLE)
def test_window_streams_equal_the_whole_batch_sql(spark, sf_dir, name):
    out = entry.queries()[name](spark, sf_dir)
    sql = f"SELECT {', '.join(out.columns)} FROM ({entry.oracle_sql()[WHOLE[name]]})"
    message, _, good = compare(spark, connect(sf_dir), sf_dir, name, lambda *_: out, sql)
    assert good, message


@pytest.mark.parametrize(("name", "count", "hops"), [("count_1h", "tx_count", 12), ("stats_24h", "amount_zscore", 24)])
def test_window_join_keeps_late_and_timeless_rows(spark, tmp_path, name, count, hops):
    base = dt.datetime(2024, 1, 1)

    def tx(i, hours):
        return (i, "u", 10.0, "x", None if hours is None else base + dt.timedelta(hours=hours), "N", "d", False)

    (tmp_path / "in").mkdir()
    stream = stream_session(spark).readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    joined = windows.window_join(stream, name).select("transaction_id", F.col("window.start").alias("start"), count)

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        joined.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append") \
            .trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    run(spark.createDataFrame([tx("1", 0.5), tx("1b", 0.5), tx("2", 30), tx("timeless", None)], SCHEMA))
    run(spark.createDataFrame([tx("late", 0.5), tx("3", 90)], SCHEMA))
    run(windows.closing_row(spark, stream.schema))
    out = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    default = 1 if name == "count_1h" else 0.0
    assert [r for r in out if r[0] == "timeless"] == [("timeless", None, default)]
    late = [r for r in out if r[0] == "late"]
    assert len(late) == len({r[1] for r in late}) == hops and {r[2] for r in late} == {default}
    assert {i: sum(r[0] == i for r in out) for i in ("1", "1b", "2", "3")} == dict.fromkeys(("1", "1b", "2", "3"), hops)
    assert len(out) == 5 * hops + 1  # and nothing of the closing row
    if name == "count_1h":
        assert {r[2] for r in out if r[0] in ("1", "1b")} == {2}


@pytest.mark.parametrize(("name", "hops"), [("stats_24h", 24), ("count_1h", 12), ("count_1min", 6)])
def test_state_holds_a_transaction_by_spans_not_by_windows(spark, tmp_path, name, hops):
    base = dt.datetime(2024, 1, 1, 0, 30)
    rows = [(str(i), f"u{i % 3}", float(i), "x", base + dt.timedelta(minutes=37 * i), "N", "d", False) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stream_session(spark).readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = windows.window_join(stream, name).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    join = [s for p in query.recentProgress for s in p["stateOperators"] if "Join" in s["operatorName"]]
    assert 0 < sum(s["numRowsUpdated"] for s in join) <= 4 * len(rows) < hops * len(rows)


def test_shuffles_of_a_batch_follow_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "_TASK_ROWS", 10)
    spark.range(1000).write.parquet(f"{tmp_path}/in")
    session = stream_session(spark)
    usual, seen = int(session.conf.get("spark.sql.shuffle.partitions")), []

    def process(batch, epoch, writer):
        seen.append(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    jobs.start(session.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), process, f"{tmp_path}/cp",
               available_now=True).awaitTermination()
    assert seen == [100] and usual < 100
    with jobs.shuffle_by_rows(session, 5):
        assert int(session.conf.get("spark.sql.shuffle.partitions")) == usual
