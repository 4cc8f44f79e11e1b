"""Order and text of instants, places of messages, and judgements without a time."""

import datetime as dt
import itertools
import json
import time

from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import times
from ledgerlens.operators import decisions, reviews
from ledgerlens.sources import topics


def test_latest_message_is_latest_by_instant(spark):
    rows = [("t", "2024-01-01T00:00:00Z", "Allow"), ("t", "2024-01-01T00:00:00.500000Z", "Quarantine"),
            ("u", "2024-01-01T02:00:00+02:00", "Allow"), ("u", "2024-01-01T00:30:00Z", "Quarantine")]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp string, verdict string")
    got = decisions.latest_message(df, "m").select("transaction_id", "m.verdict").collect()
    assert {tuple(r) for r in got} == {("t", "Quarantine"), ("u", "Quarantine")}


def test_iso_text_does_not_depend_on_the_session(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    text = session.range(1).select(times.iso_utc(F.timestamp_micros(F.lit(0).cast("bigint"))).alias("t")).first()["t"]
    assert text == "1970-01-01T00:00:00.000000Z"


def test_judgement_without_a_time_resolves_its_review(spark):
    opened = spark.createDataFrame([("r", "r", "pending")], "id string, transaction_id string, status string")
    opened = opened.select(*[F.col(f.name) if f.name in opened.columns else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in schemas.MANUAL_REVIEWS.fields])
    judged = spark.createDataFrame([("r", reviews.JUDGEMENTS[0], "o", None, None)], schemas.JUDGEMENT)
    snapshot, feedback = reviews.judge_reviews(opened, judged)
    row = snapshot.first()
    assert row["status"] == "resolved" and row["updated_at"] is not None and feedback.count() == 1


def _message(verdict, instant, transaction="t"):
    return json.dumps({"transaction_id": transaction, "verdict": verdict, "score": 0.5, "timestamp": instant})


def test_of_one_instant_the_later_place_wins(spark):
    same = ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00.000Z", "2024-01-01T11:00:00+01:00"]
    at = dt.datetime(2024, 1, 1, 12)
    for order in itertools.permutations(range(3)):
        rows = [(_message(f"v{k}", same[k]), decisions.LEVEL1_TOPIC, at, 0, place) for place, k in enumerate(order)]
        rows.append((_message("older", "2024-01-01T09:00:00Z"), decisions.LEVEL1_TOPIC, at, 0, 9))
        rows.append((_message("w", same[0]), decisions.LEVEL2_TOPIC, at, 0, 0))
        messages = spark.createDataFrame(rows, "value string, topic string, broker_time timestamp, partition int, offset bigint")
        made = decisions.correlate_levels(*decisions.levels_from_messages(messages)).collect()
        assert [(r["level1"]["verdict"], r["level2"]["verdict"]) for r in made] == [(f"v{order[-1]}", "w")]
        assert made[0].asDict().keys() == {"transaction_id", "level1", "level2"}


def test_a_later_broker_time_comes_before_the_offset(spark):
    early, late = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 13)
    rows = [(_message("first", None), decisions.LEVEL1_TOPIC, early, 1, 50), (_message("last", None), decisions.LEVEL1_TOPIC, late, 0, 3)]
    messages = spark.createDataFrame(rows, "value string, topic string, broker_time timestamp, partition int, offset bigint")
    (row,) = decisions.latest_message(decisions.levels_from_messages(messages)[0], "m").collect()
    assert row["m"]["verdict"] == "last"


def test_the_first_escalation_by_place_opens_the_review(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = []
    for place, user in enumerate("cab"):
        body = {"transaction_id": "t", "user_id": user, "verdict": "Quarantine", "score": 0.6, "timestamp": "2024-01-01T10:00:00Z"}
        rows.append((json.dumps(body), decisions.LEVEL1_TOPIC, at, 0, place))
    messages = spark.createDataFrame(rows, "value string, topic string, broker_time timestamp, partition int, offset bigint")
    opened = decisions.open_reviews(decisions.decisions_per_message(messages))
    assert [r["user_id"] for r in opened.collect()] == ["c"] and not set(decisions.POSITION) & set(opened.columns)


def test_files_tell_the_places_of_messages(spark, tmp_path):
    where = str(tmp_path)
    for bodies in (["a", "b"], ["c"]):
        topics.write_topic(topics.from_json_rows(spark, bodies).coalesce(1), "one", where)
        time.sleep(1.1)  # file times may be whole seconds
    found = topics.read_topic(spark, "one", where, streaming=False)
    assert [r["value"] for r in found.orderBy(*topics.POSITION).collect()] == ["a", "b", "c"]
    out = topics.read_topic(spark, "one", where).writeStream.format("parquet").option("checkpointLocation", f"{where}/cp") \
        .trigger(availableNow=True).start(f"{where}/out")
    out.awaitTermination()
    streamed = spark.read.parquet(f"{where}/out").orderBy(*topics.POSITION).collect()
    assert [(r["value"], r["offset"]) for r in streamed] == [("a", 0), ("b", 1), ("c", 0)]
