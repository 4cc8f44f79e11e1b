"""Compaction of epoch folders, and the review ids that live in them."""

import datetime as dt
import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens.session import stream_session
from ledgerlens.sources import segments, tables, topics
from ledgerlens.streaming import jobs

SCHEMA = "transaction_id string, created_at timestamp"


def put(where, epoch, ids, day="2024-01-01", name="audit", writer="w"):
    """An epoch folder as append_table leaves it, without a Spark job."""
    folder = f"{where}/{name}/writer={writer}/epoch={epoch}/day={day}"
    os.makedirs(folder, exist_ok=True)
    for old in glob.glob(f"{folder}/*.parquet"):
        os.remove(old)
    at = [dt.datetime.fromisoformat(day)] * len(ids)
    pq.write_table(pa.table({"transaction_id": pa.array(ids, pa.string()), "created_at": pa.array(at, pa.timestamp("us", "UTC"))}),
                   f"{folder}/part-0.parquet")


def ids(spark, where, name="audit"):
    return sorted(r[0] for r in tables.read_table(spark, where, name, tables._with_partitions(SCHEMA)).select("transaction_id").collect())


def folders(where, name="audit"):
    return len(glob.glob(f"{where}/{name}/writer=*/epoch=*")) + len(glob.glob(f"{where}/{name}/_segments/writer=*/epoch=*/part=*"))


def test_many_epochs_leave_few_folders_and_all_rows(spark, tmp_path):
    where, fan, most = str(tmp_path), 8, 0
    for epoch in range(1000):
        put(where, epoch, [f"{epoch}-a", f"{epoch}-b"], f"2024-01-0{1 + epoch // 400}")
        if epoch % 40 == 0:
            tables.compact_table(spark, where, "audit", "w", epoch, fan)
            most = max(most, folders(where))
    # the epochs of two compactions at most, and below `fan` segments of each of three levels, twice
    assert most <= 2 * 40 + 1 + 2 * 3 * fan and folders(where) <= most + 40
    assert ids(spark, where) == sorted(f"{e}-{x}" for e in range(1000) for x in "ab")
    stated = segments.manifest(spark, f"{where}/audit", "w")
    assert stated.through == 959 and len(stated.segments) < 3 * fan
    assert len(glob.glob(f"{where}/audit/_manifest/w/*")) <= 3 * 2  # with checksum files


def test_a_repeated_epoch_still_replaces_its_rows(spark, tmp_path):
    where = str(tmp_path)
    for epoch in range(6):
        put(where, epoch, [f"t{epoch}"])
    put(where, 6, ["first attempt"])
    tables.compact_table(spark, where, "audit", "w", 6, 3)
    rows = spark.createDataFrame([("second attempt", dt.datetime(2024, 1, 2))], SCHEMA)
    tables.append_table(rows, where, "audit", epoch=6, writer="w")
    assert ids(spark, where) == ["second attempt", *(f"t{e}" for e in range(6))]
    before = tables.read_table_before(spark, where, "audit", 6, SCHEMA, "w")
    assert sorted(r["transaction_id"] for r in before.collect()) == [f"t{e}" for e in range(6)]


def test_nothing_is_compacted_before_there_is_enough_or_of_the_epoch_at_work(spark, tmp_path):
    where = str(tmp_path)
    for epoch in range(5):
        put(where, epoch, [f"t{epoch}"])
    tables.compact_table(spark, where, "audit", "w", 4, 5)
    assert segments.manifest(spark, f"{where}/audit", "w").version == 0
    tables.compact_table(spark, where, "audit", "w", 4, 4)
    assert segments.manifest(spark, f"{where}/audit", "w").through == 3 and ids(spark, where) == [f"t{e}" for e in range(5)]


def test_a_failed_compaction_changes_nothing_and_is_cleared(spark, tmp_path, monkeypatch):
    where = str(tmp_path)
    for epoch in range(4):
        put(where, epoch, [f"t{epoch}"])
    with monkeypatch.context() as m:
        m.setattr(segments, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.compact_table(spark, where, "audit", "w", 4, 2)
    assert ids(spark, where) == [f"t{e}" for e in range(4)]
    tables.compact_table(spark, where, "audit", "w", 4, 2)
    assert ids(spark, where) == [f"t{e}" for e in range(4)]
    assert len(glob.glob(f"{where}/audit/_segments/writer=w/epoch=*/part=*")) == 1


def test_readers_of_the_version_before_still_find_their_folders(spark, tmp_path):
    where = str(tmp_path)
    for epoch in range(4):
        put(where, epoch, [f"t{epoch}"])
    early = tables.read_table(spark, where, "audit", tables._with_partitions(SCHEMA)).select("transaction_id")
    tables.compact_table(spark, where, "audit", "w", 4, 2)
    assert sorted(r[0] for r in early.collect()) == [f"t{e}" for e in range(4)]


def test_writers_are_compacted_apart(spark, tmp_path):
    where = str(tmp_path)
    for writer in "ab":
        for epoch in range(3):
            put(where, epoch, [f"{writer}{epoch}"], writer=writer)
    tables.compact_table(spark, where, "audit", "a", 3, 2)
    assert ids(spark, where) == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_days_of_segments_are_pruned(spark, tmp_path):
    where = str(tmp_path)
    for epoch in range(4):
        put(where, epoch, [f"t{epoch}"], f"2024-01-0{epoch + 1}")
    tables.compact_table(spark, where, "audit", "w", 4, 2)
    for path in glob.glob(f"{where}/audit/_segments/writer=w/*/*/day=2024-01-0[124]/*.parquet"):
        with open(path, "wb") as file:
            file.write(b"not to be read")
    found = tables.read_table(spark, where, "audit", tables._with_partitions(SCHEMA)).where("day = date'2024-01-03'")
    assert [r["transaction_id"] for r in found.collect()] == ["t2"]


# --- databases: the statements, as none can run here ----------------------------------------------


def test_statements_replace_the_rows_of_an_epoch():
    stage = tables.stage_name("final_decisions", "it's", 7)
    assert stage == tables.stage_name("final_decisions", "it's", 7) != tables.stage_name("final_decisions", "other", 7)
    assert tables.replace_statements("final_decisions", ["id", "reason"], stage, "it's", 7) == [
        "DELETE FROM final_decisions WHERE writer = 'it''s' AND epoch = 7",
        f"INSERT INTO final_decisions (id, reason, writer, epoch) SELECT id, reason, 'it''s', 7 FROM {stage}",
        f"DROP TABLE {stage}",
    ]


def test_ranges_of_a_split_read():
    assert tables.range_query("t", "created_at") == "SELECT min(created_at) AS low, max(created_at) AS high FROM t"
    assert tables.split_options("id", 4, 10, 90) == {
        "partitionColumn": "id", "lowerBound": "10", "upperBound": "90", "numPartitions": "4"}
    assert tables.split_options("id", 4, None, None) == {}


# --- review ids ---------------------------------------------------------------------------------


def decide(spark, where, checkpoint, batches):
    """One micro-batch for each list of transaction ids, all escalated."""
    message = {"user_id": "u", "device_id": "d", "amount": 9.0, "verdict": "Quarantine", "score": 0.6, "detection_level": 1}
    folder = f"{where}/in-{checkpoint}"
    for batch in batches:
        rows = [(topics.LEVEL1_ACTIONS, json.dumps(message | {"transaction_id": i})) for i in batch]
        spark.createDataFrame(rows, "topic string, value string").coalesce(1).write.mode("append").parquet(folder)
        stream = stream_session(spark).readStream.schema("topic string, value string").parquet(folder)
        jobs.stream_decisions(
            stream, f"{where}/topics", f"{where}/tables", f"{where}/{checkpoint}", available_now=True).awaitTermination()


def reviews(spark, where):
    return sorted(r[0] for r in tables.read_table(spark, f"{where}/tables", "manual_reviews").select("transaction_id").collect())


def test_one_review_per_transaction_over_restarts_and_compactions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 2)
    where = str(tmp_path)
    decide(spark, where, "first", [["a", "b"], ["b", "c"], ["a", "d"], ["c", "e"], ["a", "b", "e", "f"]])
    decide(spark, where, "second", [["a", "f", "g"]])
    assert reviews(spark, where) == list("abcdefg")
    assert any(m.segments for m in segments.manifests(spark, f"{where}/tables/{tables.REVIEW_IDS}").values())


def test_reviews_of_before_the_table_are_taken_over(spark, tmp_path):
    where = str(tmp_path)
    put(f"{where}/tables", 0, ["old"], name="manual_reviews", writer="earlier")
    decide(spark, where, "cp", [["old", "new"]])
    assert reviews(spark, where) == ["new", "old"]


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    where = str(tmp_path)
    known = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("transaction_id"))
    folder = f"{where}/{tables.REVIEW_IDS}"
    segments.seed(known.withColumn("bucket", tables.bucket_of(F.col("transaction_id"))), folder, "seed", "bucket")
    batch = spark.range(100).select(F.concat(F.lit("t"), F.col("id") * 7).alias("transaction_id"))
    wanted = {r[0] for r in batch.select(tables.bucket_of(F.col("transaction_id"))).collect()}
    others = 0
    for path in glob.glob(f"{folder}/_segments/*/*/*/bucket=*/*.parquet"):
        if int(os.path.basename(os.path.dirname(path)).removeprefix("bucket=")) not in wanted:
            others += 1
            with open(path, "wb") as file:
                file.write(b"not to be read")
    found = tables.reviewed_ids(spark, where, batch, 5, "w")
    assert others > 800 and found.join(batch, "transaction_id").count() == 100
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString().replace("isnotnull(bucket", "bucket")
