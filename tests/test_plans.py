"""Physical plans that must not change by accident."""

import contextlib
import io

from ledgerlens.operators import bloom, decisions, hopping, level2, trailing
from ledgerlens.plans import canonical


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stateless_jobs_do_not_shuffle(spark, sf_dir):
    messages = canonical.graph_messages(spark, sf_dir)
    assert "hashpartitioning" not in plan(level2.level2_from_messages(messages))
    from pyspark.sql import functions as F
    assert "hashpartitioning" not in plan(decisions.decisions_per_message(messages.withColumn("topic", F.lit("level2.verdicts"))))


def test_bloom_membership_shuffles_no_rows(spark, sf_dir):
    tx = canonical.transactions(spark, sf_dir)
    words = bloom.bloom_build(canonical.blacklist(spark, sf_dir), bloom.GATE_SIZE, bloom.GATE_HASHES)
    words.write.format("noop").mode("overwrite").save()
    text = plan(bloom.bloom_contains(tx, words, "device_id", "hit", bloom.GATE_SIZE, bloom.GATE_HASHES))
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text
    assert "hashpartitioning(transaction_id" not in text and "hashpartitioning(device_id" not in text


def test_json_is_parsed_once(spark, sf_dir):
    made = decisions.only_escalated(level2_decisions(spark, sf_dir))
    text = plan(made)
    generated = [line for line in text.splitlines() if "from_json" in line and line.startswith("Arguments: inline")]
    others = [line for line in text.splitlines() if "from_json" in line and not line.startswith("Arguments: inline")]
    assert len(generated) == 1 and not others


def level2_decisions(spark, sf_dir):
    from pyspark.sql import functions as F
    messages = canonical.table(spark, sf_dir, "events").select(
        F.col("props").alias("value"), F.col("event_type").alias("topic"))
    return decisions.decisions_per_message(messages)


def test_aggregates_combine_before_the_shuffle_and_read_what_they_need(spark, sf_dir):
    text = plan(hopping.user_stats_24h(canonical.transactions(spark, sf_dir)))
    assert "partial_avg" in text and "props" not in text.split("ReadSchema")[0].split("(1) Scan")[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_trailing_features_have_no_global_or_cross_step(spark, sf_dir):
    text = plan(trailing.trailing_features(canonical.transactions(spark, sf_dir)))
    source = plan(canonical.transactions(spark, sf_dir))
    assert "SinglePartition" not in text
    # one scan, one shuffle, no joins of its own
    assert all(text.count(step) == source.count(step) for step in ("Scan parquet", "Join"))
    assert text.count("hashpartitioning(user_id") - source.count("hashpartitioning(user_id") == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
