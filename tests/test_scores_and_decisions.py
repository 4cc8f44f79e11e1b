import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import decisions, level1, level2, parse, reviews
from ledgerlens.plans import canonical, flow
from ledgerlens.schemas import JUDGEMENT
from ledgerlens.sources import topics


@pytest.mark.parametrize("amount, count, score, verdict", [
    (100.0, None, 0.0, "Allow"), (100.0, 1, 0.1, "Allow"), (100.0, 2, 0.2, "Challenge"),
    (1000.0, 0, 0.0, "Allow"), (1000.01, 0, 0.5, "Challenge"), (1500.0, 2, 0.7, "Quarantine"),
    (100.0, 6, 0.6, "Quarantine"), (5000.0, 20, 1.0, "Quarantine"),
])
def test_fast_score(spark, amount, count, score, verdict):
    row = level1.fast_scores(spark.createDataFrame([(amount, count)], "amount double, tx_count_1min bigint")).first()
    assert (row["score"], row["verdict"]) == (pytest.approx(score), verdict)


@pytest.mark.parametrize("graph, amount, clamped, verdict", [
    (None, 1000, 0.1, "Allow"), ({"neighbor_count": 0, "graph_score": 0.0}, 2000, 0.2, "Challenge"),
    ({"neighbor_count": 3, "graph_score": 0.5}, 0, 0.8, "Quarantine"),
    ({"neighbor_count": 20, "graph_score": 0}, None, 1.0, "Quarantine"), (None, None, 0.0, "Allow"),
    ({"graph_score": 0.5}, 100, None, "Quarantine"), ({"neighbor_count": "x", "graph_score": 0}, 1, None, "Quarantine"),
    (None, -5, 0.0, "Allow"), ({"neighbor_count": -9, "graph_score": 0}, 1, 0.0, "Allow"),
])
def test_heavy_score(spark, graph, amount, clamped, verdict):
    body = {"transaction_id": "t", "amount": amount, "graph_features": graph}
    row = level2.level2_from_messages(topics.from_json_rows(spark, [json.dumps(body)])).first()
    assert row["verdict"] == verdict
    assert row["heavy_score_clamped"] == (None if clamped is None else pytest.approx(clamped))


def messages(spark, *items):
    return spark.createDataFrame([(t, v if isinstance(v, str) else json.dumps(v)) for t, v in items],
                                 "topic string, value string")


L1, L2 = decisions.LEVEL1_TOPIC, decisions.LEVEL2_TOPIC


@pytest.mark.parametrize("topic, verdict, expected", [
    (L2, "Quarantine", ("Block", "level2_quarantine")), (L2, "Challenge", ("Escalate", "level2_challenge")),
    (L2, "Allow", ("Allow", "level2_allow")), (L2, None, ("Allow", "level2_allow")),
    (L1, "Allow", ("Allow", "level1_allow")), (L1, "Challenge", ("Escalate", "level1_challenge")),
    (L1, "Quarantine", ("Escalate", "level1_quarantine")), (L1, None, ("Escalate", "level1_quarantine")),
])
def test_decision_per_message(spark, topic, verdict, expected):
    made = decisions.decisions_per_message(messages(spark, (topic, {"transaction_id": "t", "verdict": verdict})))
    row = made.first()
    assert (row["final_verdict"], row["reason"]) == expected


def test_neither_level_and_empty_objects_give_no_info(spark):
    schema = "level1 struct<verdict:string>, level2 struct<verdict:string>"
    full = spark.createDataFrame([(None, None)], schema).select(
        F.from_json(F.lit("{}"), decisions.LEVEL1_ACTION).alias("level1"),
        F.lit(None).cast(decisions.LEVEL2_VERDICT).alias("level2"),
    )
    assert decisions.apply_business_rules(full).first()["reason"] == "no_info"


def test_messages_without_id_are_dropped(spark):
    made = decisions.decisions_per_message(messages(
        spark, (L1, "not json"), (L1, {"verdict": "Allow"}), (L2, {"transaction_id": ""}), ("other", {"transaction_id": "x"}),
        (L1, {"transaction_id": "kept", "verdict": "Allow"}),
    ))
    assert [r["transaction_id"] for r in made.collect()] == ["kept"]


def test_combined_prefers_level2_and_keeps_one_sided_transactions(spark):
    l1 = parse.from_value(messages(
        spark, (L1, {"transaction_id": "a", "verdict": "Allow", "timestamp": "1"}),
        (L1, {"transaction_id": "a", "verdict": "Challenge", "timestamp": "2"}),
        (L1, {"transaction_id": "b", "verdict": "Quarantine", "timestamp": "1"}),
    ), decisions.LEVEL1_ACTION)
    l2 = parse.from_value(messages(
        spark, (L2, {"transaction_id": "b", "verdict": "Quarantine"}), (L2, {"transaction_id": "c", "verdict": "Challenge"}),
    ), decisions.LEVEL2_VERDICT)
    made = {r["transaction_id"]: r["reason"] for r in decisions.decisions_combined(l1, l2).collect()}
    assert made == {"a": "level1_challenge", "b": "level2_quarantine", "c": "level2_challenge"}


def test_one_review_per_transaction_with_fields_of_the_first_escalation(spark):
    made = decisions.decisions_per_message(messages(
        spark,
        (L1, {"transaction_id": "a", "user_id": "u1", "verdict": "Challenge", "score": 0.3, "timestamp": "2024-01-01T00:00:00Z"}),
        (L2, {"transaction_id": "a", "user_id": "u2", "verdict": "Challenge", "heavy_score_clamped": 0.4, "timestamp": "2024-01-01T00:00:05Z"}),
        (L1, {"transaction_id": "b", "verdict": "Allow", "timestamp": "2024-01-01T00:00:00Z"}),
        (L2, {"transaction_id": "b", "user_id": "u3", "verdict": "Challenge", "heavy_score_clamped": 0.0, "score": 0.25, "timestamp": "2024-01-01T00:00:05Z"}),
    ))
    opened = {r["transaction_id"]: r for r in decisions.open_reviews(made).collect()}
    assert (opened["a"]["user_id"], opened["a"]["level1_score"], opened["a"]["level2_score"]) == ("u1", 0.3, None)
    assert (opened["b"]["user_id"], opened["b"]["level1_score"], opened["b"]["level2_score"]) == ("u3", None, 0.25)
    existing = spark.createDataFrame([("a",)], "transaction_id string")
    assert [r["transaction_id"] for r in decisions.open_reviews(made, existing).collect()] == ["b"]


def test_judging_twice_and_rejects(spark):
    made = decisions.decisions_per_message(messages(
        spark, *[(L1, {"transaction_id": t, "verdict": "Challenge", "timestamp": "2024-01-01T00:00:00Z"}) for t in "ab"]
    ))
    opened = decisions.open_reviews(made)
    rows = [("a", "Allow", "op", "x"), ("a", "Block", "op", "y"), ("b", "Unsure", "op", None), ("zz", "Block", "op", None),
            ("b", None, "op", None)]
    judged = spark.createDataFrame([(*r, None) for r in rows], JUDGEMENT).withColumn(
        "judged_at", F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    )
    snapshot, feedback = reviews.judge_reviews(opened, judged)
    assert {r["id"]: r["status"] for r in snapshot.collect()} == {"a": "resolved", "b": "pending"}
    assert sorted(r["verdict"] for r in feedback.collect()) == ["Allow", "Block"]
    assert reviews.invalid_judgements(judged).count() == 2
    assert [r["review_id"] for r in reviews.unmatched_judgements(judged, opened).collect()] == ["zz"]


def onnx_sum_model() -> bytes:
    """A hand-made ONNX file: score = (amount + count) / 1000 by one Gemm node."""
    import struct

    def varint(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def num(field, n):
        return varint(field << 3) + varint(n)

    def sub(field, data):
        data = data.encode() if isinstance(data, str) else data
        return varint(field << 3 | 2) + varint(len(data)) + data

    def value_info(name, *dims):
        shape = b"".join(sub(1, sub(2, d) if isinstance(d, str) else num(1, d)) for d in dims)
        return sub(1, name) + sub(2, sub(1, num(1, 1) + sub(2, shape)))

    weights = num(1, 2) + num(1, 1) + num(2, 1) + sub(8, "w") + sub(9, struct.pack("<2f", 0.001, 0.001))
    node = sub(1, "x") + sub(1, "w") + sub(2, "y") + sub(4, "MatMul")
    graph = sub(1, node) + sub(2, "g") + sub(5, weights) + sub(11, value_info("x", "n", 2)) + sub(12, value_info("y", "n", 1))
    return num(1, 8) + sub(7, graph) + sub(8, sub(1, "") + num(2, 13))


def test_onnx_scores(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "model.onnx"
    path.write_bytes(onnx_sum_model())
    df = spark.createDataFrame([(300.0, 2), (5000.0, 0), (None, 3)], "amount double, tx_count_1min bigint")
    rows = level1.onnx_scores(df, str(path)).collect()
    assert [round(r["score"], 3) for r in rows] == [0.302, 1.0, 0.3]
    assert [r["verdict"] for r in rows] == ["Challenge", "Quarantine", "Challenge"]


def test_model_score_falls_back(spark):
    df = spark.createDataFrame([(1500.0, 2)], "amount double, tx_count_1min bigint")
    assert level1.model_scores(df).first()["score"] == pytest.approx(0.7)


def test_training_rows_of_judgements_need_one_join(spark, sf_dir):
    opened = flow.review_table(canonical.transactions(spark, sf_dir))
    judged = canonical.judgements(spark, sf_dir)
    two = reviews.labelled_reviews(reviews.feedback_rows(judged, opened), opened)
    one = reviews.labelled_judgements(judged, opened)
    assert set(one.columns) == set(two.columns) and one.count() == two.count() > 0
    assert one.select(*two.columns).exceptAll(two).isEmpty()


def test_levels_meet_in_one_shuffle(spark):
    l1 = spark.createDataFrame([("a", "Allow"), ("b", "Quarantine"), (None, "Allow")], "transaction_id string, verdict string")
    l2 = spark.createDataFrame([("b", "Allow"), ("c", "Challenge")], "transaction_id string, verdict string")
    both = decisions.correlate_levels(l1, l2)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(transaction_id") == 1 and "Join" not in plan
    got = {r["transaction_id"]: (r["level1"] and r["level1"]["verdict"], r["level2"] and r["level2"]["verdict"]) for r in both.collect()}
    assert got == {"a": ("Allow", None), "b": ("Quarantine", "Allow"), "c": (None, "Challenge")}
