import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.operators import alerts, bloom, level0, learning, metrics, reports
from ledgerlens.operators.running import _part_of, running_totals
from ledgerlens.sources import topics

VALID = {"transaction_id": "t", "user_id": "user_12345", "amount": 150.5, "timestamp": "2024-01-01T00:00:00",
         "device_id": "device_67890", "merchant_category": "retail", "location": "New York, US", "extra": [1]}


def violations(spark, body, **options):
    text = body if isinstance(body, str) else json.dumps(body)
    return level0.validate_schema(topics.from_json_rows(spark, [text]), **options).first()["violations"]


@pytest.mark.parametrize("change, expected", [
    ({}, []), ({"amount": -1000}, ["minimum:amount"]), ({"amount": "not_a_number"}, ["type:amount"]),
    ({"timestamp": "invalid_date"}, []), ({"amount": True}, ["type:amount"]), ({"amount": 0}, []),
    ({"amount": None}, ["type:amount"]), ({"user_id": None}, ["type:user_id"]), ({"location": 5}, ["type:location"]),
    ({"amount": 1e300}, []),
])
def test_schema(spark, change, expected):
    assert violations(spark, {**VALID, **change}) == expected


def test_schema_missing_unparseable_and_strict(spark):
    assert violations(spark, {"transaction_id": "x", "amount": -100}) == [
        "missing:user_id", "missing:timestamp", "missing:device_id", "minimum:amount"]
    assert violations(spark, '{"transaction_id": ') == ["unparseable"]
    assert violations(spark, "[1]") == ["type:body"]
    assert violations(spark, {**VALID, "timestamp": "invalid_date"}, strict_time=True) == ["format:timestamp"]


def test_blacklist_order_and_empty_values(spark):
    listed = spark.createDataFrame([("u1",), ("d1",), ("",), (None,), ("u1",)], "value string")
    df = spark.createDataFrame(
        [("1", "u1", "d1"), ("2", "u2", "d1"), ("3", "u2", "d2"), ("4", "", ""), ("5", None, None)],
        "transaction_id string, user_id string, device_id string")
    got = level0.level0_verdict(level0.blacklist_match(df, listed)).orderBy("transaction_id").collect()
    assert [r["reason"] for r in got] == ["user_id_blacklist", "device_id_blacklist", "passed", "passed", "passed"]


def test_bloom_offsets_and_membership(spark):
    values = [f"käse-{i}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "value string")

    def offset(v, i, size):
        return int.from_bytes(hashlib.sha256(v.encode() + i.to_bytes(2, "big")).digest(), "big") % size

    for size, k in ((bloom.GATE_SIZE, bloom.GATE_HASHES), (4099, 3), (2**31 - 1, 2)):
        expected = {offset(v, i, size) for v in values for i in range(k)}
        words = bloom.bloom_build(df, size, k)
        assert {r["offset"] for r in bloom.bloom_bits(words).collect()} == expected
        probes = spark.createDataFrame([(v,) for v in [*values, *map(str, range(2000)), "", None]], "p string")
        for r in bloom.bloom_contains(probes, words, "p", "hit", size, k).collect():
            assert r["hit"] == (bool(r["p"]) and all(offset(r["p"], i, size) in expected for i in range(k)))


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, *range(50)]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id int, v int")
    got = running_totals(df, [F.col("x"), F.col("id")], F.floor(F.col("x") / 7), {"run": F.col("v")}, ("g",)).collect()
    assert len(got) == 500
    for g in "ab":
        total = 0
        mine = sorted([r for r in got if r["g"] == g], key=lambda r: (r["x"] is not None, r["x"] or 0, r["id"]))
        for r in mine:
            total += r["v"]
            assert r["run"] == total
        assert {r["run_all"] for r in mine} == {total}


@pytest.mark.parametrize("ids", [lambda i: f"txn_{i:07d}", lambda i: f"txn_{i}", lambda i: hashlib.md5(str(i).encode()).hexdigest(),
                                 lambda i: "same", lambda i: None, lambda i: ["é", "", "Ünï", None][i % 4] and f"é{i}"])
def test_running_totals_of_rows_without_a_bucket(spark, ids):
    rng = random.Random(3)
    rows = [(None if i % 3 else i // 50, ids(i), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "x int, id string, v int")
    order = [F.col("x"), F.col("id"), F.col("v")]
    got = running_totals(df, order, F.col("x"), {"run": F.col("v"), "at": F.lit(1)}, unplaced=F.col("id"), part_rows=100).collect()
    mine = sorted(got, key=lambda r: (r["x"] is not None, r["x"] or 0, r["id"] is not None, (r["id"] or "").encode(), r["v"]))
    total = at = 0
    for r in sorted(got, key=lambda r: (r["at"], r["run"])):
        total, at = total + r["v"], at + 1
        assert (r["run"], r["at"]) == (total, at)
    assert [(r["x"], r["id"], r["v"]) for r in mine] == [
        (r["x"], r["id"], r["v"]) for r in sorted(got, key=lambda r: (r["at"], r["run"]))]


def test_rows_without_a_bucket_are_many_groups(spark):
    df = spark.range(1_000_000).select(F.format_string("txn_%08d", "id").alias("id"))
    part = _part_of(df, F.col("id"), 100_000)
    sizes = [r["count"] for r in df.groupBy(part.alias("part")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200_000


@pytest.mark.parametrize("scale", [1, 40])
def test_areas(spark, scale):
    rng = random.Random(2)
    rows = [((rng.choice([rng.random(), 0.5, 0.25]) - (scale > 1) / 2) * scale, int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    points, area = [(0.0, 1.0)], 0.0
    for cut in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(p >= cut for p in pos), sum(n >= cut for n in neg)
        points.append((tp / len(pos), tp / (tp + fp)))
    for (r0, p0), (r1, p1) in zip(points, points[1:]):
        area += (r1 - r0) * (p0 + p1) / 2
    row = metrics.ranking_metrics(df).first()
    assert (row["roc_auc"], row["pr_auc"]) == (pytest.approx(auc, abs=1e-12), pytest.approx(area, abs=1e-12))
    one_class = metrics.ranking_metrics(df.filter("label = 1")).first()
    assert one_class["roc_auc"] is None


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    first = {r["k"]: r["fold"] for r in learning.stratified_folds(df, "k").collect()}
    again = {r["k"]: r["fold"] for r in learning.stratified_folds(df.repartition(13), "k").collect()}
    assert first == again
    sizes = learning.stratified_folds(df, "k").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_best_model_ties_and_zero(spark):
    runs = spark.createDataFrame([("a", 0.7, 0), ("b", 0.7, 1), ("c", 0.0, 2)], "model_type string, cv_auc double, run_order int")
    assert learning.best_model(runs).first()["model_type"] == "a"
    assert learning.best_model(runs.filter("cv_auc = 0")).count() == 0


def test_train_evaluate_register(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("review_id"), F.col("id").cast("double").alias("amount"),
        (F.col("id") / 400).alias("level1_score"), (F.col("id") / 200).alias("level2_score"),
        (F.col("id") >= 120).cast("int").alias("label"))
    train, holdout = learning.split_holdout(rows, "review_id")
    assert 20 < holdout.count() < 60
    runs = learning.train_candidates(train, str(tmp_path), candidates=learning.default_candidates(2, 2), k=2)
    best = learning.best_model(runs).first()
    assert best["cv_auc"] > 0.9
    model = learning.load_model(best["model_path"])
    result = learning.compare_with_production(model, None, holdout)
    assert result.first()["better"] is True and result.first()["auc_score"] > 0.9
    for version in (1, 2):
        registry = learning.register_model(model, result, best["run_id"], f"{tmp_path}/registry")
        assert sorted(r["version"] for r in registry.collect()) == list(range(1, version + 1))
    same = learning.compare_with_production(model, model, holdout)
    assert same.first()["better"] is False
    assert learning.register_model(model, same, "x", f"{tmp_path}/registry").count() == 2
    assert registry.first()["description"].startswith("Trained on ")

    # a later session leaves runs and models of earlier ones as they are
    again = learning.train_candidates(train, str(tmp_path), candidates=learning.default_candidates(1, 1), k=2)
    every = learning.runs_of(spark, str(tmp_path))
    assert runs.count() == again.count() == 2 and every.select("run_id", "model_path").distinct().count() == 4
    assert learning.latest_run(every, "gbt").first()["run_id"] == again.filter("model_type = 'gbt'").first()["run_id"]
    assert learning.evaluate_model(learning.load_model(best["model_path"]), holdout).collect() == \
        learning.evaluate_model(model, holdout).collect()


def test_fits_read_as_many_files_as_their_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(learning, "_FIT_ROWS", 100)
    train = spark.range(1000).select(
        F.col("id").cast("string").alias("review_id"), *[F.rand(i).alias(c) for i, c in enumerate(learning.FEATURES)],
        (F.col("id") % 2).cast("int").alias("label"))
    learning.train_candidates(
        train, str(tmp_path), candidates={"random_forest": learning.default_candidates(2, 2)["random_forest"]}, k=2)
    cores = spark.sparkContext.defaultParallelism
    assert len(list(tmp_path.glob("folded/*/*.parquet"))) == min(10, cores)


def test_stages_and_the_model_in_production(spark, tmp_path):
    where = str(tmp_path)
    rows = spark.range(80).select(F.col("id").cast("double").alias("amount"), F.lit(0.1).alias("level1_score"),
                                  F.lit(0.2).alias("level2_score"), (F.col("id") >= 40).cast("int").alias("label"))
    stages = [VectorAssembler(inputCols=learning.FEATURES, outputCol="features"), learning.default_candidates(1, 2)["random_forest"]]
    model = Pipeline(stages=stages).fit(rows)
    result = learning.compare_with_production(model, None, rows)
    for _ in range(3):
        learning.register_model(model, result, "run", where)
    assert learning.production_model(spark, where) is None
    learning.move_to_stage(spark, where, 1, learning.PRODUCTION)
    learning.move_to_stage(spark, where, 3, learning.PRODUCTION)
    assert learning.production_version(spark, where).first()["version"] == 3
    learning.move_to_stage(spark, where, 3, "Archived")
    found = {r["version"]: r["stage"] for r in learning.read_registry(spark, where).collect()}
    assert found == {1: "Production", 2: "Staging", 3: "Archived"}
    assert learning.production_version(spark, where).first()["version"] == 1
    assert learning.evaluate_model(learning.production_model(spark, where), rows).collect() == learning.evaluate_model(model, rows).collect()
    with pytest.raises(ValueError, match="no version 9"):
        learning.move_to_stage(spark, where, 9, learning.PRODUCTION)


def test_pages_shallow_and_deep(spark, monkeypatch):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(str(i), base + dt.timedelta(seconds=i % 37)) for i in range(95)],
                               "transaction_id string, timestamp timestamp")

    def ids(number):
        return [r["transaction_id"] for r in alerts.page(df, number, 10).collect()]

    shallow = [ids(n) for n in (1, 5, 10, 11)]
    monkeypatch.setattr(alerts, "_TOP_K_ROWS", 0)
    assert [ids(n) for n in (1, 5, 10, 11)] == shallow
    assert [len(p) for p in shallow] == [10, 10, 5, 0]
    assert alerts.page(df, 2, 10).first()["total"] == 95
    with pytest.raises(ValueError):
        alerts.page(df, 0)
    with pytest.raises(ValueError):
        alerts.page(df, 1, 101)


def test_reports_on_an_empty_or_failed_log(spark):
    schema = "success boolean, status_code int, response_time double, transaction_id string, error string, requested_at timestamp"
    row = reports.latency_report(spark.createDataFrame([], schema)).first()
    assert row["total_requests"] == 0 and row["p99"] is None
    failed = spark.createDataFrame([(False, 500, 5.0, "a", None, dt.datetime(2024, 1, 1)), (False, 500, 5.0, "b", "boom", dt.datetime(2024, 1, 1))], schema)
    assert [tuple(r) for r in reports.error_breakdown(failed).collect()] == [("HTTP 500", 1), ("boom", 1)]
    assert [r["passed"] for r in reports.sla_check(failed).collect()] == [False, True, False]


def test_keywords(spark):
    df = spark.createDataFrame([("My PASSWORD and Secret",), ("nothing",), (None,)], "text string")
    assert [r["keywords"] for r in reports.sensitive_keyword_scan(df, "text").collect()] == [["password", "secret"], [], []]
