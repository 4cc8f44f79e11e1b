"""Named queries that train models on the supplied tables."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.operators import learning, level1, trailing
from ledgerlens.plans import canonical, flow
from ledgerlens.plans.canonical import transactions
from ledgerlens.plans.registered import query
from ledgerlens.session import work_folder


def _training(spark, d):
    """Training and holdout rows of the judged reviews, written once: fitting reads them many times."""
    folder = work_folder(spark, "learning")
    rows = flow.training_table(transactions(spark, d), canonical.judgements(spark, d))
    rows.write.parquet(f"{folder}/features")
    return folder, *learning.split_holdout(spark.read.parquet(f"{folder}/features"), "review_id")


_RUNS = {}


def _trained(spark, d):
    """One training run per application and input: the queries below look at different parts of it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        folder, train, holdout = _training(spark, d)
        _RUNS[key] = folder, learning.train_candidates(train, f"{folder}/models"), holdout
    return _RUNS[key]


@query
def train_candidates(spark, d):
    _, runs, _ = _trained(spark, d)
    return runs.select("model_type", "cv_auc", "run_order")


@query
def evaluate_model(spark, d):
    """Areas of the best candidate on the holdout."""
    _, runs, holdout = _trained(spark, d)
    best = learning.best_model(runs).first()["model_path"]
    return learning.evaluate_model(learning.load_model(best), holdout)


def _model(runs, model_type):
    return learning.load_model(learning.latest_run(runs, model_type).first()["model_path"])


@query
def compare_with_production(spark, d):
    """Boosted trees against a forest in production."""
    _, runs, holdout = _trained(spark, d)
    return learning.compare_with_production(_model(runs, "gbt"), _model(runs, "random_forest"), holdout)


def _registered(spark, d):
    """A fresh registry with the latest run of the best candidate: nothing is in production yet."""
    _, runs, holdout = _trained(spark, d)
    best = learning.best_model(runs).first()
    path = work_folder(spark, "registry")
    model = learning.load_model(best["model_path"])
    comparison = learning.compare_with_production(model, learning.production_model(spark, path), holdout)
    return path, model, holdout, learning.register_model(model, comparison, best["run_id"], path)


@query
def register_model(spark, d):
    """The best candidate becomes version 1, in staging."""
    *_, registry = _registered(spark, d)
    return registry.select("name", "version", "stage")


@query
def production_model(spark, d):
    """Version 1 in production, and the same model again: it is not better than itself, so there is no version 2."""
    path, model, holdout, _ = _registered(spark, d)
    learning.move_to_stage(spark, path, 1, learning.PRODUCTION)
    comparison = learning.compare_with_production(model, learning.production_model(spark, path), holdout)
    registry = learning.register_model(model, comparison, "again", path)
    return registry.select("name", "version", "stage", F.lit(comparison.first()["better"]).alias("better"))


@query
def model_score(spark, d):
    """Level 1 by a model of amount and 1-minute count, fitted on the transactions themselves."""
    tx = trailing.trailing_features(transactions(spark, d)).select(
        "transaction_id", "user_id", "device_id", "timestamp", "amount", "tx_count_1min",
        F.col("is_fraud").cast("int").alias("label"),
    )
    stages = [VectorAssembler(inputCols=["amount", "tx_count_1min"], outputCol="features"),
              learning.default_candidates()["random_forest"]]
    model = Pipeline(stages=stages).fit(tx)
    return level1.model_scores(tx, model).select("transaction_id", "score", "verdict")
