"""Training, evaluation and registration of risk models with Spark ML."""

import datetime as dt
import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.hashing import hash_order
from ledgerlens.operators.metrics import cv_mean, ranking_metrics, roc_auc
from ledgerlens.operators.running import running_totals
from ledgerlens.sources.tables import read_table

# --- fixed values ---------------------------------------------------------------
SEED = 42
HOLDOUT_SHARE = 0.2
FOLDS = 5
MODEL_NAME = "fraud_detector"
FEATURES = ["amount", "level1_score", "level2_score"]
# ----------------------------------------------------------------------------

_PARTS = 1_000_000
_FIT_ROWS = 20_000  # training rows that one task of a fit gets, about, as long as there are cores
RUNS_SCHEMA = ("session string, run_id string, model_type string, model_path string, cv_auc double, "
               "started_at timestamp, run_order int")
REGISTRY_SCHEMA = ("name string, version int, run_id string, model_path string, stage string, "
                   "description string, created_at timestamp")
_STAGES_SCHEMA = "name string, version int, stage string, moved_at timestamp, move int"
STAGING, PRODUCTION = "Staging", "Production"


def with_holdout(df: DataFrame, key: str, share: float = HOLDOUT_SHARE, seed: int = SEED) -> DataFrame:
    """Add `holdout`. The split follows a hash of the key, so it does not depend on partitioning or retries."""
    return df.withColumn("holdout", F.pmod(hash_order(F.col(key), seed), F.lit(_PARTS)) < int(share * _PARTS))


def split_holdout(df: DataFrame, key: str, share: float = HOLDOUT_SHARE, seed: int = SEED):
    marked = with_holdout(df, key, share, seed)
    return marked.filter(~F.col("holdout")).drop("holdout"), marked.filter("holdout").drop("holdout")


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add `fold`: within each label, rows in hash order are dealt out in turn, so folds differ by one row at most.

    A window per label would be one task per label; positions come from running totals instead.
    """
    rows = df.withColumn("_h", hash_order(F.col(key), seed))
    placed = running_totals(
        rows, [F.col("_h"), F.col(key)], F.floor(F.col("_h") / 65_536), {"_position": F.lit(1)}, (label,)
    )
    fold = F.pmod(F.col("_position") - 1, F.lit(k)).cast("int")
    return placed.select(*df.columns, fold.alias("fold"))


def default_candidates(trees: int = 20, depth: int = 5) -> dict:
    """Two boosted or bagged tree models to choose from."""
    return {
        "gbt": GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=SEED),
        "random_forest": RandomForestClassifier(
            labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED
        ),
    }


def predicted(model, rows: DataFrame, *keep: str) -> DataFrame:
    """score (probability of label 1) and label."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"), "label")


def cross_validate(train: DataFrame, estimator, features: list[str], k: int = FOLDS) -> DataFrame:
    """fold and roc_auc of each fold. `train` carries the fold number.

    Folds are fitted side by side: tree fitting is a chain of short jobs that
    leaves a cluster idle in between.
    """
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator])

    @inheritable_thread_target(train.sparkSession)
    def fold_scores(i: int) -> DataFrame:
        model = pipeline.fit(train.filter(F.col("fold") != i))
        return predicted(model, train.filter(F.col("fold") == i), "fold")

    with ThreadPool(k) as pool:
        scored = pool.map(fold_scores, range(k))
    return roc_auc(reduce(DataFrame.unionByName, scored), within=("fold",))


def train_candidates(train: DataFrame, models_path: str, features: list[str] | None = None,
                     candidates: dict | None = None, k: int = FOLDS, key: str = "review_id") -> DataFrame:
    """Cross-validate every candidate, fit it on all training rows, save it, and give the run records of this session.

    Every run has an id and a folder of its own, so later sessions leave it as it is; `runs_of` has all of them.
    """
    spark = train.sparkSession
    features = features or FEATURES
    session = uuid.uuid4().hex
    # Tree fitting makes many passes: cut the lineage behind the features once. Every pass has a task
    # per file, and the few files that adaptive execution leaves would keep most of a cluster idle.
    parts = fit_parts(train.count(), spark.sparkContext.defaultParallelism)
    folded = _written(stratified_folds(train, key, k=k).repartition(parts, key), f"{models_path}/folded/{session}")
    for order, (name, estimator) in enumerate((candidates or default_candidates()).items()):
        scores = cross_validate(folded, estimator, features, k).withColumn("model_type", F.lit(name))
        pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator])
        run_id = f"{name}-{uuid.uuid4().hex}"
        path = f"{models_path}/models/{run_id}"
        pipeline.fit(folded).write().save(path)
        log_run(cv_mean(scores).select(
            F.lit(session).alias("session"), F.lit(run_id).alias("run_id"), "model_type", F.lit(path).alias("model_path"),
            "cv_auc", F.lit(dt.datetime.now(dt.timezone.utc)).alias("started_at"), F.lit(order).alias("run_order"),
        ), f"{models_path}/runs")
    return runs_of(spark, models_path).filter(F.col("session") == session)


def fit_parts(rows: int, cores: int) -> int:
    return max(1, min(cores, -(-rows // _FIT_ROWS)))


def runs_of(spark: SparkSession, models_path: str) -> DataFrame:
    """Records of all runs of all sessions."""
    return spark.read.schema(RUNS_SCHEMA).parquet(f"{models_path}/runs")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def log_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def best_model(runs: DataFrame) -> DataFrame:
    """Candidate with the highest score above 0; the first one wins ties."""
    return runs.filter(F.col("cv_auc") > 0).orderBy(F.desc("cv_auc"), "run_order").limit(1)


def latest_run(runs: DataFrame, model_type: str) -> DataFrame:
    return runs.filter(F.col("model_type") == model_type).orderBy(F.desc("started_at")).limit(1)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluate_model(model, holdout: DataFrame) -> DataFrame:
    """roc_auc and pr_auc on the holdout."""
    return ranking_metrics(predicted(model, holdout))


def compare_with_production(candidate, production, holdout: DataFrame) -> DataFrame:
    """auc_score, production_auc and better: strictly greater, or nothing in production."""
    new = evaluate_model(candidate, holdout).select(F.col("roc_auc").alias("auc_score"), "pr_auc")
    if production is None:
        return new.withColumns({"production_auc": F.lit(None).cast("double"), "better": F.lit(True)})
    old = roc_auc(predicted(production, holdout)).select("roc_auc")
    return new.withColumn("production_auc", old.scalar()).withColumn(
        "better", F.coalesce(F.col("auc_score") > F.col("production_auc"), F.lit(False))
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Every version with its present stage."""
    versions = read_table(spark, path, "registry", StructType.fromDDL(REGISTRY_SCHEMA))
    moves = read_table(spark, path, "stages", StructType.fromDDL(_STAGES_SCHEMA))
    last = moves.groupBy("name", "version").agg(F.max_by("stage", "move").alias("moved"))
    return versions.join(last, ["name", "version"], "left").withColumn(
        "stage", F.coalesce("moved", "stage")).select(*versions.columns)


def register_model(model: PipelineModel, comparison: DataFrame, run_id: str, path: str,
                   name: str = MODEL_NAME) -> DataFrame:
    """If the comparison says better: save as the next version, in stage Staging. Gives the registry.

    A version's folder is never written twice: of two registrations at once the later one fails.
    """
    spark = comparison.sparkSession
    result = comparison.first()
    registry = read_registry(spark, path)
    if result["better"]:
        newest = registry.filter(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (newest or 0) + 1
        model_path = f"{path}/{name}/{version}"
        model.write().save(model_path)
        comparison.select(
            F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(run_id).alias("run_id"),
            F.lit(model_path).alias("model_path"), F.lit(STAGING).alias("stage"),
            F.format_string("Trained on %s; holdout ROC area %.4f, PR area %.4f", F.current_date().cast("string"),
                            F.col("auc_score"), F.col("pr_auc")).alias("description"),
            F.current_timestamp().alias("created_at"),
        ).write.mode("append").parquet(f"{path}/registry")
        registry = read_registry(spark, path)
    return registry


def move_to_stage(spark: SparkSession, path: str, version: int, stage: str, name: str = MODEL_NAME) -> DataFrame:
    """Bring a version to a stage. Moves are appended, the last one counts. Gives the registry."""
    known = read_registry(spark, path).filter((F.col("name") == name) & (F.col("version") == version))
    if known.isEmpty():
        raise ValueError(f"there is no version {version} of {name}")
    moves = read_table(spark, path, "stages", StructType.fromDDL(_STAGES_SCHEMA))
    number = (moves.agg(F.max("move")).first()[0] or 0) + 1
    known.select("name", "version", F.lit(stage).alias("stage"), F.current_timestamp().alias("moved_at"),
                 F.lit(number).alias("move")).write.mode("append").parquet(f"{path}/stages")
    return read_registry(spark, path)


def production_version(spark: SparkSession, path: str, name: str = MODEL_NAME) -> DataFrame:
    """The newest version in production: one row, or none."""
    found = read_registry(spark, path).filter((F.col("name") == name) & (F.col("stage") == PRODUCTION))
    return found.orderBy(F.desc("version")).limit(1)


def production_model(spark: SparkSession, path: str, name: str = MODEL_NAME) -> PipelineModel | None:
    """The model in production, as compare_with_production takes it."""
    found = production_version(spark, path, name).first()
    return load_model(found["model_path"]) if found else None
