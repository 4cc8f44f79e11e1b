"""Level 1: fast score, verdict and its messages."""

from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.functions import scoring
from ledgerlens.operators.parse import message_time


def fast_scores(df: DataFrame, count: str = "tx_count_1min") -> DataFrame:
    """Add score and verdict from the amount and the 1-minute count."""
    scored = df.withColumn("score", scoring.fast_score(F.col("amount"), F.col(count)))
    return scored.withColumn("verdict", scoring.policy_decision(F.col("score")))


def model_scores(df: DataFrame, model=None, count: str = "tx_count_1min") -> DataFrame:
    """Score with a fitted pipeline model, else with the fast score.

    The model reads amount and tx_count_1min and writes a `probability` vector.
    Rows it skips (a missing input) fall back to the fast score, too.
    """
    if model is None:
        return fast_scores(df, count)
    inputs = df.withColumn("tx_count_1min", F.coalesce(F.col(count), F.lit(0)).cast("bigint"))
    usable = F.col("amount").isNotNull()
    probability = vector_to_array("probability")[1]
    learned = model.transform(inputs.filter(usable)).select(
        *inputs.columns, scoring.clamp01(probability).alias("score")
    )
    plain = inputs.filter(~usable).withColumn("score", scoring.fast_score(F.col("amount"), F.col("tx_count_1min")))
    return learned.unionByName(plain).withColumn("verdict", scoring.policy_decision(F.col("score")))


def onnx_scores(df: DataFrame, model_path: str, count: str = "tx_count_1min") -> DataFrame:
    """Score with an ONNX model over [amount, tx_count_1min]; the model is loaded once per task and runs on batches.

    `model_path` is a folder path that all executors see. Rows without an amount,
    and all rows where the runtime is not installed, get the fast score.
    """
    plain = scoring.fast_score(F.col("amount"), F.col(count))
    try:
        import onnxruntime  # noqa: F401
    except ImportError:
        return fast_scores(df, count)

    def load():
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)
        name = session.get_inputs()[0].name
        return lambda rows: session.run(None, {name: rows.astype(np.float32)})[0][:, 0].astype(np.float64)

    predict = predict_batch_udf(load, return_type=DoubleType(), batch_size=10_000, input_tensor_shapes=[[2]])
    inputs = F.array(F.coalesce("amount", F.lit(0.0)), F.coalesce(F.col(count).cast("double"), F.lit(0.0)))
    scored = df.withColumn("_predicted", predict(inputs)).withColumn(
        "score", F.when(F.col("amount").isNull(), plain).otherwise(scoring.clamp01(F.col("_predicted")))
    ).drop("_predicted")
    return scored.withColumn("verdict", scoring.policy_decision(F.col("score")))


def l1_actions(scored: DataFrame) -> DataFrame:
    """Message for every level 1 result."""
    return scored.select(
        "transaction_id", "user_id", "device_id", "amount", message_time(F.col("timestamp")).alias("timestamp"),
        "score", "verdict", F.lit(1).alias("detection_level"),
    )


def route_quarantined(actions: DataFrame) -> DataFrame:
    """Level 1 quarantines go on to level 2."""
    return actions.filter(F.col("verdict") == "Quarantine").drop("detection_level")
