"""Exact ranking metrics of a scored, labelled frame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.running import running_totals

_SCORE_BUCKETS = 65_536


def _curve(scored: DataFrame, score: str, label: str, within: tuple[str, ...]) -> DataFrame:
    """One row per distinct score with its positives and negatives and their running totals from below.

    Equal scores collapse before the shuffle; buckets of the score range keep the
    running totals parallel when scores are continuous. Scores beyond [0, 1], such as
    margins, get buckets of the logistic curve: it squeezes them into (0, 1) in their order.
    """
    per_score = scored.groupBy(*within, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")
    )
    x = F.col("score").cast("double")
    beyond = F.floor(_SCORE_BUCKETS / (1 + F.exp(-x)))
    bucket = F.when(F.isnan(x), 3 * _SCORE_BUCKETS).when(x < 0, beyond - _SCORE_BUCKETS).when(x > 1, beyond + _SCORE_BUCKETS).otherwise(F.floor(x * _SCORE_BUCKETS))
    return running_totals(
        per_score, [F.col("score")], bucket, {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}, within
    )


def _roc():
    below = F.col("neg_upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    pairs = F.max("pos_upto_all").cast("double") * F.max("neg_upto_all")
    return F.when(pairs > 0, wins / pairs)


def _pr():
    """Trapezoids over (recall, precision) from the highest score down, starting at (0, 1)."""
    all_pos, all_neg = F.col("pos_upto_all"), F.col("neg_upto_all")
    tp_above, fp_above = all_pos - F.col("pos_upto"), all_neg - F.col("neg_upto")
    tp, fp = tp_above + F.col("pos"), fp_above + F.col("neg")
    precision = tp / F.nullif(tp + fp, F.lit(0))
    precision_above = F.when(tp_above + fp_above == 0, F.lit(1.0)).otherwise(
        tp_above / F.nullif(tp_above + fp_above, F.lit(0))
    )
    step = F.col("pos") / F.nullif(all_pos, F.lit(0))
    return F.sum(step * (precision + precision_above) / 2)


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", within: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; one row, or one per value of `within`."""
    return _curve(scored, score, label, within).groupBy(*within).agg(_roc().alias("roc_auc"))


def pr_auc(scored: DataFrame, score: str = "score", label: str = "label", within: tuple[str, ...] = ()) -> DataFrame:
    """Area under the precision/recall curve by trapezoids."""
    return _curve(scored, score, label, within).groupBy(*within).agg(_pr().alias("pr_auc"))


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                    within: tuple[str, ...] = ()) -> DataFrame:
    """Both areas in one pass."""
    return _curve(scored, score, label, within).groupBy(*within).agg(_roc().alias("roc_auc"), _pr().alias("pr_auc"))


def cv_mean(fold_scores: DataFrame) -> DataFrame:
    """Mean fold score per model."""
    return fold_scores.groupBy("model_type").agg(F.avg("roc_auc").alias("cv_auc"))
