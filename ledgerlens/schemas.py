"""Message and table schemas."""

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, MapType, StringType,
    StructField, StructType, TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _T = StringType(), DoubleType(), TimestampType()

# Raw message: the timestamp travels as an ISO string.
RAW_TRANSACTION = _struct(
    transaction_id=_S, user_id=_S, amount=_D, merchant_category=_S,
    timestamp=_S, location=_S, device_id=_S, is_fraud=BooleanType(),
)

HEAVY_PAYLOAD = _struct(
    transaction_id=_S, user_id=_S, device_id=_S, amount=_D, timestamp=_S,
    session_features=MapType(_S, _S), graph_features=MapType(_S, _S),
)

LEVEL1_ACTION = _struct(
    transaction_id=_S, user_id=_S, device_id=_S, amount=_D, timestamp=_S,
    score=_D, verdict=_S, detection_level=IntegerType(),
)

# `score` is what a level 1 action forwarded to level 2 carries.
LEVEL2_VERDICT = _struct(
    transaction_id=_S, user_id=_S, device_id=_S, amount=_D, timestamp=_S,
    heavy_score_clamped=_D, verdict=_S, score=_D,
)

DETECTION_PATH = _struct(level1=LEVEL1_ACTION, level2=LEVEL2_VERDICT)

FINAL_DECISION = _struct(
    transaction_id=_S, final_verdict=_S, reason=_S, timestamp=_S,
    level1=LEVEL1_ACTION, level2=LEVEL2_VERDICT,
)

# Tables. Keys are derived from the data instead of a serial, so that writers
# on many executors (and retried tasks) agree on them without coordination.
MANUAL_REVIEWS = _struct(
    id=_S, transaction_id=_S, user_id=_S, device_id=_S, amount=_D,
    detection_path=DETECTION_PATH, level1_score=_D, level2_score=_D,
    status=_S, created_at=_T, updated_at=_T,
)

FEEDBACK_LABELS = _struct(
    id=_S, review_id=_S, transaction_id=_S, operator_id=_S, verdict=_S,
    comment=_S, created_at=_T,
)

FINAL_DECISIONS = _struct(
    id=_S, transaction_id=_S, final_verdict=_S, reason=_S,
    detection_path=DETECTION_PATH, created_at=_T,
)

HOT_FEATURES = _struct(user_id=_S, tx_count_1min=LongType(), updated_at=_T)

REQUEST_LOG = _struct(
    success=BooleanType(), status_code=IntegerType(), response_time=_D,
    transaction_id=_S, error=_S, requested_at=_T,
)

JUDGEMENT = _struct(
    review_id=_S, verdict=_S, operator_id=_S, comment=_S, judged_at=_T,
)
