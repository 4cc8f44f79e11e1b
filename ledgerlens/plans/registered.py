"""Named queries over the supplied tables: every operator once, in a flat shape."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, times
from ledgerlens.operators import (
    alerts, bloom, decisions, hopping, learning, level0, level1, level2, metrics, parse, profiles, reports, reviews,
    trailing,
)
from ledgerlens.plans import canonical, flow
from ledgerlens.plans.canonical import transactions
from ledgerlens.plans.shapes import decision_columns, joined_text, plain_times, rounded, with_window_bounds

QUERIES = {}


def query(build):
    """Register a builder (spark, sf_dir) -> DataFrame under its own name."""
    def run(spark, sf_dir):
        return plain_times(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


# --- parsing and time ------------------------------------------------------------

@query
def parse_transactions(spark, d):
    """Every 13th message arrives cut off and becomes an all-null row."""
    tx = transactions(spark, d, "k")
    whole = F.to_json(F.struct(*[
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c == "timestamp" else F.col(c)
        for c in canonical.TRANSACTION
    ]))
    messages = tx.select(F.when(F.col("k") % 13 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("value"))
    return parse.parse_transactions(messages)


@query
def drop_undecodable(spark, d):
    tx = transactions(spark, d, "k")
    key = F.when(F.col("k") % 13 == 0, F.lit(None)).when(F.col("k") % 17 == 0, "").otherwise(F.col("transaction_id"))
    messages = parse.to_value(tx.select(key.alias("transaction_id"), "user_id"))
    return parse.drop_undecodable(parse.from_value(messages, "transaction_id string, user_id string"))


@query
def time_features(spark, d):
    return parse.time_features(transactions(spark, d)).select("transaction_id", "hour_of_day", "day_of_week")


@query
def to_value(spark, d):
    messages = parse.to_value(flow.features(transactions(spark, d)).select("transaction_id", "amount", "is_fraud"))
    return parse.from_value(messages, "transaction_id string, amount double, is_fraud boolean")


# --- features ----------------------------------------------------------------------

@query
def user_stats_24h(spark, d):
    out = with_window_bounds(hopping.user_stats_24h(transactions(spark, d)))
    return rounded(out, "mean_amount", "stddev_amount")


@query
def tx_count_1h(spark, d):
    return with_window_bounds(hopping.tx_count_1h(transactions(spark, d)))


@query
def tx_count_1min(spark, d):
    return with_window_bounds(hopping.tx_count_1min(transactions(spark, d)))


@query
def join_window_stats(spark, d):
    out = hopping.join_window_stats(transactions(spark, d)).select(
        "transaction_id", "window_start", "window_end", "mean_amount", "stddev_amount"
    )
    return rounded(out, "mean_amount", "stddev_amount")


@query
def join_hourly_counts(spark, d):
    return hopping.join_hourly_counts(transactions(spark, d)).select("transaction_id", "window_start", "tx_count")


@query
def join_minute_counts(spark, d):
    return hopping.join_minute_counts(transactions(spark, d)).select("transaction_id", "window_start", "tx_count_1min")


@query
def amount_zscore(spark, d):
    scored = hopping.amount_zscore(hopping.join_window_stats(transactions(spark, d)))
    return rounded(scored.select("transaction_id", "window_start", "amount_zscore"), "amount_zscore")


@query
def hopping_features(spark, d):
    """All 1,728 rows of every transaction, added up per transaction."""
    return rounded(hopping.hopping_totals(transactions(spark, d)), "amount_zscore")


@query
def default_count(spark, d):
    """Counts of the windows that start with the transaction's own slot; other transactions have none there."""
    tx = transactions(spark, d)
    start = times.slot_start(times.slot(times.micros(F.col("timestamp")), times.HOUR), times.HOUR)
    counts = hopping.tx_count_1h(tx).filter(F.col("tx_count") > 1).select(
        "user_id", F.col("window.start").alias("start"), F.col("tx_count").alias("transactions_last_hour")
    )
    joined = tx.withColumn("start", start).join(counts, ["user_id", "start"], "left")
    return hopping.default_counts(joined, "transactions_last_hour").select("transaction_id", "transactions_last_hour")


@query
def trailing_features(spark, d):
    out = trailing.trailing_features(transactions(spark, d)).select(
        "transaction_id", "mean_amount", "stddev_amount", "amount_zscore", "transactions_last_hour", "tx_count_1min"
    )
    return rounded(out, "mean_amount", "stddev_amount", "amount_zscore")


@query
def enriched_projection(spark, d):
    return rounded(trailing.enriched_projection(flow.features(transactions(spark, d))), "amount_zscore")


@query
def upsert_hot_features(spark, d):
    return trailing.hot_features(flow.features(transactions(spark, d)))


def _published_features(spark, d) -> DataFrame:
    """Hot features as the feature job publishes them, 30 seconds after each transaction."""
    return trailing.trailing_features(transactions(spark, d)).select(
        "user_id", "tx_count_1min",
        F.timestamp_micros(times.micros(F.col("timestamp")) + 30 * times.SECOND).alias("updated_at"),
    )


@query
def lookup_hot_feature(spark, d):
    return trailing.lookup_hot_feature(transactions(spark, d), _published_features(spark, d)).select(
        "transaction_id", "hot_tx_count_1min"
    )


# --- level 0 ------------------------------------------------------------------------

def _validated(spark, d) -> DataFrame:
    return level0.validate_schema(canonical.ingest_bodies(spark, d))


@query
def validate_schema(spark, d):
    return _validated(spark, d).select("message_id", "readable", joined_text(F.col("violations")).alias("violations"))


@query
def validate_schema_strict(spark, d):
    checked = level0.validate_schema(canonical.ingest_bodies(spark, d), strict_time=True)
    return checked.select("message_id", joined_text(F.col("violations")).alias("violations"))


@query
def reject_bad_json(spark, d):
    return level0.reject_bad_json(_validated(spark, d)).select("message_id", "value")


@query
def rejected_bodies(spark, d):
    return level0.rejected(_validated(spark, d)).select(
        "message_id", joined_text(F.col("violations")).alias("violations")
    )


@query
def blacklist_match(spark, d):
    matched = level0.blacklist_match(transactions(spark, d), canonical.blacklist(spark, d))
    return matched.select("transaction_id", "user_listed", "device_listed")


@query
def level0_verdict(spark, d):
    matched = level0.blacklist_match(transactions(spark, d), canonical.blacklist(spark, d))
    return level0.level0_verdict(matched).select("transaction_id", "user_id", "device_id", "verdict", "reason")


def _gate(spark, d) -> DataFrame:
    """Level 0 events of the accepted bodies, timed by the body itself."""
    matched = level0.blacklist_match(level0.accepted(_validated(spark, d)), canonical.blacklist(spark, d))
    at = F.coalesce(F.col("timestamp").try_cast("timestamp"), F.timestamp_micros(F.lit(0)))
    return level0.gatekeeping_events(level0.level0_verdict(matched), at=at)


@query
def gatekeeping_events(spark, d):
    return _gate(spark, d).withColumn("amount", F.get_json_object("payload", "$.amount").cast("double")).drop("payload")


@query
def route_l0_quarantined(spark, d):
    return level0.route_l0_quarantined(_gate(spark, d)).select("transaction_id", "user_id", "device_id", "reason")


# --- bloom --------------------------------------------------------------------------

@query
def bloom_offsets(spark, d):
    return bloom.bloom_offsets(transactions(spark, d), "device_id", bloom.GATE_SIZE, bloom.GATE_HASHES).select(
        "transaction_id", "hash", "offset"
    )


def _gate_bitmap(spark, d) -> DataFrame:
    return bloom.bloom_build(canonical.blacklist(spark, d), bloom.GATE_SIZE, bloom.GATE_HASHES)


@query
def bloom_build(spark, d):
    return bloom.bloom_bits(_gate_bitmap(spark, d))


@query
def bloom_contains(spark, d):
    return bloom.bloom_match(transactions(spark, d), _gate_bitmap(spark, d)).select(
        "transaction_id", "user_listed", "device_listed"
    )


# --- level 1 and 2 --------------------------------------------------------------------

@query
def fast_score(spark, d):
    return flow.score_transactions(transactions(spark, d)).select("transaction_id", "tx_count_1min", "score")


@query
def policy_decision(spark, d):
    return flow.score_transactions(transactions(spark, d)).groupBy("verdict").agg(
        F.count("*").alias("transactions"), F.sum("tx_count_1min").alias("tx_count_1min")
    )


@query
def l1_actions(spark, d):
    return flow.level1_messages(transactions(spark, d))


@query
def route_quarantined(spark, d):
    return level1.route_quarantined(flow.level1_messages(transactions(spark, d)))


@query
def heavy_payload(spark, d):
    payload = level2.heavy_payload(flow.features(transactions(spark, d)))
    return payload.select(
        "transaction_id", "user_id", "device_id", "amount", "timestamp", "session_features.session_length",
        F.size("session_features.recent_amounts").alias("recent_amounts"), "graph_features.neighbor_count",
        "graph_features.graph_score",
    )


@query
def extract_graph_features(spark, d):
    messages = parse.parse_level2(canonical.graph_messages(spark, d))
    return level2.extract_graph_features(messages).select("transaction_id", "neighbor_count", "graph_score")


@query
def heavy_score(spark, d):
    scored = level2.heavy_scores(parse.parse_level2(canonical.graph_messages(spark, d)))
    return rounded(
        scored.select("transaction_id", "amount", "heavy_score", "heavy_score_clamped", "verdict"),
        "heavy_score", "heavy_score_clamped",
    )


def _level2_inputs(spark, d, lift_payload):
    tx = transactions(spark, d)
    messages = level2.level2_inputs(
        level2.heavy_payload(flow.features(tx)),
        level1.route_quarantined(flow.level1_messages(tx)),
        level0.route_l0_quarantined(_gate(spark, d)), lift_payload,
    )
    return level2.level2_from_messages(messages).select(
        "transaction_id", "amount", "heavy_score_clamped", "verdict"
    )


@query
def level2_inputs(spark, d):
    return _level2_inputs(spark, d, lift_payload=True)


@query
def level2_inputs_as_sent(spark, d):
    """Level 0 events keep their amount inside the payload, where level 2 does not see it."""
    return _level2_inputs(spark, d, lift_payload=False)


# --- decisions --------------------------------------------------------------------------

@query
def decisions_per_message(spark, d):
    made = decisions.decisions_per_message(flow.level_messages(transactions(spark, d)))
    return made.select("transaction_id", "final_verdict", "reason", *decision_columns(made))


def _routed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Level 1 messages, and level 2 verdicts of the quarantined ones only."""
    l1 = flow.level1_messages(transactions(spark, d))
    return l1, level2.level2_from_messages(parse.to_value(level1.route_quarantined(l1)))


@query
def correlate_levels(spark, d):
    both = decisions.correlate_levels(*_routed(spark, d))
    return both.select("transaction_id", *decision_columns(both))


@query
def apply_business_rules(spark, d):
    made = decisions.decisions_combined(*_routed(spark, d))
    return made.select("transaction_id", "final_verdict", "reason")


@query
def decisions_combined(spark, d):
    made = flow.combined_decisions(transactions(spark, d))
    return made.select("transaction_id", "final_verdict", "reason", *decision_columns(made))


@query
def final_decision(spark, d):
    made = flow.combined_decisions(transactions(spark, d))
    return decisions.final_decision(made, at=decisions.message_instant(made)).select(
        "transaction_id", "final_verdict", "reason", "timestamp", F.col("level1.amount").alias("amount")
    )


@query
def only_escalated(spark, d):
    return decisions.only_escalated(flow.combined_decisions(transactions(spark, d))).select(
        "transaction_id", "reason"
    )


@query
def level_scores(spark, d):
    """Per message, so that one of the two scores is always missing."""
    made = decisions.decisions_per_message(flow.level_messages(transactions(spark, d)))
    return decisions.level_scores(made).select("transaction_id", "reason", "level1_score", "level2_score")


@query
def detection_path(spark, d):
    made = decisions.detection_path(decisions.decisions_combined(*_routed(spark, d)))
    return made.select(
        "transaction_id", F.col("detection_path.level1.score").alias("level1_score"),
        F.col("detection_path.level2.heavy_score_clamped").alias("level2_score"),
    )


@query
def open_reviews(spark, d):
    return flow.review_table(transactions(spark, d)).drop("detection_path")


# --- reviews ------------------------------------------------------------------------------

@query
def pending_reviews(spark, d):
    tx = transactions(spark, d)
    snapshot, _ = reviews.judge_reviews(flow.review_table(tx), canonical.judgements(spark, d))
    return reviews.pending_reviews(snapshot).drop("detection_path")


@query
def valid_judgements(spark, d):
    return reviews.valid_judgements(canonical.judgements(spark, d))


@query
def invalid_judgements(spark, d):
    return reviews.invalid_judgements(canonical.judgements(spark, d))


@query
def match_reviews(spark, d):
    return reviews.match_reviews(canonical.judgements(spark, d), flow.review_table(transactions(spark, d)))


@query
def unmatched_judgements(spark, d):
    return reviews.unmatched_judgements(
        canonical.judgements(spark, d), flow.review_table(transactions(spark, d))
    ).select("review_id", "verdict")


@query
def append_feedback(spark, d):
    return reviews.feedback_rows(canonical.judgements(spark, d), flow.review_table(transactions(spark, d)))


@query
def judge_reviews(spark, d):
    snapshot, _ = reviews.judge_reviews(
        flow.review_table(transactions(spark, d)), canonical.judgements(spark, d)
    )
    return snapshot.select("id", "transaction_id", "status", "created_at", "updated_at")


@query
def labelled_reviews(spark, d):
    opened = flow.review_table(transactions(spark, d))
    feedback = reviews.feedback_rows(canonical.judgements(spark, d), opened)
    return reviews.labelled_reviews(feedback, opened).drop("detection_path", "id")


@query
def training_features(spark, d):
    """From per-message decisions, where one score is missing in every row."""
    made = decisions.decisions_per_message(flow.level_messages(transactions(spark, d)))
    opened = decisions.open_reviews(made)
    feedback = reviews.feedback_rows(canonical.judgements(spark, d), opened)
    return reviews.training_features(reviews.labelled_reviews(feedback, opened), "review_id")


@query
def drop_incomplete(spark, d):
    l1, l2 = _routed(spark, d)
    opened = decisions.open_reviews(decisions.decisions_combined(l1, l2))
    feedback = reviews.feedback_rows(canonical.judgements(spark, d), opened)
    return reviews.drop_incomplete(
        reviews.training_features(reviews.labelled_reviews(feedback, opened), "review_id")
    )


@query
def extract_features(spark, d):
    return flow.training_table(transactions(spark, d), canonical.judgements(spark, d))


# --- alerts ---------------------------------------------------------------------------------

def _alerts(spark, d) -> DataFrame:
    """Audit rows of the routed decisions: levels 1 and 2 both occur."""
    made = decisions.decisions_combined(*_routed(spark, d))
    return decisions.final_decision_rows(made, at=decisions.message_instant(made))


ALERT = ["transaction_id", "final_verdict", "reason", "created_at", "detection_level"]


@query
def detection_level(spark, d):
    return alerts.detection_level(_alerts(spark, d)).select("transaction_id", "detection_level")


@query
def recent_alerts(spark, d):
    return alerts.recent_alerts(_alerts(spark, d)).select(*ALERT)


def _both_decisions(spark, d):
    """Two decisions per transaction, one per message, that of level 2 a minute later."""
    made = decisions.decisions_per_message(flow.level_messages(transactions(spark, d)))
    second = F.when(F.col("level2").isNotNull(), times.MINUTE).otherwise(0)
    at = F.timestamp_micros(F.unix_micros(decisions.message_instant(made)) + second)
    return decisions.final_decision_rows(made, at=at)


@query
def latest_per_transaction(spark, d):
    """The newer decision of every transaction."""
    return alerts.latest_per_transaction(_both_decisions(spark, d)).select(*ALERT)


@query
def alert_detail(spark, d):
    """The newer decision of the transaction with the least id."""
    least = transactions(spark, d).agg(F.min("transaction_id")).first()[0]
    return alerts.alert_detail(_both_decisions(spark, d), least).select(*ALERT)


@query
def alerts_by_level(spark, d):
    return alerts.alerts_by_level(alerts.detection_level(_alerts(spark, d)), 2).select(*ALERT)


@query
def alert_stats(spark, d):
    return alerts.alert_stats(alerts.detection_level(_alerts(spark, d)))


@query
def alert_view(spark, d):
    rows = alerts.detection_level(_alerts(spark, d))
    return alerts.alert_view(rows.withColumn("id", F.col("transaction_id")))


@query
def total_count(spark, d):
    return alerts.total_count(transactions(spark, d))


@query
def page(spark, d):
    return alerts.page(transactions(spark, d), 3, 25)


# --- reports ----------------------------------------------------------------------------------

@query
def latency_report(spark, d):
    out = reports.latency_report(canonical.request_log(spark, d))
    return rounded(out, "success_pct", "failed_pct", "duration_seconds", "throughput", "mean", "stdev", "median")


@query
def error_breakdown(spark, d):
    return reports.error_breakdown(canonical.request_log(spark, d))


@query
def sla_check(spark, d):
    return rounded(reports.sla_check(canonical.request_log(spark, d)), "value")


@query
def running_fraud_rate(spark, d):
    return rounded(reports.running_fraud_rate(transactions(spark, d)), "fraud_rate")


@query
def sensitive_keyword_scan(spark, d):
    scanned = reports.sensitive_keyword_scan(canonical.table(spark, d, "documents"), "text")
    return scanned.select("doc_id", joined_text(F.col("keywords")).alias("keywords"), "exposed")


@query
def sensitive_keyword_scan_conversations(spark, d):
    scanned = reports.sensitive_keyword_scan(canonical.table(spark, d, "conversations"), "text")
    return scanned.select("conv_id", "turn", joined_text(F.col("keywords")).alias("keywords"), "exposed")


# --- profiles -----------------------------------------------------------------------------------

@query
def user_profile(spark, d):
    profile = profiles.user_profile(transactions(spark, d))
    return profile.withColumn("preferred_categories", joined_text(F.col("preferred_categories")))


@query
def previous_location(spark, d):
    return profiles.previous_location(transactions(spark, d)).select(
        "transaction_id", "location", "previous_location"
    )


@query
def fraud_pattern_flags(spark, d):
    return profiles.fraud_pattern_flags(transactions(spark, d)).select(
        "transaction_id", "high_amount", "rapid_fire", "location_jump", "new_device", "unusual_category"
    )


# --- learning -------------------------------------------------------------------------------------

def _scored(spark, d, score: str) -> DataFrame:
    """Transactions scored by one of the built-in scores, with their fraud label and fold."""
    tx = transactions(spark, d)
    if score == "fast":
        scored = level1.fast_scores(trailing.trailing_features(tx))
    else:
        heavy = scoring.clamp01(scoring.heavy_score(F.lit(0.0), F.lit(0.0), F.col("amount")))
        scored = tx.withColumn("score", heavy)
    return scored.select("transaction_id", "score", F.col("is_fraud").cast("int").alias("label"))


@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_scored(spark, d, "heavy")), "roc_auc")


@query
def pr_auc(spark, d):
    return rounded(metrics.pr_auc(_scored(spark, d, "heavy")), "pr_auc")


@query
def split_holdout(spark, d):
    tx = transactions(spark, d).select("transaction_id", F.col("is_fraud").cast("int").alias("label"))
    return learning.with_holdout(tx, "transaction_id")


@query
def stratified_folds(spark, d):
    tx = transactions(spark, d).select("transaction_id", F.col("is_fraud").cast("int").alias("label"))
    return learning.stratified_folds(tx, "transaction_id")


def _fold_scores(spark, d) -> DataFrame:
    both = _scored(spark, d, "fast").withColumn("model_type", F.lit("fast")).unionByName(
        _scored(spark, d, "heavy").withColumn("model_type", F.lit("heavy"))
    )
    folded = learning.stratified_folds(transactions(spark, d).select(
        "transaction_id", F.col("is_fraud").cast("int").alias("label")), "transaction_id"
    ).select("transaction_id", "fold")
    return metrics.roc_auc(both.join(folded, "transaction_id"), within=("model_type", "fold"))


@query
def cv_mean(spark, d):
    return rounded(metrics.cv_mean(_fold_scores(spark, d)), "cv_auc")


@query
def best_model(spark, d):
    runs = metrics.cv_mean(_fold_scores(spark, d)).withColumn(
        "run_order", F.when(F.col("model_type") == "fast", 0).otherwise(1)
    )
    return rounded(learning.best_model(runs), "cv_auc")


@query
def latest_run(spark, d):
    """Each fold of a score is one run, started in fold order."""
    runs = _fold_scores(spark, d).select(
        "model_type", "roc_auc", "fold", F.timestamp_seconds(F.col("fold") * 60).alias("started_at")
    )
    return rounded(learning.latest_run(runs, "fast"), "roc_auc")
