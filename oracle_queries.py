"""SQL twins of the registered queries, for DuckDB over the same tables."""

from ledgerlens.plans.canonical import GRAPH_MESSAGE, INGEST_BODY


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _policy(score: str) -> str:
    return (f"CASE WHEN {score} < 0.2e0 THEN 'Allow' WHEN {score} < 0.6e0 THEN 'Challenge' "
            "ELSE 'Quarantine' END")


def _clamp(score: str) -> str:
    return f"CASE WHEN {score} < 0 THEN 0e0 WHEN {score} > 1 THEN 1e0 ELSE {score} END"


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

TX = """
tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS user_id, value * 20e0 AS amount,
         event_type AS merchant_category, ts, n_name AS location,
         'device_' || user_id || '_' || (k % 4) AS device_id,
         (event_type = 'error' AND value > 100) AS is_fraud, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e
  LEFT JOIN nation ON n_nationkey = (user_id + k // 90) % 25
)"""

FEAT = """
feat AS (
  SELECT *, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
         avg(amount) OVER d AS mean_amount, stddev_samp(amount) OVER d AS stddev_amount,
         count(*) OVER h AS transactions_last_hour, count(*) OVER m AS tx_count_1min
  FROM tx
  WINDOW d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW),
         h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
         m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW)
)"""

ZSCORE = ("CASE WHEN stddev_amount IS NULL OR stddev_amount = 0 THEN 0e0 "
          "ELSE (amount - mean_amount) / stddev_amount END")

L1 = f"""
l1raw AS (
  SELECT *, least(1e0, tx_count_1min / 10e0 + CASE WHEN amount > 1000 THEN 0.5e0 ELSE 0e0 END) AS score FROM feat
),
l1 AS (SELECT *, {_policy('score')} AS verdict FROM l1raw)"""

L2 = f"""
l2raw AS (SELECT *, 0 / 10e0 + 0e0 + CASE WHEN amount > 0 THEN amount / 10000e0 ELSE 0e0 END AS heavy FROM tx),
l2cut AS (SELECT *, {_clamp('heavy')} AS heavy_score_clamped FROM l2raw),
l2 AS (SELECT *, {_policy('heavy_score_clamped')} AS verdict FROM l2cut)"""

RULES = """
  CASE WHEN l2v IS NOT NULL THEN
         CASE l2v WHEN 'Quarantine' THEN 'Block' WHEN 'Challenge' THEN 'Escalate' ELSE 'Allow' END
       ELSE CASE l1v WHEN 'Allow' THEN 'Allow' ELSE 'Escalate' END END AS final_verdict,
  CASE WHEN l2v IS NOT NULL THEN 'level2_' || lower(l2v) ELSE 'level1_' || lower(l1v) END AS reason"""

# Level 2 for every transaction.
COMBINED = f"""
paired AS (
  SELECT l1.*, l1.verdict AS l1v, l2.heavy_score_clamped, l2.verdict AS l2v
  FROM l1 JOIN l2 USING (transaction_id)
),
decided AS (SELECT *, {RULES} FROM paired)"""

# Level 2 for the quarantined only.
ROUTED = f"""
paired AS (
  SELECT l1.*, l1.verdict AS l1v, q.heavy_score_clamped, q.verdict AS l2v
  FROM l1 LEFT JOIN (
    SELECT l2.* FROM l2 JOIN l1 USING (transaction_id) WHERE l1.verdict = 'Quarantine'
  ) q USING (transaction_id)
),
decided AS (SELECT *, {RULES} FROM paired)"""

# One decision per message.
PER_MESSAGE = f"""
messages AS (
  SELECT transaction_id, user_id, device_id, amount, ts, score AS s1, verdict AS l1v,
         CAST(NULL AS DOUBLE) AS s2, CAST(NULL AS VARCHAR) AS l2v FROM l1
  UNION ALL
  SELECT transaction_id, user_id, device_id, amount, ts, NULL, NULL, heavy_score_clamped, verdict FROM l2
),
made AS (SELECT *, {RULES} FROM messages)"""

REVIEWS = """
review AS (
  SELECT transaction_id AS id, transaction_id, user_id, device_id, amount, score AS level1_score,
         nullif(heavy_score_clamped, 0) AS level2_score, 'pending' AS status, ts AS created_at, ts AS updated_at
  FROM decided WHERE final_verdict = 'Escalate'
)"""

REVIEWS_PER_MESSAGE = """
review AS (
  SELECT transaction_id AS id, transaction_id, user_id, device_id, amount, s1 AS level1_score,
         nullif(s2, 0) AS level2_score, 'pending' AS status, ts AS created_at, ts AS updated_at
  FROM made WHERE final_verdict = 'Escalate'
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY l2v IS NOT NULL) = 1
)"""

JUDGED = """
judgement AS (
  SELECT transaction_id AS review_id,
         CASE WHEN merchant_category = 'view' THEN 'Unsure' WHEN is_fraud THEN 'Block' ELSE 'Allow' END AS verdict,
         'operator_' || (CAST(user_id AS BIGINT) % 5) AS operator_id, 'seen at ' || location AS comment,
         ts + INTERVAL 24 HOUR AS judged_at
  FROM tx
),
feedback AS (
  SELECT md5(concat_ws('|', review_id, operator_id, verdict, comment, CAST(epoch_us(judged_at) AS VARCHAR))) AS id,
         review_id, transaction_id, operator_id, verdict, comment, judged_at AS created_at
  FROM judgement JOIN review ON review.id = review_id
  WHERE verdict IN ('Allow', 'Block', 'Escalate')
)"""

LABELLED = """
labelled AS (
  SELECT f.review_id, f.operator_id, f.verdict, f.comment, f.created_at, r.transaction_id, r.user_id, r.amount,
         r.device_id, r.level1_score, r.level2_score, CAST(f.verdict = 'Block' AS INTEGER) AS label
  FROM feedback f JOIN review r ON r.id = f.review_id
)"""

SNAPSHOT = """
snapshot AS (
  SELECT r.* REPLACE (CASE WHEN j.judged_at IS NOT NULL THEN 'resolved' ELSE status END AS status,
                      coalesce(j.judged_at, updated_at) AS updated_at)
  FROM review r LEFT JOIN (SELECT * FROM judgement WHERE verdict IN ('Allow', 'Block', 'Escalate')) j
    ON j.review_id = r.id
)"""

# The gate's SQL differs from Spark's only in the name of the text type.
BODIES = f"""
bodies AS (
  SELECT transaction_id AS message_id, value, json_valid(value) AS readable,
         CASE WHEN json_valid(value) THEN value END AS body
  FROM (SELECT transaction_id, {INGEST_BODY} AS value FROM tx)
),
kinds AS (
  SELECT *, json_type(body) = 'OBJECT' AS is_object,
    json_type(body, '$.transaction_id') AS k_transaction_id, json_type(body, '$.user_id') AS k_user_id,
    json_type(body, '$.device_id') AS k_device_id, json_type(body, '$.amount') AS k_amount,
    json_type(body, '$.merchant_category') AS k_merchant_category, json_type(body, '$.timestamp') AS k_timestamp,
    json_type(body, '$.location') AS k_location
  FROM bodies
)"""

_NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _checked(strict: bool) -> str:
    required = ["transaction_id", "user_id", "amount", "timestamp", "device_id"]
    texts = ["transaction_id", "user_id", "device_id", "merchant_category", "timestamp", "location"]
    parts = ["CASE WHEN NOT is_object THEN 'type:body' END"]
    parts += [f"CASE WHEN is_object AND k_{f} IS NULL THEN 'missing:{f}' END" for f in required]
    parts += [f"CASE WHEN is_object AND k_{f} <> 'VARCHAR' THEN 'type:{f}' END" for f in texts]
    parts += [
        f"CASE WHEN is_object AND k_amount IS NOT NULL AND k_amount NOT IN {_NUMBERS} THEN 'type:amount' END",
        f"CASE WHEN k_amount IN {_NUMBERS} AND CAST(json_extract(body, '$.amount') AS DOUBLE) < 0 "
        "THEN 'minimum:amount' END",
    ]
    if strict:
        parts.append("CASE WHEN k_timestamp = 'VARCHAR' AND "
                     "TRY_CAST(json_extract_string(body, '$.timestamp') AS TIMESTAMP) IS NULL "
                     "THEN 'format:timestamp' END")
    listed = ", ".join(parts)
    return f"""
checked AS (
  SELECT *, CASE WHEN readable THEN coalesce(concat_ws(',', {listed}), '') ELSE 'unparseable' END AS violations
  FROM kinds
)"""


BLACKLIST = """
listed AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE user_id % 37 = 0
  UNION
  SELECT DISTINCT 'device_' || user_id || '_3' FROM events WHERE user_id % 10 = 1
)"""

GATE = """
passed AS (
  SELECT json_extract_string(body, '$.transaction_id') AS transaction_id,
         json_extract_string(body, '$.user_id') AS user_id, json_extract_string(body, '$.device_id') AS device_id,
         CAST(json_extract(body, '$.amount') AS DOUBLE) AS amount,
         coalesce(TRY_CAST(json_extract_string(body, '$.timestamp') AS TIMESTAMP), TIMESTAMP '1970-01-01') AS ts
  FROM checked WHERE violations = ''
),
gate AS (
  SELECT *, user_id IN (SELECT value FROM listed) AS user_listed, device_id IN (SELECT value FROM listed)
    AS device_listed FROM passed
),
events0 AS (
  SELECT *, CASE WHEN user_listed OR device_listed THEN 'Quarantine' ELSE 'Allow' END AS verdict,
    CASE WHEN user_listed THEN 'user_id_blacklist' WHEN device_listed THEN 'device_id_blacklist' ELSE 'passed' END
    AS reason FROM gate
)"""


def _offset(value: str, i: str) -> str:
    digest = f"sha256({value} || chr(0) || chr(CAST({i} AS INTEGER)))"
    chunks = f"list_transform(range(8), lambda j: CAST('0x' || substr({digest}, CAST(8 * j + 1 AS BIGINT), 8) AS BIGINT))"
    return f"list_reduce({chunks}, lambda a, c: (a * 4294967296 + c) % 2000000, CAST(0 AS BIGINT))"


def _hopping(name: str, slide: str, count: int, aggregates: str) -> str:
    step = f"INTERVAL {slide}"
    return f"""
{name} AS (
  SELECT user_id, time_bucket({step}, ts) - CAST(i AS INTEGER) * {step} AS window_start, {aggregates}
  FROM tx, generate_series(0, {count - 1}) g(i) GROUP BY 1, 2
)"""


STATS = _hopping("stats", "1 HOUR", 24, "avg(amount) AS mean_amount, stddev_samp(amount) AS stddev_amount")
HOURLY = _hopping("hourly", "5 MINUTE", 12, "count(*) AS tx_count")
MINUTELY = _hopping("minutely", "10 SECOND", 6, "count(*) AS tx_count_1min")


def _joined(name: str, slide: str, count: int) -> str:
    step = f"INTERVAL {slide}"
    return f"""
joined AS (
  SELECT t.transaction_id, t.amount, w.* FROM (
    SELECT *, time_bucket({step}, ts) - CAST(i AS INTEGER) * {step} AS ws FROM tx, generate_series(0, {count - 1}) g(i)
  ) t LEFT JOIN {name} w ON w.user_id = t.user_id AND w.window_start = t.ws
)"""


SCORES = f"""
scores AS (
  SELECT transaction_id, 'heavy' AS model_type, heavy_score_clamped AS score, CAST(is_fraud AS INTEGER) AS label FROM l2
  UNION ALL
  SELECT transaction_id, 'fast', score, CAST(is_fraud AS INTEGER) FROM l1
)"""

HASH42 = "CAST('0x' || substr(md5(transaction_id || '#42'), 1, 8) AS BIGINT)"

FOLDS = f"""
folds AS (
  SELECT transaction_id, CAST(is_fraud AS INTEGER) AS label,
    CAST((row_number() OVER (PARTITION BY is_fraud ORDER BY {HASH42}, transaction_id) - 1) % 5 AS INTEGER) AS fold
  FROM tx
)"""


def _auc(source: str, *keys: str) -> str:
    """Rank-sum with mid-ranks per group."""
    group = ", ".join(keys)
    partition = f"PARTITION BY {group}" if keys else ""
    same = ", ".join([*keys, "score"])
    prefix = f"{group}, " if keys else ""
    tail = f"GROUP BY {group}" if keys else ""
    return f"""
  SELECT {prefix}(sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2e0)
         / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS roc_auc
  FROM (SELECT *, rank() OVER ({partition} ORDER BY score)
                  + (count(*) OVER (PARTITION BY {same}) - 1) / 2e0 AS r FROM {source}) {tail}"""


FOLD_AUC = f"""
fold_scores AS (
  {_auc('(SELECT s.*, fold FROM scores s JOIN folds USING (transaction_id))', 'model_type', 'fold')}
)"""

LOG = """
log AS (
  SELECT event_type <> 'error' AS success,
         CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 500 ELSE 422 END ELSE 200 END AS status_code,
         value * 10e0 AS response_time, CASE WHEN event_type = 'error' AND value > 100 THEN 'timeout' END AS error, ts
  FROM events
),
span AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM log),
sorted AS (SELECT list_sort(list(response_time)) AS v, count(*) AS n FROM log WHERE success)"""


def _keywords(table: str, keys: str) -> str:
    words = ["password", "secret", "token", "key", "credential"]
    found = ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in words)
    return (f"SELECT {keys}, coalesce(concat_ws(',', {found}), '') AS keywords, "
            f"coalesce(concat_ws(',', {found}), '') <> '' AS exposed FROM {table}")


GRAPH = f"""
graph AS (
  SELECT transaction_id, CAST(json_extract(m, '$.amount') AS DOUBLE) AS amount,
    CASE WHEN json_extract(m, '$.graph_features') IS NULL THEN 0e0
         ELSE TRY_CAST(json_extract_string(m, '$.graph_features.neighbor_count') AS DOUBLE) END AS neighbor_count,
    CASE WHEN json_extract(m, '$.graph_features') IS NULL THEN 0e0
         ELSE TRY_CAST(json_extract_string(m, '$.graph_features.graph_score') AS DOUBLE) END AS graph_score
  FROM (SELECT transaction_id, {GRAPH_MESSAGE.replace('AS STRING', 'AS VARCHAR')} AS m FROM tx)
)"""

PROFILE = """
habits AS (
  SELECT user_id, kind, value, count(*) AS uses FROM (
    SELECT user_id, 'location' AS kind, location AS value FROM tx
    UNION ALL SELECT user_id, 'device_id', device_id FROM tx
    UNION ALL SELECT user_id, 'merchant_category', merchant_category FROM tx
  ) GROUP BY ALL
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY uses DESC, value) AS place FROM habits
  QUALIFY place <= 3
),
profile AS (
  SELECT user_id, min(amount) AS lowest_amount, max(amount) AS highest_amount, count(*) AS transaction_count,
         max(ts) AS last_transaction_time, bool_or(is_fraud) AS is_fraudster,
         (SELECT value FROM top WHERE top.user_id = tx.user_id AND kind = 'location' AND place = 1) AS home_location,
         (SELECT value FROM top WHERE top.user_id = tx.user_id AND kind = 'device_id' AND place = 1) AS device_id,
         (SELECT string_agg(value, ',' ORDER BY place) FROM top
          WHERE top.user_id = tx.user_id AND kind = 'merchant_category') AS preferred_categories
  FROM tx GROUP BY user_id
)"""

FEATURED, LEVELS = (TX, FEAT), (TX, FEAT, L1, L2)

ORACLES = {
    "parse_transactions": _with(TX, select="""
SELECT CASE WHEN k % 13 <> 0 THEN transaction_id END AS transaction_id, CASE WHEN k % 13 <> 0 THEN user_id END AS user_id,
  CASE WHEN k % 13 <> 0 THEN amount END AS amount, CASE WHEN k % 13 <> 0 THEN merchant_category END AS merchant_category,
  CASE WHEN k % 13 <> 0 THEN ts END AS "timestamp", CASE WHEN k % 13 <> 0 THEN location END AS location,
  CASE WHEN k % 13 <> 0 THEN device_id END AS device_id, CASE WHEN k % 13 <> 0 THEN is_fraud END AS is_fraud
FROM tx"""),
    "drop_undecodable": _with(TX, select="SELECT transaction_id, user_id FROM tx WHERE k % 13 <> 0 AND k % 17 <> 0"),
    "time_features": _with(TX, select="""
SELECT transaction_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM tx"""),
    "to_value": _with(TX, select="SELECT transaction_id, amount, is_fraud FROM tx"),

    "user_stats_24h": _with(TX, STATS, select="""
SELECT user_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, round(mean_amount, 6) AS mean_amount,
  round(stddev_amount, 6) AS stddev_amount FROM stats"""),
    "tx_count_1h": _with(TX, HOURLY, select="""
SELECT user_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, tx_count FROM hourly"""),
    "tx_count_1min": _with(TX, MINUTELY, select="""
SELECT user_id, window_start, window_start + INTERVAL 1 MINUTE AS window_end, tx_count_1min FROM minutely"""),
    "join_window_stats": _with(TX, STATS, _joined("stats", "1 HOUR", 24), select="""
SELECT transaction_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, round(mean_amount, 6) AS mean_amount,
  round(stddev_amount, 6) AS stddev_amount FROM joined"""),
    "join_hourly_counts": _with(TX, HOURLY, _joined("hourly", "5 MINUTE", 12), select="""
SELECT transaction_id, window_start, tx_count FROM joined"""),
    "join_minute_counts": _with(TX, MINUTELY, _joined("minutely", "10 SECOND", 6), select="""
SELECT transaction_id, window_start, tx_count_1min FROM joined"""),
    "amount_zscore": _with(TX, STATS, _joined("stats", "1 HOUR", 24), select=f"""
SELECT transaction_id, window_start, round({ZSCORE}, 6) AS amount_zscore FROM joined"""),
    "default_count": _with(TX, select="""
SELECT transaction_id, count(*) OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts)) AS transactions_last_hour
FROM tx"""),
    "hopping_features": _with(
        TX, STATS, HOURLY, MINUTELY,
        _joined("stats", "1 HOUR", 24).replace("joined AS", "with_stats AS"),
        _joined("hourly", "5 MINUTE", 12).replace("joined AS", "with_hours AS"),
        _joined("minutely", "10 SECOND", 6).replace("joined AS", "with_minutes AS"), select=f"""
SELECT transaction_id, count(*) AS feature_rows, round(avg({ZSCORE.replace('amount -', 's.amount -')}), 6) AS amount_zscore,
  CAST(sum(h.tx_count) AS BIGINT) AS transactions_last_hour, CAST(sum(m.tx_count_1min) AS BIGINT) AS tx_count_1min,
  max(h.tx_count * m.tx_count_1min) AS highest_product
FROM with_stats s JOIN with_hours h USING (transaction_id) JOIN with_minutes m USING (transaction_id)
GROUP BY transaction_id"""),
    "trailing_features": _with(*FEATURED, select=f"""
SELECT transaction_id, round(mean_amount, 6) AS mean_amount, round(stddev_amount, 6) AS stddev_amount,
  round({ZSCORE}, 6) AS amount_zscore, transactions_last_hour, tx_count_1min FROM feat"""),
    "enriched_projection": _with(*FEATURED, select=f"""
SELECT transaction_id, user_id, amount, merchant_category, ts AS "timestamp", location, device_id, is_fraud,
  CAST(hour_of_day AS INTEGER) AS hour_of_day, CAST(day_of_week AS INTEGER) AS day_of_week,
  round({ZSCORE}, 6) AS amount_zscore, transactions_last_hour, tx_count_1min FROM feat"""),
    "upsert_hot_features": _with(*FEATURED, select="""
SELECT user_id, arg_max(tx_count_1min, ts) AS tx_count_1min, max(ts) AS updated_at FROM feat GROUP BY user_id"""),
    "lookup_hot_feature": _with(*FEATURED, select="""
SELECT t.transaction_id, CASE WHEN epoch_us(t.ts) - epoch_us(f.at) < 120000000 THEN f.tx_count_1min ELSE 0 END
  AS hot_tx_count_1min
FROM tx t ASOF LEFT JOIN (SELECT user_id, ts + INTERVAL 30 SECOND AS at, tx_count_1min FROM feat) f
  ON t.user_id = f.user_id AND t.ts >= f.at"""),

    "validate_schema": _with(TX, BODIES, _checked(False), select="SELECT message_id, readable, violations FROM checked"),
    "validate_schema_strict": _with(TX, BODIES, _checked(True), select="SELECT message_id, violations FROM checked"),
    "reject_bad_json": _with(TX, BODIES, select="SELECT message_id, value FROM bodies WHERE NOT readable"),
    "rejected_bodies": _with(TX, BODIES, _checked(False), select="""
SELECT message_id, violations FROM checked WHERE readable AND violations <> ''"""),
    "blacklist_match": _with(TX, BLACKLIST, select="""
SELECT transaction_id, user_id IN (SELECT value FROM listed) AS user_listed,
  device_id IN (SELECT value FROM listed) AS device_listed FROM tx"""),
    "level0_verdict": _with(TX, BLACKLIST, select="""
SELECT transaction_id, user_id, device_id,
  CASE WHEN u OR v THEN 'Quarantine' ELSE 'Allow' END AS verdict,
  CASE WHEN u THEN 'user_id_blacklist' WHEN v THEN 'device_id_blacklist' ELSE 'passed' END AS reason
FROM (SELECT *, user_id IN (SELECT value FROM listed) AS u, device_id IN (SELECT value FROM listed) AS v FROM tx)"""),
    "gatekeeping_events": _with(TX, BODIES, _checked(False), BLACKLIST, GATE, select=f"""
SELECT 0 AS level, transaction_id, user_id, device_id, verdict, reason, {ISO} AS "timestamp", amount FROM events0"""),
    "route_l0_quarantined": _with(TX, BODIES, _checked(False), BLACKLIST, GATE, select="""
SELECT transaction_id, user_id, device_id, reason FROM events0 WHERE verdict = 'Quarantine'"""),

    "bloom_offsets": _with(TX, select=f"""
SELECT transaction_id, CAST(i AS INTEGER) AS hash, {_offset('device_id', 'i')} AS "offset"
FROM tx, generate_series(0, 4) g(i)"""),
    "bloom_build": _with(BLACKLIST, select=f"""
SELECT DISTINCT {_offset('value', 'i')} AS "offset" FROM listed, generate_series(0, 4) g(i)"""),
    "bloom_contains": _with(TX, BLACKLIST, f"""
bits AS (SELECT DISTINCT {_offset('value', 'i')} AS b FROM listed, generate_series(0, 4) g(i)),
probes AS (
  SELECT v, bool_and(b IS NOT NULL) AS hit FROM (
    SELECT v, {_offset('v', 'i')} AS o FROM
      (SELECT user_id AS v FROM tx UNION SELECT device_id FROM tx), generate_series(0, 4) g(i)
  ) LEFT JOIN bits ON b = o GROUP BY v
)""", select="""
SELECT transaction_id, u.hit AS user_listed, d.hit AS device_listed
FROM tx JOIN probes u ON u.v = tx.user_id JOIN probes d ON d.v = tx.device_id"""),

    "fast_score": _with(TX, FEAT, L1, select="SELECT transaction_id, tx_count_1min, score FROM l1"),
    "policy_decision": _with(TX, FEAT, L1, select="""
SELECT verdict, count(*) AS transactions, CAST(sum(tx_count_1min) AS BIGINT) AS tx_count_1min FROM l1 GROUP BY verdict"""),
    "l1_actions": _with(TX, FEAT, L1, select=f"""
SELECT transaction_id, user_id, device_id, amount, {ISO} AS "timestamp", score, verdict, 1 AS detection_level FROM l1"""),
    "route_quarantined": _with(TX, FEAT, L1, select=f"""
SELECT transaction_id, user_id, device_id, amount, {ISO} AS "timestamp", score, verdict FROM l1
WHERE verdict = 'Quarantine'"""),
    "heavy_payload": _with(*FEATURED, select=f"""
SELECT transaction_id, user_id, device_id, amount, {ISO} AS "timestamp", transactions_last_hour AS session_length,
  0 AS recent_amounts, 0 AS neighbor_count, 0e0 AS graph_score FROM feat"""),
    "extract_graph_features": _with(TX, GRAPH, select="SELECT transaction_id, neighbor_count, graph_score FROM graph"),
    "heavy_score": _with(TX, GRAPH, f"""
heavy AS (
  SELECT *, neighbor_count / 10e0 + graph_score + CASE WHEN amount > 0 THEN amount / 10000e0 ELSE 0e0 END AS heavy_score
  FROM graph
),
cut AS (SELECT *, {_clamp('heavy_score')} AS c FROM heavy)""", select=f"""
SELECT transaction_id, amount, round(heavy_score, 6) AS heavy_score, round(c, 6) AS heavy_score_clamped,
  {_policy('c')} AS verdict FROM cut"""),
    "level2_inputs": _with(TX, FEAT, L1, BODIES, _checked(False), BLACKLIST, GATE, f"""
sent AS (
  SELECT transaction_id, amount FROM tx
  UNION ALL SELECT transaction_id, amount FROM l1 WHERE verdict = 'Quarantine'
  UNION ALL SELECT transaction_id, amount FROM events0 WHERE verdict = 'Quarantine'
),
cut AS (
  SELECT transaction_id, amount, {_clamp('h')} AS c FROM
    (SELECT *, 0 / 10e0 + 0e0 + CASE WHEN amount > 0 THEN amount / 10000e0 ELSE 0e0 END AS h FROM sent)
)""", select=f"""
SELECT transaction_id, amount, c AS heavy_score_clamped, {_policy('c')} AS verdict FROM cut"""),

    "decisions_per_message": _with(*LEVELS, PER_MESSAGE, select="""
SELECT transaction_id, final_verdict, reason, s1 AS level1_score, l1v AS level1_verdict, s2 AS level2_score,
  l2v AS level2_verdict FROM made"""),
    "correlate_levels": _with(*LEVELS, ROUTED, select="""
SELECT transaction_id, score AS level1_score, l1v AS level1_verdict, heavy_score_clamped AS level2_score,
  l2v AS level2_verdict FROM paired"""),
    "apply_business_rules": _with(*LEVELS, ROUTED, select="SELECT transaction_id, final_verdict, reason FROM decided"),
    "decisions_combined": _with(*LEVELS, COMBINED, select="""
SELECT transaction_id, final_verdict, reason, score AS level1_score, l1v AS level1_verdict,
  heavy_score_clamped AS level2_score, l2v AS level2_verdict FROM decided"""),
    "final_decision": _with(*LEVELS, COMBINED, select=f"""
SELECT transaction_id, final_verdict, reason, {ISO} AS "timestamp", amount FROM decided"""),
    "only_escalated": _with(*LEVELS, COMBINED, select="""
SELECT transaction_id, reason FROM decided WHERE final_verdict = 'Escalate'"""),
    "level_scores": _with(*LEVELS, PER_MESSAGE, select="""
SELECT transaction_id, reason, s1 AS level1_score, nullif(s2, 0) AS level2_score FROM made"""),
    "detection_path": _with(*LEVELS, ROUTED, select="""
SELECT transaction_id, score AS level1_score, heavy_score_clamped AS level2_score FROM decided"""),
    "open_reviews": _with(*LEVELS, COMBINED, REVIEWS, select="SELECT * FROM review"),

    "pending_reviews": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, SNAPSHOT, select="""
SELECT id, transaction_id, user_id, device_id, amount, level1_score, level2_score, created_at FROM snapshot
WHERE status = 'pending' ORDER BY created_at"""),
    "valid_judgements": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, select="""
SELECT * FROM judgement WHERE verdict IN ('Allow', 'Block', 'Escalate')"""),
    "match_reviews": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, select="""
SELECT * FROM judgement WHERE review_id IN (SELECT id FROM review)"""),
    "unmatched_judgements": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, select="""
SELECT review_id, verdict FROM judgement WHERE review_id NOT IN (SELECT id FROM review)"""),
    "append_feedback": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, select="SELECT * FROM feedback"),
    "judge_reviews": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, SNAPSHOT, select="""
SELECT id, transaction_id, status, created_at, updated_at FROM snapshot"""),
    "labelled_reviews": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, LABELLED, select="SELECT * EXCLUDE (label) FROM labelled"),
    "training_features": _with(*LEVELS, PER_MESSAGE, REVIEWS_PER_MESSAGE, JUDGED, LABELLED, select="""
SELECT review_id, amount, level1_score, level2_score, label FROM labelled"""),
    "drop_incomplete": _with(*LEVELS, ROUTED, REVIEWS, JUDGED, LABELLED, select="""
SELECT review_id, amount, level1_score, level2_score, label FROM labelled
WHERE amount IS NOT NULL AND level1_score IS NOT NULL AND level2_score IS NOT NULL"""),
    "extract_features": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, LABELLED, select="""
SELECT review_id, amount, level1_score, level2_score, label FROM labelled
WHERE amount IS NOT NULL AND level1_score IS NOT NULL AND level2_score IS NOT NULL"""),

    "detection_level": _with(*LEVELS, ROUTED, select="""
SELECT transaction_id, CASE WHEN l2v IS NOT NULL THEN 2 ELSE 1 END AS detection_level FROM decided"""),
    "recent_alerts": _with(*LEVELS, ROUTED, select="""
SELECT transaction_id, final_verdict, reason, ts AS created_at, CASE WHEN l2v IS NOT NULL THEN 2 ELSE 1 END
  AS detection_level FROM decided ORDER BY ts DESC LIMIT 100"""),
    "latest_per_transaction": _with(*LEVELS, PER_MESSAGE, select="""
SELECT transaction_id, final_verdict, reason, ts + INTERVAL 1 MINUTE AS created_at, 2 AS detection_level
FROM made WHERE l2v IS NOT NULL"""),
    "alerts_by_level": _with(*LEVELS, ROUTED, select="""
SELECT transaction_id, final_verdict, reason, ts AS created_at, 2 AS detection_level FROM decided
WHERE l2v IS NOT NULL"""),
    "alert_stats": _with(*LEVELS, ROUTED, select="""
SELECT count(*) AS total, count(l2v) AS high_risk, count(*) FILTER (WHERE l2v IS NULL) AS suspicious,
  CAST(0 AS BIGINT) AS safe FROM decided"""),
    "alert_view": _with(*LEVELS, ROUTED, select="""
SELECT transaction_id AS id, substr(transaction_id, 1, 18) || '...' AS short_id,
  CASE WHEN l2v IS NOT NULL THEN 'Fraud' ELSE 'Suspicious' END AS status,
  CASE WHEN l2v IS NOT NULL THEN '0.98' ELSE '0.65' END AS score, reason FROM decided"""),
    "total_count": "SELECT count(*) AS total FROM events",
    "page": _with(TX, select="""
SELECT transaction_id, user_id, amount, merchant_category, ts AS "timestamp", location, device_id, is_fraud,
  (SELECT count(*) FROM tx) AS total, 3 AS page, 25 AS page_size FROM tx ORDER BY ts, transaction_id LIMIT 25 OFFSET 50"""),

    "latency_report": _with(LOG, select="""
SELECT count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful,
  count(*) FILTER (WHERE NOT success) AS failed,
  round(count(*) FILTER (WHERE success) * 100e0 / count(*), 6) AS success_pct,
  round(count(*) FILTER (WHERE NOT success) * 100e0 / count(*), 6) AS failed_pct,
  round(any_value(seconds), 6) AS duration_seconds, round(count(*) / any_value(seconds), 6) AS throughput,
  min(response_time) FILTER (WHERE success) AS min, max(response_time) FILTER (WHERE success) AS max,
  round(avg(response_time) FILTER (WHERE success), 6) AS mean,
  round(stddev_samp(response_time) FILTER (WHERE success), 6) AS stdev,
  round(median(response_time) FILTER (WHERE success), 6) AS median,
  any_value(v[CAST(floor(n * 0.50e0) AS BIGINT) + 1]) AS p50, any_value(v[CAST(floor(n * 0.95e0) AS BIGINT) + 1]) AS p95,
  any_value(v[CAST(floor(n * 0.99e0) AS BIGINT) + 1]) AS p99
FROM log, span, sorted"""),
    "error_breakdown": _with(LOG, select="""
SELECT coalesce(error, 'HTTP ' || status_code) AS error, count(*) AS occurrences FROM log WHERE NOT success
GROUP BY 1 ORDER BY 2 DESC, 1"""),
    "sla_check": _with(LOG, """
m AS (
  SELECT count(*) FILTER (WHERE success) * 100e0 / count(*) AS s, avg(response_time) FILTER (WHERE success) AS t,
    count(*) / any_value(seconds) AS r FROM log, span
)""", select="""
SELECT 'Success Rate' AS criterion, round(s, 6) AS value, '>= 95%' AS target, s >= 95 AS passed FROM m
UNION ALL SELECT 'Average Response Time', round(t, 6), '< 1000ms', t < 1000 FROM m
UNION ALL SELECT 'Throughput', round(r, 6), '> 10 req/sec', r > 10 FROM m"""),
    "running_fraud_rate": _with(TX, """
counted AS (
  SELECT row_number() OVER w AS sent, CAST(sum(CAST(is_fraud AS BIGINT)) OVER w AS BIGINT) AS fraudulent
  FROM tx WINDOW w AS (ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING)
)""", select="""
SELECT sent, fraudulent, round(fraudulent * 100e0 / sent, 6) AS fraud_rate FROM counted WHERE sent % 100 = 0"""),
    "sensitive_keyword_scan": _keywords("documents", "doc_id"),
    "sensitive_keyword_scan_conversations": _keywords("conversations", "conv_id, turn"),

    "user_profile": _with(TX, PROFILE, select="SELECT * FROM profile"),
    "previous_location": _with(TX, select="""
SELECT transaction_id, location, lag(location) OVER (PARTITION BY user_id ORDER BY ts, transaction_id)
  AS previous_location FROM tx"""),
    "fraud_pattern_flags": _with(TX, FEAT, PROFILE, """
seen AS (
  SELECT *, lag(location) OVER u AS previous, row_number() OVER u AS nth,
    row_number() OVER (PARTITION BY user_id, device_id ORDER BY ts, transaction_id) AS device_nth
  FROM feat WINDOW u AS (PARTITION BY user_id ORDER BY ts, transaction_id)
)""", select="""
SELECT transaction_id, amount >= 1000 AS high_amount, tx_count_1min >= 2 AS rapid_fire,
  coalesce(location <> previous, false) AS location_jump, device_nth = 1 AND nth > 1 AS new_device,
  amount >= 800 AND NOT list_contains(string_split(p.preferred_categories, ','), merchant_category) AS unusual_category
FROM seen JOIN profile p USING (user_id)"""),

    "roc_auc": _with(*LEVELS, SCORES, "heavy AS (SELECT * FROM scores WHERE model_type = 'heavy'),\nauc AS ("
                     + _auc("heavy") + ")", select="SELECT round(roc_auc, 6) AS roc_auc FROM auc"),
    "pr_auc": _with(*LEVELS, SCORES, """
grouped AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores WHERE model_type = 'heavy' GROUP BY score
),
cumulative AS (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM grouped
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
),
points AS (
  SELECT score, CAST(tp AS DOUBLE) / p AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS "precision" FROM cumulative
),
steps AS (
  SELECT recall - lag(recall, 1, 0e0) OVER w AS step, "precision" + lag("precision", 1, 1e0) OVER w AS height
  FROM points WINDOW w AS (ORDER BY score DESC)
)""", select="SELECT round(sum(step * height / 2), 6) AS pr_auc FROM steps"),
    "split_holdout": _with(TX, select=f"""
SELECT transaction_id, CAST(is_fraud AS INTEGER) AS label, {HASH42} % 1000000 < 200000 AS holdout FROM tx"""),
    "stratified_folds": _with(TX, FOLDS, select="SELECT transaction_id, label, fold FROM folds"),
    "cv_mean": _with(*LEVELS, SCORES, FOLDS, FOLD_AUC, select="""
SELECT model_type, round(avg(roc_auc), 6) AS cv_auc FROM fold_scores GROUP BY model_type"""),
    "best_model": _with(*LEVELS, SCORES, FOLDS, FOLD_AUC, select="""
SELECT model_type, round(avg(roc_auc), 6) AS cv_auc, CAST(model_type = 'heavy' AS INTEGER) AS run_order
FROM fold_scores GROUP BY model_type HAVING avg(roc_auc) > 0 ORDER BY avg(roc_auc) DESC, run_order LIMIT 1"""),
    "latest_run": _with(*LEVELS, SCORES, FOLDS, FOLD_AUC, select="""
SELECT model_type, round(roc_auc, 6) AS roc_auc, fold,
  TIMESTAMP '1970-01-01' + fold * INTERVAL 1 MINUTE AS started_at
FROM fold_scores WHERE model_type = 'fast' ORDER BY fold DESC LIMIT 1"""),
}

ORACLES |= {
    "level2_inputs_as_sent": ORACLES["level2_inputs"].replace(
        "SELECT transaction_id, amount FROM events0", "SELECT transaction_id, CAST(NULL AS DOUBLE) FROM events0"),
    "invalid_judgements": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, select="""
SELECT * FROM judgement WHERE coalesce(verdict, '') NOT IN ('Allow', 'Block', 'Escalate')"""),
    "alert_detail": f"""{ORACLES['latest_per_transaction']}
  AND transaction_id = (SELECT min(transaction_id) FROM made)""",
}

# --- streams: the closing row lets every window out, so these are the batch results ----------------------------

ORACLES |= {
    "stream_user_stats_24h": _with(TX, STATS, select="""
SELECT user_id, window_start, round(mean_amount, 6) AS mean_amount, round(stddev_amount, 6) AS stddev_amount FROM stats"""),
    "stream_tx_count_1h": _with(TX, HOURLY, select="SELECT * FROM hourly"),
    "stream_tx_count_1min": _with(TX, MINUTELY, select="SELECT * FROM minutely"),
    "stream_join_window_stats": _with(TX, STATS, _joined("stats", "1 HOUR", 24), select=f"""
SELECT transaction_id, window_start, round({ZSCORE}, 6) AS amount_zscore FROM joined"""),
    "stream_join_hourly_counts": _with(TX, HOURLY, _joined("hourly", "5 MINUTE", 12), select=f"""
SELECT transaction_id, window_start, tx_count FROM joined"""),
    "stream_join_minute_counts": _with(TX, MINUTELY, _joined("minutely", "10 SECOND", 6), select=f"""
SELECT transaction_id, window_start, tx_count_1min FROM joined"""),
    "stream_trailing_features": ORACLES["trailing_features"],
    "stream_hot_features": ORACLES["upsert_hot_features"],
    "stream_side_effects": _with(*FEATURED, select=f"""
SELECT transaction_id, user_id, device_id, amount, {ISO} AS "timestamp", transactions_last_hour AS session_length,
  0 AS neighbor_count, 0e0 AS graph_score FROM feat"""),
    "stream_preprocessed": _with(*FEATURED, select=f"""
SELECT transaction_id, amount, CAST(hour_of_day AS INTEGER) AS hour_of_day, CAST(day_of_week AS INTEGER) AS day_of_week,
  round({ZSCORE}, 6) AS amount_zscore, transactions_last_hour, tx_count_1min FROM feat"""),
    "stream_level0": _with(TX, BODIES, _checked(False), BLACKLIST, GATE, select="""
SELECT transaction_id, user_id, device_id, verdict, reason FROM events0"""),
    "stream_level1": _with(*FEATURED, """
hot AS (
  SELECT transaction_id, amount,
    CASE WHEN ts = max(ts) OVER (PARTITION BY user_id) THEN tx_count_1min ELSE 0 END AS n FROM feat
),
scored AS (
  SELECT *, least(1e0, n / 10e0 + CASE WHEN amount > 1000 THEN 0.5e0 ELSE 0e0 END) AS score FROM hot
)""", select=f"SELECT transaction_id, amount, score, {_policy('score')} AS verdict FROM scored"),
    "stream_level2": ORACLES["heavy_score"].replace("round(heavy_score, 6) AS heavy_score, ", ""),
    "stream_decisions": _with(*LEVELS, PER_MESSAGE, select="""
SELECT transaction_id, final_verdict, reason, ts AS created_at, s1 AS level1_score, s2 AS level2_score FROM made"""),
    "stream_final_decisions": _with(*LEVELS, PER_MESSAGE, select=f"""
SELECT transaction_id, final_verdict, reason, {ISO} AS "timestamp" FROM made"""),
    "stream_open_reviews": _with(*LEVELS, PER_MESSAGE, REVIEWS_PER_MESSAGE, select="SELECT * FROM review"),
    "read_topic": _with(TX, select="""
SELECT transaction_id, user_id, amount, merchant_category, ts AS "timestamp", location, device_id, is_fraud,
  CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM tx"""),
    "read_ingest_json": _with(TX, BODIES, _checked(False), select="""
SELECT violations, count(*) AS bodies FROM checked GROUP BY violations"""),
    "register_model": "SELECT 'fraud_detector' AS name, CAST(1 AS INTEGER) AS version, 'Staging' AS stage",
    "production_model": """
SELECT 'fraud_detector' AS name, CAST(1 AS INTEGER) AS version, 'Production' AS stage, false AS better""",
    "write_features": ORACLES["extract_features"],
    "read_table": ORACLES["labelled_reviews"],
    "write_feedback_topic": _with(*LEVELS, COMBINED, REVIEWS, JUDGED, select="""
SELECT review_id, transaction_id, operator_id, verdict, comment FROM feedback"""),
}
