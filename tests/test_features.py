import datetime as dt
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import hopping, parse, profiles, trailing
from ledgerlens.sources import topics

NOW = dt.datetime(2024, 1, 10, 12, 0, 0)
SMOKE = [("t1", "u1", 10.0, 120), ("t2", "u1", 200.0, 90), ("t3", "u1", 20.0, 20), ("t4", "u2", 5.0, 40), ("t5", "u2", 7.0, 10)]


@pytest.fixture
def smoke(spark):
    rows = [json.dumps({
        "transaction_id": t, "user_id": u, "amount": a, "merchant_category": "groceries",
        "timestamp": (NOW - dt.timedelta(minutes=m)).isoformat(), "location": "US", "device_id": "device-1",
        "is_fraud": False,
    }) for t, u, a, m in SMOKE]
    return parse.time_features(parse.parse_transactions(topics.from_json_rows(spark, rows)))


def test_smoke_trailing(smoke):
    rows = {r["transaction_id"]: r for r in trailing.enriched_projection(trailing.trailing_features(smoke)).collect()}
    assert [rows[f"t{i}"]["transactions_last_hour"] for i in range(1, 6)] == [1, 2, 1, 1, 2]
    assert all(r["tx_count_1min"] == 1 for r in rows.values())
    assert rows["t1"]["amount_zscore"] == rows["t4"]["amount_zscore"] == 0.0
    assert (rows["t1"]["hour_of_day"], rows["t1"]["day_of_week"]) == (10, 2)


def test_smoke_hopping_chain(smoke):
    assert hopping.join_window_stats(smoke).count() == 5 * 24
    assert hopping.join_hourly_counts(smoke).count() == 5 * 12
    assert hopping.join_minute_counts(smoke).count() == 5 * 6
    chain = hopping.hopping_features(smoke)
    assert chain.select(*trailing.ENRICHED).count() == 5 * 24 * 12 * 6


def test_hopping_chain_equals_brute_force(smoke):
    def windows(at, size, slide):
        start = math.floor(at / slide) * slide
        return [start - i * slide for i in range(size // slide)]

    at = {t: (NOW - dt.timedelta(minutes=m) - dt.datetime(1970, 1, 1)).total_seconds() for t, _, _, m in SMOKE}
    expected = {}
    for t, u, a, _ in SMOKE:
        def inside(w, size):
            return [x for x, v, _, _ in SMOKE if v == u and w <= at[x] < w + size]

        amounts = {x: b for x, _, b, _ in SMOKE}
        for w in windows(at[t], 86400, 3600):
            values = [amounts[x] for x in inside(w, 86400)]
            spread = statistics.stdev(values) if len(values) > 1 else 0
            z = round((a - statistics.mean(values)) / spread, 6) if spread else 0.0
            for h in windows(at[t], 3600, 300):
                for m in windows(at[t], 60, 10):
                    row = (t, z, len(inside(h, 3600)), len(inside(m, 60)))
                    expected[row] = expected.get(row, 0) + 1
    got = hopping.hopping_features(smoke).groupBy(
        "transaction_id", F.round("amount_zscore", 6).alias("z"), "transactions_last_hour", "tx_count_1min"
    ).count().collect()
    assert {tuple(r)[:4]: r["count"] for r in got} == expected


def test_hopping_totals_add_up_the_chain_and_move_each_transaction_once(spark):
    df = random_transactions(spark, 60, 5)
    df = df.unionByName(df.filter("transaction_id = '1'"))
    names = ["transaction_id", "feature_rows", "z", "transactions_last_hour", "tx_count_1min", "highest_product"]
    expected = hopping.hopping_features(df).groupBy("transaction_id").agg(
        F.count("*").alias("feature_rows"), F.round(F.avg("amount_zscore"), 6).alias("z"),
        F.sum("transactions_last_hour").alias("transactions_last_hour"), F.sum("tx_count_1min").alias("tx_count_1min"),
        F.max(F.col("transactions_last_hour") * F.col("tx_count_1min")).alias("highest_product"))
    totals = hopping.hopping_totals(df)
    got = totals.withColumn("z", F.round("amount_zscore", 6)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected.select(*names).collect()))
    text = hopping.hopping_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert max(i for i, line in enumerate(text.splitlines()) if "Generate explode" in line) < min(
        i for i, line in enumerate(text.splitlines()) if "Join " in line)  # unfolded above all joins


def random_transactions(spark, n, seed):
    """Few users, clustered times with exact ties, equal amounts, missing users, times and amounts."""
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = base + dt.timedelta(seconds=rng.choice([0, 60, 3600, 86400, 86401, 90000]) + rng.randrange(0, 200),
                                 microseconds=rng.choice([0, 1, 999999]))
        rows.append((
            str(i), rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([5.0, 5.0, 1e6 + 0.25, 7.5, None]),
            rng.choice("xyz"), rng.choice([at] * 20 + [None]), rng.choice("NS"), rng.choice("12"), False,
        ))
    return spark.createDataFrame(rows, """transaction_id string, user_id string, amount double, merchant_category string,
        timestamp timestamp, location string, device_id string, is_fraud boolean""")


def test_trailing_features_equal_brute_force(spark):
    df = random_transactions(spark, 400, 7).cache()
    rows = df.collect()
    got = {r["transaction_id"]: r for r in trailing.trailing_features(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["transaction_id"]]
        if r["user_id"] is None or r["timestamp"] is None:
            assert (g["transactions_last_hour"], g["tx_count_1min"], g["amount_zscore"]) == (1, 1, 0.0)
            continue

        def back(**width):
            since = r["timestamp"] - dt.timedelta(**width)
            return [x for x in rows if x["user_id"] == r["user_id"] and x["timestamp"] is not None
                    and since <= x["timestamp"] <= r["timestamp"]]

        assert g["transactions_last_hour"] == len(back(hours=1))
        assert g["tx_count_1min"] == len(back(minutes=1))
        amounts = [x["amount"] for x in back(hours=24) if x["amount"] is not None]
        if not amounts:
            assert g["mean_amount"] is None
            continue
        assert g["mean_amount"] == pytest.approx(statistics.mean(amounts))
        spread = statistics.stdev(amounts) if len(amounts) > 1 else None
        assert g["stddev_amount"] == (spread if not spread else pytest.approx(spread))
        if not spread:
            assert g["amount_zscore"] == 0.0


def test_window_aggregates_equal_plain_form(spark):
    df = random_transactions(spark, 300, 3).filter("user_id IS NOT NULL")

    def key(rows, *names):
        return {(r["user_id"], r["window"]["start"]): [r[n] for n in names] for r in rows.collect()}

    ours, plain = (key(f(df), "mean_amount", "stddev_amount") for f in (hopping.user_stats_24h, hopping.window_stats))
    assert ours.keys() == plain.keys()
    for k, values in plain.items():
        assert ours[k] == [v if v is None else pytest.approx(v, abs=1e-6) for v in values]
    assert key(hopping.tx_count_1h(df), "tx_count") == key(
        hopping.window_counts(df, hopping.COUNT_1H, "tx_count"), "tx_count")


def test_lookup_ttl_and_misses(spark):
    def at(seconds):
        return NOW + dt.timedelta(seconds=seconds)

    features = spark.createDataFrame(
        [("u", 3, at(0)), ("u", 4, at(50)), ("v", 9, at(0)), (None, 7, at(0))],
        "user_id string, tx_count_1min bigint, updated_at timestamp")
    tx = spark.createDataFrame(
        [("before", "u", at(-1)), ("same", "u", at(0)), ("mid", "u", at(49)), ("newer", "u", at(50)),
         ("old", "u", at(169)), ("gone", "u", at(170)), ("other", "w", at(1)), ("nobody", None, at(1)), ("never", "u", None)],
        "transaction_id string, user_id string, timestamp timestamp")
    got = {r["transaction_id"]: r["hot_tx_count_1min"] for r in trailing.lookup_hot_feature(tx, features).collect()}
    assert got == {"before": 0, "same": 3, "mid": 3, "newer": 4, "old": 4, "gone": 0, "other": 0, "nobody": 0, "never": 0}


def test_pattern_flags(spark):
    def row(i, minutes, amount, place, device, category="food"):
        return (str(i), "u", amount, category, NOW + dt.timedelta(minutes=minutes), place, device, False)

    rows = [row(1, 0, 10.0, "A", "d1"), row(2, 0.5, 10.0, "A", "d1"), row(3, 200, 1000.0, "B", "d1"),
            row(4, 3000, 10.0, "B", "d2"), row(5, 9000, 900.0, "B", "d2", "travel"), row(6, 9900, 5.0, "B", "d1", "b"),
            row(7, 12000, 5.0, "B", "d1", "a"), row(8, 15000, 5.0, "B", "d1", "b"), row(9, 15100, 5.0, "B", "d1", "a"),
            (("10", None, 2000.0, "food", None, "Z", "d9", False))]
    df = spark.createDataFrame(rows, """transaction_id string, user_id string, amount double, merchant_category string,
        timestamp timestamp, location string, device_id string, is_fraud boolean""")
    names = ["high_amount", "rapid_fire", "location_jump", "new_device", "unusual_category"]
    got = {r["transaction_id"]: [n for n in names if r[n]] for r in profiles.fraud_pattern_flags(df).collect()}
    assert got == {"1": [], "2": ["rapid_fire"], "3": ["high_amount", "location_jump"], "4": ["new_device"],
                   "5": ["unusual_category"], "6": [], "7": [], "8": [], "9": [], "10": ["high_amount"]}


SHIFT = [(1_000_000_000.0 + i, 0) for i in range(50)] + [(10.0 + i, 10 * 86400) for i in range(5)]


def shifted_level(spark):
    """One user whose amounts fall from about 1e9 to about 10."""
    base = dt.datetime(2024, 1, 1, 13)
    return spark.createDataFrame(
        [(str(i), "u", amount, base + dt.timedelta(seconds=after + 60 * i)) for i, (amount, after) in enumerate(SHIFT)],
        "transaction_id string, user_id string, amount double, timestamp timestamp")


def test_deviation_survives_a_level_shift(spark):
    got = {int(r["transaction_id"]): r for r in trailing.trailing_features(shifted_level(spark)).collect()}
    for i in range(51, 55):
        amounts = [a for a, _ in SHIFT[50:i + 1]]
        assert got[i]["mean_amount"] == pytest.approx(statistics.mean(amounts))
        assert got[i]["stddev_amount"] == pytest.approx(statistics.stdev(amounts))


@pytest.mark.parametrize("width", [60, 3600, 86400])
def test_frames_over_midnight_hold_both_ends(spark, width):
    midnight = dt.datetime(2024, 1, 2)
    offsets = [-width - 1e-6, -width, -width / 2, -1e-6, 0.0, 1e-6, width / 2, width, width + 1e-6]
    df = spark.createDataFrame(
        [(f"{start}/{o}", "u", float(i), midnight + dt.timedelta(seconds=start + o))
         for start in (0, width / 3) for i, o in enumerate(offsets)],
        "transaction_id string, user_id string, amount double, timestamp timestamp")
    rows = df.collect()
    names = {60: "tx_count_1min", 3600: "transactions_last_hour"}
    for g in trailing.trailing_features(df).collect():
        since = g["timestamp"] - dt.timedelta(seconds=width)
        inside = [r["amount"] for r in rows if since <= r["timestamp"] <= g["timestamp"]]
        if width in names:
            assert g[names[width]] == len(inside)
        else:
            assert g["mean_amount"] == pytest.approx(statistics.mean(inside))


def test_batch_windows_equal_plain_windows_after_a_level_shift(spark):
    tx = shifted_level(spark)
    got = {r["window"]: r for r in hopping.user_stats_24h(tx).collect()}
    plain = hopping.window_stats(tx).collect()
    assert len(got) == len(plain) == 48
    joined = {r["window_start"]: r for r in hopping.join_window_stats(tx).collect()}
    for r in plain:
        for g in (got[r["window"]], joined[r["window"]["start"]]):
            assert g["mean_amount"] == pytest.approx(r["mean_amount"])
            assert g["stddev_amount"] == (r["stddev_amount"] and pytest.approx(r["stddev_amount"]))


def test_rows_without_a_user_do_not_meet_in_frames(spark):
    n = 100_000
    tx = spark.range(0, n, 1, 1).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(None).cast("string").alias("user_id"),
        F.lit(1.0).alias("amount"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("timestamp"))
    found = trailing.trailing_features(tx).agg(
        F.count("*"), F.max("transactions_last_hour"), F.max("tx_count_1min"), F.count("mean_amount")).first()
    assert tuple(found) == (n, 1, 1, 0)
