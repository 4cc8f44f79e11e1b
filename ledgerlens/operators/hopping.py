"""Per-user statistics over hopping windows, and their join back to the transactions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, times
from ledgerlens.functions.times import DAY, HOUR, MINUTE, SECOND

# --- fixed values: window size and slide of each feature ---------------------
STATS_24H = (DAY, HOUR)
COUNT_1H = (HOUR, 5 * MINUTE)
COUNT_1MIN = (MINUTE, 10 * SECOND)
# ----------------------------------------------------------------------------


def hop(size_slide: tuple[int, int], timestamp: str = "timestamp") -> Column:
    size, slide = size_slide
    return F.window(timestamp, f"{size} microseconds", f"{slide} microseconds")


def window_stats(df: DataFrame) -> DataFrame:
    """Mean and deviation per user and 24 h window, in the plain form."""
    return df.groupBy("user_id", hop(STATS_24H).alias("window")).agg(
        F.avg("amount").alias("mean_amount"), F.stddev("amount").alias("stddev_amount")
    )


def window_counts(df: DataFrame, size_slide: tuple[int, int], name: str) -> DataFrame:
    """Transactions per user and window, in the plain form."""
    return df.groupBy("user_id", hop(size_slide).alias("window")).agg(F.count("*").alias(name))


# The same results are built from one row per (user, slot), in streams per (user, span): the
# plain form sends every transaction to each of its 24, 12 or 6 windows.

def user_stats_24h(df: DataFrame) -> DataFrame:
    if df.isStreaming:
        return _stats_of_spans(df)
    size, slide = STATS_24H
    hops = size // slide
    blocks = _block_windows(_slots(df, STATS_24H, moments_aggs("amount")), hops)
    first = F.col("_w.first_slot")
    window = F.struct(
        times.slot_start(first, slide).alias("start"), times.slot_start(first + hops, slide).alias("end")
    )
    # the outer form, as a plain explode is given a filter that works out all windows once more
    return blocks.select("user_id", F.explode_outer("_windows").alias("_w")).filter("_w.seen").select(
        "user_id", window.alias("window"), "_w.mean_amount", "_w.stddev_amount"
    )


def tx_count_1h(df: DataFrame) -> DataFrame:
    return _counts(df, COUNT_1H, "tx_count")


def tx_count_1min(df: DataFrame) -> DataFrame:
    return _counts(df, COUNT_1MIN, "tx_count_1min")


def _counts(df: DataFrame, size_slide: tuple[int, int], name: str) -> DataFrame:
    if df.isStreaming:
        return _counts_of_spans(df, size_slide, name)
    slots = _slots(df, size_slide, [F.count("*").alias("n")])
    return _all_windows(slots, size_slide, _per_slot_counts).select("user_id", "window", F.col("_w.n").alias(name))


def _slots(df: DataFrame, size_slide: tuple[int, int], aggregates) -> DataFrame:
    """Aggregates per (user, slot), a slot being as wide as the windows' slide."""
    slot = times.slot(times.micros(F.col("timestamp")), size_slide[1])
    return df.filter(F.col("timestamp").isNotNull()).groupBy("user_id", slot.alias("_slot")).agg(*aggregates)


def _all_windows(slots: DataFrame, size_slide: tuple[int, int], per_slot) -> DataFrame:
    """Every window that holds a transaction, once: it is taken from the first of its slots that has any."""
    size, slide = size_slide
    before = F.lag("_slot").over(Window.partitionBy("user_id").orderBy("_slot"))
    unfolded = per_slot(slots.withColumn("_before", before), size // slide, "_before").select(
        "user_id", "_before", F.explode("_windows").alias("_w")
    )
    first = F.col("_w.first_slot")
    window = F.struct(
        times.slot_start(first, slide).alias("start"), times.slot_start(first + size // slide, slide).alias("end")
    )
    return unfolded.filter(F.col("_before").isNull() | (first > F.col("_before"))).select(
        "user_id", window.alias("window"), "_w"
    )


def _per_slot_counts(slots: DataFrame, hops: int, *keep: str) -> DataFrame:
    """For every (user, slot) an array with one struct (first_slot, n) per window that covers the slot.

    The window that starts i slots earlier spans the slots from -i to hops - 1 - i
    around the current one, which is a range frame over the user's slots. Frames
    hold at most hops rows, and a user has one row per slot, however many
    transactions fall in it.
    """
    ordered = Window.partitionBy("user_id").orderBy("_slot")

    def window(i):
        frame = ordered.rangeBetween(-i, hops - 1 - i)
        return F.struct((F.col("_slot") - i).alias("first_slot"), F.sum("n").over(frame).alias("n"))

    return slots.select("user_id", "_slot", *keep, F.array(*[window(i) for i in range(hops - 1, -1, -1)]).alias("_windows"))


def _block_windows(slots: DataFrame, hops: int) -> DataFrame:
    """user_id, _block and _windows: one struct for each of the `hops` windows that begin in a block of as many slots.

    A window is the end of the block that it begins in and the beginning of the next
    one. So every block is gone through once forward and once backward, pooling its
    slots one by one, and a window pools two of those results; only slots that have
    transactions are held. Structs are (first_slot, seen, mean_amount, stddev_amount);
    a window without transactions is not `seen`.
    """
    place = F.pmod("_slot", F.lit(hops))
    part = F.struct(place.alias("place"), direct_moments().alias("moments"))
    blocks = slots.groupBy("user_id", times.slot(F.col("_slot"), hops).alias("_block")).agg(
        F.array_sort(F.collect_list(part)).alias("_parts"))

    none = F.lit(None).cast(_POOLED)
    roles = F.array(
        F.struct(F.col("_block").alias("_block"), _pooled_one_by_one(F.reverse("_parts")).alias("ends"), none.alias("begins")),
        F.struct((F.col("_block") - 1).alias("_block"), none.alias("ends"), _pooled_one_by_one(F.col("_parts")).alias("begins")),
    )
    both = blocks.select("user_id", F.inline(roles)).groupBy("user_id", "_block").agg(
        F.first("ends", ignorenulls=True).alias("ends"), F.first("begins", ignorenulls=True).alias("begins"))
    return both.select("user_id", "_block", _windows_of_block(F.col("_block") * hops, hops).alias("_windows"))


def _pooled_one_by_one(parts: Column) -> Column:
    """Parts (place, moments), each pooled with all before it."""
    def add(done, part):
        last = F.get(done, F.size(done) - 1)
        pooled = merge_moments([last["moments"], part["moments"]])
        return F.concat(done, F.array(F.struct(part["place"].alias("place"), pooled.alias("moments"))))

    return F.aggregate(parts, F.array().cast(_POOLED), add)


def _windows_of_block(first_slot: Column, hops: int) -> Column:
    """The windows that begin in a block, from the pooled `ends` of the block and `begins` of the next one.

    Neighbouring windows that hold the same slots are worked out once, as one run.
    """
    def place_after(part):
        return part["place"] + 1

    def changes(pooled):  # of a block without transactions there are none
        return F.coalesce(F.transform(pooled, place_after), F.array().cast("array<bigint>"))

    changed = F.concat(F.array(F.lit(0).cast("bigint")), changes("ends"), changes("begins"))
    runs = F.array_sort(F.array_distinct(F.filter(changed, lambda i: i < hops)))

    def halves(i):
        end = F.filter("ends", lambda p: p["place"] >= i)  # the last of these pools all of them
        begin = F.filter("begins", lambda p: p["place"] < i)
        return F.struct(
            i.alias("place"), F.try_element_at(end, F.lit(-1))["moments"].alias("end"),
            F.try_element_at(begin, F.lit(-1))["moments"].alias("begin"))

    def run(half):
        return F.struct(
            half["place"].alias("place"), (half["end"].isNotNull() | half["begin"].isNotNull()).alias("seen"),
            merge_moments([half["end"], half["begin"]]).alias("moments"))

    def result(r):
        return F.struct(r["place"].alias("place"), r["seen"].alias("seen"),
                        mean_of(r["moments"]).alias("mean_amount"), stddev_of(r["moments"]).alias("stddev_amount"))

    def windows(done, r):
        """From the last run back to the first, each up to where the one behind it begins."""
        until = F.coalesce(F.get(done, F.lit(0))["first_slot"] - first_slot, F.lit(hops))
        return F.concat(F.transform(F.sequence(r["place"], until - 1), lambda i: F.struct(
            (first_slot + i).alias("first_slot"), r["seen"].alias("seen"), r["mean_amount"].alias("mean_amount"),
            r["stddev_amount"].alias("stddev_amount"))), done)

    # one transform after the other, so that each part is worked out once
    pooled = F.reverse(F.transform(F.transform(F.transform(runs, halves), run), result))
    return F.aggregate(pooled, F.array().cast(_WINDOWS), windows)


_WINDOWS = "array<struct<first_slot:bigint,seen:boolean,mean_amount:double,stddev_amount:double>>"
_POOLED = "array<struct<place:bigint,moments:struct<n:bigint,mean:double,m2:double,lowest:double,highest:double>>>"


# A stream keeps its state by spans. The span of a block holds all windows that begin in it, so a
# transaction is in two of them, however many windows hold it, and the windows are unfolded from what comes out.

def span(size_slide: tuple[int, int], timestamp: str = "timestamp") -> Column:
    size, slide = size_slide
    return F.window(timestamp, f"{2 * size - slide} microseconds", f"{size} microseconds")


def place_in_span(slide: int) -> Column:
    """Number of a row's slot within its span."""
    return times.slot(times.micros(F.col("timestamp")) - times.micros(F.col("span.start")), slide)


def window_in_span(place: Column, size_slide: tuple[int, int]) -> Column:
    """The window that begins with the slot at `place`."""
    size, slide = size_slide
    start = times.micros(F.col("span.start")) + place.cast("bigint") * F.lit(slide)
    return F.struct(F.timestamp_micros(start).alias("start"), F.timestamp_micros(start + size).alias("end"))


def span_stats(df: DataFrame) -> DataFrame:
    """user_id, span and _windows, as _block_windows gives them.

    Slots are pooled first, so that a span is gathered from one row per slot.
    """
    size, slide = STATS_24H
    hops = size // slide
    placed = df.withColumn("span", span(STATS_24H)).withColumn("place", place_in_span(slide))
    slots = placed.groupBy("user_id", "span", "place").agg(*moments_aggs("amount"))
    part = F.struct("place", direct_moments().alias("moments"))
    spans = slots.groupBy("user_id", "span").agg(F.array_sort(F.collect_list(part)).alias("_parts"))

    def next_block(p):
        return F.struct((p["place"] - hops).alias("place"), p["moments"].alias("moments"))

    ends = F.reverse(F.filter("_parts", lambda p: p["place"] < hops))
    begins = F.transform(F.filter("_parts", lambda p: p["place"] >= hops), next_block)
    pooled = spans.select("user_id", "span", _pooled_one_by_one(ends).alias("ends"), _pooled_one_by_one(begins).alias("begins"))
    return pooled.select("user_id", "span", _windows_of_block(F.lit(0).cast("bigint"), hops).alias("_windows"))


def span_counts(df: DataFrame, size_slide: tuple[int, int]) -> DataFrame:
    """user_id, span and _windows: the count of each window that begins in the span's block."""
    size, slide = size_slide
    hops = size // slide
    placed = df.withColumn("span", span(size_slide)).withColumn("place", place_in_span(slide))
    per_slot = [F.count(F.when(F.col("place") == i, 1)).alias(f"n_{i}") for i in range(2 * hops - 1)]
    windows = [reduce(lambda a, b: a + b, [F.col(f"n_{j}") for j in range(i, i + hops)]) for i in range(hops)]
    return placed.groupBy("user_id", "span").agg(*per_slot).select("user_id", "span", F.array(*windows).alias("_windows"))


def _stats_of_spans(df: DataFrame) -> DataFrame:
    unfolded = span_stats(df).select("user_id", "span", F.explode_outer("_windows").alias("_w")).filter("_w.seen")
    return unfolded.select(
        "user_id", window_in_span(F.col("_w.first_slot"), STATS_24H).alias("window"), "_w.mean_amount", "_w.stddev_amount")


def _counts_of_spans(df: DataFrame, size_slide: tuple[int, int], name: str) -> DataFrame:
    unfolded = span_counts(df, size_slide).select("user_id", "span", F.posexplode("_windows").alias("_i", name))
    return unfolded.filter(F.col(name) > 0).select("user_id", window_in_span(F.col("_i"), size_slide).alias("window"), name)


def _held_counts(df: DataFrame, source: DataFrame, size_slide, held: str) -> DataFrame:
    """Left join of each row with the array of all windows of `source` that hold it.

    Rows are not multiplied before the shuffle: they meet their slot's array of
    windows in an equi join on (user, slot), one row per key on that side. A hot
    slot is a skewed left side, which adaptive execution splits.
    """
    size, slide = size_slide
    slot = times.slot(times.micros(F.col("timestamp")), slide)
    slots = _slots(source.filter(F.col("user_id").isNotNull()), size_slide, [F.count("*").alias("n")])
    joined = df.withColumn("_slot", slot).join(_per_slot_counts(slots, size // slide), ["user_id", "_slot"], "left")
    return joined.select(*df.columns, F.col("_windows").alias(held))


def _held_stats(df: DataFrame, held: str) -> DataFrame:
    """Like _held_counts, by blocks of slots: the windows of a slot begin in its own block or in the one before."""
    size, slide = STATS_24H
    hops = size // slide
    blocks = _block_windows(_slots(df.filter(F.col("user_id").isNotNull()), STATS_24H, moments_aggs("amount")), hops)
    of_user = Window.partitionBy("user_id").orderBy("_block")
    # a block with transactions has windows that begin in it and in the one before it
    around = blocks.select("user_id", "_block", F.lag("_windows").over(of_user).alias("_before"), "_windows")
    slot = times.slot(times.micros(F.col("timestamp")), slide)
    placed = df.withColumn("_slot", slot).withColumn("_block", times.slot(F.col("_slot"), hops))
    found = F.slice(F.concat("_before", "_windows"), (F.pmod("_slot", F.lit(hops)) + 2).cast("int"), hops)
    return placed.join(around, ["user_id", "_block"], "left").select(*df.columns, found.alias(held))


def _unfolded(df: DataFrame, held: str, size_slide, *outputs) -> DataFrame:
    """One row per window of the array `held`, or a single one without any."""
    size, slide = size_slide
    columns = [c for c in df.columns if c != held]
    first = F.col("_w.first_slot")
    return df.select(*columns, F.explode_outer(held).alias("_w")).select(
        *columns, times.slot_start(first, slide).alias("window_start"),
        times.slot_start(first + size // slide, slide).alias("window_end"), *outputs,
    )


def join_window_stats(df: DataFrame) -> DataFrame:
    """Every transaction with mean and deviation of each 24 h window that holds it (24 per row)."""
    return _unfolded(_held_stats(df, "_held"), "_held", STATS_24H, "_w.mean_amount", "_w.stddev_amount")


def _join_counts(df: DataFrame, source: DataFrame | None, size_slide, name: str) -> DataFrame:
    held = _held_counts(df, df if source is None else source, size_slide, "_held")
    return _unfolded(held, "_held", size_slide, F.col("_w.n").alias(name))


def join_hourly_counts(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Every transaction with the count of each 1 h window that holds it (12 per row).

    The counted transactions are those of `source`, by default the same rows.
    """
    return _join_counts(df, source, COUNT_1H, "tx_count")


def join_minute_counts(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Every transaction with the count of each 1 min window that holds it (6 per row)."""
    return _join_counts(df, source, COUNT_1MIN, "tx_count_1min")


_LISTS = {"_scores": "amount_zscore", "_hourly": "transactions_last_hour", "_minutely": "tx_count_1min"}


def hopping_lists(df: DataFrame) -> DataFrame:
    """Every transaction once, with the z-scores and counts of the windows that hold it as three arrays.

    No array is unfolded on the way, so each of the three joins moves one row per transaction.
    """
    def scores(w):
        return scoring.zscore(F.col("amount"), w["mean_amount"], w["stddev_amount"])

    def counts(held):
        return F.coalesce(F.transform(held, lambda w: scoring.default_count(w["n"])), F.array(F.lit(1).cast("bigint")))

    listed = _held_stats(df, "_scores").withColumn(
        "_scores", F.coalesce(F.transform("_scores", scores), F.array(F.lit(0.0))))
    listed = _held_counts(listed, df, COUNT_1H, "_hourly").withColumn("_hourly", counts("_hourly"))
    return _held_counts(listed, df, COUNT_1MIN, "_minutely").withColumn("_minutely", counts("_minutely"))


def hopping_features(df: DataFrame) -> DataFrame:
    """The three joins in a row: 24 * 12 * 6 rows per transaction.

    Kept for its exact semantics; trailing_features gives one row per transaction.
    Counts are those of the transactions, not of the rows the first join unfolds.
    """
    rows = hopping_lists(df)
    for held, name in _LISTS.items():
        rows = rows.withColumn(name, F.explode_outer(held)).drop(held)
    return rows


def hopping_totals(df: DataFrame) -> DataFrame:
    """The rows of hopping_features added up per transaction_id, without unfolding them.

    Each element of one array stands in a row with every element of the other two, so a sum over
    the rows is the sum over its array, times the lengths of the others.
    """
    def total(held):
        return F.aggregate(held, F.lit(0).cast("bigint"), lambda done, n: done + n)

    scored = F.filter("_scores", lambda z: z.isNotNull())
    per_row = hopping_lists(df).select(
        "transaction_id", *[F.size(held).cast("bigint").alias(f"_n{held}") for held in _LISTS],
        F.size(scored).cast("bigint").alias("scored"),
        F.aggregate(scored, F.lit(0.0), lambda done, z: done + z).alias("score"),
        total("_hourly").alias("hourly"), total("_minutely").alias("minutely"),
        (F.array_max("_hourly") * F.array_max("_minutely")).alias("product"),
    )
    scores, hourly, minutely = (F.col(f"_n{held}") for held in _LISTS)
    return per_row.groupBy("transaction_id").agg(
        F.sum(scores * hourly * minutely).alias("feature_rows"),
        (F.sum(F.col("score") * hourly * minutely) / F.nullif(F.sum(F.col("scored") * hourly * minutely), F.lit(0)))
        .alias("amount_zscore"),
        F.sum(F.col("hourly") * scores * minutely).alias("transactions_last_hour"),
        F.sum(F.col("minutely") * scores * hourly).alias("tx_count_1min"), F.max("product").alias("highest_product"),
    )


def amount_zscore(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "amount_zscore", scoring.zscore(F.col("amount"), F.col("mean_amount"), F.col("stddev_amount"))
    )


def default_counts(df: DataFrame, *names: str) -> DataFrame:
    """A count that found no window is 1: the transaction itself."""
    return df.withColumns({name: scoring.default_count(F.col(name)) for name in names})


# --- moments: count, mean and squared deviations that can be merged -----------
#
# A moments struct has n, mean, m2 (sum of squared distances from the mean),
# lowest and highest. Raw aggregates and their combination are kept apart,
# because a window aggregate is evaluated once for every place it appears in.

def moments_aggs(value: str):
    """Raw moments of `value` in a group."""
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"),
    ]


def direct_moments(raw: Column | None = None) -> Column:
    """Moments struct from raw moments, those of a struct or of the row itself."""
    def part(name):
        return F.col(name) if raw is None else raw[name]

    return F.struct(
        part("n").alias("n"), part("mean").alias("mean"), (part("variance") * part("n")).alias("m2"),
        part("lowest").cast("double").alias("lowest"), part("highest").cast("double").alias("highest"),
    )


def merge_moments(parts: list[Column]) -> Column:
    """One moments struct from several disjoint ones; absent or empty parts count as nothing."""
    def count(p):
        return F.coalesce(p["n"], F.lit(0))

    def add(columns):
        return reduce(lambda a, b: a + b, columns)

    n = add([count(p) for p in parts])
    mean = add([F.coalesce(count(p) * p["mean"], F.lit(0.0)) for p in parts]) / F.nullif(n, F.lit(0))

    def spread(p, center):
        gap = p["mean"] - center
        return F.coalesce(p["m2"] + count(p) * gap * gap, F.lit(0.0))

    return F.struct(
        n.alias("n"), mean.alias("mean"), add([spread(p, mean) for p in parts]).alias("m2"),
        F.least(*[p["lowest"] for p in parts]).alias("lowest"),
        F.greatest(*[p["highest"] for p in parts]).alias("highest"),
    )


def mean_of(m: Column) -> Column:
    return F.when(m["lowest"] == m["highest"], m["lowest"]).otherwise(m["mean"])


def stddev_of(m: Column) -> Column:
    """Sample deviation: null below two values, exactly 0 when all values are equal."""
    return F.when(
        m["n"] > 1,
        F.when(m["lowest"] == m["highest"], F.lit(0.0)).otherwise(F.sqrt(m["m2"] / (m["n"] - 1))),
    )
