"""Mixing sources to target weights, with DataFrame operations only.

Token shares p of the sources become weights p^a / sum p^a. The exponent a is
found by bisection: the largest one (nearest to the natural mixture) whose entropy
reaches a share of the greatest possible, but not so small that a source is
repeated more than a limit. Every pass over the small table of sources halves the
interval five times.

Weights become a stream per source: its documents pass in epochs, each a new
permutation of blocks and of the documents inside blocks, until the source's
budget of tokens is met; in the last epoch only documents that begin within the
budget take part. Offsets come from sums per block and then within each block, so
no task holds more than a block or the list of blocks.

The unit is a document id with its text: repeated rows travel together.

Defined cases: null source is the empty name, null text has no words; a source
without tokens has weight 0 and its rows pass once; all sources empty or an empty
table: rows pass once; other columns are ignored here and kept by `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import packs

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 100_000
MOST_BLOCKS = 65_536
PASSES, HALVINGS = 6, 5


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (digest of the text), copies and n_tokens of all copies."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.md5(text.cast("binary")).alias("key"),
                    F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n"))
        .groupBy("doc_id", "source", "key").agg(F.count(F.lit(1)).alias("copies"), F.sum("n").alias("n_tokens"))
    )


def _figures(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy and largest weight over share for every exponent."""
    at = F.explode(F.array(*(F.lit(float(a)) for a in exponents)))
    rows = shares.select("p", at.alias("a")).groupBy("a").agg(
        F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("l"),
        F.max(F.pow("p", F.col("a") - 1)).alias("most")).collect()
    return {r["a"]: (math.log(r["z"]) - r["a"] * r["l"] / r["z"], r["most"] / r["z"]) for r in rows}


def _bisected(shares: DataFrame, good, keep_low: bool) -> float:
    """End of the interval on the good side; `good` is monotone in the exponent, given its figures."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 2**HALVINGS
        points = [low + (high - low) * i / n for i in range(n + 1)]
        figures = _figures(shares, points)
        left, right = 0, n
        while right - left > 1:
            middle = (left + right) // 2
            if good(*figures[points[middle]]) == keep_low:
                left = middle
            else:
                right = middle
        low, high = points[left], points[right]
    return low if keep_low else high


def exponent(shares: DataFrame, target_entropy: float, most_repeats: float, per_share: float) -> float:
    """Exponent in [0, 1]. per_share: budget over all tokens."""
    ends = _figures(shares, [0.0, 1.0])
    target = target_entropy * ends[0.0][0]
    flat = 1.0 if ends[1.0][0] >= target else _bisected(shares, lambda h, _: h >= target, keep_low=True)
    if ends[0.0][1] * per_share <= most_repeats:
        return flat
    if ends[1.0][1] * per_share > most_repeats:
        return 1.0
    return max(flat, _bisected(shares, lambda _, r: r * per_share <= most_repeats, keep_low=False))


def _number(*parts) -> Column:
    """32 bits of a digest that any engine can reproduce."""
    return F.conv(F.substring(_digest(*parts), 1, 8), 16, 10).cast("bigint")


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def planned(
    units_: DataFrame, work: packs.Work, target_entropy: float, most_repeats: float, budget: int | None = None,
    keep_all: bool = False, seed: int = 1,
) -> DataFrame:
    """doc_id, source, key, copies, n_tokens, epoch and start (place in the source's stream) of every pass of a unit.

    budget: tokens of the mixture (as many as there are). keep_all: instead, the
    smallest budget that lets every source pass at least once.
    """
    totals = work.keep(units_.groupBy("source").agg(F.sum("n_tokens").alias("total")), "sources")
    row = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()
    tokens = row["t"]
    shares = totals.where("total > 0").select("source", "total", (F.col("total") / F.lit(max(tokens, 1))).alias("p"))
    a, z, per_share = 1.0, 1.0, 1.0
    if tokens:
        per_share = 1.0 if budget is None else budget / tokens
        # with keep_all, repeats are relative to the largest share, whose source passes once
        top = shares.agg(F.max("p")).first()[0]
        relative = shares.select((F.col("p") / F.lit(top)).alias("q"), "p")
        if keep_all:
            a = _kept_exponent(relative, shares, target_entropy, most_repeats)
        else:
            a = exponent(shares, target_entropy, most_repeats, per_share)
        z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
        if keep_all:
            per_share = z * top ** (1 - a)
    size = max(BLOCK_TOKENS, -(-tokens // MOST_BLOCKS))
    quota = F.pow(F.col("total") / F.lit(float(max(tokens, 1))), F.lit(a)) / F.lit(z) * F.lit(per_share * tokens)
    passes = F.floor(F.round(quota / F.col("total"), 9)).cast("bigint")
    sources = totals.select(
        "source", "total",
        F.when(F.col("total") > 0, passes).otherwise(F.lit(1)).cast("bigint").alias("full"),
        F.when(F.col("total") > 0, F.round(quota - passes * F.col("total"), 6)).otherwise(F.lit(0.0)).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("bigint").alias("blocks"))
    epochs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)))
    seed_ = F.lit(seed)
    placed = units_.join(sources, "source").withColumn(
        "block", F.pmod(_number(seed_, F.col("doc_id"), F.col("key")), F.col("blocks")))
    blocks = (
        placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
        .join(sources, "source").where("full > 0 OR rest > 0").select("source", "block", "size", epochs.alias("epoch"))
        .withColumn("offset", F.sum("size").over(Window.partitionBy("source", "epoch").orderBy(
            _digest(seed_, F.col("source"), F.col("epoch"), F.col("block")), "block").rowsBetween(
            Window.unboundedPreceding, -1)))
        .select("source", "block", "epoch", F.coalesce("offset", F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("source", "epoch", "block").orderBy(
        _digest(seed_, F.col("epoch"), F.col("doc_id"), F.col("key")), "doc_id", "key").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        placed.where("full > 0 OR rest > 0").withColumn("epoch", epochs).join(blocks, ["source", "block", "epoch"])
        .withColumn("within", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("epoch < full OR within < rest")
        .select("doc_id", "source", "key", "copies", "n_tokens", "epoch",
                (F.col("epoch") * F.col("total") + F.col("within")).alias("start"))
    )


def _kept_exponent(relative: DataFrame, shares: DataFrame, target_entropy: float, most_repeats: float) -> float:
    """As `exponent`, where the smallest source repeats (p_least / p_most)^(a - 1) times."""
    least = relative.agg(F.min("q")).first()[0]
    a = exponent(shares, target_entropy, math.inf, 1.0)
    low, high = 0.0, 1.0
    if least ** (low - 1) <= most_repeats:
        return a
    for _ in range(PASSES * HALVINGS):
        middle = (low + high) / 2
        low, high = (low, middle) if least ** (middle - 1) <= most_repeats else (middle, high)
    return max(a, high)


def mixed(docs: DataFrame, target_entropy: float, most_repeats: float) -> DataFrame:
    """The rows of docs, each as often as the plan that keeps every source whole lets it pass."""
    work = packs.Work(docs.sparkSession, "mixing")
    known = work.keep(units(docs), "units")
    times = planned(known, work, target_entropy, most_repeats, keep_all=True).groupBy("doc_id", "source", "key").agg(
        F.count(F.lit(1)).cast("int").alias("times"))
    # rows travel as one column, so that no name of theirs clashes
    own = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.coalesce("source", F.lit("")).alias("own_source"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own_key"))
    joined = own.join(times, own["own_id"].eqNullSafe(times["doc_id"]) & (own["own_key"] == times["key"]) & (
        own["own_source"] == times["source"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
