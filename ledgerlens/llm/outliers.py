"""Quality rules and robust multivariate outliers of text statistics.

For every language and source, a minimum-covariance-determinant estimate of the
transformed statistics: concentration steps take the HALF share of rows with the
least distance (of rows at the same limit, each an equal part, so that many copies
count no more than fits) and estimate place and scatter from them, until the
determinant stops falling. It falls with every step, so they end. There are two
starts at the medians, one with median deviations and one with the scatter of
directions; the one that ends with the least determinant counts. A row is an outlier
if its squared Mahalanobis distance is above CUTOFF times what a normal distribution
has at its HALF quantile, relative to the group's own. Steps are grouped sums over
all rows (combined before the shuffle), so a group of any size is fine.

The scatter gets FLOOR on its diagonal: a statistic that is constant in a group
(no symbols at all, say) does not make tiny differences infinitely far.

Defined cases: null text is empty (and fails the base rules); null language or
source is the empty name; groups with fewer than LEAST rows that pass the base
rules are pooled by language, then altogether, and if even those are too few all
rows that pass are kept. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import blocks, packs
from ledgerlens.llm.structure import Structure

LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, per cent of repeated words
HALF, LEAST = 0.5, 60
FALL = 1e-3  # of the determinant's logarithm; steps that bring less are the last
FLOOR = 0.25
_P = 6
# --- fixed values: quantiles of the chi-square distribution with 6 degrees of freedom -------
_CHI2_HALF, _CHI2_FAR = 5.3481, 38.2583  # at 0.5 and 0.999999
# ---------------------------------------------------------------------------------------------
CUTOFF = _CHI2_FAR / _CHI2_HALF
_X = [f"x{i}" for i in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and the transformed vector of every row."""
    def measure(batches):
        for batch in batches:
            for part, data, offsets in blocks.blocks(batch, "text"):
                s = Structure(data, offsets)
                words, lines = np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1)
                vector = [
                    np.log1p(s.n_words) / 2, np.log(s.word_chars / words + 0.1) * 3, np.arcsinh(10 * s.n_symbols / words),
                    np.arcsinh(2 * s.n_dup_lines / lines), np.arcsinh(2 * s.n_repeat_words / words),
                    np.arcsinh(10 * s.n_upper / np.maximum(s.n_bytes, 1)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), part.column("source"),
                     *(pa.array(getattr(s, c).astype(np.int64)) for c in _COUNTS), *(pa.array(v) for v in vector)],
                    names=["doc_id", "lang", "source", *_COUNTS, *_X])

    schema = "doc_id bigint, lang string, source string, " + ", ".join(
        [f"{c} bigint" for c in _COUNTS] + [f"{x} double" for x in _X])
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"),
                       F.coalesce("source", F.lit("")).alias("source")).mapInArrow(measure, schema)


def _celled(rows: DataFrame) -> DataFrame:
    """Adds `cell`: what a row's estimate is made of."""
    passed = F.count_if(~F.col("base_failed"))
    sizes = rows.groupBy("lang", "source").agg(passed.alias("_n"))
    own = F.when(F.col("_n") >= LEAST, F.concat_ws("\u0000", F.lit("g"), "lang", "source"))
    langs = sizes.where(F.col("_n") < LEAST).groupBy("lang").agg(F.sum("_n").alias("_m"))
    named = sizes.join(langs, "lang", "left").select("lang", "source", F.coalesce(
        own, F.when(F.col("_m") >= LEAST, F.concat_ws("\u0000", F.lit("l"), "lang")), F.lit("all")).alias("cell"))
    return rows.join(named, ["lang", "source"], "left")


def _distance(matrix: str = "inverse"):
    """Squared distance of x from the cell's centre."""
    z = [F.col(x) - F.get("centre", F.lit(i)) for i, x in enumerate(_X)]
    terms = [F.get(matrix, F.lit(k)) * z[i] * z[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)]
    return reduce(lambda a, b: a + b, terms)


_ESTIMATE = "cell string, start int, centre array<double>, inverse array<double>, log_det double, done boolean"


def _sums(weight) -> list:
    """Count, sums and sums of products of the rows where `weight` is 1 and not null."""
    return [F.coalesce(F.sum(weight), F.lit(0.0)), *(F.coalesce(F.sum(weight * F.col(x)), F.lit(0.0)) for x in _X),
            *(F.coalesce(F.sum(weight * F.col(_X[i]) * F.col(_X[j])), F.lit(0.0)) for i, j in _PAIRS)]


def _symmetric(values) -> np.ndarray:
    out = np.zeros((_P, _P))
    for value, (i, j) in zip(values, _PAIRS, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _upper(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in _PAIRS]


def _step(clean: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step; an estimate whose determinant falls no more is kept and done."""
    def renew(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                below, ties, wanted = np.array(row.below, float), np.array(row.ties, float), HALF * row.n
                sums = below + ties * (min(max((wanted - below[0]) / ties[0], 0.0), 1.0) if ties[0] else 0.0)
                centre, second = sums[1:_P + 1] / sums[0], _symmetric(sums[_P + 1:] / sums[0])
                scatter = second - np.outer(centre, centre) + np.eye(_P) * FLOOR**2
                log_det = float(np.linalg.slogdet(scatter)[1])
                if log_det < row.log_det:
                    new = centre.tolist(), _upper(np.linalg.inv(scatter)), log_det
                else:
                    new = list(row.centre), list(row.inverse), row.log_det
                out.append((row.cell, row.start, *new, not log_det < row.log_det - FALL))
            yield pd.DataFrame(out, columns=["cell", "start", "centre", "inverse", "log_det", "done"])

    limits = clean.join(estimates, "cell").groupBy("cell", "start").agg(
        F.percentile_approx(_distance(), HALF, 10_000).alias("limit"), F.count(F.lit(1)).alias("n"))
    known = estimates.join(limits, ["cell", "start"])
    away = clean.join(known.select("cell", "start", "centre", "inverse", "limit"), "cell").select(
        "cell", "start", *_X, "limit", _distance().alias("d"))
    sums = away.where(F.col("d") <= F.col("limit")).groupBy("cell", "start").agg(
        F.array(*_sums(F.when(F.col("d") < F.col("limit"), 1.0))).alias("below"),
        F.array(*_sums(F.when(F.col("d") == F.col("limit"), 1.0))).alias("ties"))
    return known.join(sums, ["cell", "start"]).mapInPandas(renew, _ESTIMATE)


def _starts(clean: DataFrame) -> DataFrame:
    """Two estimates for every cell, both at the medians."""
    def invert(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                scale = np.array(row.scale, float)
                # a direction that no row takes still has some width
                round_ = _P * _symmetric(np.array(row.directions, float) / row.n) + np.eye(_P) * 1e-3
                for start, shape in enumerate((np.eye(_P), round_)):
                    inverse = np.linalg.inv(shape * np.outer(scale, scale))
                    out.append((row.cell, start, list(row.centre), _upper(inverse), float("inf"), False))
            yield pd.DataFrame(out, columns=["cell", "start", "centre", "inverse", "log_det", "done"])

    medians = clean.groupBy("cell").agg(F.array(*(F.percentile_approx(x, 0.5) for x in _X)).alias("centre"))
    scales = clean.join(medians, "cell").groupBy("cell", "centre").agg(F.array(*(F.sqrt(F.lit(FLOOR**2) + F.pow(
        1.4826 * F.percentile_approx(F.abs(F.col(x) - F.get("centre", F.lit(i))), 0.5), 2)) for i, x in enumerate(_X))).alias("scale"))
    z = clean.join(scales, "cell").select("cell", "centre", "scale", *(
        ((F.col(x) - F.get("centre", F.lit(i))) / F.get("scale", F.lit(i))).alias(x) for i, x in enumerate(_X)))
    square = F.greatest(reduce(lambda a, b: a + b, [F.col(x) * F.col(x) for x in _X]), F.lit(1e-12))
    return z.groupBy("cell", "centre", "scale").agg(F.count(F.lit(1)).alias("n"), F.array(*(
        F.sum(F.col(_X[i]) * F.col(_X[j]) / square) for i, j in _PAIRS)).alias("directions")).mapInPandas(invert, _ESTIMATE)


def robust_outliers(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, distance (relative squared) and kept of every row."""
    work = packs.Work(docs.sparkSession, "outliers")
    measured = statistics(docs).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = work.keep(_celled(work.keep(measured, "statistics")), "cells")
    clean = rows.where(~F.col("base_failed"))
    estimates, ended = work.keep(_starts(clean), "start"), []
    while not estimates.isEmpty():
        stepped = work.keep(_step(clean, estimates), "estimate")
        ended.append(stepped.where("done"))
        estimates = stepped.where("NOT done")
    if ended:
        estimates = reduce(DataFrame.unionAll, ended)
    estimates = work.keep(estimates.groupBy("cell").agg(F.min_by(F.struct("centre", "inverse"), F.struct("log_det", "start")).alias(
        "best")).select("cell", "best.centre", "best.inverse"), "best")
    spread = clean.join(estimates, "cell").groupBy("cell").agg(
        F.percentile_approx(_distance(), HALF, 10_000).alias("spread"), F.count(F.lit(1)).alias("n"))
    final = work.keep(estimates.join(spread, "cell").where(F.col("n") >= LEAST), "final")
    distance = _distance() / F.greatest(F.col("spread"), F.lit(1.0))
    return rows.join(final, "cell", "left").select(
        "doc_id", "lang", "source", *_COUNTS, "base_failed", distance.alias("distance"),
        F.when(F.col("base_failed"), False).otherwise(F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))
