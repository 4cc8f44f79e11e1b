"""Quality classifier: a factorisation machine over hashed words and the form of the text.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The second sum is all pairwise interactions of rank FACTORS in linear time. The
inputs are log word counts hashed into WORD_SLOTS, numbers about the form of the
text (sizes, shares of symbols, capitals, digits, marks, repeated lines, words and
passages), and the same numbers as steps. Language, source, id and labels are
never inputs.

The model is fitted on the driver from SAMPLE rows of each label at most (the
least hashes of their ids), so fitting costs the same at every corpus size.
Scoring goes over whole texts in one pass without a shuffle.

Defined cases: null text is empty and gets the score of its form; null labels are
ignored, and of several labels of one id the mean decides; without both labels
among the training rows every score is 1 (nothing is known against any text);
rows may repeat and other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlens.llm import blocks
from ledgerlens.llm.structure import Structure

WORD_SLOTS = 1 << 14
FACTORS = 8
SAMPLE = 2_000  # rows of each label
STEPS = 8
THRESHOLD = 0.7
_EPOCHS, _BATCH, _RATE, _DECAY = 12, 64, 0.02, 1e-4


def form(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Structure]:
    s = Structure(data, offsets)
    words, size = np.maximum(s.n_words, 1), np.maximum(s.n_bytes, 1)
    lines = np.maximum(s.n_lines, 1)
    return np.column_stack([
        np.log1p(s.n_words), s.word_chars / words, np.minimum(s.n_symbols / words, 3), s.n_upper / size,
        s.n_digits / size, np.minimum(s.n_marks / words, 3), np.minimum(s.n_bangs / words, 3), np.log1p(s.n_words / lines),
        s.n_dup_lines / lines, s.n_repeat_words / words, s.n_distinct / words,
    ]), s


def word_inputs(s: Structure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of every hashed word of every text; the values of a text have length 1."""
    key = s.words.text_of() * WORD_SLOTS + (s.hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    text, value = key // WORD_SLOTS, np.log1p(times)
    length = np.sqrt(np.bincount(text, weights=value * value, minlength=len(s.n_words)))
    return text, key % WORD_SLOTS, value / length[text]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray  # a row of step edges for each number
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, numbers, text, slot, value):
        """Texts, input indices and values, by text."""
        n, width = numbers.shape
        z = np.clip((numbers - self.mean) / self.spread, -4, 4) / 4
        step = np.stack([np.searchsorted(self.edges[j], numbers[:, j]) for j in range(width)], axis=1)
        rows = np.repeat(np.arange(n), width)
        of = np.tile(np.arange(width), n)
        texts = np.concatenate([rows, rows, text])
        index = np.concatenate([of, width + of * STEPS + step.ravel(), width * (1 + STEPS) + slot])
        values = np.concatenate([z.ravel(), np.full(n * width, 0.3), value])
        order = np.argsort(texts, kind="stable")
        return texts[order], index[order], values[order]

    def margins(self, index, values, first):
        """Sum-of-squares identity over the inputs first[i]:first[i + 1]; also the factor sums."""
        vx = self.factors[index] * values[:, None]
        sums = np.add.reduceat(vx, first[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first[:-1])
        flat = np.add.reduceat(self.linear[index] * values, first[:-1])
        return self.bias + flat + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, data, offsets) -> np.ndarray:
        numbers, s = form(data, offsets)
        texts, index, values = self.inputs(numbers, *word_inputs(s))
        margin, _ = self.margins(index, values, np.searchsorted(texts, np.arange(len(numbers) + 1)))
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def fit(numbers, words, labels, seed: int = 7) -> Model:
    """Adam on the logistic loss, both labels weighing the same. words: (slots, values) of every text."""
    rng = np.random.default_rng(seed)
    n, width = numbers.shape
    edges = np.quantile(numbers, np.arange(1, STEPS) / STEPS, axis=0).T
    size = width * (1 + STEPS) + WORD_SLOTS
    model = Model(numbers.mean(axis=0), numbers.std(axis=0) + 1e-6, np.ascontiguousarray(edges), 0.0,
                  np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    text = np.repeat(np.arange(n), [len(w[0]) for w in words])
    texts, index, values = model.inputs(
        numbers, text, np.concatenate([w[0] for w in words]), np.concatenate([w[1] for w in words]))
    values = values.astype(np.float32)
    at = np.searchsorted(texts, np.arange(n + 1))
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (model.linear, model.factors)]
    bias_moments, t = [0.0, 0.0], 0
    for _ in range(_EPOCHS):
        for rows in np.array_split(rng.permutation(n), max(1, n // _BATCH)):
            t += 1
            lengths = at[rows + 1] - at[rows]
            first = np.concatenate([[0], np.cumsum(lengths)])
            take = np.arange(first[-1]) + np.repeat(at[rows] - first[:-1], lengths)
            i, x = index[take], values[take]
            margin, sums = model.margins(i, x, first)
            error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - labels[rows]) * weight[rows] / len(rows)
            each = np.repeat(error, lengths).astype(np.float32) * x
            used, of = np.unique(i, return_inverse=True)
            pair = np.repeat(sums, lengths, axis=0) - model.factors[i] * x[:, None]
            grads = [np.bincount(of, weights=each, minlength=len(used)), np.stack(
                [np.bincount(of, weights=each * pair[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1)]
            for values_, (m, v), g in zip((model.linear, model.factors), moments, grads, strict=True):
                g = g + _DECAY * values_[used]
                m[used] = 0.9 * m[used] + 0.1 * g
                v[used] = 0.99 * v[used] + 0.01 * g * g
                values_[used] -= (_RATE * (m[used] / (1 - 0.9**t)) / (np.sqrt(v[used] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            g = float(error.sum())
            bias_moments = [0.9 * bias_moments[0] + 0.1 * g, 0.99 * bias_moments[1] + 0.01 * g * g]
            model.bias -= _RATE * (bias_moments[0] / (1 - 0.9**t)) / (np.sqrt(bias_moments[1] / (1 - 0.99**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model | None:
    """Model of (doc_id, text) rows with a label in (doc_id, target); null without both labels."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(target) >= 0.5).cast("int").alias("_label"))
    ranked = known.withColumn("_at", F.xxhash64("doc_id"))
    picked = [ranked.where(f"_label = {k}").orderBy("_at", "doc_id").limit(SAMPLE) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1]).select("doc_id", "_label")

    def extract(batches):
        for batch in batches:
            for part, data, offsets in blocks.blocks(batch, "text"):
                numbers, s = form(data, offsets)
                text, slot, value = word_inputs(s)
                cuts = np.searchsorted(text, np.arange(1, len(numbers)))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("_label"), blocks.binary_column(list(numbers)),
                    blocks.binary_column([x.astype(np.int32) for x in np.split(slot, cuts)]),
                    blocks.binary_column([x.astype(np.float32) for x in np.split(value, cuts)]),
                ], names=["doc_id", "label", "numbers", "slots", "weights"])

    # 2 x SAMPLE ids of the sample at most are broadcast
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .mapInArrow(extract, "doc_id bigint, label int, numbers binary, slots binary, weights binary")
        .groupBy("doc_id").agg(F.min(F.struct("label", "numbers", "slots", "weights")).alias("r"))
        .orderBy("doc_id").select("r.*").collect()
    )
    target_values = np.array([r["label"] for r in rows])
    if len(set(target_values.tolist())) < 2:
        return None
    return fit(np.array([np.frombuffer(r["numbers"]) for r in rows]),
               [(np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["weights"], np.float32))
                for r in rows], target_values.astype(np.float64))


def scored(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """All columns and the score of every whole text."""
    kept = docs.drop(column)
    if model is None:
        return kept.withColumn(column, F.lit(1.0))

    def score(batches):
        for batch in batches:
            for part, data, offsets in blocks.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.scores(data, offsets), pa.float64())], names=[*part.schema.names, column])

    return kept.mapInArrow(score, StructType([*kept.schema.fields, StructField(column, DoubleType())]))
