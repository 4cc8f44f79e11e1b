"""Katz backoff language model of two orders over words, with Good-Turing discounts.

P(w | u) = d(c) c / c(u)          for a pair seen c = c(u, w) times in training,
           a(u) P(w)              else, where P(w) = d(c) c / N for seen words.

What the discounts of single words leave over is the probability of the unknown
word. a(u) is what the pairs of u leave over, divided by the probability of all
words that were not seen after u, so every history sums to one. A history whose
pairs were all seen too often to be discounted gets one more in its denominator.

Counting and scoring go by chunks of documents and by hash buckets:
1. every chunk sends its distinct words with their training counts; the bucket
   of a word answers with the total and a number for the word (small for frequent
   ones), and stores them in the table of words;
2. every chunk sends its distinct pairs (with the totals of their second words);
   the bucket of the history stores the pairs and what their weights need, and
   answers with totals. Frequent histories are spread over several buckets by
   their second word and their sums added up afterwards;
3. with the discounts known, histories get their weights, and every chunk looks
   its tokens up, pair first, then history weight and word.
The tables lie in the shared work folder, partitioned by kind, a row per bucket.

Words are told apart by 64 bits of one hash and a bucket by another; from then
on by their numbers, so pairs are never mixed up.

Defined cases: a null text is empty and still has its end token. Rows without
doc_id or with a repeated one count like any other. No training rows: the only
known thing is the unknown word, with probability 1, so scores are 0. Null in
the training column means not in training. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import blocks, packs

U = np.uint64
TOP = 5  # counts up to this are discounted
END = U(0x5BF0_3635_1E2D_9A47)  # hash of the end mark
BEGIN, FIRST = 1, 2  # number of the begin mark, and of the first word
_HOT_LISTED = 16_384  # frequent histories at most: their weights go to every task
_ANSWER = "kind string, chunk bigint, bucket bigint, keys binary, counts binary, more binary, sums binary, stats array<bigint>"


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts of counts 1 .. TOP from n[r - 1], the number of types seen r times (TOP + 1 of them).

    Where the estimate is not between 0 and 1 (few or oddly repeated data), all
    counts lose the same share b = n1 / (n1 + 2 n2) of one occurrence instead.
    """
    n1, n2 = n[0], n[1]
    r = np.arange(1, TOP + 1)
    if min(n) > 0:
        common = (TOP + 1) * n[TOP] / n1
        d = ((r + 1) * np.array(n[1:]) / (r * np.array(n[:-1])) - common) / (1 - common) if common != 1 else r * 0.0
        if (d > 0).all() and (d < 1).all():
            return d
    b = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return (r - b) / r


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for every count; 0 stays 0."""
    table = np.concatenate([[0.0], d * np.arange(1, TOP + 1)])
    return np.where(count > TOP, count.astype(np.float64), table[np.minimum(count, TOP).astype(np.int64)])


class Unigrams:
    """Probabilities of words from their training counts."""

    def __init__(self, n: list[int], types: int, tokens: int):
        self.types, self.tokens, self.d = types, tokens, good_turing(n)
        left = float(((1 - self.d) * np.arange(1, TOP + 1) * np.array(n[:TOP])).sum())
        self.size = tokens if left > 0 else tokens + 1
        self.unknown = (left or 1.0) / self.size

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / self.size, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.types + 1.0))


def history_weights(m: np.ndarray, high: np.ndarray, seen: np.ndarray, d: np.ndarray) -> np.ndarray:
    """a(u) from the followers seen 1 .. TOP times, the occurrences of all others, and the seen words' P(w).

    Negative where the denominator is one more than c(u).
    """
    r = np.arange(1, TOP + 1)
    total = m @ r + high
    left = m @ ((1 - d) * r)
    bare = left <= 1e-12
    share = np.where(bare, 1.0 / (total + 1), left / np.maximum(total, 1))
    weight = np.where(total > 0, share / np.maximum(1 - seen, 1e-300), 1.0)
    return np.where(bare & (total > 0), -weight, weight)


class _Tokens:
    """Tokens of a chunk, and its distinct words by (bucket, hash)."""

    def __init__(self, table: pa.Table, buckets: int):
        data, offsets = blocks.strings(table["text"])
        words = blocks.Words(data, offsets, lower=True)
        n = len(words.counts)
        self.first = words.first + np.arange(n + 1)
        key = np.insert(words.hashes(0), words.first[1:], END)
        bucket = np.insert(words.hashes(1), words.first[1:], END) % U(buckets)
        train = table["train"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        self.train = np.repeat(train, np.diff(self.first))
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        self.word = np.empty(len(order), np.int64)  # number of the word of each token
        self.word[order] = np.cumsum(new) - 1
        self.keys, self.bucket = key[new], bucket[new].astype(np.int64)
        self.n_train = np.bincount(self.word[self.train], minlength=len(self.keys))

    def answered(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Training totals and numbers of the words, put together from the buckets' answers."""
        first, _ = packs.runs(self.bucket)
        place = {b: i for i, b in enumerate(answers["bucket"].to_pylist())}
        rows = [place[b] for b in self.bucket[first].tolist()]
        totals, numbers = answers["counts"], answers["more"]
        return (np.concatenate([packs.decoded(totals[i]) for i in rows]),
                np.concatenate([packs.decoded(numbers[i]) for i in rows]))


class _Pairs:
    """Distinct pairs of a chunk by (bucket, history, second word). `n`: training tokens."""

    def __init__(self, tokens: _Tokens, totals: np.ndarray, numbers: np.ndarray, buckets: int, n: int):
        word = tokens.word
        v = len(tokens.keys)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[tokens.first[:-1]] = v  # the begin mark
        kinds, self.of = np.unique(before * (v + 1) + word, return_inverse=True)
        history, second = kinds // (v + 1), kinds % (v + 1)
        ends = totals[word[tokens.first[1] - 1]]  # training has as many begin marks as end marks
        self.seen = np.append(totals, ends)
        h, w = np.append(numbers, BEGIN)[history], numbers[second]
        hot = self.seen[history] > n / min(4 * buckets, _HOT_LISTED)
        parts = np.ceil(self.seen[history] * (4 * buckets) / max(n, 1)).astype(np.int64)
        spread = np.where(hot, (blocks.mix(w.astype(U)) >> U(20)).astype(np.int64) % np.maximum(parts, 1), 0)
        bucket = (blocks.mix(blocks.mix(h.astype(U)) + spread.astype(U)) % U(buckets)).astype(np.int64)
        bucket += np.where(hot, buckets, 0)
        order = np.lexsort((w, h, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[self.of]
        self.bucket, self.h, self.w = bucket[order], h[order], w[order]
        self.history, self.second = history[order], second[order]
        self.n_train = np.bincount(self.of[tokens.train], minlength=len(kinds))
        new = np.ones(len(order), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.run = np.flatnonzero(new)  # first pair of every (bucket, history)
        self.run_of = np.cumsum(new) - 1


def _rows(kind: str, n: int, **columns) -> pa.Table:
    none = {"chunk": pa.int64(), "bucket": pa.int64(), "keys": pa.binary(), "counts": pa.binary(),
            "more": pa.binary(), "sums": pa.binary(), "stats": pa.list_(pa.int64())}
    return pa.table({"kind": pa.array([kind] * n, pa.string()),
                     **{k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in none.items()}})


def _types_by_count(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, TOP + 2).astype(np.int64), minlength=TOP + 3)[1:TOP + 2].tolist()


def word_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of kinds answer (by chunk), words (the table) and stats."""
    def send(key, table):
        found = _Tokens(packs.unpacked(table), buckets)
        first, ends = packs.runs(found.bucket)
        cut = list(zip(first, ends[1:], strict=True))
        return pa.table({
            "bucket": pa.array(found.bucket[first], pa.int64()),
            "chunk": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
            "keys": blocks.binary_column([found.keys[a:b] for a, b in cut]),
            "counts": blocks.binary_column([packs.coded(found.n_train[a:b]) for a, b in cut]),
        })

    def answer(key, table):
        keys = np.concatenate([packs.u64(v) for v in table["keys"]])
        counts = np.concatenate([packs.decoded(v) for v in table["counts"]])
        sizes = [len(v.as_buffer()) // 8 for v in table["keys"]]
        kinds, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, weights=counts, minlength=len(kinds)).astype(np.int64)
        bucket, known, n = key[0].as_py(), total > 0, len(sizes)
        number = np.empty(len(kinds), np.int64)
        number[np.argsort(-total, kind="stable")] = FIRST + np.arange(len(kinds)) * buckets + bucket
        mine, own, at = total[of], number[of], np.concatenate([[0], np.cumsum(sizes)])
        cut = list(zip(at, at[1:], strict=False))
        return pa.concat_tables([
            _rows("answer", n, chunk=table["chunk"].to_pylist(), bucket=[bucket] * n,
                  counts=[packs.coded(mine[a:b]) for a, b in cut], more=[packs.coded(own[a:b]) for a, b in cut]),
            _rows("words", 1, bucket=[bucket], keys=[kinds[known].tobytes()], counts=[packs.coded(total[known])],
                  more=[packs.coded(number[known])]),
            _rows("stats", 1, stats=[[*_types_by_count(total), int(known.sum()), int(total.sum())]]),
        ])

    return (
        packed.groupBy("chunk").applyInArrow(send, "bucket bigint, chunk bigint, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(answer, _ANSWER)
    )


def _added_up(rows: DataFrame) -> list[int]:
    """Sums of the stats of all buckets: one row."""
    n = TOP + 3
    row = rows.where("kind = 'stats'").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n))).first()
    return [int(x or 0) for x in row]


def pair_counts(packed: DataFrame, words: DataFrame, buckets: int, unigrams: Unigrams) -> DataFrame:
    """Rows of kinds answer (by chunk and bucket), pairs (the table), histories (their sums) and stats."""
    def send(key, own, answers):
        tokens = _Tokens(packs.unpacked(own), buckets)
        totals, numbers = tokens.answered(answers)
        found = _Pairs(tokens, totals, numbers, buckets, unigrams.tokens)
        first, ends = packs.runs(found.bucket)
        lengths = np.diff(np.append(found.run, len(found.h)))
        run_at = np.append(np.searchsorted(found.run, first), len(found.run))
        cut = list(zip(first, ends[1:], strict=True))
        run_cut = list(zip(run_at, run_at[1:], strict=False))
        return pa.table({
            "bucket": pa.array(found.bucket[first], pa.int64()),
            "chunk": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
            "histories": blocks.binary_column([packs.coded(found.h[found.run[a:b]]) for a, b in run_cut]),
            "runs": blocks.binary_column([packs.coded(lengths[a:b]) for a, b in run_cut]),
            "seconds": blocks.binary_column([packs.coded(found.w[a:b]) for a, b in cut]),
            "totals": blocks.binary_column([packs.coded(totals[found.second[a:b]]) for a, b in cut]),
            "counts": blocks.binary_column([packs.coded(found.n_train[a:b]) for a, b in cut]),
        })

    def answer(key, table):
        def column(name):
            parts = [packs.decoded(v) for v in table[name]]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

        histories, h_at = column("histories")
        h_kinds, h_of = np.unique(histories, return_inverse=True)
        history = np.repeat(h_of, column("runs")[0])
        second, at = column("seconds")
        order = np.lexsort((second, history))
        hs, ss = history[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        total = np.bincount(of, weights=column("counts")[0], minlength=int(new.sum())).astype(np.int64)
        word = column("totals")[0][order][new]
        hs, ss = hs[new], ss[new]
        known = total > 0
        low = known & (total <= TOP)
        m = np.bincount(hs[low] * TOP + total[low] - 1, minlength=len(h_kinds) * TOP).reshape(-1, TOP)
        high = np.bincount(hs, weights=np.where(total > TOP, total, 0), minlength=len(h_kinds))
        seen = np.bincount(hs, weights=np.where(known, unigrams.probability(word), 0.0), minlength=len(h_kinds))
        bucket, n, mine = key[0].as_py(), len(table), total[of]
        return pa.concat_tables([
            _rows("answer", n, chunk=table["chunk"].to_pylist(), bucket=[bucket] * n,
                  counts=[packs.coded(mine[a:b]) for a, b in zip(at, at[1:], strict=False)],
                  more=[packs.coded(h_of[a:b]) for a, b in zip(h_at, h_at[1:], strict=False)]),
            _rows("pairs", 1, bucket=[bucket], keys=[packs.coded(ss[known])], counts=[packs.coded(total[known])],
                  more=[packs.coded(hs[known])]),
            _rows("histories", 1, bucket=[bucket], keys=[packs.coded(h_kinds)],
                  counts=[packs.coded(np.column_stack([m, high]).T.ravel())], sums=[seen.tobytes()]),
            _rows("stats", 1, stats=[[*_types_by_count(total), int(known.sum()), int(total.sum())]]),
        ])

    sent = "bucket bigint, chunk bigint, histories binary, runs binary, seconds binary, totals binary, counts binary"
    asked = words.where("kind = 'answer'").select("chunk", "bucket", "counts", "more")
    return (
        packed.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(send, sent)
        .groupBy("bucket").applyInArrow(answer, _ANSWER)
    )


def _sums(counts: pa.Scalar, seen: pa.Scalar) -> np.ndarray:
    """Rows of histories: followers seen 1 .. TOP times, occurrences of the others, probability of the seen words."""
    seen = np.frombuffer(seen.as_buffer(), np.float64)
    return np.column_stack([packs.decoded(counts).reshape(TOP + 1, -1).T, seen])


def _frequent(pairs: DataFrame, buckets: int, d: np.ndarray) -> dict[int, float]:
    """Weights of the histories that are spread over buckets; there are _HOT_LISTED at most."""
    def explode(batches):
        for batch in batches:
            for keys, counts, seen in zip(*(batch.column(c) for c in ("keys", "counts", "sums")), strict=True):
                parts = _sums(counts, seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packs.decoded(keys)), *(pa.array(np.ascontiguousarray(c)) for c in parts.T)],
                    names=["history", *(f"s{i}" for i in range(TOP + 2))])

    names = [f"s{i}" for i in range(TOP + 2)]
    rows = (
        pairs.where(f"kind = 'histories' AND bucket >= {buckets}").select("keys", "counts", "sums")
        .mapInArrow(explode, "history bigint, " + ", ".join(f"{n} double" for n in names))
        .groupBy("history").agg(*(F.sum(n).alias(n) for n in names)).collect()
    )
    if not rows:
        return {}
    sums = np.array([r[1:] for r in rows])
    weights = history_weights(sums[:, :TOP], sums[:, TOP], sums[:, TOP + 1], d)
    return dict(zip((r["history"] for r in rows), weights.tolist(), strict=True))


def _weights_by_chunk(pairs: DataFrame, buckets: int, frequent: dict[int, float], d: np.ndarray) -> DataFrame:
    """chunk, bucket, totals of its pairs and weights of its histories."""
    def look_up(key, asked, histories):
        if key[0].as_py() >= buckets:
            weights = np.array([frequent[k] for k in packs.decoded(histories["keys"][0]).tolist()])
        else:
            sums = _sums(histories["counts"][0], histories["sums"][0])
            weights = history_weights(sums[:, :TOP], sums[:, TOP], sums[:, TOP + 1], d)
        return pa.table({
            "kind": pa.array(["pairs"] * len(asked), pa.string()), "chunk": asked["chunk"], "bucket": asked["bucket"],
            "counts": asked["counts"], "more": pa.nulls(len(asked), pa.binary()),
            "weights": blocks.binary_column([weights[packs.decoded(v)] for v in asked["more"]]),
        })

    asked = pairs.where("kind = 'answer'").select("chunk", "bucket", "counts", "more")
    histories = pairs.where("kind = 'histories'").select("bucket", "keys", "counts", "sums")
    return asked.groupBy("bucket").cogroup(histories.groupBy("bucket")).applyInArrow(
        look_up, "kind string, chunk bigint, bucket bigint, counts binary, more binary, weights binary")


def katz_scores(docs: DataFrame) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text, train).

    The model learns from the rows whose `train` is true; scores are log10
    probabilities of the lower-cased words and one end token.
    """
    docs = docs.select("doc_id", "text", "train")
    _, size = packs.corpus_size(docs)
    buckets = packs.parts_for(size)
    packed = packs.packed(docs, packs.chunking(docs, buckets))
    work = packs.Work(docs.sparkSession, "backoff")

    words = work.keep(word_counts(packed, buckets), "words", by="kind")
    *n, types, tokens = _added_up(words)
    unigrams = Unigrams(n, types, tokens)
    pairs = work.keep(pair_counts(packed, words, buckets, unigrams), "pairs", by="kind")
    d = good_turing(_added_up(pairs)[:TOP + 1])
    frequent = _frequent(pairs, buckets, d)

    def score(key, own, answers):
        table = packs.unpacked(own)
        found = _Tokens(table, buckets)
        kind = answers["kind"].to_numpy(zero_copy_only=False)
        totals, numbers = found.answered(answers.filter(pa.array(kind == "words")))
        mine = answers.filter(pa.array(kind == "pairs"))
        pair = _Pairs(found, totals, numbers, buckets, tokens)
        first, _ = packs.runs(pair.bucket)
        place = {b: i for i, b in enumerate(mine["bucket"].to_pylist())}
        rows = [place[b] for b in pair.bucket[first].tolist()]
        count = np.concatenate([packs.decoded(mine["counts"][i]) for i in rows])
        weight = np.concatenate([np.frombuffer(mine["weights"][i].as_buffer(), np.float64) for i in rows])[pair.run_of]
        size = pair.seen[pair.history] + (weight < 0)
        backed = np.abs(weight) * unigrams.probability(totals)[pair.second]
        p = np.where(count > 0, discounted(count, d) / np.maximum(size, 1), backed)
        scores, base = np.log10(p)[pair.of], unigrams.base(totals)[found.word]
        return pa.table({
            "doc_id": table["doc_id"], "train": table["train"],
            "n_tokens": pa.array(np.diff(found.first).astype(np.int64)),
            "n_known": pa.array(blocks.sums_between(totals[found.word] > 0, found.first)),
            "train_tokens": pa.array(np.full(len(table), tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, found.first[:-1])),
            "score": pa.array(np.add.reduceat(scores, found.first[:-1])),
        })

    asked = words.where("kind = 'answer'").select(
        F.lit("words").alias("kind"), "chunk", "bucket", "counts", "more",
        F.lit(None).cast("binary").alias("weights"))
    answers = asked.unionByName(_weights_by_chunk(pairs, buckets, frequent, d))
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double")
