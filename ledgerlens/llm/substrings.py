"""Removal of word passages that occur earlier in the corpus.

Every window of `width` words gets a Rabin-Karp hash (a polynomial over its
words' hashes, from prefix sums). Windows are counted bucket by bucket: a chunk
of neighbouring documents sends each distinct hash once, so a passage that all
documents share costs one number per chunk; the bucket answers to each chunk
which of its hashes an earlier chunk holds. Repeats inside a chunk need no
answer. The words under all repeated windows form maximal intervals.

Two windows count as equal when 64 bits agree and a second hash gives the same
bucket. Only numbers are shuffled twice, the texts once per job, compressed.

Defined cases: null text is no words; texts shorter than a window lose nothing;
rows of one doc_id are ordered by their text, rows without doc_id come first;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm import blocks, packs

WIDTH = 20
_OUT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_text string"


class _Windows:
    """Windows of a chunk by (bucket, hash), first occurrences before later ones."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        self.data, self.offsets = blocks.strings(table["text"])
        self.words = words = blocks.Words(self.data, self.offsets)
        self.at = blocks.windows(words, width)
        key = blocks.range_hashes(words.hashes(0), self.at, self.at + width, blocks.TOKEN_BASES[0])
        other = blocks.range_hashes(words.hashes(1), self.at, self.at + width, blocks.TOKEN_BASES[1])
        bucket = (other % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.at, key, bucket))
        self.at, self.key, self.bucket = self.at[order], key[order], bucket[order]
        self.new = np.ones(len(order), bool)
        self.new[1:] = (self.key[1:] != self.key[:-1]) | (self.bucket[1:] != self.bucket[:-1])


def repeated_hashes(packed: DataFrame, width: int, buckets: int) -> DataFrame:
    """chunk, bucket and the hashes of the chunk that an earlier chunk holds as well."""
    def send(key, table):
        found = _Windows(packs.unpacked(table), width, buckets)
        keys, bucket = found.key[found.new], found.bucket[found.new]
        first, ends = packs.runs(bucket)
        return pa.table({
            "bucket": pa.array(bucket[first], pa.int64()),
            "chunk": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
            "hashes": blocks.binary_column([keys[a:b] for a, b in zip(first, ends[1:], strict=True)]),
        })

    def answer(key, table):
        parts = [packs.u64(v) for v in table["hashes"]]
        hashes = np.concatenate(parts)
        chunk = np.repeat(table["chunk"].to_numpy(), [len(p) for p in parts])
        order = np.lexsort((chunk, hashes))
        hashes, chunk = hashes[order], chunk[order]
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        hashes, chunk = hashes[again], chunk[again]
        order = np.argsort(chunk, kind="stable")
        hashes, chunk = hashes[order], chunk[order]
        first, ends = packs.runs(chunk)
        return pa.table({
            "chunk": pa.array(chunk[first], pa.int64()),
            "bucket": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
            "hashes": blocks.binary_column([hashes[a:b] for a, b in zip(first, ends[1:], strict=True)]),
        })

    return (
        packed.groupBy("chunk").applyInArrow(send, "bucket bigint, chunk bigint, hashes binary")
        .groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket bigint, hashes binary")
    )


def _removed(table: pa.Table, answers: pa.Table, width: int, buckets: int) -> pa.Table:
    found = _Windows(table, width, buckets)
    again = ~found.new
    first, ends = packs.runs(found.bucket)
    place = dict(zip(found.bucket[first].tolist(), zip(first, ends[1:], strict=True), strict=True))
    for bucket, value in zip(answers["bucket"].to_pylist(), answers["hashes"], strict=True):
        begin, end = place[bucket]
        again[begin:end] |= np.isin(found.key[begin:end], packs.u64(value))
    words = found.words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found.at[again], 1)
    np.add.at(change, found.at[again] + width, -1)
    gone = np.cumsum(change[:-1]) > 0

    doc = words.text_of()
    edge = np.zeros(len(words) + 1, bool)  # intervals end with their document
    edge[words.first] = True
    begins = np.flatnonzero(gone & (~np.append(False, gone[:-1]) | edge[:-1])) if len(words) else np.zeros(0, np.int64)
    stops = np.flatnonzero(gone & (~np.append(gone[1:], False) | edge[1:])) + 1 if len(words) else np.zeros(0, np.int64)
    owner = doc[begins]
    spans = pa.StructArray.from_arrays(
        [pa.array((begins - words.first[owner]).astype(np.int32)), pa.array((stops - words.first[owner]).astype(np.int32))],
        names=["start", "end"])
    span_offsets = np.searchsorted(owner, np.arange(len(words.counts) + 1))

    kept = ~gone
    spaced = np.append(found.data, np.uint8(0x20))
    bytes_, offsets = blocks.gathered(spaced, words.starts[kept], (words.ends - words.starts)[kept] + 1)
    bytes_[offsets[1:] - 1] = 0x20
    n_kept = blocks.sums_between(kept, words.first)
    upto = np.concatenate([[0], np.cumsum(n_kept)])
    bounds = offsets[upto]
    drop = np.unique(bounds[1:][n_kept > 0] - 1)  # the space behind a document's last word
    bytes_ = np.delete(bytes_, drop)
    bounds = bounds - np.concatenate([[0], np.cumsum(n_kept > 0)])
    return pa.table({
        "doc_id": table["doc_id"].combine_chunks(),
        "n_words": pa.array(words.counts.astype(np.int64)),
        "n_removed": pa.array((words.counts - n_kept).astype(np.int64)),
        "removed": pa.ListArray.from_arrays(pa.array(span_offsets.astype(np.int32)), spans),
        "kept_text": blocks.string_column(bytes_, bounds),
    })


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, removed word intervals and kept_text (words joined by one space) of every row."""
    docs = docs.select("doc_id", "text")
    _, size = packs.corpus_size(docs)
    buckets = packs.parts_for(size)
    plan = packs.chunking(docs, buckets)
    packed = packs.packed(docs, plan)
    work = packs.Work(docs.sparkSession, "substrings")
    answers = work.keep(repeated_hashes(packed, width, buckets), "repeated")

    def cut(key, own, found):
        return _removed(packs.unpacked(own), found, width, buckets)

    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, _OUT)
