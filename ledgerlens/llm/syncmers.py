"""Fingerprints of documents from closed syncmers.

A k-mer (K bytes of UTF-8) is a closed syncmer if the least hash of its S-byte
substrings is the first or the last one. That depends on the k-mer alone, so an
edit only touches the anchors that overlap it. A fingerprint keeps the least
hashes of the distinct syncmers (M at most) with the place of their first
occurrence. Likeness of two fingerprints is the share of common anchors among
the least of both, where anchors only count as common if they moved as far as
the median common anchor (give or take SLACK bytes).

Defined cases: null text is the empty text, whose fingerprint is empty; two empty
fingerprints are alike (1), an empty and another one are not (0); a text shorter
than K bytes, or without a syncmer, is one anchor. Equal texts have equal
fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.llm import blocks, packs

K, S, M = 24, 9, 64
SLACK = 256
MOST_HEADS = 262_144
_UNIT = 8  # places are kept in units of so many bytes
_PLACES = 0xFFFFF


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte places and texts (by index) of the closed syncmers."""
    n = len(data)
    wide = K - S + 1
    if n < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - S + 1)
    small = blocks.range_hashes(blocks.byte_numbers(blocks.BASES[0])[data], at, at + S, blocks.BASES[0])
    least, span = small, 1
    while span * 2 <= wide:  # least of the next `span` hashes, doubling
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = wide - span
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    starts = np.flatnonzero((small[:len(least)] == least) | (small[wide - 1:wide - 1 + len(least)] == least))
    text = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + K <= offsets[text + 1]
    starts, text = starts[inside], text[inside]
    hashes = blocks.range_hashes(blocks.byte_numbers(blocks.BASES[1])[data], starts, starts + K, blocks.BASES[1])
    return hashes >> np.uint64(32), starts - offsets[text], text


class Sketches:
    """Least anchors of every text: rows of hashes (padded with the largest number) and places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        hashes, places, text = anchors(data, offsets)
        bare = np.flatnonzero((np.bincount(text, minlength=n) == 0) & (offsets[1:] > offsets[:-1]))
        whole = blocks.range_hashes(
            blocks.byte_numbers(blocks.BASES[1])[data], offsets[bare], offsets[bare + 1], blocks.BASES[1])
        hashes = np.concatenate([hashes, whole >> np.uint64(32)]).astype(np.int64)
        places, text = np.append(places, bare * 0), np.append(text, bare)
        order = np.lexsort((places, hashes, text))
        hashes, places, text = hashes[order], places[order], text[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, places, text = hashes[new], places[new], text[new]
        first = np.searchsorted(text, np.arange(n + 1))
        rank = np.arange(len(text)) - first[text]
        kept = rank < M
        self.hashes = np.full((n, M), 1 << 32, np.int64)
        self.places = np.zeros((n, M), np.int64)
        self.hashes[text[kept], rank[kept]] = hashes[kept]
        self.places[text[kept], rank[kept]] = np.minimum(places[kept] // _UNIT, _PLACES)

    def texts(self) -> list[str]:
        out = []
        for hashes, places in zip(self.hashes.tolist(), self.places.tolist(), strict=True):
            out.append("".join(["%08x%05x" % x for x in zip(hashes, places, strict=True) if x[0] < 1 << 32]))
        return out

    def rows(self, take: np.ndarray) -> Sketches:
        part = object.__new__(Sketches)
        part.hashes, part.places = self.hashes[take], self.places[take]
        return part


def likeness(a: Sketches, b: Sketches) -> np.ndarray:
    """Likeness of the fingerprints in the same rows."""
    n = len(a.hashes)
    none = 1 << 32
    both = np.concatenate([a.hashes, b.hashes], axis=1)
    place = np.concatenate([a.places, b.places], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    both, place = np.take_along_axis(both, order, 1), np.take_along_axis(place, order, 1)
    twin = np.zeros(both.shape, bool)  # second of two equal hashes
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < none)
    union = np.cumsum(~twin & (both < none), axis=1)
    size = np.minimum(union[:, -1], np.minimum(M, np.maximum((a.hashes < none).sum(1), (b.hashes < none).sum(1))))
    common = twin & (union <= size[:, None])
    moved = np.zeros(both.shape)
    moved[:, 1:] = place[:, 1:] - place[:, :-1]
    moved = np.where(common, moved, np.nan)
    has = common.any(axis=1)
    middle = np.zeros(n)
    if has.any():
        middle[has] = np.nanmedian(moved[has], axis=1)
    good = common & (np.abs(np.where(common, moved, 0) - middle[:, None]) <= SLACK / _UNIT)
    return np.where(size > 0, good.sum(axis=1) / np.maximum(size, 1), 1.0)


def code_point_starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _edited(data, offsets, n_chars, following):
    """Every text with its last quarter replaced by the beginning of the text in row `following`."""
    starts = np.flatnonzero(np.append(code_point_starts(data), True))  # byte of every code point, and the end
    first = np.searchsorted(starts, offsets)
    quarter = n_chars // 4
    keep = starts[first[:-1] + n_chars - quarter] - offsets[:-1]
    take = starts[first[following] + np.minimum(quarter, n_chars[following])] - offsets[following]
    parts = np.empty(2 * len(keep), np.int64)
    sizes = np.empty(2 * len(keep), np.int64)
    parts[::2], parts[1::2] = offsets[:-1], offsets[following]
    sizes[::2], sizes[1::2] = keep, take
    bytes_, at = blocks.gathered(data, parts, sizes)
    return bytes_, at[::2]


def _compared(table: pa.Table) -> pa.Table:
    """All rows but the last, each with the row behind it."""
    data, offsets = blocks.strings(table["text"])
    n_chars = blocks.sums_between(code_point_starts(data), offsets)
    following = np.minimum(np.arange(len(table)) + 1, len(table) - 1)
    new, new_offsets = _edited(data, offsets, n_chars, following)
    rows = np.arange(len(table) - 1)
    sketches, edited = Sketches(data, offsets), Sketches(new, new_offsets).rows(rows)
    own = sketches.rows(rows)
    return pa.table({
        "doc_id": table["doc_id"].slice(0, len(rows)),
        "n_chars": pa.array(n_chars[rows]),
        "edited_text": blocks.string_column(new[:new_offsets[len(rows)]], new_offsets[:len(rows) + 1]).cast(pa.string()),
        "fingerprint": pa.array(own.texts(), pa.string()),
        "edited_fingerprint": pa.array(edited.texts(), pa.string()),
        "near_edited": pa.array(likeness(own, edited)),
        "near_next": pa.array(likeness(own, sketches.rows(rows + 1))),
    })


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns and `fingerprint`, without any shuffle."""
    def sketch(batches):
        for batch in batches:
            for part, data, offsets in blocks.blocks(batch, column):
                texts = pa.array(Sketches(data, offsets).texts(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "fingerprint"])

    kept = docs.drop("fingerprint")
    return kept.mapInArrow(sketch, StructType([*kept.schema.fields, StructField("fingerprint", StringType())]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of (doc_id, text) and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by as many from
    the beginning of the next row by (doc_id, text), nulls first; after the last
    row comes the first. Rows go to tasks by ranges of ids; only the first rows of
    the ranges (MOST_HEADS at most, listed on the driver) go to two.
    """
    docs = docs.select("doc_id", "text")
    _, size = packs.corpus_size(docs)
    plan = packs.chunking(docs, min(MOST_HEADS, max(1024, packs.parts_for(size))))
    packed = packs.packed(docs, plan, packs.heads(docs, plan))

    def compare(key, table):
        rows = packs.unpacked(table)
        extra = rows["extra"].to_numpy()
        own, after = rows.filter(pa.array(~extra)), rows.filter(pa.array(extra)).slice(0, 1)
        rows = pa.concat_tables([own, after]).select(["doc_id", "text"]).combine_chunks()
        sizes = np.diff(blocks.strings(own["text"])[1])
        return pa.concat_tables([
            _compared(rows.slice(begin, end - begin + 1)) for begin, end in blocks.slices(sizes)])

    return packed.groupBy("chunk").applyInArrow(
        compare, "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")
