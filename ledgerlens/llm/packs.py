"""Documents in chunks of neighbouring ids, packed for the way between tasks, and results between jobs.

Some operators need the same documents together several times: to send what they
hold, and to meet the answers. A chunk is a range of ids, so chunk numbers rise
with the ids. It travels as a few compressed Arrow streams instead of rows.
"""

from __future__ import annotations

import io
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import blocks
from ledgerlens.session import work_folder

CHUNK_CHARS = 4_000_000  # text of a chunk or a hash bucket, about
LEAST_CHUNKS = 256
MOST_BOUNDS = 4_096  # ids that go to the driver to cut the chunks; further cuts are even inside these
NO_ID = np.iinfo(np.int64).min  # stands for a missing id, before all others
_PACK_BYTES = 16_000_000
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """A fresh folder below the shared one, for what an operator writes between its jobs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, work_folder(spark, name)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes (in a folder for each value of `by`) and rereads.

        This cuts the lineage, and frees the shuffle files of the job at its end.
        """
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_freed(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


@dataclass(frozen=True)
class Chunking:
    """Chunk numbers of ids: `bounds` are the least ids of the ranges, each cut into `parts` even parts."""

    bounds: np.ndarray
    parts: int

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds[1:], ids, side="right")
        if self.parts == 1:
            return at
        low = self.bounds[at].astype(np.float64)
        high = np.append(self.bounds[1:], self.bounds[-1] + 1)[at].astype(np.float64)
        inside = (ids.astype(np.float64) - low) * self.parts / np.maximum(high - low, 1.0)
        return at * self.parts + np.clip(inside, 0, self.parts - 1).astype(np.int64)

    @property
    def count(self) -> int:
        return len(self.bounds) * self.parts


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def parts_for(text_bytes: int) -> int:
    return max(LEAST_CHUNKS, -(-text_bytes // CHUNK_CHARS))


def chunking(docs: DataFrame, chunks: int) -> Chunking:
    ranges = min(chunks, MOST_BOUNDS)
    shares = [i / ranges for i in range(ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges)).alias("b"),
                     F.min("doc_id").alias("m")).first()
    bounds = np.unique(np.array([found["m"], *(found["b"] or [])] if found["m"] is not None else [0], np.int64))
    return Chunking(bounds, -(-chunks // ranges))


def heads(docs: DataFrame, plan: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Least id of every chunk that has rows, and the chunk with rows before it (before the first comes the last)."""
    def least(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            chunk = plan.numbers(ids)
            order = np.lexsort((ids, chunk))
            first, _ = runs(chunk[order])
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order][first]), pa.array(ids[order][first])], names=["chunk", "id"])

    rows = docs.select("doc_id").mapInArrow(least, "chunk bigint, id bigint").groupBy("chunk").agg(F.min("id").alias("id"))
    found = sorted((r["chunk"], r["id"]) for r in rows.collect())
    chunks, ids = np.array([c for c, _ in found], np.int64), np.array([i for _, i in found], np.int64)
    return ids, np.roll(chunks, 1)


def packed(docs: DataFrame, plan: Chunking, next_heads: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """chunk and pack (an Arrow stream of the rows): to be grouped by chunk.

    With `next_heads`, rows with the least id of a chunk also go to the chunk before, marked `extra`.
    """
    def pack(batches):
        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += table.nbytes
            if size >= _PACK_BYTES:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    def cut(tables):
        table = pa.concat_tables(tables).combine_chunks()
        if not table.num_rows:
            return
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        chunk = plan.numbers(ids)
        if next_heads is not None:
            at = np.minimum(np.searchsorted(next_heads[0], ids), len(next_heads[0]) - 1)
            again = np.flatnonzero(next_heads[0][at] == ids)
            table = pa.concat_tables([table, table.take(pa.array(again))])
            table = table.append_column("extra", pa.array(np.arange(len(table)) >= len(ids)))
            chunk = np.append(chunk, next_heads[1][at[again]])
        order = np.argsort(chunk, kind="stable")
        table, chunk = table.take(pa.array(order)).combine_chunks(), chunk[order]
        at = np.flatnonzero(np.diff(chunk, prepend=-1))
        for begin, end in zip(at, np.append(at[1:], len(chunk)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(chunk[begin])], pa.int64()), pa.array([to_stream(table.slice(begin, end - begin))], pa.binary())],
                names=["chunk", "pack"])

    return docs.mapInArrow(pack, "chunk bigint, pack binary")


def to_stream(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue()


def unpacked(packs: pa.Table, column: str = "pack") -> pa.Table:
    """Rows of all packs by doc_id, nulls first; rows of one id by their text."""
    tables = []
    for value in packs[column]:
        with pa.ipc.open_stream(value.as_buffer()) as reader:
            tables.append(reader.read_all())
    table = pa.concat_tables(tables)
    ids = table["doc_id"].fill_null(NO_ID).to_numpy()
    known = np.diff(ids)
    if (known > 0).all() and table["doc_id"].null_count == 0:
        return table
    order = pc.sort_indices(
        table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)


def u64(value) -> np.ndarray:
    """The numbers in a binary value."""
    return np.frombuffer(value.as_buffer() if isinstance(value, pa.Scalar) else value, np.uint64)


def coded(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs, compressed byte place by byte place."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def decoded(value: pa.Scalar) -> np.ndarray:
    raw = value.as_buffer()
    width = raw[0] if isinstance(raw[0], int) else raw[0][0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(raw)[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel().astype(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of every run of equal values, and the end of the last."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    new = np.empty(len(sorted_values), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return first, np.append(first, len(sorted_values))


__all__ = ["CHUNK_CHARS", "Chunking", "Work", "blocks", "chunking", "coded", "corpus_size", "decoded", "heads", "packed", "parts_for", "runs",
           "shuffles_freed", "to_stream", "u64", "unpacked"]
