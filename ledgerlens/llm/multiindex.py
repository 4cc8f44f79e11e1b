"""Nearest vectors by an inverted multi-index.

Each half of the vectors has its own codebook of k centroids, so k * k pairs of
centroids are the cells of the index. A query sorts the centroids of each half by
distance and walks the pairs by the sum of both squared distances with a heap, until
the cells it took hold a share of all vectors; what they hold is compared exactly.

The codebooks, and the share that reaches RECALL, come from a sample of SAMPLE
vectors at most (those with the least hashes of their ids); every vector is indexed.
On the driver are only codebooks and the counts of k * k cells (k is MOST_CENTROIDS at
most). Cells of one centroid of the first half are put together to tiles of about TILE
vectors; a larger cell is dealt over several tiles. A query goes to each tile of its cells
once, so no task holds more than a tile and QUERY_BLOCK queries.

Equal vectors are one entry with the `most + 1` least ids: no larger id can be
among the nearest, as ties go to the smaller id. Equal queries are searched once.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinity take
no part, nor do rows without id or those whose dimension is not the most frequent one
(of several, the least); repeated rows of an id and vector are one; of different
vectors under one id the nearest counts, and the least is asked; a query's own id is
never found; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import packs

SAMPLE = 16_384
_SAMPLE_NUMBERS = 4_000_000  # vectors of many dimensions: fewer of them
MOST_CENTROIDS = 256
_PER_CELL = 8  # vectors a cell, about, until there are MOST_CENTROIDS
ROUNDS = 12
RECALL = 0.97  # aimed at in the sample
TRIALS = 256  # queries of the sample
TILE = 8_192
QUERY_BLOCK = 65_536
RESULTS = "query_id bigint, rank int, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that can take part, each once."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & whole & F.exists(x, lambda v: v != 0)).distinct()


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """Of every vector the `most` least ids."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).drop("_n")


def matrix(column) -> np.ndarray:
    """Vectors of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (x.shape[1] + 1) // 2
    return x[:, :middle], x[:, middle:]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k-means; a centroid that loses all its vectors moves to the one that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        distance = squared(x, centroids)
        nearest = distance.argmin(1)
        held = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
        far = np.argsort(-distance[np.arange(len(x)), nearest], kind="stable")
        empty = np.flatnonzero(held == 0)
        centroids[empty] = x[far[:len(empty)]]
    return centroids


def walk(first: np.ndarray, second: np.ndarray):
    """Pairs (i, j) by first[i] + second[j], least first; equal sums in the order of the sorted places."""
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_first].tolist(), second[by_second].tolist()
    i_of, j_of = by_first.tolist(), by_second.tolist()
    # row p of the sorted grid holds one open place at a time; a row opens when the one before has begun
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        _, p, q = heapq.heappop(heap)
        yield i_of[p], j_of[q]
        if q == 0 and p + 1 < len(a):
            heapq.heappush(heap, (a[p + 1] + b[0], p + 1, 0))
        if q + 1 < len(b):
            heapq.heappush(heap, (a[p] + b[q + 1], p, q + 1))


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def k(self) -> int:
        return len(self.first)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = halves(x)
        return squared(a, self.first), squared(b, self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def taken(self, first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
        """Cells in the order of the walk until they hold `enough` vectors; empty cells are left out."""
        cells, seen = [], 0
        for i, j in walk(first, second):
            n = held[i * self.k + j]
            if n:
                cells.append(i * self.k + j)
                seen += n
                if seen >= enough:
                    break
        return cells


def fitted(sample: np.ndarray, k: int) -> tuple[Codebooks, float]:
    """Codebooks and the share of vectors to look at, so that RECALL of the ten nearest of the trials are among them."""
    a, b = halves(sample)
    books = Codebooks(codebook(a, k), codebook(b, k))
    cells = books.cells(sample)
    held = np.bincount(cells, minlength=k * k)
    trials = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(np.int64)
    first, second = books.distances(sample[trials])
    needed = []
    for n, trial in enumerate(trials):
        order = np.argsort((first[n][:, None] + second[n]).ravel(), kind="stable")  # the whole walk at once
        seen = np.zeros(k * k, np.int64)
        seen[order] = np.cumsum(held[order])
        far = squared(sample[trial:trial + 1], sample)[0]
        far[trial] = np.inf
        nearest = np.argsort(far, kind="stable")[:min(10, len(sample) - 1)]
        needed.append(seen[cells[nearest]] / len(sample))
    needed = np.concatenate(needed) if needed else np.zeros(0)
    return books, float(np.quantile(needed, RECALL)) if len(needed) else 1.0


def tiles(held: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First tile of every cell and how many it is dealt over. A tile has cells of one first centroid."""
    first, parts = np.zeros(k * k, np.int64), np.maximum(1, -(-held // size))
    tile, filled = -1, 0
    for cell, n in enumerate(held.tolist()):
        if cell % k == 0 or parts[cell] > 1 or filled + n > size:
            tile, filled = tile + 1, 0
        first[cell] = tile
        if parts[cell] > 1:
            tile, filled = tile + int(parts[cell]) - 1, size
        else:
            filled += n
    return first, parts


def _with_cells(rows: DataFrame, books) -> DataFrame:
    def assign(batches):
        for batch in batches:
            cells = books.value.cells(matrix(batch.column("embedding"))) if len(batch) else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(cells, pa.int64()))

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id bigint, embedding {kind}, cell bigint")


def _visits(queries: DataFrame, books, plan, enough: int) -> DataFrame:
    """tile, block of queries, query, embedding and cells (binary) of every tile that a query goes to."""
    def send(batches):
        held, first_tile, parts = plan.value
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if not len(batch):
                continue
            first, second = books.value.distances(x)
            for at in range(len(batch)):
                cells = np.array(books.value.taken(first[at], second[at], held, enough), np.int64)
                n = parts[cells]
                cell = np.repeat(cells, n)
                tile = np.repeat(first_tile[cells], n) + np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                order = np.argsort(tile, kind="stable")
                tile, cell = tile[order], cell[order].astype(np.int32)
                begin, ends = packs.runs(tile)
                m = len(begin)
                yield pa.RecordBatch.from_arrays([
                    pa.array(tile[begin], pa.int64()), batch.column("query").take(pa.array(np.full(m, at))),
                    batch.column("embedding").take(pa.array(np.full(m, at))),
                    pa.array([cell[a:b].tobytes() for a, b in zip(begin, ends[1:], strict=True)], pa.binary()),
                ], names=["tile", "query", "embedding", "cells"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(send, f"tile bigint, query bigint, embedding {kind}, cells binary")


def _compared(entries: DataFrame, visits: DataFrame, most: int) -> DataFrame:
    """query, vec_id and score of the `most` nearest of every tile that a query goes to."""
    def compare(key, entries, visits):
        ids, cell, x = entries["vec_id"].to_numpy(), entries["cell"].to_numpy(), matrix(entries["embedding"])
        query, y = visits["query"].to_numpy(), matrix(visits["embedding"])
        repeated = len(np.unique(ids)) < len(ids)
        out = [], [], []
        for n, cells in enumerate(visits["cells"]):
            among = np.flatnonzero(np.isin(cell, np.frombuffer(cells.as_buffer(), np.int32)))
            if not len(among):
                continue
            score = np.sqrt(np.square(x[among] - y[n]).sum(1))
            if repeated:  # of the vectors of one id the nearest counts
                order = np.lexsort((score, ids[among]))
                order = order[packs.runs(ids[among][order])[0]]
                among, score = among[order], score[order]
            if len(among) > most:  # all that tie with the last one stay for the order by id
                near = score <= np.partition(score, most - 1)[most - 1]
                among, score = among[near], score[near]
            order = np.lexsort((ids[among], score))[:most]
            out[0].append(np.full(len(order), query[n]))
            out[1].append(ids[among[order]])
            out[2].append(score[order])
        names = ("query", "vec_id", "score")
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({name: np.concatenate([none, *part]) for name, none, part in zip(names, empty, out, strict=True)})

    keys = ["tile", "block"]
    return entries.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(
        compare, "query bigint, vec_id bigint, score double")


def _sampled(entries: DataFrame, n: int, most: int) -> np.ndarray:
    """Vectors with the least hashes. The filter keeps the order from seeing more than a few times as many."""
    digest = F.xxhash64("vec_id", "embedding")
    share = min(1.0, 2.0 * most / n)
    few = entries.where(F.pmod(digest, F.lit(1 << 30)) <= int(share * (1 << 30)))
    return matrix(few.orderBy(F.pmod(digest, F.lit(1 << 30)), "vec_id", "embedding").limit(most).select(
        "embedding").toArrow()["embedding"])


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10, recall_sample: int = SAMPLE, tile: int = TILE,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """RESULTS: the `most` nearest of `vectors` for every row of `queries` (both vec_id, embedding), nearest first."""
    spark = vectors.sparkSession
    work = packs.Work(spark, "multiindex")
    rows = usable(vectors)
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], RESULTS)
    fits = F.size("embedding") == usual["d"]
    entries = work.keep(entries_of(rows.where(fits), most + 1), "entries")
    asked = work.keep(usable(queries).where(fits).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    n = entries.count()
    sample = _sampled(entries, n, max(2, min(recall_sample, _SAMPLE_NUMBERS // usual["d"])))
    k = max(1, min(MOST_CENTROIDS, int((n / _PER_CELL) ** 0.5), len(sample) // 4))
    books, share = fitted(sample, k)

    shared = spark.sparkContext.broadcast(books)
    placed = work.keep(_with_cells(entries, shared), "cells")
    held = np.zeros(k * k, np.int64)
    for row in placed.groupBy("cell").count().collect():  # k * k rows at most
        held[row["cell"]] = row["count"]
    first_tile, parts = tiles(held, k, tile)
    plan = spark.sparkContext.broadcast((held, first_tile, parts))
    enough = max(most + 1, int(np.ceil(share * n)))

    # equal queries are asked once, under the least of their ids
    once = work.keep(asked.groupBy("embedding").agg(F.min("vec_id").alias("query")), "queries")
    query_blocks = max(1, -(-once.count() // query_block))
    block = F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")
    visits = _visits(once.select("query", "embedding"), shared, plan, enough).withColumn("block", block)
    known = spark.createDataFrame(
        [(c, int(first_tile[c]), int(parts[c])) for c in np.flatnonzero(held).tolist()], "cell bigint, first bigint, parts bigint")
    # one row for each cell, k * k at most
    dealt = placed.join(F.broadcast(known), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("tile"), "vec_id", "embedding", "cell",
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"))
    found = work.keep(_compared(dealt, visits, most + 1), "found")

    by_query = found.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    best = by_query.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answered = asked.join(once.join(lists, "query").select("embedding", "near"), "embedding")
    own = F.filter("near", lambda f: f["vec_id"] != F.col("vec_id"))
    return answered.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(own, 1, most)).alias("_at", "_found")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_found.vec_id").alias("vec_id"),
        F.col("_found.score").alias("score"))
