"""Inverted multi-index against brute force: recall, exact scores, copies, and odd rows."""

from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import multiindex

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def brute(rows, most=10):
    """Nearest of every queried id: (id, vec_id, score), for one vector an id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.sqrt(np.square(x - x[i]).sum(1))
        others = ids != ids[i]
        order = np.lexsort((ids[others], score[others]))[:most]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[others][order], score[others][order], strict=True)]
    return out


def measured(df, **options):
    out = {}
    for r in multiindex.nearest(df, df.where("vec_id % 100 = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for found in out.values():
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
    return {q: [f[1:] for f in found] for q, found in out.items()}


def recall(got, wanted):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in found}) / max(1, len(found)) for q, found in wanted.items()])


def table(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], 1, 0.5) for i, x in rows], SCHEMA)


def clustered(n, d, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    x = centers[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))
    return list(enumerate(x.astype(np.float32)))


def test_recall_and_scores(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet").collect()]
    for given in (rows, clustered(4000, 9)):
        wanted, got = brute(given), measured(table(spark, given))
        assert set(got) == set(wanted) and all(len(got[q]) == 10 for q in got) and recall(got, wanted) >= 0.9
        exact = {i: np.array(x, np.float32).astype(np.float64) for i, x in given}
        for q, found in got.items():
            assert [i for i, s in sorted(found, key=lambda f: (f[1], f[0]))] == [i for i, _ in found]
            assert all(s == pytest.approx(np.linalg.norm(exact[q] - exact[i]), rel=1e-14) for i, s in found)


def test_small_tiles_and_blocks_change_nothing(spark):
    rows = clustered(1500, 6)
    assert measured(table(spark, rows), tile=7, query_block=3) == measured(table(spark, rows))


def test_copies_are_found_by_the_least_ids(spark):
    # a third of all rows share one vector, and queries are among them
    rows = [(i, [1.0, 0.0, 0.0, 1.0] if i % 3 == 0 else x) for i, x in clustered(1800, 4)]
    got, wanted = measured(table(spark, rows)), brute(rows)
    for q in (0, 300, 600, 1500):
        assert got[q] == wanted[q]
    assert [i for i, _ in got[300]] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27] and recall(got, wanted) >= 0.9


def test_few_candidates(spark):
    rows = [(100 * i, [1.0 + i, 2.0]) for i in range(4)]
    got = measured(table(spark, rows))
    assert got == brute(rows) and len(got[0]) == 3
    assert measured(table(spark, rows[:1])) == {}


def test_odd_rows_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1, 0.5), (0, [1.0, 1.0], 1, 0.5), (1, [1.0, 2.0], 1, 0.5), (2, [nan, 1.0], 1, 0.5), (3, [inf, 1.0], 1, 0.5),
        (4, [None, 1.0], 1, 0.5), (5, None, None, None), (6, [], 1, 0.5), (7, [0.0, -0.0], 1, 0.5), (8, [1.0, 1.0, 1.0], 1, 0.5),
        (None, [1.0, 1.5], 1, 0.5), (9, [1.0, 0.0], 1, 0.5), (9, [1.0, 3.0], 1, 0.5), (100, None, 1, 0.5), (200, [3.0, 1.0], 1, 0.5),
        (200, [9.0, 9.0], 1, 0.5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = measured(df)
    assert [i for i, _ in got[0]] == [1, 9, 200] and [s for _, s in got[0]] == [1.0, 1.0, 2.0]
    assert set(got) == {0, 200} and [i for i, _ in got[200]] == [0, 1, 9]
    empty = df.where("false")
    assert multiindex.nearest(empty, empty).count() == 0
    assert multiindex.nearest(df, empty).count() == 0
    assert multiindex.nearest(df.where("vec_id in (5, 6)"), df).count() == 0


def test_walk_goes_by_the_sum():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    walked = list(multiindex.walk(a, b))
    sums = [a[i] + b[j] for i, j in walked]
    assert len(set(walked)) == 63 and sums == sorted(sums)
    assert list(islice(multiindex.walk(a, b), 1)) == [(int(a.argmin()), int(b.argmin()))]


def test_tiles_hold_one_row_of_cells():
    held = np.array([0, 3, 3, 9, 1, 0, 2, 2, 2])
    first, parts = multiindex.tiles(held, 3, 4)
    assert parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1]
    of = {}
    for cell, n in enumerate(held):
        for tile in range(first[cell], first[cell] + parts[cell]):
            if n:
                of.setdefault(int(tile), []).append(cell)
    assert all(len({c // 3 for c in cells}) == 1 for cells in of.values())
    assert all(sum(held[c] for c in cells) <= 4 or len(cells) == 1 for cells in of.values())


def test_extra_columns_are_not_read(spark):
    df = table(spark, clustered(300, 4)).withColumns({"rank": F.lit(1), "query_id": F.lit("x"), "cell": F.lit(2), "tile": F.lit(3)})
    assert multiindex.nearest(df, df.where("vec_id = 100")).columns == ["query_id", "rank", "vec_id", "score"]
