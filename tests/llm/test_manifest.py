"""Merkle manifest against a plain tree in Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, pos int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    parts = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def climb(nodes, fanout):
    """Root, and the steps (before, after) of every node."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, pos in enumerate(at):
            run = pos - pos % fanout
            steps[k].append(("".join(nodes[run:pos]), "".join(nodes[pos + 1:run + fanout])))
        nodes = [sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [pos // fanout for pos in at]
    return nodes[0], steps


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row.source].append((row, plain_leaf(row, row.text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner, subroots = {}, []
    for source in order:
        groups[source].sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        subroot, inner[source] = climb([x[1] for x in groups[source]], fanout)
        subroots.append(subroot)
    root, outer = climb(subroots, fanout)
    out = []
    for k, source in enumerate(order):
        for (row, leaf), steps in zip(groups[source], inner[source], strict=True):
            way = steps + outer[k]
            h = plain_leaf(row, row.text.replace("\n", "") if row.text else row.text)
            for before, after in way:
                h = sha(before + h + after)
            out.append((str(row.doc_id), leaf, subroots[k], root, "".join(b + a for b, a in way), h))
    return sorted(out)


def measured(docs, fanout=3):
    found = merkle.manifest(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, fanout=fanout)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded) for r in found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_text(F.col("path")).alias("proof"),
        merkle.folded(F.col("path"), F.col("changed_leaf")).alias("folded")).collect())


def rows_of(sizes):
    rows = []
    for source, n in sizes:
        for i in range(n):
            text = [f"line {i}\nend", "", None, "Ü\n中"][i % 4]
            rows.append((None if i == 5 else i * 7, source, None if i % 3 else "en", None if i % 5 == 0 else i, text, "x", 1))
    return rows


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_a_plain_tree(spark, fanout):
    rows = rows_of([("a", 40), (None, 10), ("", 1), ("é", 9), ("B", 2), ("z", 27), ("y", 28)])
    docs = spark.createDataFrame(rows, SCHEMA)
    assert measured(docs, fanout) == plain_manifest(docs.collect(), fanout)


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 1), ("b", 1)], [("a", 4)]])
def test_smallest_trees(spark, sizes):
    docs = spark.createDataFrame(rows_of(sizes), SCHEMA)
    assert measured(docs) == plain_manifest(docs.collect(), 3)


def test_repeated_rows_have_places_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a", "en", 3, "abc", "x", 1)] * 60 + [(None, None, None, None, None, None, None)] * 7, SCHEMA)
    got = measured(docs)
    assert got == plain_manifest(docs.collect(), 3) and len(got) == 67


def test_a_changed_row_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame(rows_of([("a", 12), ("b", 3)]), SCHEMA)
    found = merkle.manifest(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}).withColumn(
        "good", merkle.folded(F.col("path"), F.col("changed_leaf")) == F.col("root"))
    assert {r.good for r in found.where("leaf = changed_leaf").collect()} == {True}
    assert {r.good for r in found.where("leaf <> changed_leaf").collect()} == {False}


def test_empty_table_and_odd_rows(spark, odd):
    assert merkle.manifest(odd.where("false")).count() == 0
    assert measured(odd) == plain_manifest(odd.collect(), 3)
