"""Alignment of two tokenizers against overlaps of all token pairs, and the counts of a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import alignment
from ledgerlens.llm.queries import BYTE_MODEL
from tests.llm.conftest import MODEL

CODERS = alignment.ByteLevel(BYTE_MODEL), alignment.Pieces(MODEL)
TEXTS = [
    "Hello world, this is a test.", "", None, "naïve café — 中文字符 \U0001F600!", "tab\tand\nnew  lines   here", " leading space",
    "<|endoftext|> and </s> <s> as text", "▁ marks are changed", "<0x41> <0x0A>", "x" * 3000, "Ünïcödé ürgeschichtlich " * 40,
    "Hello world, this is a test.", "don't can't we'll 12345678 3.14159", "\x00\x01 control", "nbsp here", "ａｂｃ ﬁ",
]


def spans(coder, text):
    """(id, from, to) of every token, or nothing if the bytes are not those of space and text."""
    given = (" " + text) if isinstance(coder, alignment.ByteLevel) else text
    (ids,) = coder.ids([given])
    if b"".join(coder.bytes[i] for i in ids) != (" " + text).encode():
        return None
    ends = np.cumsum([len(coder.bytes[i]) for i in ids]).tolist()
    return list(zip(ids.tolist(), [0, *ends], ends))


def plain(text):
    """Groups and linked pairs, from the byte ranges alone."""
    a, b = (spans(c, text) if text else None for c in CODERS)
    if a is None or b is None:
        return [], [], 0, 0
    links = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
    groups, start = [], 0
    for end in sorted({x[2] for x in a} & {y[2] for y in b}):
        groups.append(tuple([x[0] for x in side if start <= x[1] and x[2] <= end] for side in (a, b)))
        start = end
    return groups, links, len(a), len(b)


def brute(texts):
    parts = [plain(t) for t in texts]
    count = Counter(pair for _, links, _, _ in parts for pair in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for groups, links, n_a, n_b in parts:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


def expected(rows):
    return sorted(str(("row", r[0], *x)) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True))


def plain_rows(found):
    return sorted(str(("row", *r)) for r in found)


@pytest.mark.parametrize("chunk", [alignment.CHUNK_BYTES, 1])
def test_equals_overlaps_of_all_pairs(spark, chunk):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = alignment.aligned_documents(docs, BYTE_MODEL, MODEL, chunk).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert plain_rows(found) == expected(rows)


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 1500).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = alignment.aligned_documents(docs, BYTE_MODEL, MODEL).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert len(rows) > 50 and plain_rows(found) == expected(rows)


def test_vocabulary_bytes_are_all_bytes():
    assert sorted(alignment._byte_of_mark().values()) == list(range(256))
    assert {bytes([b]) for b in range(256)} <= set(CODERS[0].bytes)


def test_both_encoders_give_the_same_ids():
    coder, rng = CODERS[0], random.Random(1)
    texts = [form.replace("?", chr(c)) for c in range(0x250) for form in ("a?b", " ? ", "??a", "1?2", "  ?", "'?s", "!?!", "\n?\n")]
    signs = [chr(c) for c in range(0x250)] + list(" \n\t'.,abc012 ") * 20
    texts += ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(3000)] + ["x" * 20_000, "a " * 5000]
    assert coder.fast is not None and all(alignment._PLAIN.fullmatch(t) for t in texts)
    assert [i.tolist() for i in coder.ids(texts)] == [e.ids for e in coder.coder.encode_batch(texts, add_special_tokens=False)]


def test_long_runs_of_space_and_other_scripts():
    texts = [" " * 50_000, "a" + "\n" * 3000 + "b", "\u0100\u4e2d " * 50]
    assert not any(alignment._PLAIN.fullmatch(t) for t in texts)
    assert [sum(len(CODERS[0].bytes[i]) for i in ids) for ids in CODERS[0].ids(texts)] == [len(t.encode()) for t in texts]


def test_odd_rows_and_empty_table(spark, odd):
    found = {(r.doc_id, r.n_a): r for r in alignment.aligned_documents(odd, BYTE_MODEL, MODEL).collect()}
    assert len(alignment.aligned_documents(odd, BYTE_MODEL, MODEL).collect()) == odd.count()
    assert found[(2, 0)].n_links == 0 and found[(1, 0)].groups == ""
    assert alignment.aligned_documents(odd.where("false"), BYTE_MODEL, MODEL).count() == 0
