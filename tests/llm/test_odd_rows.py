"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: defined results for all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import backoff, chat, factorisation, jaccard, mixing, outliers, packs, pieces, secrets, substrings, syncmers
from tests.llm.conftest import MODEL


def results(docs, spark):
    labels = spark.createDataFrame([(4, 1), (4, None), (8, 0), (None, 1)], "doc_id bigint, quality int")
    work = packs.Work(spark, "odd")
    return {
        2: lambda: syncmers.edited_fingerprints(docs), 3: lambda: jaccard.linked_components(docs),
        4: lambda: backoff.katz_scores(docs.withColumn("train", F.col("source") == "a")),
        5: lambda: factorisation.scored(docs, factorisation.train(docs, labels)),
        6: lambda: pieces.decode(pieces.encode(docs, MODEL), MODEL),
        7: lambda: outliers.robust_outliers(docs), 8: lambda: secrets.found_secrets(docs),
        9: lambda: substrings.remove_repeated_passages(docs),
        10: lambda: mixing.planned(work.keep(mixing.units(docs), "units"), work, 0.95, 4.0),
    }


@pytest.mark.parametrize("operator", [2, 3, 4, 5, 6, 7, 8, 9, 10])
def test_empty_table(spark, odd, operator):
    assert results(odd.where("false"), spark)[operator]().count() == 0


@pytest.mark.parametrize("operator", [2, 3, 4, 5, 6, 7, 8, 9])
def test_a_row_for_every_row(spark, odd, operator):
    assert results(odd, spark)[operator]().count() == odd.count()


def test_joined_odd_rows(odd):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.linked_components(odd).collect())
    long = 97  # distinct shingles of the repeating words
    assert got == sorted([
        ("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", long, "4"), ("5", long, "4"), ("5", long, "4"), ("None", long, "4"),
        ("None", 1, "6"), ("6", 1, "6"), ("7", 1, "7"), ("8", 1, "8")])


def test_repeats_in_odd_rows(odd):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.remove_repeated_passages(odd).collect()}
    # the row without an id is first and keeps its first 97 + 19 words
    assert got[(None, 30_000)] == 30_000 - 97 and got[(4, 30_000)] == got[(5, 30_000)] == 30_000 and got[(2, 0)] == 0


def test_pieces_of_odd_rows(odd):
    rows = pieces.decode(pieces.encode(odd, MODEL), MODEL).select("text", "decoded", "n_pieces").collect()
    assert all((r.text or "") == r.decoded for r in rows) and {r.n_pieces for r in rows if not r.text} == {0}


def test_mixing_repeats_and_empty_sources(spark):
    rows = [(i, f"w{i} " * 10, "big") for i in range(80)] + [(100 + i, f"v{i} " * 10, "small") for i in range(20)]
    rows += [(200, "", "none"), (201, None, "none"), (0, "w0 " * 10, "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = mixing.mixed(docs, 1.0, 2.0).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    got = {r.source: (r.n, r.d) for r in kept.collect()}
    assert got["big"] == (81, 80) and got["none"] == (2, 2) and got["small"][1] == 20 and 38 <= got["small"][0] <= 41


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "a\\</s>"), (1, 1, "user", None), (1, 1, "assistant", "\\\\[INST]\n<|end|>"), (None, None, None, None),
            (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [
        ("user", "a\\</s>"), ("assistant", "\\\\[INST]\n<|end|>"), ("user", "")]
    assert got[1].learned == "\\\\[INST]\n<|end|>" and [tuple(t) for t in got[None].turns] == [("", "")]
    assert [tuple(t) for t in got[2].turns] == [("assistant", "")] * 2 and len(got[2].loss_mask) == 2
    assert chat.formatted(df.where("false")).count() == 0


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.where("false")):
        rows = start
        for _, stage in corpus_pipeline.STAGES:
            before, rows = rows.columns, stage(spark, rows, sf_dir)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert rows.columns == before
        rows.collect()
