"""The pipeline's stages against plain versions, and the columns they give back."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import factorisation, jaccard, pieces, secrets
from ledgerlens.llm.queries import remainder
from tests.llm.conftest import MODEL
from tests.llm.test_texts import shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
T = "one two three four five six seven eight nine ten"
U = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def survivors(spark, rows):
    return sorted(((str(r.doc_id), r.text) for r in jaccard.without_near_copies(table(spark, rows)).collect()), key=str)


def components(texts):
    """Components of texts by links of 0.75 or more."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                of[top(i)] = top(j)
    return [top(i) for i in range(len(texts))], sets


def test_copies_of_rows_without_ids_go(spark):
    assert survivors(spark, [(1, T), (None, T), (None, T), (None, U), (None, U)]) == [("1", T), ("None", U)]


def test_no_text_is_lost_under_a_repeated_id(spark):
    assert survivors(spark, [(1, T), (2, U), (2, T)]) == [("1", T), ("2", U)]


def test_rows_without_words_and_repeated_rows(spark):
    rows = [(1, T), (1, T), (1, T + " eleven"), (3, None), (3, None), (3, " \n"), (4, "")]
    got = survivors(spark, rows)
    assert [i for i, t in got if t and t.strip()] == ["1"] and len([1 for _, t in got if not (t or "").strip()]) == 4


def test_survivors_of_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    of, sets = components([t for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        least[c] = min(i, least.get(c, i))
    wanted = [i for (i, _), c, s in zip(rows, of, sets, strict=True) if not s or least[c] == i]
    assert sorted(r.doc_id for r in jaccard.without_near_copies(docs).collect()) == wanted and len(wanted) < len(rows)


def test_long_chains_and_hubs_are_one_component(spark):
    base = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(f"x{k}-{i}" if k < 8 * (i % 12) else base[k] for k in range(400))) for i in range(12)]
    slide = [(100 + i, " ".join(f"s{k}" for k in range(8 * i, 8 * i + 300))) for i in range(40)]
    rows = chain + slide
    of, _ = components([t for _, t in rows])
    wanted = {i: min(rows[k][0] for k in range(len(rows)) if of[k] == of[at]) for at, (i, _) in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in jaccard.linked_components(table(spark, rows)).collect()}
    assert got == wanted and wanted[139] == 100


def test_run_equals_its_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    scored = factorisation.scored(docs, factorisation.train(docs, labels)).where(F.col("score") >= factorisation.THRESHOLD)
    rows = sorted((r.doc_id, r.text, r.source) for r in scored.collect())
    of, sets = components([t for _, t, _ in rows])
    first = {}
    for (i, _, _), c in zip(rows, of, strict=True):
        first[c] = min(i, first.get(c, i))
    kept = {i: (t, s) for (i, t, s), c, own in zip(rows, of, sets, strict=True) if not own or first[c] == i}
    spans = {r.doc_id: r.secrets for r in secrets.found_secrets(scored).collect()}

    def redacted(i, text):
        out, at = [], 0
        for start, _, end in sorted((s.start, s.kind, s.end) for s in spans[i]):
            if start >= at and not (out and start == at and at):
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join(out) + text[at:] if spans[i] else text

    wanted = {i: redacted(i, t or "") for i, (t, _) in kept.items()}
    got = pieces.decode(corpus_pipeline.run(spark, sf_dir), MODEL).select("doc_id", "source", "decoded").collect()
    assert {r.doc_id for r in got} == set(wanted) and all(r.decoded == wanted[r.doc_id] for r in got)
    # every row passes, and no source's rows differ by more than one pass
    times = collections.Counter(r.doc_id for r in got)
    for source in {s for _, s in kept.values()}:
        own = [times[i] for i, (_, s) in kept.items() if s == source]
        assert min(own) >= 1 and max(own) - min(own) <= 1


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_columns_with_names_of_results_stay(spark, sf_dir, stage):
    names = ["secrets", "score", "_digest", "_score", "_at", "key", "row", "times", "n", "class", "label", "worded", "turn", "_Secrets"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for name in names:
        if name.lower() not in (c.lower() for c in docs.columns):
            docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    out = stage[1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in docs.columns[5:])
