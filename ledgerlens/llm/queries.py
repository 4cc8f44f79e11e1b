"""Named queries that apply the operators to the whole supplied tables, and their SQL twins."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    alignment, backoff, chat, factorisation, jaccard, merkle, mixing, multiindex, outliers, packs, pieces, secrets, substrings, syncmers,
)
from ledgerlens.llm.shipping import ship

QUERIES = {}
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def _query(run):
    @wraps(run)
    def query(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = query
    return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int):
    """crc32 of a key as text, modulo `by`; a missing key counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % by


@_query
def op1_chat_formatting(spark, sf_dir):
    """All conversations and one that writes control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.posexplode(F.array(
        F.lit("user"), F.lit("assistant"))).alias("turn", "role")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = chat.formatted(turns.unionByName(planted)).withColumn("turns", chat.read_back(F.col("formatted")))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = chat.learned_text(F.col("formatted"), F.col("loss_mask"))
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@_query
def op2_closed_syncmers(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    found = syncmers.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


@_query
def op3_jaccard_join(spark, sf_dir):
    """Components of near copies among all documents."""
    return jaccard.linked_components(_table(spark, sf_dir, "documents"))


@_query
def op4_katz_backoff(spark, sf_dir):
    """Log probabilities of all documents under a model of those outside the fold."""
    docs = _table(spark, sf_dir, "documents").withColumn("train", remainder("doc_id", 7) != 2)
    return backoff.katz_scores(docs).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op5_factorisation_machine(spark, sf_dir):
    """Quality of all documents, learnt from the labels outside the fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = factorisation.train(docs, labels.where(remainder("doc_id", 4) != 2))
    return factorisation.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= factorisation.THRESHOLD).cast("int").alias("predicted"))


@_query
def op6_nbest_pieces(spark, sf_dir):
    """The three best segmentations of all documents, and the best one decoded."""
    rows = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL).drop("text")
    return pieces.decode(rows, PIECE_MODEL).select(
        "doc_id", "n_pieces", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "scores", "alternatives")


@_query
def op7_robust_outliers(spark, sf_dir):
    """Base rules and outliers per language and source, over all documents."""
    return outliers.robust_outliers(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@_query
def op8_secret_scan(spark, sf_dir):
    """Secrets in all documents: the base kinds and high entropy."""
    found = secrets.found_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(secrets.of_kind(F.col("secrets"), k)).cast("bigint").alias(f"n_{name}")
              for k, name in enumerate(secrets.KINDS[:3])]
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed(F.col("secrets")).alias("spans"))


@_query
def op9_substring_dedup(spark, sf_dir):
    """Passages of 20 words or more that start earlier in the corpus, removed."""
    found = substrings.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op10_temperature_mixing(spark, sf_dir):
    """As many tokens as the corpus has, flattened to 95 % of the greatest entropy, no source more than four times."""
    work = packs.Work(spark, "mixing")
    known = work.keep(mixing.units(_table(spark, sf_dir, "documents")), "units")
    return mixing.planned(known, work, target_entropy=0.95, most_repeats=4.0).select(
        "doc_id", "source", "copies", "n_tokens", "epoch", "start")


@_query
def op11_multi_index(spark, sf_dir):
    """The ten nearest of all other vectors for every hundredth one."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multiindex.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@_query
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of all documents; line ends deleted from half of them, and found by the proof."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, {"text": text})
    return found.withColumn("folded_root", merkle.folded(F.col("path"), F.col("changed_leaf"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@_query
def op13_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers over all documents, with how often the linked ids meet in the corpus."""
    found = alignment.aligned_documents(_table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL)
    return found.withColumnRenamed("groups", "groups_sha256")
