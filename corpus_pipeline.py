"""From raw documents to encoded training data.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor
kept. All but the last return the columns they got, whatever their names; null texts
are empty; an empty table passes through.

1. quality classifier: documents scored below the threshold go;
2. near copies: of each component one row stays, that with the least id (rows
   without id last), then the least digest of its text; rows without words all stay;
3. secrets: every stretch found is replaced by a mark;
4. mixing: rows pass as often as the weights of their source ask, every source at
   least once;
5. pieces: the three best segmentations of every text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import factorisation, jaccard, mixing, pieces, secrets
from ledgerlens.llm.queries import PIECE_MODEL, remainder
from ledgerlens.llm.shipping import ship

ENTROPY, MOST_REPEATS = 0.9, 1.25
_FOLD = 4


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", _FOLD) != 2)
    score = _fresh(docs, "score")
    scored = factorisation.scored(docs, factorisation.train(docs, labels), column=score)
    return scored.where(F.col(score) >= factorisation.THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.without_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = _fresh(docs, "secrets")
    found = secrets.found_secrets(docs, into=spans)
    hit = F.size(spans) > 0
    changed = found.withColumn("text", F.when(hit, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, target_entropy=ENTROPY, most_repeats=MOST_REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(docs, PIECE_MODEL).select("doc_id", "lang", "source", *pieces.RESULTS.names)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None  # classifier and segmentation have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
