"""Bloom membership as a small table of bitmap words.

The bitmap of `size` bits is cut into words of 512 bits (64 bytes), and only
words with a bit set are kept. The table has at most size / 512 rows whatever
the number of values, 3,907 rows for the 2,000,000 bits of the gate, and that
bound is what makes it safe to broadcast.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import bloom_digest, digest_offset

# --- fixed values: shape of the gate's filter, and of a filter made without one -
GATE_SIZE, GATE_HASHES = 2_000_000, 5
DEFAULT_SIZE, DEFAULT_HASHES = 10_000_000, 7
# ----------------------------------------------------------------------------

_BLOCK = 32_768  # bits in a bitmap of the built-in aggregate
_WORD = 512
_WORD_ROW_BYTES = 256  # a broadcast row with its word, generously
_BROADCAST_BYTES = 64 * 1024 * 1024


def bloom_offsets(df: DataFrame, column: str, size: int = DEFAULT_SIZE, hashes: int = DEFAULT_HASHES) -> DataFrame:
    """One row per hash of every non-null value: its number `hash` and its `offset`."""
    digests = F.array(*[bloom_digest(F.col(column), i) for i in range(hashes)])
    hashed = df.filter(F.col(column).isNotNull()).select("*", F.posexplode(digests).alias("hash", "_digest"))
    return hashed.withColumn("offset", digest_offset(F.col("_digest"), size)).drop("_digest")


def bloom_build(values: DataFrame, size: int = DEFAULT_SIZE, hashes: int = DEFAULT_HASHES,
                column: str = "value") -> DataFrame:
    """(word, bits) of all values. Bits are set on the map side, so the shuffle carries bitmaps, not values."""
    offsets = bloom_offsets(values, column, size, hashes).select("offset")
    blocks = offsets.groupBy((F.col("offset") - F.pmod("offset", F.lit(_BLOCK))).alias("first_bit")).agg(
        F.bitmap_construct_agg(F.pmod("offset", F.lit(_BLOCK))).alias("bitmap")
    )
    words = blocks.select(
        "first_bit", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(_BLOCK // _WORD - 1))).alias("n")
    ).select(
        ((F.col("first_bit") / _WORD).cast("bigint") + F.col("n")).alias("word"),
        F.substring("bitmap", F.col("n") * (_WORD // 8) + 1, F.lit(_WORD // 8)).alias("bits"),
    )
    return words.filter(F.bitmap_count("bits") > 0)


def bloom_bits(words: DataFrame) -> DataFrame:
    """Offsets of the set bits."""
    positions = words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(_WORD - 1))).alias("bit"))
    return positions.filter(_is_set(F.col("bits"), F.col("bit"))).select(
        (F.col("word") * _WORD + F.col("bit")).alias("offset")
    )


def _is_set(bits, position):
    byte = F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.getbit(number, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))


def bloom_contains(df: DataFrame, words: DataFrame, column: str, flag: str,
                   size: int = DEFAULT_SIZE, hashes: int = DEFAULT_HASHES) -> DataFrame:
    """Add `flag`: all bits of the value are set. False positives are possible, false negatives are not.

    Each of the k bits is found by an equi join with the word table, so rows are
    neither multiplied nor shuffled. A bit is only hashed while the ones before it
    were set, which spares most values all but the first. Null and empty values
    are never contained.
    """
    small = (size // _WORD + 1) * _WORD_ROW_BYTES <= _BROADCAST_BYTES
    rows = df.withColumn(flag, F.coalesce(F.col(column) != "", F.lit(False)))
    for i in range(hashes):
        hashed = rows.withColumn("_digest", bloom_digest(F.when(F.col(flag), F.col(column)), i))
        placed = hashed.withColumn("_offset", digest_offset(F.col("_digest"), size))
        placed = placed.withColumn("_word", (F.col("_offset") / _WORD).cast("bigint"))
        side = words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        found = placed.join(F.broadcast(side) if small else side, "_word", "left")
        rows = found.select(*df.columns, _is_set(F.col("_bits"), F.pmod("_offset", F.lit(_WORD))).alias(flag))
    return rows


def bloom_match(df: DataFrame, words: DataFrame, size: int = GATE_SIZE, hashes: int = GATE_HASHES) -> DataFrame:
    """Level 0 flags by Bloom membership instead of the exact list."""
    users = bloom_contains(df, words, "user_id", "user_listed", size, hashes)
    return bloom_contains(users, words, "device_id", "device_listed", size, hashes)
