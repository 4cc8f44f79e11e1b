"""Hash expressions used for Bloom offsets and reproducible splits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 4294967296  # 2^32: the digest is folded eight hex digits at a time


def bloom_digest(value: Column, salt: int) -> Column:
    """Hex SHA-256 of the utf8 value followed by the two-byte salt."""
    return F.sha2(F.concat(F.encode(value, "UTF-8"), F.lit(salt.to_bytes(2, "big"))), 256)


def digest_offset(digest: Column, size: int) -> Column:
    """Digest, read as a big-endian number, mod `size`. Give it a column: it reads the digest eight times.

    The 256-bit remainder is folded over eight 32-bit chunks, which stays inside
    a bigint as long as size is below 2^31.
    """
    if not 0 < size < 2**31:
        raise ValueError("size must be between 1 and 2^31 - 1")
    remainder = F.lit(0).cast("bigint")
    for start in range(1, 65, 8):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        remainder = (remainder * _CHUNK + chunk) % F.lit(size)
    return remainder


def hash_order(key: Column, seed: int) -> Column:
    """32-bit pseudo-random number of a key that any engine can reproduce (md5 prefix)."""
    text = F.concat(key.cast("string"), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
