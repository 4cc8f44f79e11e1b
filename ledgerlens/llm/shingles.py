"""Sets of word shingles of the texts of a block."""

from __future__ import annotations

import numpy as np

from ledgerlens.llm import blocks

WIDTH = 5


class ShingleSets:
    """Distinct shingle hashes of every text, ascending: `hashes[first[i]:first[i + 1]]`.

    Words are lower-cased (A-Z). A text of fewer than WIDTH words has its whole
    sequence as its only shingle, a text without words has none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
        words = blocks.Words(data, offsets, lower=True)
        numbers = words.hashes(0)
        at = blocks.windows(words, width)
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        hashes = np.concatenate([
            blocks.range_hashes(numbers, at, at + width, blocks.TOKEN_BASES[0]),
            blocks.range_hashes(numbers, words.first[short], words.first[short + 1], blocks.TOKEN_BASES[0])])
        owner = np.concatenate([np.searchsorted(words.first, at, side="right") - 1, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.sizes = np.diff(self.first)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every whole set."""
        out = []
        for salt in (0x2545_F491_4F6C_DD1D, 0x8F5D_2E4B_71A3_C60B):
            total = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(blocks.mix(self.hashes ^ np.uint64(salt)), out=total[1:])
            out.append(blocks.mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64)))
        return out[0], out[1]

    def parities(self) -> list[np.ndarray]:
        """Bit sketches of 4 to 8 bits per element (a power of two, 64 at least).

        Each element turns one bit over, so the sketches of two sets differ in no
        more bits than the sets do in elements. Halves laid over one another are
        the sketch of half the size.
        """
        level = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(np.int64)
        words = np.maximum(1, (8 << level) >> 6)
        at = np.concatenate([[0], np.cumsum(words)])
        bit = blocks.mix(self.hashes ^ np.uint64(0x6A09_E667_F3BC_C908)).astype(np.int64) & ((words << 6) - 1)[self.owner]
        out = np.zeros(at[-1], np.uint64)
        np.bitwise_xor.at(out, at[self.owner] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return np.split(out, at[1:-1])


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Sketches (in the last dimension) brought to a smaller size."""
    while parity.shape[-1] > words:
        half = parity.shape[-1] // 2
        parity = parity[..., :half] ^ parity[..., half:]
    return parity


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elements in which the sets of two sketches differ at least."""
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)
