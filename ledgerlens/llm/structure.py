"""Counts that describe the form of texts, for all texts of a block at once."""

from __future__ import annotations

import numpy as np

from ledgerlens.llm import blocks

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _class(test) -> np.ndarray:
    return np.array([bool(test(chr(b))) and b < 128 for b in range(256)])


_UPPER = _class(str.isupper)
_DIGIT = _class(str.isdigit)
_MARKS = _class(lambda c: c in ".,;:!?'\"()-")
_BANG = _class(lambda c: c in "!?")


def _within(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that are equal only if the texts are the same as well."""
    with np.errstate(over="ignore"):
        return blocks.mix(keys ^ blocks.mix(owner.astype(np.uint64) + np.uint64(0x632B_E59B_D9B4_E019)))


class Structure:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = blocks.Words(data, offsets)
        n = len(offsets) - 1
        self.n_words = words.counts.astype(np.int64)
        outside = blocks.SPACE[data]
        letters = ~outside & ((data & 0xC0) != 0x80)
        self.n_bytes = np.diff(offsets)
        self.word_chars = blocks.sums_between(letters, offsets)
        self.n_symbols, self.n_upper, self.n_digits, self.n_marks, self.n_bangs = (
            blocks.sums_between(kind[data], offsets) for kind in (_SYMBOLS, _UPPER, _DIGIT, _MARKS, _BANG))

        self.hashes = words.hashes(0)
        owner = words.text_of()
        self.n_distinct = self._distinct(self.hashes, owner, n)

        at = blocks.windows(words, 3)
        key = _within(blocks.range_hashes(self.hashes, at, at + 3, blocks.TOKEN_BASES[0]), owner[at])
        _, of, times = np.unique(key, return_inverse=True, return_counts=True)
        again = at[times[of] > 1]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + 3, -1)
        self.n_repeat_words = blocks.sums_between(np.cumsum(change[:-1]) > 0, words.first)

        cuts = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
        line_owner = np.repeat(np.arange(n), blocks.sums_between(data == 10, offsets) + 1)
        ends = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
        held = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends, line_owner = starts[held], ends[held], line_owner[held]
        lines = blocks.range_hashes(blocks.byte_numbers(blocks.BASES[1])[data], starts, ends, blocks.BASES[1])
        self.n_lines = np.bincount(line_owner, minlength=n)
        self.n_dup_lines = self.n_lines - self._distinct(lines, line_owner, n)

    @staticmethod
    def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        _, first = np.unique(_within(hashes, owner), return_index=True)
        return np.bincount(owner[first], minlength=n)
