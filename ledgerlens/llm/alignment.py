"""Alignment of two tokenizers over the same bytes, and how often their ids meet in the corpus.

Both token sequences of a text are cut at byte offsets. The ends of one sequence are
a dictionary from end to index, in which the ends of the other are looked up in
rising order: so the offsets where both have an end come sorted, with their indices in
both. They slice both id lists into groups, and each slice's links - the pairs whose
byte ranges overlap - are expanded by themselves: all pairs if one side is a single
token, else by walking along both.

A pair's count is the number of documents that hold it. Texts are encoded once. Task
by task, documents are closed into chunks of about CHUNK_BYTES; a chunk leaves one
row per document (its distinct pairs and how often each, compressed) and one row per
distinct pair of the chunk. Summed over chunks, those are the counts of the corpus;
what a chunk asks for comes back as one row per pair and chunk, so a pair that is in
every document is one row per chunk and not one per document.

The vocabularies are files; nothing is trained. Special tokens' strings in texts are
plain text. Offsets are bytes of the first tokenizer's text, which has the space that
the second adds by itself.

Defined cases: texts that are null or empty, or that a tokenizer changes (its tokens'
bytes are not the text), have no tokens and all counts 0; repeated rows and ids count
as documents of their own; rows without id are kept; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import packs

CHUNK_BYTES = 8_000_000  # of text; a longer text is a chunk by itself
_BATCH_BYTES = 1_000_000  # of text encoded at once
RESULTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
_SHIFT = 32  # a pair is one number: id of the first tokenizer, then of the second

# --- fixed value: how byte-level vocabularies cut a text before they merge -----------------------
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ------------------------------------------------------------------------------------------------
# Both libraries class these characters alike, and neither runs out of stack.
_PLAIN = re.compile(r"(?!.*\s{1000})[\x00-\u024f]*", re.DOTALL)


def _byte_of_mark() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: its own if it has one, else one from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library.

    Texts of Latin letters and signs are encoded by tiktoken with the merges of the file, in a
    quarter of the time; all others, and files of another make, by the library itself. Ids are the same.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        vocabulary, byte = stated["model"]["vocab"], _byte_of_mark()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte for c in token):
                self.bytes[i] = bytes(byte[c] for c in token)
        self.fast = self._ranked(stated)

    def _ranked(self, stated):
        """The same merges as ranks, if the file has them in the order of their ids and nothing but a byte-level cut before."""
        model, before = stated["model"], stated.get("pre_tokenizer") or {}
        merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        plain = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and not stated.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
            and merged == list(range(256, 256 + len(merged))))
        if not plain:
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("merges", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        fast = [self.fast is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(self.coder.encode_batch_fast([t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [np.array(self.fast.encode_ordinary(t) if f else next(others).ids, np.int64) for t, f in zip(texts, fast, strict=True)]


class Pieces:
    """A SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.coder = SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        self.bytes = [
            bytes([int(piece[3:-1], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.coder.id_to_piece(i)) for i in range(n))]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.coder.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def _loaded(kind, path: str):
    """Coder, the lengths of its tokens, and its ids as texts."""
    coder = kind(path)
    lengths = np.array([len(b) for b in coder.bytes], np.int64)
    return coder, lengths, np.array([str(i) for i in range(len(lengths))], object)


def linked(ids_a: list[int], ends_a: list[int], ids_b: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Pairs of ids whose byte ranges overlap, in order, within a slice that begins and ends with both."""
    out, i, j = [], 0, 0
    while i < len(ids_a) and j < len(ids_b):
        out.append((ids_a[i], ids_b[j]))
        if ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
    return out


def _all_of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places begin[0] .. end[0] - 1, begin[1] .. end[1] - 1 and so on."""
    n = end - begin
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


class Alignment:
    """Groups and links of one text's two token sequences."""

    def __init__(self, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray):
        self.ids_a, self.ids_b, self.ends_a, self.ends_b = ids_a, ids_b, ends_a, ends_b
        at_b = dict(zip(ends_b.tolist(), range(1, len(ids_b) + 1), strict=True))
        cut = np.fromiter(map(at_b.get, ends_a.tolist(), repeat(0)), np.int64, len(ids_a))
        self.cuts_a = np.flatnonzero(cut) + 1
        self.cuts_b = cut[self.cuts_a - 1]
        self.from_a, self.from_b = (np.concatenate([[0], cuts[:-1]]) for cuts in (self.cuts_a, self.cuts_b))
        self.n_of_a, self.n_of_b = self.cuts_a - self.from_a, self.cuts_b - self.from_b

    @property
    def n_groups(self) -> int:
        return len(self.cuts_a)

    def slices(self, which: np.ndarray):
        """(from, to) in the first and in the second sequence, for the groups at the given places."""
        return zip(*(x[which].tolist() for x in (self.from_a, self.cuts_a, self.from_b, self.cuts_b)), strict=True)

    def groups(self) -> list[tuple[list[int], list[int]]]:
        return [(self.ids_a[a:b].tolist(), self.ids_b[c:d].tolist()) for a, b, c, d in self.slices(np.arange(self.n_groups))]

    def links(self) -> np.ndarray:
        """Rows of two ids, in no order."""
        one_a = self.n_of_a == 1  # one token beside one or several
        one_b = ~one_a & (self.n_of_b == 1)
        of_a = [np.repeat(self.ids_a[self.from_a[one_a]], self.n_of_b[one_a]), self.ids_a[_all_of(self.from_a[one_b], self.cuts_a[one_b])]]
        of_b = [self.ids_b[_all_of(self.from_b[one_a], self.cuts_b[one_a])], np.repeat(self.ids_b[self.from_b[one_b]], self.n_of_a[one_b])]
        others = np.flatnonzero(~one_a & ~one_b)
        if len(others):
            ids_a, ends_a, ids_b, ends_b = (x.tolist() for x in (self.ids_a, self.ends_a, self.ids_b, self.ends_b))
            pairs = []
            for a, b, c, d in self.slices(others):
                pairs += linked(ids_a[a:b], ends_a[a:b], ids_b[c:d], ends_b[c:d])
            several = np.array(pairs, np.int64)
            of_a.append(several[:, 0])
            of_b.append(several[:, 1])
        return np.column_stack([np.concatenate(of_a), np.concatenate(of_b)])

    def text(self, names_a: np.ndarray, names_b: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`."""
        shown_a, shown_b = names_a[self.ids_a], names_b[self.ids_b]
        shown = (shown_a[self.from_a] + "|" + shown_b[self.from_b]).tolist()
        several = np.flatnonzero((self.n_of_a > 1) | (self.n_of_b > 1))
        if len(several):
            shown_a, shown_b = shown_a.tolist(), shown_b.tolist()
            for at, (a, b, c, d) in zip(several.tolist(), self.slices(several), strict=True):
                shown[at] = f"{','.join(shown_a[a:b])}|{','.join(shown_b[c:d])}"
        return ";".join(shown)


def aligned(texts: list[str], coder_a, coder_b, length_a: np.ndarray, length_b: np.ndarray) -> list[Alignment | None]:
    """Alignments of texts; None for those that a tokenizer does not give back."""
    known = [i for i, text in enumerate(texts) if text]
    all_a = coder_a.ids([" " + texts[i] for i in known])
    all_b = coder_b.ids([texts[i] for i in known])
    out: list[Alignment | None] = [None] * len(texts)
    for i, ids_a, ids_b in zip(known, all_a, all_b, strict=True):
        whole = (" " + texts[i]).encode()
        if (b"".join(map(coder_a.bytes.__getitem__, ids_a.tolist())) == whole
                and b"".join(map(coder_b.bytes.__getitem__, ids_b.tolist())) == whole):
            out[i] = Alignment(ids_a, np.cumsum(length_a[ids_a]), ids_b, np.cumsum(length_b[ids_b]))
    return out


def _chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    """Rows of kinds doc (chunk and what is known of the document) and pair (chunk, pair, documents of the chunk that hold it)."""
    names = ["kind", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "pair", "docs"]

    def encode(batches):
        coder_a, length_a, names_a = _loaded(ByteLevel, path_a)
        coder_b, length_b, names_b = _loaded(Pieces, path_b)
        context = TaskContext.get()
        chunk, held, seen = context.partitionId() << 32, 0, []

        def counted():
            pairs, n = np.unique(np.concatenate(seen), return_counts=True)
            for at in range(0, len(pairs), 100_000):
                part = slice(at, at + 100_000)
                m = len(pairs[part])
                yield row_batch(["pair"] * m, [chunk] * m, pair=pa.array(pairs[part]), docs=pa.array(n[part]))

        def row_batch(kind, chunks, **columns):
            m = len(kind)
            types = {"doc_id": pa.int64(), "groups": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
            given = {"kind": pa.array(kind, pa.string()), "chunk": pa.array(chunks, pa.int64()), **columns}
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(m, types.get(c, pa.int64())) for c in names], names=names)

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            at = 0
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and (end == at or size < _BATCH_BYTES):
                    size += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
                    end += 1
                found = aligned(texts.slice(at, end - at).to_pylist(), coder_a, coder_b, length_a, length_b)
                numbers, digests, pairs, times = [], [], [], []
                for one in found:
                    if one is None:
                        numbers.append((0, 0, 0, 0))
                        digests.append("")
                        pairs.append(packs.coded(np.zeros(0, np.uint64)))
                        times.append(pairs[-1])
                        continue
                    links = one.links()
                    distinct, n = np.unique((links[:, 0] << _SHIFT) | links[:, 1], return_counts=True)
                    numbers.append((len(one.ids_a), len(one.ids_b), one.n_groups, len(links)))
                    digests.append(hashlib.sha256(one.text(names_a, names_b).encode()).hexdigest())
                    pairs.append(packs.coded(np.diff(distinct, prepend=0)))
                    times.append(packs.coded(n))
                    seen.append(distinct)
                m = end - at
                columns = {c: pa.array([x[k] for x in numbers], pa.int64()) for k, c in enumerate(names[3:7])}
                yield row_batch(["doc"] * m, [chunk] * m, doc_id=ids.slice(at, m), groups=pa.array(digests, pa.string()),
                                pairs=pa.array(pairs, pa.binary()), times=pa.array(times, pa.binary()), **columns)
                held += size
                if held >= chunk_bytes:
                    if seen:
                        yield from counted()
                    chunk, held, seen = chunk + 1, 0, []
                at = end
        if seen:
            yield from counted()

    return docs.select("doc_id", "text").mapInArrow(
        encode, "kind string, chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                "pairs binary, times binary, pair bigint, docs bigint")


def _rated(pairs: DataFrame) -> DataFrame:
    """chunk, pair, count (documents of the corpus) and best (1 where no pair of the same first id has more)."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    first = F.shiftright("pair", _SHIFT)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    rated = counts.join(most, first == most["a"]).select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))
    return pairs.select("chunk", "pair").join(rated, "pair")


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """RESULTS for every row of (doc_id, text); groups is the digest of Alignment.text, '' without tokens."""
    work = packs.Work(docs.sparkSession, "alignment")
    made = work.keep(_chunks(docs, path_a, path_b, chunk_bytes), "chunks", by="kind")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    rows = made.where("kind = 'doc'").select("chunk", *names, "pairs", "times")
    rated = work.keep(_rated(made.where("kind = 'pair'").select("chunk", "pair", "docs")), "rated")

    def summed(key, rows, answers):
        order = np.argsort(answers["pair"].to_numpy())
        pair, count, best = (answers[c].to_numpy()[order] for c in ("pair", "count", "best"))
        totals = np.zeros((2, len(rows)), np.int64)
        for k, (pairs, times) in enumerate(zip(rows["pairs"], rows["times"], strict=True)):
            own = np.cumsum(packs.decoded(pairs))
            if len(own):
                at, n = np.searchsorted(pair, own), packs.decoded(times)
                totals[0, k], totals[1, k] = n @ best[at], n @ count[at]
        return rows.select(names[:-1]).append_column("n_best", pa.array(totals[0])).append_column(
            "count_sum", pa.array(totals[1])).append_column("groups", rows["groups"])

    return rows.groupBy("chunk").cogroup(rated.groupBy("chunk")).applyInArrow(summed, RESULTS)
