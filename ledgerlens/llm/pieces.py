"""SentencePiece encoding with the N best segmentations, and decoding.

A text is written with U+2581 for each space and one in front, and cut where no
piece reaches across (the pair of characters is in no piece): these stretches,
words mostly, have lattices of their own. A forward Viterbi pass over all distinct
stretches of a block finds best and second-best scores. The N best of the text
differ from its best only in the N - 1 stretches with the least gap to their second
best, so only these get a backward A* search: from the end of the lattice, with
the forward scores as exact heuristics, paths come out in order. Their lists are
merged to the N best sums.

A path's score is the sum of its pieces' scores in the model file. Characters
without a piece of their own are written as byte pieces, for UNKNOWN less than the
least score. U+2581 in a text is written as bytes as well, so decoding gives
back every text exactly.

Defined cases: null text is empty and has no pieces; a text with fewer
segmentations than N has as many as there are; equal scores come in the order of
later stretches, then fewer changes; repeated rows are encoded like any other;
other columns are kept and those named like a result replaced.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ledgerlens.llm import blocks

N = 3
UNKNOWN = 10.0
MARK = 0x2581
_LITERAL = 0x110000  # a mark that stands in the text itself
_LONG = 40  # stretches up to this are worked on together
_NONE = -1e18
_BITS = 20
_BYTES = 600_000
RESULTS = StructType([
    StructField("n_pieces", LongType()), StructField("ids", ArrayType(IntegerType())),
    StructField("scores", ArrayType(DoubleType())),
    StructField("alternatives", ArrayType(ArrayType(StructType([
        StructField("at", IntegerType()), StructField("drop", IntegerType()), StructField("ids", ArrayType(IntegerType()))])))),
])


class Pieces:
    """Pieces of a model file by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [(model.id_to_piece(i), model.get_score(i), i) for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.texts = [b""] * model.get_piece_size()
        for text, _, i in rows:
            self.texts[i] = text.replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.texts[i] = bytes([b])
        self.longest = max(len(t) for t, _, _ in rows)
        self.unknown = min(s for _, s, _ in rows if s > -1e8) - UNKNOWN
        codes = np.frombuffer("".join(t for t, _, _ in rows).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t, _, _ in rows])
        starts = ends - [len(t) for t, _, _ in rows]
        keys = blocks.range_hashes(_numbers(codes), starts, ends, blocks.TOKEN_BASES[1])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, _, i in rows])[order]
        self.scores = np.array([s for _, s, _ in rows])[order]
        slots = (self.keys >> np.uint64(64 - _BITS)).astype(np.int64)
        self.slot = np.full(1 << _BITS, -1, np.int32)  # last piece of every slot
        self.slot[slots] = np.arange(len(slots))
        self.shared = np.bincount(slots, minlength=1 << _BITS) > 1
        self.by_text = {t: (s, i) for t, s, i in rows}
        inner = np.ones(len(codes), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        self.joined = np.unique(codes[at - 1].astype(np.int64) << 21 | codes[at].astype(np.int64))
        data = b"".join(self.texts)
        self.data = np.frombuffer(data, np.uint8)
        self.lengths = np.array([len(t) for t in self.texts])
        self.places = np.cumsum(self.lengths) - self.lengths

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every hash among the pieces, or -1."""
        slots = (keys >> np.uint64(64 - _BITS)).view(np.int64)
        out = self.slot[slots]
        some = np.flatnonzero(out >= 0)
        wrong = some[self.keys[out[some]] != keys[some]]
        out[wrong] = -1
        wrong = wrong[self.shared[slots[wrong]]]  # another piece of the slot, perhaps
        if len(wrong):
            at = np.minimum(np.searchsorted(self.keys, keys[wrong]), len(self.keys) - 1)
            good = self.keys[at] == keys[wrong]
            out[wrong[good]] = at[good]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _numbers(codes: np.ndarray) -> np.ndarray:
    return blocks.mix(codes.astype(np.uint64) + np.uint64(0x1F83_D9AB_FB41_BD6B))


def _written(code: int) -> str:
    return chr(MARK) if code == _LITERAL else chr(code)


def edges(model: Pieces, codes: list[int]) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """For every end in a stretch: the beginnings, scores and ids of the pieces that end there."""
    text = "".join("\x00" if c == _LITERAL else chr(c) for c in codes)
    out: list[list] = [[] for _ in range(len(codes) + 1)]
    for end in range(1, len(codes) + 1):
        for start in range(max(0, end - model.longest), end):
            if _LITERAL not in codes[start:end] and (found := model.by_text.get(text[start:end])):
                out[end].append((start, found[0], (found[1],)))
        if not any(start == end - 1 for start, _, _ in out[end]):
            raw = _written(codes[end - 1]).encode("utf-8", "surrogatepass")
            out[end].append((end - 1, model.unknown, tuple(int(model.byte_ids[b]) for b in raw)))
    return out


def nbest(model: Pieces, codes: list[int], n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a stretch: backward A* with forward Viterbi scores."""
    lattice = edges(model, codes)
    best = [0.0] + [_NONE] * len(codes)
    for end in range(1, len(codes) + 1):
        best[end] = max(best[start] + score for start, score, _ in lattice[end])
    queue: list = [(-best[-1], 0, len(codes), 0.0, None)]
    out, serial, visits = [], 0, [0] * (len(codes) + 1)
    while queue and len(out) < n:
        _, _, at, behind, path = heapq.heappop(queue)
        visits[at] += 1
        if visits[at] > n:  # n better ways on from here are known
            continue
        if at == 0:
            ids: list[int] = []
            while path is not None:
                ids.extend(path[0])
                path = path[1]
            out.append((behind, ids))
            continue
        for start, score, own in lattice[at]:
            serial -= 1  # of equal paths the longest first
            heapq.heappush(queue, (-(best[start] + score + behind), serial, start, score + behind, (own, path)))
    return out


class _Stretches:
    """Distinct stretches of a block with their best segmentation and the gap to the second best."""

    def __init__(self, model: Pieces, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        keys = blocks.range_hashes(_numbers(codes), starts, ends, blocks.TOKEN_BASES[0])
        _, some, self.of = np.unique(keys, return_index=True, return_inverse=True)
        self.codes, self.starts, self.lengths = codes, starts[some], (ends - starts)[some]
        n = len(some)
        self.best, self.second = np.full(n, _NONE), np.full(n, _NONE)
        short = np.flatnonzero(self.lengths <= _LONG)
        ids = [None] * n
        flat, counts = self._together(model, short)
        for i in np.flatnonzero(self.lengths > _LONG):
            found = nbest(model, self.stretch(i), 2)
            self.best[i], ids[i] = found[0][0], np.array(found[0][1])
            self.second[i] = found[1][0] if len(found) > 1 else _NONE
        sizes = np.zeros(n, np.int64)
        sizes[short] = counts
        for i, x in enumerate(ids):
            if x is not None:
                sizes[i] = len(x)
        self.sizes = sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.empty(self.first[-1], np.int64)
        take = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[short], counts)
        self.ids[take] = flat
        for i, x in enumerate(ids):
            if x is not None:
                self.ids[self.first[i]:self.first[i + 1]] = x

    def stretch(self, i: int) -> list[int]:
        return self.codes[self.starts[i]:self.starts[i] + self.lengths[i]].tolist()

    def _together(self, model: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi with the two best scores at every place, for all stretches at once; the best paths' ids and counts."""
        order = np.argsort(-self.lengths[which], kind="stable")
        which = which[order]
        lengths, starts = self.lengths[which], self.starts[which]
        n, width = len(which), int(lengths[0]) if len(which) else 0
        total = len(self.codes)
        power = blocks.powers(blocks.TOKEN_BASES[1], total)
        inverse = blocks.powers(pow(blocks.TOKEN_BASES[1], -1, 1 << 64), total + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(total + 1, np.uint64)
            np.cumsum(_numbers(self.codes) * power, out=sums[1:])
        best, second = np.full((width + 1, n), _NONE), np.full((width + 1, n), _NONE)
        back, by = np.zeros((width + 1, n), np.int16), np.full((width + 1, n), -2, np.int32)
        best[0] = 0
        for end in range(1, width + 1):
            m = int(np.searchsorted(-lengths, -end, side="right"))  # stretches that reach so far
            b, s = best[end, :m], second[end, :m]
            for size in range(1, min(end, model.longest) + 1):
                at = starts[:m] + end - size
                with np.errstate(over="ignore"):
                    keys = blocks.mix((sums[at + size] - sums[at]) * inverse[at])
                found = model.find(keys)
                hit = np.flatnonzero(found >= 0) if size > 1 else np.arange(m)
                if not len(hit):
                    continue
                place = found[hit]
                score = np.where(place >= 0, model.scores[np.maximum(place, 0)], model.unknown)
                one, two = best[end - size, hit] + score, second[end - size, hit] + score
                old = b[hit]
                wins = one > old
                s[hit] = np.maximum(np.maximum(s[hit], two), np.minimum(one, old))
                b[hit] = np.maximum(one, old)
                back[end, hit[wins]] = size
                by[end, hit[wins]] = place[wins]
        columns = np.arange(n)
        self.best[which], self.second[which] = best[lengths, columns], second[lengths, columns]
        # paths from the ends to the beginnings
        at, steps = lengths.copy(), []
        live = columns
        while len(live):
            place, end = by[at[live], live], at[live]
            steps.append((live, end, place))
            at[live] = end - back[end, live]
            live = live[at[live] > 0]
        who = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
        end = np.concatenate([s[1] for s in steps]) if steps else np.zeros(0, np.int64)
        place = np.concatenate([s[2] for s in steps]) if steps else np.zeros(0, np.int64)
        who = order[who]  # back to the given order
        sorted_ = np.lexsort((end, who))
        who, end, place = who[sorted_], end[sorted_], place[sorted_]
        ids = np.where(place >= 0, model.ids[np.maximum(place, 0)], -1).astype(np.int64)
        counts = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(place < 0)
        if len(bare):  # characters without a piece become as many ids as they have bytes
            given = np.empty(n, np.int64)
            given[order] = starts
            kinds, of = np.unique(self.codes[given[who[bare]] + end[bare] - 1], return_inverse=True)
            raw = [[int(model.byte_ids[x]) for x in _written(int(k)).encode("utf-8", "surrogatepass")] for k in kinds]
            counts[bare] = np.array([len(r) for r in raw])[of]
            out = np.repeat(ids, counts)
            table = np.array([x for r in raw for x in r])
            starts_ = np.cumsum([len(r) for r in raw]) - [len(r) for r in raw]
            first = np.cumsum(counts) - counts
            fill = np.arange(counts[bare].sum()) - np.repeat(np.cumsum(counts[bare]) - counts[bare], counts[bare])
            out[np.repeat(first[bare], counts[bare]) + fill] = table[np.repeat(starts_[of], counts[bare]) + fill]
            ids = out
        return ids, np.bincount(who, weights=counts, minlength=n).astype(np.int64)


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters as the model sees them, with a mark before every text that is not empty, and offsets."""
    text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = np.where(text == MARK, _LITERAL, np.where(text == 0x20, MARK, text))
    full = np.flatnonzero(np.diff(chars) > 0)
    codes = np.insert(codes, chars[full], MARK)
    added = np.concatenate([[0], np.cumsum(np.diff(chars) > 0)])
    return codes, chars + added


def encoded(model: Pieces, data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[pa.Array]:
    """n_pieces, ids, scores and alternatives of the texts of a block."""
    codes, at = _codes(data, offsets)
    texts = len(offsets) - 1
    cut = np.ones(len(codes), bool)
    if len(codes):
        pair = codes[:-1].astype(np.int64) << 21 | codes[1:].astype(np.int64)
        place = np.minimum(np.searchsorted(model.joined, pair), len(model.joined) - 1)
        cut[1:] = model.joined[place] != pair
        cut[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(codes))
    all_ = _Stretches(model, codes, starts, ends)
    first = np.searchsorted(starts, at)
    owner = np.repeat(np.arange(texts), np.diff(first))
    sizes = all_.sizes[all_.of]
    ids, id_at = blocks.gathered(all_.ids, all_.first[all_.of], sizes)
    ids_first = id_at[first]
    best = blocks.sums_between(all_.best[all_.of].astype(np.float64), first)
    gap = np.where(all_.second[all_.of] > _NONE / 2, (all_.best - all_.second)[all_.of], np.inf)
    # the n - 1 stretches of each text with the least gaps
    order = np.lexsort((gap, owner))
    rank = np.arange(len(order)) - first[owner[order]]
    chosen = order[(rank < n - 1) & np.isfinite(gap[order])]
    lists: dict[int, list] = {}
    of_text: list[list[int]] = [[] for _ in range(texts)]
    for i in chosen.tolist():
        of_text[owner[i]].append(i)
        kind = int(all_.of[i])
        if kind not in lists:
            lists[kind] = nbest(model, all_.stretch(kind), n)
    scores, alternatives = [], []
    for text in range(texts):
        sums = [(0.0, ())]
        for i in sorted(of_text[text]):
            own = lists[int(all_.of[i])]
            sums = heapq.nsmallest(n, ((lost + own[0][0] - own[k][0], path + ((i, k),) if k else path)
                                       for lost, path in sums for k in range(len(own))), key=lambda x: (x[0], len(x[1])))
        scores.append([float(best[text]) - lost for lost, _ in sums] if first[text + 1] > first[text] else [])
        alternatives.append([[
            {"at": int(id_at[i] - ids_first[text]), "drop": int(sizes[i]), "ids": lists[int(all_.of[i])][k][1]}
            for i, k in path] for _, path in sums[1:]])
    return [
        pa.array(np.diff(ids_first)),
        pa.ListArray.from_arrays(pa.array(ids_first.astype(np.int32)), pa.array(ids.astype(np.int32))),
        pa.array(scores, pa.list_(pa.float64())),
        pa.array(alternatives, pa.list_(pa.list_(pa.struct(
            [("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))),
    ]


def encode(docs: DataFrame, model_path: str, n: int = N, column: str = "text") -> DataFrame:
    """All columns, n_pieces, ids of the best segmentation, scores of the n best, and the others as changes of ids."""
    kept = docs.drop(*RESULTS.names)

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            for part, data, offsets in blocks.blocks(batch, column, _BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *encoded(model, data, offsets, n)], names=[*part.schema.names, *RESULTS.names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *RESULTS.fields]))


def decoded(model: Pieces, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data, at = blocks.gathered(model.data, model.places[ids], model.lengths[ids])
    bounds = at[offsets]
    full = bounds[1:] > bounds[:-1]
    data = np.delete(data, bounds[:-1][full])  # the mark in front
    return blocks.string_column(data, bounds - np.concatenate([[0], np.cumsum(full)]))


def decode(rows: DataFrame, model_path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the text of the ids."""
    kept = rows.drop(into)

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            lists = batch.column(column).fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            for begin, end in blocks.slices(np.diff(offsets), _BYTES // 4):
                part = offsets[begin:end + 1]
                ids = lists.values.to_numpy()[part[0]:part[-1]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(begin, end - begin).columns, decoded(model, ids, part - part[0]).cast(pa.string())],
                    names=[*batch.schema.names, into])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, StringType())]))


__all__ = ["N", "Pieces", "decode", "decoded", "edges", "encode", "encoded", "nbest", "pieces"]
