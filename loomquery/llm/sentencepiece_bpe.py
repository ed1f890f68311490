"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different units (a run of spaces and what follows it; no piece of
such a vocabulary goes on into another run) are concatenated and indexed by a
suffix array. Every piece is binary-searched in it, which gives the ranges of
its occurrences; these are the edges of a graph over text positions. Edges are
sorted by position and relaxed from left to right. For a vocabulary of merges
(BPE), relaxing isn't adding scores: the last piece of each prefix's encoding
is the one edge whose piece may follow the last piece of the prefix that it
starts from. Two pieces may follow each other if no merge across their border
would come before the merges that made them. Characters without a piece are
spelled in bytes. Vocabularies of this kind only; others are refused.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import arrow_map, over_batches
from loomquery.llm._text import Known, buffers, chunks, grouped, keys_of, sums

SPACE = "▁"
#: Bytes of units that one suffix array indexes, and ids of known units that a task holds.
BLOCK, HELD = 1 << 18, 4 << 20
#: Bytes of text whose ids are returned at once.
RETURNED = 8 << 20
#: Ids that are spelled at once, and bits of the table of pairs of pieces that were asked for.
SPELLED, ANSWERS = 1 << 17, 19
_SEPARATOR, _SPREAD = 0xFE, np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces with spaces for the space sign; ranks: order of merging, below 0 for single characters."""

    pieces: list[bytes]
    ids: dict[bytes, int]
    byte_ids: np.ndarray
    rank: list[int]
    parts: dict[int, tuple[int, int]]
    unknown: int
    asked: np.ndarray = field(default_factory=lambda: np.full(1 << ANSWERS, -1, np.int64))
    answer: np.ndarray = field(default_factory=lambda: np.zeros(1 << ANSWERS, bool))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file of the library; it must be BPE with byte fallback, a dummy prefix and spaces only before words."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        byte_ids = np.full(256, -1, np.int32)
        ids, scores = {}, {}
        pieces = []
        for i in range(n):
            piece = own.id_to_piece(i)
            raw = piece.replace(SPACE, " ").encode()
            if own.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw = bytes([int(piece[3:5], 16)])
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                raw = b""
            else:
                ids[raw] = i
                scores[i] = own.get_score(i)
            pieces.append(raw)
        if (byte_ids < 0).any() or any(b" " in p.lstrip(b" ") for p in ids):
            raise ValueError("only BPE vocabularies with byte fallback and spaces before words can be matched")
        # pieces of equal score merge from left to right, as one rank
        steps = {s: k for k, s in enumerate(sorted({-s for s in scores.values()}))}
        rank = [0] * n
        for raw, i in ids.items():
            rank[i] = -1 if len(raw.decode()) == 1 else steps[-scores[i]]
        found = cls(pieces, ids, byte_ids, rank, {}, own.unk_id())
        for raw, i in ids.items():
            if rank[i] >= 0:
                last = found.merges(raw)[1]
                if last is not None and last[0] == i:
                    found.parts[i] = last[1:]
        if found.encode_merging(b" Hello  w\xc3\xb6rld") != own.encode("Hello  wörld"):
            raise ValueError("the model normalises or merges in another way")
        return found

    def merges(self, raw: bytes):
        """Encode by merging the best adjacent pair again and again, the left one of equals: (ids with their bytes, the last merge).

        -1 stands for a character without a piece. The last merge is None
        unless one piece is left.
        """
        now: list = [(self.ids.get(c.encode(), -1), c.encode()) for c in raw.decode()]
        left, right = list(range(-1, len(now) - 1)), [*range(1, len(now)), -1]
        queue: list = []

        def offer(k: int) -> None:
            if k >= 0 and right[k] >= 0:
                i = self.ids.get(now[k][1] + now[right[k]][1])
                if i is not None:
                    heapq.heappush(queue, (self.rank[i], k, i, len(now[k][1])))

        for k in range(len(now)):
            offer(k)
        last = None
        while queue:
            _, k, i, size = heapq.heappop(queue)
            # passed over if either part has changed since
            if now[k] is None or len(now[k][1]) != size or right[k] < 0 or size + len(now[right[k]][1]) != len(self.pieces[i]):
                continue
            other = right[k]
            last = (i, now[k][0], now[other][0])
            now[k], now[other] = (i, now[k][1] + now[other][1]), None
            right[k] = right[other]
            if right[k] >= 0:
                left[right[k]] = k
            offer(left[k])
            offer(k)
        out = [x for x in now if x is not None]
        return out, last if len(out) == 1 else None

    def encode_merging(self, raw: bytes) -> list[int]:
        out = []
        for i, part in self.merges(raw)[0]:
            out += [i] if i >= 0 else self.byte_ids[list(part)].tolist()
        return out

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of two pieces' text is just the two, for each pair. Answers are kept in a table of fixed size."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - ANSWERS)).astype(np.int64)
        todo = self.asked[slot] != key
        out = self.answer[slot]
        if todo.any():
            own, back = np.unique(key[todo], return_inverse=True)
            found = np.array([self._follows(k >> 20, k & 0xFFFFF) for k in own.tolist()], bool)
            out[todo] = found[back]
            self.asked[slot[todo]], self.answer[slot[todo]] = key[todo], out[todo]
        return out

    def _follows(self, a: int, b: int) -> bool:
        limit = 1 << 40  # merges across the border of this step or later come too late
        rank, pieces, parts = self.rank, self.pieces, self.parts
        while True:
            across = self.ids.get(pieces[a] + pieces[b])
            if across is not None and rank[across] < limit:
                return False
            # undo the later of the two pieces' last merges; on a tie the right one came later
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and how many each has."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        i = 0
        while i < len(units):
            j, held = i, 0
            while j < len(units) and (j == i or held + len(units[j]) < BLOCK):
                held += len(units[j]) + 1
                j += 1
            ids, n = self._encode_block(units[i:j])
            flat.append(ids)
            counts.append(n)
            i = j
        return np.concatenate(flat), np.concatenate(counts)

    def _encode_block(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(bytes([_SEPARATOR]).join([*units, b""]), np.uint8)
        other, begin = len(self.pieces), len(self.pieces) + 1  # a character without a piece, the start of a unit
        size = np.array([len(u) for u in units])
        bounds = np.concatenate([[0], np.cumsum(size + 1)])
        start, length, piece = self.edges(text)
        end = start + length
        place = end - np.repeat(bounds[:-1], size + 1)[start]
        order = np.argsort(place.astype(np.int16) if size.max() < 1 << 15 else place, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        last = np.full(len(text) + 1, -1, np.int64)  # the last piece of the encoding up to a position
        last[bounds[:-1]] = begin
        steps = np.flatnonzero(np.diff(place[order], prepend=-1))
        for a, b in zip(steps.tolist(), [*steps[1:].tolist(), len(order)], strict=True):
            before, own = last[start[a:b]], piece[a:b]
            good = (before >= other) | (own == other) & (before >= 0)
            ask = np.flatnonzero((before >= 0) & ~good)
            if len(ask):
                good[ask] = self.follow(before[ask], own[ask])
            last[end[a:b][good]] = own[good]
        # back from the end of every unit
        width = np.array([*map(len, self.pieces), 0])
        at, unit = bounds[:-1] + size, np.arange(len(units))
        special = np.zeros(len(units), bool)  # with characters that have no piece
        trail: list = []
        unit = unit[size > 0]
        while len(unit):
            own = last[at[unit]]
            odd = own >= other
            special[unit[odd]] = True
            unit, own = unit[~odd], own[~odd]
            trail.append((unit, own))
            at[unit] -= width[own]
            unit = unit[at[unit] > bounds[unit]]
        if trail:
            of, ids = np.concatenate([u for u, _ in trail]), np.concatenate([t for _, t in trail])
            step = np.repeat(np.arange(len(trail)), [len(u) for u, _ in trail])
            keep = ~special[of]
            of, ids, step = of[keep], ids[keep], step[keep]
            order = np.lexsort((-step, of))
            of, ids = of[order], ids[order]
        else:
            of, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if special.any():
            alone = {k: self._backwards(text, last, int(bounds[k]), int(bounds[k] + size[k]), width) for k in np.flatnonzero(special).tolist()}
            of = np.concatenate([of, np.repeat(list(alone), [len(x) for x in alone.values()])]).astype(np.int64)
            ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(alone.values()), np.int64)])
            order = np.argsort(of, kind="stable")
            of, ids = of[order], ids[order]
        return ids.astype(np.int32), np.bincount(of, minlength=len(units)).astype(np.int64)

    def _backwards(self, text: np.ndarray, last: np.ndarray, begin: int, at: int, width: np.ndarray) -> list[int]:
        """The ids of a unit that holds characters without a piece."""
        ids: list[int] = []
        while at > begin:
            t = int(last[at])
            if t < len(self.pieces):
                ids.append(t)
                at -= int(width[t])
            else:
                size = 1
                while text[at - size] & 0xC0 == 0x80:
                    size += 1
                ids += self.byte_ids[text[at - size : at][::-1]].tolist()
                at -= size
        return ids[::-1]

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of every reachable piece, and of characters without one (piece: the number of pieces)."""
        array, eight = suffix_array(text)
        ids, lengths, bounds = self._searched()
        # ranges of the suffixes that begin with a piece's first 8 bytes; within them, by the next 8, and so on
        low = np.searchsorted(eight[array], bounds[0][0])
        high = np.searchsorted(eight[array], bounds[0][1], "right")
        for k, (least, most) in enumerate(bounds[1:], 1):
            open_ = np.flatnonzero((lengths > 8 * k) & (high > low))
            ranges = low[open_], high[open_]
            low[open_] = _bisect(array, eight, 8 * k, least[open_], *ranges, after=False)
            high[open_] = _bisect(array, eight, 8 * k, most[open_], *ranges, after=True)
        sizes = np.maximum(high - low, 0)
        some = np.flatnonzero(sizes)
        before = np.concatenate([[0], np.cumsum(sizes[some])])
        start = array[np.repeat(low[some] - before[:-1], sizes[some]) + np.arange(before[-1])]
        piece, length = np.repeat(ids[some], sizes[some]), np.repeat(lengths[some], sizes[some])
        # characters without a piece
        begins = ((text & 0xC0) != 0x80) & (text != _SEPARATOR)
        size = np.diff(np.concatenate([np.flatnonzero((text & 0xC0) != 0x80), [len(text)]]))
        size = size[text[(text & 0xC0) != 0x80] != _SEPARATOR]
        chars = np.flatnonzero(begins)
        covered = np.zeros(len(text), bool)
        single = np.array([r < 0 for r in self.rank])
        covered[start[single[piece]]] = True
        other = ~covered[chars]
        return np.concatenate([start, chars[other]]), np.concatenate([length, size[other]]), np.concatenate([piece, np.full(other.sum(), len(self.pieces))])

    def _searched(self):
        """The pieces that merging can reach, their lengths, and for each 8 bytes of them the bounds to search: bytes beyond a piece are free."""
        if not hasattr(self, "_bounds"):
            own = [i for _, i in sorted(self.ids.items()) if self.rank[i] < 0 or i in self.parts]
            lengths = np.array([len(self.pieces[i]) for i in own], np.int64)
            width = -(-int(lengths.max()) // 8) * 8
            low, high = (np.frombuffer(b"".join(self.pieces[i].ljust(width, c) for i in own), ">u8").reshape(len(own), -1).astype(np.uint64) for c in (b"\0", b"\xff"))
            self._bounds = (np.array(own, np.int64), lengths, [(low[:, k].copy(), high[:, k].copy()) for k in range(width // 8)])
        return self._bounds


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all suffixes of a text in their order, and the 8 bytes from each position on as a number.

    Suffixes are ordered by 8 bytes; those that are equal so far, again and
    again, by the places of what follows, which doubles the bytes compared.
    """
    n = len(text)
    eight = np.ndarray(n, ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    order = np.argsort(eight, kind="stable")
    slot, own, width = np.arange(n), eight[order], 8
    place = np.empty(n, np.int64)
    while len(slot):
        new = np.concatenate([[True], own[1:] != own[:-1]])
        place[order[slot]] = slot[np.flatnonzero(new)][np.cumsum(new) - 1]
        slot = slot[~(new & np.append(new[1:], True))]
        at = order[slot]
        after = np.where(at + width < n, place[np.minimum(at + width, n - 1)] + width + 1, n - at)  # of two that end, the shorter comes first
        own = place[at].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        again = np.argsort(own, kind="stable")
        order[slot], own = at[again], own[again]
        width *= 2
    return order, eight


def _bisect(array: np.ndarray, eight: np.ndarray, skip: int, value: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """For each value, the first place in its range of the array whose suffix has, skip bytes on, 8 bytes of at least (after: more than) the value."""
    low, high = low.copy(), high.copy()
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) // 2
        at = array[middle] + skip
        own = np.where(at < len(eight), eight[np.minimum(at, len(eight) - 1)], np.uint64(0))
        less = own <= value[todo] if after else own < value[todo]
        low[todo[less]] = middle[less] + 1
        high[todo[~less]] = middle[~less]
    return low


def _unit_bounds(data: np.ndarray, offsets: np.ndarray):
    """The texts, each that isn't empty behind one more space, with all space signs as spaces; unit starts; and texts' offsets."""
    raw = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    sign = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else []
    if len(sign):
        keep = np.ones(len(raw), bool)
        keep[sign + 1] = keep[sign + 2] = False
        raw = raw.copy()
        raw[sign] = 0x20
        gone = np.concatenate([[0], np.cumsum(~keep)])
        raw, at = raw[keep], at - gone[at]
    size = np.diff(at)
    more = (size > 0).astype(np.int64)
    begin = at + np.concatenate([[0], np.cumsum(more)])
    text = np.full(begin[-1], 0x20, np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.cumsum(more), size)] = raw
    space = text == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[begin[:-1][size > 0]] = True
    return text, np.flatnonzero(starts), begin


class Encoder:
    """Encodes chunks of texts, each different unit once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self):
        self.known, self.first, self.count, self.flat = Known(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        text, start, begin = _unit_bounds(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(text))
        keys = np.stack(keys_of(text, start, end))
        at, own = grouped(*keys)
        if len(self.flat) > HELD:
            self.clear()
        number = self.known.find(*keys[:, at])
        new = at[number < 0]
        if len(new):
            raw = text.tobytes()
            ids, sizes = self.vocabulary.encode_units([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            more = len(self.first) + np.arange(len(new))
            number[number < 0] = more
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
            self.count, self.flat = np.concatenate([self.count, sizes]), np.concatenate([self.flat, ids])
            self.known.add(*keys[:, new], more)
        place = number[own]
        count = self.count[place]
        before = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.repeat(self.first[place] - before[:-1], count) + np.arange(before[-1])]
        return flat, sums(count, np.searchsorted(start, begin))


def encode(df: DataFrame, path: str, *keep: str, text_col: str = "text", spell: bool = False) -> DataFrame:
    """The kept columns of each row, and ids: the pieces of the text, without any special ones.

    A null text has null ids, an empty one none; repeated rows each give a
    row; texts of any length are encoded whole. spell: also decoded, what the
    ids spell, made from the ids by the same task.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # the size of the vocabulary
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    schema = "".join(f"k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep)) + "ids array<int>" + ", decoded string" * spell
    names = [*[f"k{i}" for i in range(len(keep))], "ids", *["decoded"] * spell]

    def run(batches):
        own = Encoder(shared.value)
        for batch in batches:
            data, offsets, valid = buffers(batch.column(len(keep)))
            for i, j in chunks(offsets, RETURNED):
                ids, counts, texts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [pa.array([], pa.string())]
                for a, b in chunks(offsets[i : j + 1]):
                    flat, n = own.encode(data, offsets[i + a : i + b + 1])
                    ids.append(flat)
                    counts.append(n)
                    if spell:
                        texts.append(spelled(own.vocabulary.pieces, flat, np.concatenate([[0], np.cumsum(n)])))
                ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
                there = valid[i:j]
                out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=None if there.all() else pa.array(~there))]
                if spell:
                    out.append(_nulled(pa.concat_arrays(texts), there))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), *out], names)

    return over_batches(rows, run, schema).toDF(*keep, *names[len(keep) :])


def _nulled(texts: pa.Array, valid: np.ndarray) -> pa.Array:
    return texts if valid.all() else pa.compute.if_else(pa.array(valid), texts, pa.scalar(None, pa.string()))


def spelled(pieces: list[bytes], ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """The texts that consecutive runs of ids spell."""
    texts = [pa.array([], pa.string())]
    for i, j in chunks(first, SPELLED):
        data, offsets = decode_flat(pieces, ids[first[i] : first[j]], first[i : j + 1] - first[i])
        texts.append(pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)))
    return pa.concat_arrays(texts)


def decode_flat(pieces: list[bytes], ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of consecutive runs of ids, each without the space before it."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    table = np.frombuffer(b"".join(pieces), np.uint8)
    count = size[ids]
    before = np.concatenate([[0], np.cumsum(count)])
    out = table[np.repeat(begin[ids] - before[:-1], count) + np.arange(before[-1])]
    at = before[first]
    some = at[:-1] < at[1:]
    lead = np.zeros(len(at) - 1, bool)
    lead[some] = out[at[:-1][some]] == 0x20
    keep = np.ones(len(out), bool)
    keep[at[:-1][lead]] = False
    return out[keep], at - np.concatenate([[0], np.cumsum(lead)])


def decode(df: DataFrame, path: str, *keep: str, ids_col: str = "ids") -> DataFrame:
    """The kept columns of each row, and text: what the ids spell. Null ids have a null text; special ids spell nothing."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path).pieces)
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("ids"))
    schema = "".join(f"k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep)) + "text string"
    names = [*[f"k{i}" for i in range(len(keep))], "text"]

    def spell(batch: pa.RecordBatch):
        column = batch.column(len(keep))
        first = np.asarray(column.offsets).astype(np.int64)
        texts = _nulled(spelled(shared.value, np.asarray(column.values), first), np.asarray(column.is_valid()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names)

    return arrow_map(rows, spell, schema).toDF(*keep, "text")
