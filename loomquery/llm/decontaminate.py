"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The windows of the test items are hashed into one set, which every task scans
its documents' token windows against. A window found in the set is verified
word by word before it counts. The set's size is measured first: items beyond
``set_bytes`` are dealt over several sets, each within the bound, which a task
holds one after the other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loomquery.llm._store import arrow_map
from loomquery.llm._text import ALNUM, buffers, chunks, hashes_of, split_words, sums, window_hashes

WINDOW = 8
#: Bytes of a set as it is built, and those that a word takes in it: its key, and its window's hash, place and item.
SET_BYTES, WORD_BYTES = 64 << 20, 36
#: A word, before capitals are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Windows:
    """The windows of a set of items, in flat arrays.

    By window length: sorted hashes of the windows, the first word and the
    item of each. Windows of one hash are in groups of equal words.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        raw = [(text or "").encode() for _, text in items]
        self.names = [item for item, _ in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words = split_words(np.frombuffer(b"".join(raw), np.uint8), offsets, ALNUM)
        self.keys = np.stack(words.keys())
        h, text, counts = hashes_of(*self.keys), words.text_of(), words.counts
        self.sets = {}
        for n in sorted({min(window, c) for c in counts.tolist() if c}):
            own = window_hashes(h, n)
            at = np.arange(len(own))
            at = at[(text[at] == text[at + n - 1]) & (np.minimum(window, counts[text[at]]) == n)]
            order = np.lexsort((at, own[at]))
            at, own = at[order], own[at[order]]
            # equal windows take the place of the first: the group that they are in
            group = np.zeros(len(at), np.int64)
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            group[start] = 1
            group = start[np.cumsum(group) - 1]
            other = np.flatnonzero(~self.same(self.keys, at, at[group], n))
            for k in other.tolist():  # another window of the same hash
                known = [g for g in range(start[np.searchsorted(start, k, "right") - 1], k) if group[g] == g and self.same(self.keys, at[k : k + 1], at[g : g + 1], n)[0]]
                group[k] = known[0] if known else k
            order = np.lexsort((group, own))
            bits = np.zeros(1 << 20, bool)
            bits[own >> np.uint64(44)] = True
            self.sets[n] = (own[order], at[order], text[at[order]].astype(np.int32), bits, bool(len(other)))

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + sum(x.nbytes for own in self.sets.values() for x in own[:4])

    def same(self, keys: np.ndarray, k: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each of places k of keys on are those from places i of the items' words on."""
        out = np.ones(len(k), bool)
        for j in range(n):
            out &= (keys[:, k + j] == self.keys[:, i + j]).all(axis=0)
        return out

    def scan(self, words) -> tuple[np.ndarray, list[set]]:
        """Which words are hit, and the items found in each text."""
        keys, text = np.stack(words.keys()), words.text_of()
        h = hashes_of(*keys)
        edge = np.zeros(len(h) + 1, np.int64)
        found: list[set] = [set() for _ in range(len(words.first) - 1)]
        for n, (hashes, first, item, bits, shared) in self.sets.items():
            own = window_hashes(h, n)
            likely = np.flatnonzero(bits[own >> np.uint64(44)])
            likely = likely[text[likely] == text[likely + n - 1]]
            low, high = (np.searchsorted(hashes, own[likely], side) for side in ("left", "right"))
            some = high > low
            likely, low, high = likely[some], low[some], high[some]
            if shared:  # windows of one hash may differ
                times = high - low
                at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                place = np.repeat(likely, times)
                good = self.same(keys, place, first[at], n)
                place, at = place[good], at[good]
                hits = np.unique(place)
                pairs = np.stack([text[place], item[at]])
            else:
                good = self.same(keys, likely, first[low], n)
                hits, low, high = likely[good], low[good], high[good]
                # equal windows of a text name their items once
                asked = np.unique(np.stack([text[hits], low, high]), axis=1)
                times = asked[2] - asked[1]
                at = np.repeat(asked[1] - np.cumsum(times) + times, times) + np.arange(times.sum())
                pairs = np.stack([np.repeat(asked[0], times), item[at]])
            np.add.at(edge, hits, 1)
            np.add.at(edge, hits + n, -1)
            for t, i in np.unique(pairs, axis=1).T.tolist():
                found[t].add(self.names[i])
        return np.cumsum(edge[:-1]) > 0, found


def hit_spans(words, hit: np.ndarray, i: int, base: int) -> list[dict]:
    """Byte spans of the runs of hit words of text i."""
    a, b = words.first[i], words.first[i + 1]
    flags = np.concatenate([[0], hit[a:b].astype(np.int8), [0]])
    turn = np.diff(flags)
    return [{"start": int(words.start[a + s] - base), "end": int(words.end[a + e - 1] - base)} for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]


def item_sets(items: DataFrame, item_col: str, text_col: str, window: int, set_bytes: int) -> list:
    """The items' windows as broadcast sets, each of about set_bytes as it is built, or of one item."""
    spark = items.sparkSession
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND item IS NOT NULL")
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    size = words * WORD_BYTES
    parts = math.ceil(size / set_bytes) if size <= set_bytes else math.ceil(2 * size / set_bytes)
    sets = []
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        sets.append(spark.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()], window)))
    return sets


def _find(sets: list, data: np.ndarray, offsets: np.ndarray):
    """(first and last text, words, hit words, items of each text) of a batch's chunks; a task holds one set at a time, for a whole batch."""
    parts = [(i, j, split_words(data, offsets[i : j + 1], ALNUM)) for i, j in chunks(offsets)]
    hits = [np.zeros(len(w.start), bool) for _, _, w in parts]
    found = [[set() for _ in range(j - i)] for i, j, _ in parts]
    for one in sets:
        own_set = one.value if len(sets) == 1 else one.load_from_path(one._path)
        for k, (_, _, words) in enumerate(parts):
            more, items = own_set.scan(words)
            hits[k] |= more
            for own, new in zip(found[k], items, strict=True):
                own |= new
    return [(i, j, words, hit, items) for (i, j, words), hit, items in zip(parts, hits, found, strict=True)]


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids of the items found), spans (byte ranges of hit words).

    A null text or one without words has no words and no hits; items that are
    null or without words have no windows; an item shorter than the window is
    one window of its own length; items that repeat share their windows.
    A null id stays null; repeated rows each give a row; other columns are
    ignored; without items nothing is hit.
    """
    sets = item_sets(items, item_col, item_text_col, window, set_bytes)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_hit long, items array<{item_kind}>, spans array<struct<start:long,end:long>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def find(batch: pa.RecordBatch):
        data, offsets, _ = buffers(batch.column(1))
        n_words, n_hit, items_of, spans = [], [], [], []
        for i, j, words, hit, found in _find(sets, data, offsets):
            hits = sums(hit.astype(np.int64), words.first)
            n_words.append(words.counts)
            n_hit.append(hits)
            items_of += [sorted(x) for x in found]
            spans += [hit_spans(words, hit, k, int(offsets[i + k] - offsets[i])) if n else [] for k, n in enumerate(hits.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_hit)), pa.array(items_of, arrow.field("items").type), pa.array(spans, arrow.field("spans").type)], names=arrow.names)

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), find, schema).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_items: int = 2, set_bytes: int = SET_BYTES) -> DataFrame:
    """The documents without those in which min_items or more items occur, and without the hit spans of the others.

    All columns stay. A document that holds no window is returned as it is;
    of one that loses spans, length_col (where there is one) follows the text.
    Null texts and repeated rows stay.
    """
    sets = item_sets(items, item_col, item_text_col, window, set_bytes)
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(batch: pa.RecordBatch):
        data, offsets, _ = buffers(batch.column(at))
        drop, cut = np.zeros(batch.num_rows, bool), {}
        for i, j, words, hit, found in _find(sets, data, offsets):
            for k, own in enumerate(found):
                if len(own) >= min_items:
                    drop[i + k] = True
                elif own:
                    raw, kept, last = data[offsets[i + k] : offsets[i + k + 1]].tobytes(), [], 0
                    for span in hit_spans(words, hit, k, int(offsets[i + k] - offsets[i])):
                        kept.append(raw[last : span["start"]])
                        last = span["end"]
                    cut[i + k] = b"".join([*kept, raw[last:]]).decode()
        columns = list(batch.columns)
        if cut:
            texts = columns[at].to_pylist()
            for k, text in cut.items():
                texts[k] = text
            columns[at] = pa.array(texts, columns[at].type)
            if count_at is not None:
                counts = columns[count_at].to_pylist()
                for k, text in cut.items():
                    counts[k] = len(text)
                columns[count_at] = pa.array(counts, columns[count_at].type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(~drop))

    return arrow_map(docs, clean, docs.schema)


def digest(df: DataFrame, id_col: str = "doc_id", min_items: int = 2) -> DataFrame:
    """Counts and a checksum of what scan() found."""
    return df.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )
