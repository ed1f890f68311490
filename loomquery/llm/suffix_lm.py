"""Language-model scores from a probabilistic suffix tree over words.

Symbols are lower-cased words and one end of text. The root's distribution is
add-0.1 over all training tokens. A longer context enters the tree if words
follow it often enough (``LEAST`` times, whatever the corpus' size) and a
divergence test tells its next-symbol distribution from that of its longest
suffix in the tree. A context keeps the symbols whose probability differs,
smoothed towards that suffix; the mass of the others is the suffix's, rescaled.
So every distribution sums to one, and a token is scored by the longest suffix
of its history in the tree.

Counts cover all training tokens, and the tree is a table: it grows with the
corpus and stays distributed. A run of words is one word longer than its
context, which in turn is the run before it; so a text's log-probability is the
root's and one addend for each run of it that the tree has (``Tree.nodes``).
Addends of frequent runs, at most 1 / MIN_WORD a length, are added in place, as
are frequent words' counts. For others, a task asks once for each different run
or word of its texts: the questions are dealt by key to the ranges of the tree
that can answer them, and the answers go back to the texts. Filters of bounded
size keep runs out of the shuffle that can't be frequent or aren't in the tree;
what they let through is counted or asked for all the same.

Words are told apart by 128-bit keys, runs of words by 56-bit hashes of these.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import Store, arrow_map, over_batches
from loomquery.llm._text import SPACED, Known, buffers, chunks, grouped, hashes_of, mix, split_words

ADD = 0.1
#: Longest context in words; least share in all tokens of a word or run that is counted in place.
DEPTH, MIN_WORD = 3, 1e-6
#: A kept symbol occurs this often after its context, with a probability this many times the suffix's or less than its inverse; weight of the suffix.
LEAST, RATIO, PRIOR = 8, 1.5, 4.0
#: A context's gain in log-likelihood over its suffix must exceed this many nats, and one half ln(count) more for each symbol it keeps.
GAIN = 8.0
#: Bits of a filter for each of its keys, and most bits of a filter.
KEY_BITS, FILTER_BITS = 12, 1 << 28
#: Key of the end of a text, which no word has, and the hash of what stands before a text.
END, BEFORE = np.array([[0x0E4D], [0xFE << 56]], np.uint64), np.uint64(0xBEF0)
#: Bits beyond those of a run's hash, by which a counted run tells a few of the texts that hold it.
TAG = np.uint64(8)
#: Tokens of the corpus to a task that sums up the counts of runs.
RANGE = 4 << 20
#: Questions that a task collects before it asks.
ASKED = 4 << 20
_STEP = np.uint64(0xA24BAED4963EE407)


def _search(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def _packed(values: np.ndarray) -> bytes:
    """Numbers in few bytes: the first bytes of all, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: pa.Scalar, dtype: type = np.uint64) -> np.ndarray:
    raw = blob.as_buffer()
    n, size = int.from_bytes(raw[:8].to_pybytes(), "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _packed_up(values: np.ndarray) -> bytes:
    """Numbers that ascend, by their differences."""
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _unpacked_up(blob: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(blob), dtype=np.uint64)


class _Counter:
    """Counts of 64-bit keys, merged as they come; keys that differ in the lowest bits only are one, the least."""

    def __init__(self, low: np.uint64):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.low = low

    def firsts(self, keys: np.ndarray) -> np.ndarray:
        own = keys >> self.low
        return np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(keys) else np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        first = self.firsts(keys)
        self.put(keys[first], np.diff(np.append(first, len(keys))))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of keys."""
        self.parts.append((keys, counts))
        self.held += len(keys)
        if len(self.parts) > 1 and self.held > 2 * len(self.parts[0][0]) + (1 << 20):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in self.parts])[order]
        first = self.firsts(keys)
        self.parts = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.held = len(first)


def _counts(texts: DataFrame, keys_of, low: np.uint64, limit: int = 4 << 20):
    """A function over batches of texts: counts in each of the keys that keys_of(data, offsets) gives for a chunk of texts, as batches' columns."""

    def count(batches):
        held = _Counter(low)
        for batch in batches:
            data, offsets, _ = buffers(batch.column(0))
            for i, j in chunks(offsets):
                held.add(keys_of(data, offsets[i : j + 1]))
                if held.held > limit:  # more meet in the shuffle
                    yield held
                    held = _Counter(low)
        yield held

    return count


def _counted(texts: DataFrame) -> DataFrame:
    """(a, b, key, n): the halves of each word's key, its hash, and its number in all rows."""

    def merged(parts):
        keys, n = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        at, own = grouped(*keys)
        return keys[:, at], np.bincount(own, weights=n, minlength=len(at)).astype(np.int64)

    def flushed(parts):
        keys, n = merged(parts)
        for i in range(0, len(n), 1 << 17):
            k = keys[:, i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.copy().view(np.int64)) for x in k), pa.array(n[i : i + (1 << 17)])], ["a", "b", "n"])

    def rows(batches):
        parts, held = [], 0
        for batch in batches:
            data, offsets, _ = buffers(batch.column(0))
            for i, j in chunks(offsets):
                keys = _words(data, offsets[i : j + 1])[2]
                parts.append(merged([(keys, np.ones(keys.shape[1], np.int64))]))
                held += len(parts[-1][1])
                if held > 1 << 20:
                    parts = [merged(parts)]
                    held = len(parts[0][1])
                    if held > 1 << 20:  # more meet in the shuffle
                        yield from flushed(parts)
                        parts, held = [], 0
        if parts:
            yield from flushed(parts)

    def hashed(batch: pa.RecordBatch):
        a, b, n = batch.columns
        keys = (np.asarray(x).view(np.uint64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(_hashes(keys).view(np.int64)), n], ["a", "b", "key", "n"])

    met = over_batches(texts, rows, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return arrow_map(met, hashed, "a long, b long, key long, n long")


def _frequent(texts: DataFrame, keys_of, total: int) -> DataFrame:
    """The keys without their TAG bits that occur LEAST times in all rows, with their counts and least tags.

    Most keys are rare, so they are dealt out in blocks: a row holds all of a
    task for one of parts ranges of keys. A range has RANGE of the corpus'
    tokens on average, whatever its size.
    """
    parts = 1 << max(3, (total // RANGE).bit_length())
    width = np.uint64(64 - parts.bit_length() + 1)
    count = _counts(texts, keys_of, TAG)

    def block(batches):
        for held in count(batches):
            if not held.parts:
                continue
            held.merge()
            keys, n = held.parts[0]
            ends = np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << width)
            ends = np.append(ends, len(keys))
            full = np.flatnonzero(ends[1:] > ends[:-1])
            for some in np.array_split(full, max(1, len(full) // 16)):
                columns = [pa.array([pack(x[ends[p] : ends[p + 1]]) for p in some], pa.binary()) for pack, x in ((_packed_up, keys), (_packed, n.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *columns], ["part", "keys", "n"])

    def meet(batches):
        held = _Counter(TAG)
        for batch in batches:
            for keys, n in zip(batch.column(1), batch.column(2), strict=True):
                held.put(_unpacked_up(keys), _unpacked(n, np.int32).astype(np.int64))
        if held.parts:
            held.merge()
            keys, n = held.parts[0]
            keys, n = keys[n >= LEAST], n[n >= LEAST]
            for i in range(0, len(keys), 1 << 17):
                part = keys[i : i + (1 << 17)]
                tag = part & np.uint64((1 << int(TAG)) - 1)
                yield pa.RecordBatch.from_arrays([pa.array((part >> TAG).view(np.int64)), pa.array(n[i : i + (1 << 17)]), pa.array(tag.view(np.int64))], ["key", "n", "tag"])

    dealt = over_batches(texts, block, "part int, keys binary, n binary").repartition(parts, "part")
    return over_batches(dealt, meet, "key long, n long, tag long")


def _hashes(keys: np.ndarray) -> np.ndarray:
    """56-bit hashes of words' keys."""
    return hashes_of(*keys) >> TAG


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts, each text's last the end; the first token of each; and the tokens' keys."""
    words = split_words(data, offsets, SPACED)
    n = len(offsets) - 1
    first = words.first + np.arange(n + 1)
    keys = np.repeat(END, first[-1], axis=1)
    keys[:, np.arange(len(words.start)) + words.text_of()] = words.keys()
    return _hashes(keys), first, keys


def _runs(tokens: np.ndarray, first: np.ndarray, depth: int) -> list[np.ndarray]:
    """runs[d][i]: key of the d + 1 words that end in token i, what stands before the text counted as one; 0 where there are fewer."""
    out = [tokens]
    for d in range(1, depth + 1):
        before = np.zeros(len(tokens), np.uint64)
        before[1:] = out[-1][:-1]
        before[first[:-1]] = BEFORE if d == 1 else 0
        out.append(np.where(before > 0, mix(before * _STEP + tokens + np.uint64(d)) >> TAG, np.uint64(0)))
    return out


def _shifted(runs: np.ndarray, first: np.ndarray, d: int) -> np.ndarray:
    """The context of d words before each token, or 0."""
    before = np.zeros(len(runs), np.uint64)
    before[1:] = runs[:-1]
    before[first[:-1]] = BEFORE if d == 1 else 0
    return before


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and bits of each key in a filter of size cells."""
    h = mix(keys * _STEP + np.uint64(77))
    bits = np.zeros(len(keys), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(40 + 6 * k)) & np.uint64(63))
    return (h & np.uint64(size - 1)).astype(np.int64), bits


def _filter(keys: DataFrame, column: str = "key") -> np.ndarray:
    """A filter of the keys: cells of 64 bits. It holds all of them, and few others as long as FILTER_BITS do."""
    count = keys.count()
    size = 1 << max(4, min(FILTER_BITS, max(1, KEY_BITS * count)).bit_length() - 6)

    def put(batch: pa.RecordBatch):
        cell, bits = _places(np.asarray(batch.column(0)).view(np.uint64), size)
        order = np.argsort(cell)
        cell, bits = cell[order], bits[order]
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(bits, new) if len(new) else bits
        yield pa.RecordBatch.from_arrays([pa.array(cell[new]), pa.array(bits.view(np.int64))], ["cell", "bits"])

    cells = arrow_map(keys.select(column), put, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def _holds(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, bits = _places(keys, len(cells))
    return (cells[at] & bits) == bits


@dataclass
class Tree:
    """The root and the tree over it.

    words and counts: the words counted in place. nodes: for each run
    in the tree, what it adds to the log10 probability of its last word (entry)
    and, as a context, of any word that follows (alpha). keys, entry and alpha:
    the nodes added in place. held: a filter of all nodes.
    """

    words: Known
    counts: np.ndarray
    total: int
    kinds: int
    depth: int
    keys: np.ndarray
    entry: np.ndarray
    alpha: np.ndarray
    held: np.ndarray
    start: float
    nodes: DataFrame | None

    def gains(self, data: np.ndarray, offsets: np.ndarray):
        """The tokens of a few texts, and what the tree adds to each token's log10 probability."""
        tokens, first, words = _words(data, offsets)
        runs = _runs(tokens, first, self.depth)
        keys, entry, alpha = self.keys, self.entry, self.alpha
        asked = np.unique(np.concatenate(runs))
        asked = asked[_holds(self.held, asked) & (_search(keys, asked) < 0)]
        if len(asked) and self.total * MIN_WORD > LEAST:  # else all nodes are in place
            more = self.nodes.filter(F.col("key").isin(asked.view(np.int64).tolist())).toPandas()
            keys = np.concatenate([keys, more["key"].to_numpy(np.int64).view(np.uint64)])
            order = np.argsort(keys)
            keys, entry, alpha = keys[order], np.concatenate([entry, more["entry"]])[order], np.concatenate([alpha, more["alpha"]])[order]
        gain = np.zeros(len(tokens))
        for d, run in enumerate(runs):
            at = _search(keys, run)
            gain += np.where(at >= 0, entry[at], 0.0) if len(keys) else 0.0
            if d < self.depth:
                at = _search(keys, _shifted(run, first, d + 1))
                gain += np.where(at >= 0, alpha[at], 0.0) if len(keys) else 0.0
        gain[first[:-1]] += 0.0 if _search(keys, np.array([BEFORE]))[0] >= 0 else self.start
        return tokens, first, self.words.find(*words), gain


def _grow(named: DataFrame, level: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(key, n, p, entry) of the runs, and (key, n, alpha) of the contexts that pass the divergence test, from the runs one word shorter (key, n, p)."""
    joined = named.join(level.select(F.col("key").alias("ctx"), F.col("n").alias("total")), "ctx").join(level.select(F.col("key").alias("suffix"), F.col("p").alias("above")), "suffix")
    ratio = F.col("n") / F.col("total") / F.col("above")
    joined = joined.withColumn("own", (ratio >= RATIO) | (ratio <= 1 / RATIO)).withColumn("smooth", (F.col("n") + PRIOR * F.col("above")) / (F.col("total") + PRIOR))
    joined = store.cut(joined.select("key", "n", "ctx", "total", "above", "own", "smooth"), "runs", clean=True)
    tried = joined.filter("own").groupBy("ctx").agg(F.max("total").alias("total"), F.sum("n").alias("n"), F.sum("above").alias("above"), F.count("*").alias("symbols"), F.sum(F.col("n") * F.log(F.col("smooth") / F.col("above"))).alias("gain"))
    others = F.greatest(F.lit(0), F.col("total") - F.col("n"))
    tried = tried.filter("above < 1 - 1e-9").withColumn("scale", (others + PRIOR * (1 - F.col("above"))) / (F.col("total") + PRIOR) / (1 - F.col("above")))
    passed = F.col("gain") + others * F.log("scale") > GAIN + 0.5 * F.log("total") * F.col("symbols")
    kept = store.cut(tried.filter(passed).select("ctx", "total", "scale"), "contexts", clean=True)
    rows = joined.join(kept.select("ctx", "scale"), "ctx", "left")
    inside = F.col("scale").isNotNull()
    p = F.when(inside & F.col("own"), F.col("smooth")).when(inside, F.col("scale") * F.col("above")).otherwise(F.col("above"))
    entry = F.when(inside & F.col("own"), F.log10(F.col("smooth") / F.col("above")) - F.log10("scale"))
    out = store.cut(rows.select("key", "n", p.alias("p"), entry.alias("entry")), "level", clean=True)
    store.drop(joined)
    return out, kept.select(F.col("ctx").alias("key"), F.col("total").alias("n"), F.log10("scale").alias("alpha"))


def train(df: DataFrame, store: Store, text_col: str = "text", depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree of all rows of df (a null text is empty), and the table of all words' counts (key, n)."""
    context = df.sparkSession.sparkContext
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = store.cut(_counted(texts), "words", clean=True)
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.filter(F.col("n") >= MIN_WORD * total).toArrow()  # at most 1 / MIN_WORD rows
    words = Known()
    words.add(*(common[c].to_numpy().view(np.uint64) for c in ("a", "b")), np.arange(common.num_rows))
    n = common["n"].to_numpy()

    denominator = total + ADD * (kinds + 1)
    # as many texts end as begin
    edge = counts.filter((F.col("a") == int(END[0, 0])) & (F.col("b") == int(END.view(np.int64)[1, 0]))).select(F.lit(int(BEFORE)).cast("long").alias("key"), "n")
    # runs of one word go by its hash: words that share one are one run
    level = counts.filter(F.col("n") >= LEAST).groupBy("key").agg(F.sum("n").alias("n")).unionByName(edge).select("key", "n", ((F.col("n") + ADD) / denominator).alias("p"))
    level = store.cut(level, "level", clean=True)
    filters, levels = [_filter(level)], [level]
    tables, tagged = [], []
    for d in range(1, depth + 1):
        shared = context.broadcast(filters[-1])

        def keys_of(data, offsets, shared=shared, d=d):
            tokens, first, _ = _words(data, offsets)
            runs = _runs(tokens, first, d)
            # no run is more frequent than the shorter runs in it
            ok = (runs[d] > 0) & _holds(shared.value, runs[d - 1])
            ok &= _holds(shared.value, _shifted(runs[d - 1], first, d))
            return (runs[d][ok] << TAG) | np.repeat(_tags(tokens, first), np.diff(first))[ok]

        table = store.cut(_frequent(texts, keys_of, total), "counts", clean=True)
        shared.unpersist()
        tables.append(table)
        filters.append(_filter(table))
        tagged.append(_filter(table.select((F.shiftleft("key", int(TAG)).bitwiseOR(F.col("tag"))).alias("key"))))
    shared = context.broadcast((filters, tagged))

    def name(batch: pa.RecordBatch):
        """The frequent runs of the texts that are to tell their parts: context, and the run without its first word."""
        filters, tagged = shared.value
        data, offsets, _ = buffers(batch.column(0))
        for i, j in chunks(offsets):
            tokens, first, _ = _words(data, offsets[i : j + 1])
            runs = _runs(tokens, first, depth)
            tag = np.repeat(_tags(tokens, first), np.diff(first))
            for d in range(1, depth + 1):
                at = np.flatnonzero((runs[d] > 0) & _holds(filters[d], runs[d]))
                at = at[_holds(tagged[d - 1], (runs[d][at] << TAG) | tag[at])]
                key, once = np.unique(runs[d][at], return_index=True)
                at = at[once]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), *(pa.array(x.view(np.int64)) for x in (key, _shifted(runs[d - 1], first, d)[at], runs[d - 1][at]))], ["d", "key", "ctx", "suffix"])

    names = store.cut(arrow_map(texts, name, "d int, key long, ctx long, suffix long").dropDuplicates(["d", "key"]), "names", clean=True)
    parts = []
    for d, table in enumerate(tables, 1):
        level, kept = _grow(table.select("key", "n").join(names.filter(F.col("d") == d).drop("d"), "key"), level, store)
        levels.append(level)
        parts += [level.filter("entry IS NOT NULL").select("key", "n", "entry", F.lit(0.0).alias("alpha")), kept.select("key", "n", F.lit(0.0).alias("entry"), "alpha")]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    nodes = store.cut(nodes.groupBy("key").agg(F.max("n").alias("n"), F.sum("entry").alias("entry"), F.sum("alpha").alias("alpha")), "nodes", clean=True)
    store.drop(names, *tables, *levels)
    start = nodes.filter(F.col("key") == int(BEFORE)).agg(F.coalesce(F.sum("alpha"), F.lit(0.0))).first()[0]
    place = nodes.filter(F.col("n") >= MIN_WORD * total).toArrow()  # at most 1 / MIN_WORD rows a length
    keys = place["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = [place[c].to_numpy()[order] for c in ("entry", "alpha")]
    return Tree(words, n, int(total), int(kinds), depth, keys[order], *values, _filter(nodes), float(start), nodes), counts


def _tags(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A few bits for each text, the same for equal texts."""
    return mix(np.add.reduceat(tokens, first[:-1])) >> (np.uint64(64) - TAG) if len(first) > 1 else np.zeros(0, np.uint64)


def _answered(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(chunk, part, value): for each blob of keys asked for, the 64 bits of the values that the table (part, a, b, value) has for them, 0 where none."""

    def answer(questions: pa.Table, rows: pa.Table) -> pa.Table:
        known = Known()
        known.add(*(rows[c].to_numpy().view(np.uint64) for c in ("a", "b")), np.arange(rows.num_rows))
        values = np.append(rows["value"].to_numpy().view(np.uint64), np.uint64(0))
        out = []
        for first, second in zip(questions["first"], questions["second"], strict=True):
            first = _unpacked_up(first)
            out.append(_packed(values[known.find(first, _unpacked(second) if second.is_valid else np.zeros_like(first))]))
        return pa.table({"chunk": questions["chunk"], "part": questions["part"], "value": pa.array(out, pa.binary())})

    return asked.select("chunk", "part", "first", "second").groupBy("part").cogroup(table.groupBy("part")).applyInArrow(answer, "chunk long, part int, value binary")


def score(df: DataFrame, tree: Tree, counts: DataFrame, store: Store, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns of each row with n_tokens, n_known, train_tokens, base_score and score.

    Both scores are log10 probabilities of a text with its end: base_score by
    the root alone, score by the tree. A null text is empty: its end is its
    one token. Repeated rows each give a row. Without training tokens every
    token has probability 1 / 1 by the root of one kind. A kept column that
    has the name of a score gives way to it.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    shared = df.sparkSession.sparkContext.broadcast(replace(tree, nodes=None))
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    kept = [f"k{i}" for i in range(len(keep))]
    kinds = {f"k{i}": df.schema[c].dataType.simpleString() for i, c in enumerate(keep)}
    bits = max(3, (tree.total // RANGE).bit_length())  # of the ranges that answer

    def measured(batches):
        own = shared.value
        logs, values = np.log10(own.counts + ADD), own.entry + own.alpha
        chunk, held = TaskContext.get().partitionId() << 32, 0
        docs, words, runs = [], [], []  # of texts: columns, and the numbers of their questions' places; keys asked for
        for batch in batches:
            data, offsets, _ = buffers(batch.column(len(keep)))
            for i, j in chunks(offsets):
                tokens, first, keys = _words(data, offsets[i : j + 1])
                at = own.words.find(*keys)
                known = at >= 0
                text_of = np.repeat(np.arange(j - i), np.diff(first))
                base = np.bincount(text_of[known], logs[at[known]], j - i).astype(float)  # without words, of integers
                gain = np.full(j - i, own.start)
                place, key = [], []
                for run in _runs(tokens, first, own.depth):
                    maybe = np.flatnonzero((run > 0) & _holds(own.held, run))
                    here = _search(own.keys, run[maybe])
                    found = here >= 0
                    gain += np.bincount(text_of[maybe[found]], values[here[found]], j - i)
                    place.append(text_of[maybe[~found]])
                    key.append(run[maybe[~found]])
                place, key = np.concatenate(place), np.concatenate(key)
                order = np.argsort(place, kind="stable")
                docs.append(([c.slice(i, j - i) for c in batch.columns[:-1]], np.diff(first), np.bincount(text_of[known], minlength=j - i), base, gain, text_of[~known], place[order]))
                words.append(keys[:, ~known])
                runs.append(key[order])
                held += len(key) + int((~known).sum())
                if held > ASKED:
                    yield from flushed(chunk, docs, words, runs)
                    chunk, held, docs, words, runs = chunk + 1, 0, [], [], []
        if docs:
            yield from flushed(chunk, docs, words, runs)

    names = ["chunk", "at", *kept, "n_tokens", "n_common", "logs", "gain", "words_of", "runs_of", "part", "first", "second", "kind"]
    schema = ", ".join(["chunk long, at long", *(f"{k} {t}" for k, t in kinds.items()), "n_tokens long, n_common long, logs double, gain double, words_of binary, runs_of binary, part int, first binary, second binary, kind string"])
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def flushed(chunk: int, docs: list, words: list, runs: list):
        def batch(kind: str, at: np.ndarray, columns=None, **more: pa.Array) -> pa.RecordBatch:
            columns = columns or [pa.nulls(len(at), c.type) for c in docs[0][0]]
            rest = [more.get(name, pa.nulls(len(at), t)) for name, t in zip(names[2 + len(kept) : -1], types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at), *columns, *rest, pa.array([kind] * len(at), pa.string())], names)

        asked = np.concatenate(words, axis=1)
        at, own = grouped(*asked)
        range_of = (_hashes(asked[:, at]) >> np.uint64(56 - bits)).astype(np.int32)
        order = np.lexsort((asked[0, at], range_of))  # questions go by range
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        asked, words_of, ranges = asked[:, at[order]], number[own], range_of[order]
        keys, runs_of = np.unique(np.concatenate(runs), return_inverse=True)
        row = w = r = 0
        for columns, n, common, logs, gain, word_in, run_in in docs:
            # of the texts' questions, the text and the question's number: in order, as sums need no other
            lists = [_packed_up(np.sort(text.astype(np.uint64) << np.uint64(32) | of.astype(np.uint64))) for text, of in ((word_in, words_of[w : w + len(word_in)]), (run_in, runs_of[r : r + len(run_in)]))]
            yield batch("texts", row + np.arange(len(n)), columns, n_tokens=pa.array(n), n_common=pa.array(common), logs=pa.array(logs), gain=pa.array(gain))
            yield batch("texts", np.array([row]), words_of=pa.array(lists[:1], pa.binary()), runs_of=pa.array(lists[1:], pa.binary()))
            row, w, r = row + len(n), w + len(word_in), r + len(run_in)
        for kind, part, first, second in (("words", ranges, *asked), ("runs", (keys >> np.uint64(56 - bits)).astype(np.int32), keys, None)):
            new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            spans = list(zip(new, np.append(new, len(part))[1:], strict=True))
            blobs = {"first": [_packed_up(first[a:b]) for a, b in spans], "second": [None if second is None else _packed(second[a:b].copy()) for a, b in spans]}
            yield batch(kind, np.zeros(len(new), np.int64), part=pa.array(part[new]), **{k: pa.array(x, pa.binary()) for k, x in blobs.items()})

    table = store.cut(over_batches(rows, measured, schema), "measured", "kind", clean=True)
    bound = MIN_WORD * tree.total
    range_ = F.shiftrightunsigned("key", 56 - bits).cast("int").alias("part")
    tables = {"words": counts.filter(F.col("n") < bound).select(range_, "a", "b", F.col("n").alias("value"))}
    if tree.nodes is not None:
        tables["runs"] = tree.nodes.filter(F.col("n") < bound).select(range_, F.col("key").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("entry") + F.col("alpha")).alias("value"))
    answers = []
    for kind, known in tables.items():  # one kind after the other: questions go as soon as they are answered
        answers.append(store.cut(_answered(table.filter(F.col("kind") == kind), known), "answers", clean=True).withColumn("kind", F.lit(kind)))
        store.drop_part(table, f"kind={kind}")
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)

    log_add, log_total = float(np.log10(ADD)), float(np.log10(tree.total + ADD * (tree.kinds + 1)))
    total = tree.total

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        found, docs = found.sort_by([("part", "ascending")]), docs.sort_by([("at", "ascending")])
        lists = docs.filter(pc.is_valid(docs["words_of"]))
        docs = docs.filter(pc.is_valid(docs["n_tokens"]))

        def answered(kind: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.uint64), *(_unpacked(v) for v in found.filter(pc.equal(found["kind"], kind))["value"])])

        def places(column: str) -> tuple[np.ndarray, np.ndarray]:
            """The text of each of the texts' questions, and the question's number."""
            each = [_unpacked_up(x) + (np.uint64(row) << np.uint64(32)) for row, x in zip(lists["at"].to_pylist(), lists[column], strict=True)]
            each = np.concatenate([np.zeros(0, np.uint64), *each])
            return (each >> np.uint64(32)).astype(np.int64), (each & np.uint64(0xFFFFFFFF)).astype(np.int64)

        n = docs["n_tokens"].to_numpy()
        (text, word), seen = places("words_of"), answered("words")
        text, word = text[seen[word] > 0], word[seen[word] > 0]
        known = docs["n_common"].to_numpy() + np.bincount(text, minlength=len(n))
        logs = docs["logs"].to_numpy() + np.bincount(text, np.log10(seen + ADD)[word], len(n))
        (text, run), values = places("runs_of"), answered("runs").view(float)
        gain = docs["gain"].to_numpy() + (np.bincount(text, values[run], len(n)) if len(values) else 0.0)
        base = logs + (n - known) * log_add - n * log_total
        out = [*(docs[k] for k in kept), pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(base + gain)]
        return pa.table(out, names=[*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    docs = table.filter("kind = 'texts'").select("chunk", "at", *kept, "n_tokens", "n_common", "logs", "gain", "words_of", "runs_of")
    out = docs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "n_tokens long, n_known long, train_tokens long, base_score double, score double"]))
    return out.toDF(*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
