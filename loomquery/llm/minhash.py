"""Near-duplicate groups by MinHash.

Each text's set of word shingles gets many universal hash minima
(multiply-shift, one odd multiplier each). Bands of minima bring candidates
together; a candidate pair's whole signatures are compared, and pairs that
pass are confirmed on their full shingle sets. Texts of the same words are one
class and take part once. Within a bucket, every member is first paired with
the least one. Only buckets whose members are then not all connected go on:
small ones pair all their members that aren't connected; the members of larger
ones, by groups of buckets that share members, are dealt into blocks, and each
two blocks meet in one task, which compares signatures and full sets in place
and returns no more links than it takes to connect its members. So no partner
is left out, and the pairs that are written grow with the members of a group.
Connected components come from alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm._store import Store, arrow_map, give_back
from loomquery.llm._text import SPACED, buffers, chunks, distinct, mix, split_words, window_keys
from loomquery.llm.components import components

#: At a similarity of 0.8, 48 bands of 6 minima miss a pair once in 2 million.
BANDS, ROWS = 48, 6
#: Matching minima below which a pair's similarity is under 0.8 but for six standard errors.
SLACK = 6.0
#: Members up to which a bucket pairs all that aren't connected; texts and shingles of a block beyond that, on average.
SMALL, BLOCK, BLOCK_SHINGLES = 16, 1024, 1 << 20
#: Bits of the filter that keeps texts without candidates out of the shuffle.
FILTER_BITS = 1 << 23

_rng = np.random.default_rng(0xB0D5)
_FACTORS = _rng.integers(0, 1 << 32, 4096, dtype=np.uint32) | np.uint32(1)
_KEYS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Each text's words (joined) and set of shingles, as two rows of 128-bit values' halves; a text of fewer words is one shingle."""
    words = split_words(data, offsets, SPACED)
    first, second = words.keys()
    x, y = window_keys(first, second, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a < size:
            yield words, a, b, np.stack(window_keys(first[a:b], second[a:b], b - a) if a < b else (x[:0], y[:0]))
        else:
            yield words, a, b, np.stack(distinct(x[a : b - size + 1], y[a : b - size + 1]))


def minima(grams: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of count hash functions over a set that isn't empty."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(best, (x[i : i + 256, None] * _FACTORS[:count]).min(axis=0), out=best)
    return best


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = mins[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return mix((parts * _KEYS[:rows]).sum(axis=1, dtype=np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64)))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, cls (a digest of the words), keys of the bands and sig (16 bits of each minimum) of each row."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batch: pa.RecordBatch):
        data, offsets, _ = buffers(batch.column(1))
        n, cls, keys, sig = [], [], [], []
        for i, j in chunks(offsets):
            for words, a, b, grams in shingle_sets(data, offsets[i : j + 1], size):
                n.append(grams.shape[1])
                if not grams.shape[1]:
                    cls.append(None)
                    keys.append(np.zeros(0, np.int64))
                    sig.append(b"")
                    continue
                mins = minima(grams[0], bands * rows)
                cls.append(_class(words, a, b))
                keys.append(band_keys(mins, bands, rows).view(np.int64))
                sig.append(mins.astype(np.uint16).tobytes())
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys))), pa.array(sig, pa.binary())], ["id", "n_shingles", "cls", "keys", "sig"])

    return arrow_map(docs, sign, f"id {kind}, n_shingles long, cls binary, keys array<long>, sig binary")


def _class(words, a: int, b: int) -> bytes:
    """A digest of a text's words, whatever is between them."""
    raw = words.low[words.start[a] : words.end[b - 1]]
    return hashlib.blake2b(b" ".join(raw.tobytes().split()), digest_size=16).digest()


def _least(minima_count: int, percent: int) -> int:
    """Matching minima that a pair needs to be looked at."""
    p = percent / 100
    return int(minima_count * p - SLACK * (minima_count * p * (1 - p)) ** 0.5)


def _texts_of(ids: DataFrame, docs: DataFrame, store: Store) -> DataFrame:
    """A written table of the texts (id, text) that holds those of all given ids, and few others.

    A fixed number of bits says which texts can be needed; more ids only make
    it less selective.
    """
    kind = docs.schema["id"].dataType.simpleString()
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    needed = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[needed["w"].to_numpy(dtype=np.int64)] = needed["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def maybe(batch: pa.RecordBatch):
        s = np.asarray(batch.column(2))
        yield batch.select([0, 1]).filter(pa.array((shared.value[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    rows = docs.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text", slot.alias("s"))
    return store.cut(arrow_map(rows, maybe, f"id {kind}, text string"), "texts")


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    data, offsets, _ = buffers(column)
    return [s[3] for i, j in chunks(offsets) for s in shingle_sets(data, offsets[i : j + 1], size)]


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sets share."""
    both = np.concatenate([x, y], axis=1)
    order = np.argsort(both[0], kind="stable")
    same, equal = (h[1:] == h[:-1] for h in both[:, order])
    if (same & ~equal).any():  # halves are equal where values aren't
        order = np.lexsort((both[1], both[0]))
        same, equal = (h[1:] == h[:-1] for h in both[:, order])
    return int((same & equal).sum())


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n, m = x.shape[1], y.shape[1]
    if min(n, m) * 100 < percent * max(n, m):
        return False
    both = _shared(x, y)
    return 100 * both >= percent * (n + m - both)


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, store: Store, size: int, percent: int, minima_count: int) -> DataFrame:
    """The pairs (a, b) of at least percent similarity, by signature and then by full set; written."""
    kind = docs.schema["id"].dataType.simpleString()
    least = _least(minima_count, percent)

    def alike(batch: pa.RecordBatch):
        sa, sb = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
        yield batch.select([0, 1]).filter(pa.array((sa == sb).sum(axis=1) >= least))

    own = sigs.select("id", "sig", "n_shingles")
    likely = pairs.join(own.withColumnsRenamed({"id": "a", "sig": "sa", "n_shingles": "na"}), "a").join(own.withColumnsRenamed({"id": "b", "sig": "sb", "n_shingles": "nb"}), "b")
    likely = likely.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    likely = store.cut(arrow_map(likely.select("a", "b", "sa", "sb"), alike, f"a {kind}, b {kind}"), "likely")
    texts = _texts_of(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))), docs, store)

    def confirm(batch: pa.RecordBatch):
        good: list[bool] = []
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            good += [_alike(x, y, percent) for x, y in zip(_sets(part.column(2), size), _sets(part.column(3), size), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    full = likely.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    links = store.cut(arrow_map(full.select("a", "b", "ta", "tb"), confirm, f"a {kind}, b {kind}").distinct(), "links")
    store.drop(texts, likely)
    return links


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of small buckets that aren't connected and not too unlike in size."""
    first = members.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("rn").alias("ra"), F.col("component").alias("ca"))
    met = members.join(first, "key").filter((F.col("rn") > F.col("ra")) & (F.col("component") != F.col("ca")))
    met = met.filter(F.least("n", "na") * 100 >= F.greatest("n", "na") * percent)
    return met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).filter("a < b").distinct()


def _in_blocks(members: DataFrame, sigs: DataFrame, docs: DataFrame, store: Store, size: int, percent: int, minima_count: int) -> DataFrame:
    """Links that connect all members of large buckets that links can connect; written."""
    kind = docs.schema["id"].dataType.simpleString()
    least = _least(minima_count, percent)
    groups = store.cut(components(members.select(F.col("low_id").alias("a"), F.col("id").alias("b")), store), "groups")
    labels = members.groupBy("id").agg(F.min("component").alias("label"), F.max("n").alias("n"))
    named = groups.withColumnRenamed("node", "id").join(labels, "id")
    sizes = named.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = named.drop("n").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = store.cut(dealt, "dealt")
    texts = _texts_of(dealt.select("id"), docs, store)
    rows = dealt.join(sigs.select("id", "sig"), "id").join(texts, "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "sig", "text")

    def compare(table: pa.Table) -> pa.Table:
        try:
            return pairs_of(table)
        finally:
            give_back()

    def pairs_of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, labels_, block = (table.column(c).to_pylist() for c in ("id", "label", "block"))
        sets = _sets(table.column("text").combine_chunks(), size)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        n = np.array([x.shape[1] for x in sets])
        block = np.array(block)
        up = {x: x for x in labels_}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        links: list = []
        for x in left.tolist():
            own = right[right > x] if block.min() == block.max() else right
            own = own[np.minimum(n[own], n[x]) * 100 >= percent * np.maximum(n[own], n[x])]
            same = (sig[own] == sig[x]).sum(axis=1)
            for y in own[same >= least].tolist():
                a, b = top(labels_[x]), top(labels_[y])
                if a != b and _alike(sets[x], sets[y], percent):
                    up[max(a, b)] = min(a, b)
                    links.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([a for a, _ in links], table.schema.field("id").type), "b": pa.array([b for _, b in links], table.schema.field("id").type)})

    links = store.cut(rows.groupBy("component", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"), "links")
    store.drop(texts, groups, dealt)
    return links


def _by_ids(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the representatives of all classes that an id belongs to."""
    several = linked.groupBy("id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high").select("id")
    reps = linked.select("id", "cls").join(several, "id").distinct().join(classes, "cls")
    least = reps.groupBy("id").agg(F.min("rep").alias("a"))
    return reps.join(least, "id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the least id reachable by links), kept (id = component_id).

    Texts are linked if 100 * intersection >= percent * union of their sets of
    shingle-word shingles; a text of fewer words is one shingle. A text that
    is null or without words has 0 shingles and no link. Rows that repeat an
    id are one document with each of their texts; rows with a null id are
    linked with nothing, have a null component and are kept. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    store = Store(spark, "minhash")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sigs = store.cut(signatures(docs, shingle, bands, rows), "signatures")
    linked = sigs.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = store.cut(linked.groupBy("cls").agg(F.min("id").alias("rep")), "classes")

    reps = linked.join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"]).dropDuplicates(["cls", "id"])
    reps = store.cut(reps.select("id", F.col("n_shingles").alias("n"), "keys"), "representatives")
    keyed = reps.select("id", "n", F.explode("keys").alias("key"))
    # counted before the rows meet: a bucket of any size is dealt over tasks when it is joined
    buckets = keyed.groupBy("key").agg(F.min("id").alias("low_id"), F.count("*").alias("size")).filter("size > 1")
    members = store.cut(keyed.join(buckets, "key"), "members")
    verify = (sigs, docs, store, shingle, percent, bands * rows)
    links = _verified(members.filter("low_id < id").select(F.col("low_id").alias("a"), F.col("id").alias("b")).distinct(), *verify)
    found = store.cut(components(links, store), "components")

    # buckets whose members aren't all connected: the rest of their pairs
    after = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    after = store.cut(after, "members")
    store.drop(members, reps)
    apart = after.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    rest = store.cut(after.join(apart, "key"), "members")
    few = rest.filter(F.col("size") <= SMALL)
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id", "n")))  # at most SMALL rows a key
    more = _verified(_pairs(few, percent), *verify)
    blocks = _in_blocks(rest.filter(F.col("size") > SMALL), *verify)
    store.drop(found, after, rest)
    shared = _by_ids(linked, classes)
    found = store.cut(components(links.unionByName(more).unionByName(blocks).unionByName(shared), store), "components")
    rows_ = store.cut(sigs.select("id", "n_shingles", "cls"), "rows")
    store.drop(links, more, blocks, sigs)

    by_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = rows_.join(by_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df without the rows whose id near_duplicates() doesn't keep; all columns stay as they are."""
    dropped = near_duplicates(df, id_col=id_col, **options).filter("NOT kept").select(id_col)
    return df.join(dropped, id_col, "left_anti").select(df.columns)
