"""Language identification by language-bitmask n-gram filters.

All byte 4-grams of a language's training texts belong to that language. They
go into bit-sliced Bloom filters, sized by their counted number: every slot is
a bitmask of languages, so one probe of an n-gram returns all languages
containing it. A text's popcounts per
language are corrected for the false positives that each language's fill
brings about; the largest corrected count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import Store, arrow_map, over_batches
from loomquery.llm._text import buffers, chunks, mix, sums

#: Least and most slots of the filters, slots for each n-gram of the language with most, probes per n-gram.
SLOTS, MOST, ROOM, PROBES = 1 << 18, 1 << 23, 8, 3
NONE = "und"

#: ASCII letters lowered, bytes beyond ASCII as they are, all else a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_BLANK = np.uint32(0x20202020)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte 4-grams of the texts, each framed by spaces, without blank ones; and the text of each."""
    base, n = offsets[0], len(offsets) - 1
    size = np.diff(offsets)
    framed = np.full(int(offsets[-1] - base) + 4 * n, 0x20, np.uint8)  # 2 spaces on either side
    begin = offsets[:-1] - base + 4 * np.arange(n) + 2
    place = np.arange(int(offsets[-1] - base)) + np.repeat(4 * np.arange(n) + 2, size)
    framed[place] = _FOLD[data[base : offsets[-1]]]
    wide = framed.astype(np.uint32)
    gram = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    text = np.repeat(np.arange(n), size + 4)[: len(gram)] if n else np.zeros(0, np.int64)
    inside = np.arange(len(gram)) <= np.repeat(begin + size - 2, size + 4)[: len(gram)]  # the last starts 2 before the end
    keep = inside & (gram != _BLANK) & (size[text] > 0)
    return gram[keep], text[keep]


def has_letter(raw: np.ndarray) -> bool:
    """Whether there is a letter: an ASCII one, or else any of Unicode's."""
    low = raw | 0x20
    return bool(((low >= 97) & (low <= 122)).any()) or any(c.isalpha() for c in raw.tobytes().decode(errors="ignore"))


def _slots(gram: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + np.uint64(0x51ED270B))
    step = (h >> np.uint64(33)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(probes)]


@dataclass
class Filters:
    """Bit-sliced filters: masks[w, slot] holds languages 64 w .. 64 w + 63."""

    langs: list[str]
    masks: np.ndarray
    probes: int

    def __post_init__(self):
        slots = self.masks.shape[1]
        fill = np.array([((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum() / slots for i in range(len(self.langs))])
        self.false = fill**self.probes

    def counts(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected number of each text's n-grams that each language contains."""
        at = _slots(gram, self.masks.shape[1], self.probes)
        n = np.diff(first).astype(float)
        out = np.zeros((len(n), len(self.langs)))
        for w in range(len(self.masks)):
            held = self.masks[w][at[0]]
            for more in at[1:]:
                held &= self.masks[w][more]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                hits = sums(((held >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64), first)
                out[:, i] = np.clip((hits - n * self.false[i]) / max(1e-9, 1 - self.false[i]), 0, n)
        return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS, probes: int = PROBES) -> Filters:
    """Filters of every non-null language in df, from all its rows.

    Null and empty texts add nothing. What reaches the driver is bounded by
    the number of slots, not by the rows; slots follow the number of different
    n-grams up to MOST (64 MB for every 64 languages). Beyond that all n-grams
    still enter, and the counts' correction takes in the larger fill.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches):
        held: dict[str, list] = {}

        def merged(lang):
            g = np.concatenate([x[0] for x in held[lang]])
            c = np.concatenate([x[1] for x in held[lang]])
            own, back = np.unique(g, return_inverse=True)
            held[lang] = [(own, np.bincount(back, weights=c).astype(np.int64))]
            return held[lang][0]

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            data, offsets, _ = buffers(batch.column(0))
            for i, j in chunks(offsets, 4 << 20):
                gram, text = grams(data, offsets[i : j + 1])
                for lang in sorted(set(names[i:j].tolist())):
                    held.setdefault(lang, []).append(np.unique(gram[(names[i:j] == lang)[text]], return_counts=True))
                    if len(held[lang]) >= 16:
                        merged(lang)
        for lang in held:
            g, c = merged(lang)
            for i in range(0, len(g), 100_000):
                k = len(g[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(g[i : i + k].astype(np.int64)), pa.array(c[i : i + k])], ["lang", "gram", "n"])

    counts = over_batches(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    store = Store(spark, "langid")
    counts = store.cut(counts, "counts")
    kinds = counts.groupBy("lang").agg(F.count("*").alias("kinds")).orderBy("lang").collect()  # a row for each language
    langs = [r.lang for r in kinds]
    slots = max(slots, min(MOST, 1 << (ROOM * max((r.kinds for r in kinds), default=1) - 1).bit_length()))
    masks = np.zeros((max(1, -(-len(langs) // 64)), slots), np.uint64)
    if langs:
        code = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
        own = counts.select("gram", code[F.col("lang")].alias("code"))

        def place(batch: pa.RecordBatch):
            gram, code = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            at = _slots(gram, slots, probes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.tile(code // 64, probes)), pa.array((np.uint64(1) << (np.tile(code, probes) % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "mask"])

        sliced = arrow_map(own, place, "slot long, word int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most slots rows a word
        masks[sliced["word"].to_numpy(), sliced["slot"].to_numpy()] = sliced["mask"].to_numpy().view(np.uint64)
    store.drop(counts)
    return Filters(langs, masks, probes)


def identify(df: DataFrame, filters: Filters, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns of each row with lang_pred and score (0 to 1: the best language's part of all corrected counts).

    A null text, one without a letter, and any text when no language was
    learned give ``und`` with score 0. A text of which no n-gram is known
    gives the first language by name with score 0. Ties go to the first name.
    A kept column named lang_pred or score gives way to the result.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    shared = df.sparkSession.sparkContext.broadcast(filters)  # masks: slots * 8 bytes for every 64 languages
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def decide(batch: pa.RecordBatch):
        own = shared.value
        data, offsets, valid = buffers(batch.column(len(keep)))
        names, scores = [], []
        for i, j in chunks(offsets):
            at = offsets[i : j + 1]
            gram, text = grams(data, at)
            counts = own.counts(gram, np.searchsorted(text, np.arange(j - i + 1))) if own.langs else np.zeros((j - i, 1))
            best, total = counts.argmax(axis=1), counts.sum(axis=1)
            part = np.where(total > 0, counts.max(axis=1) / np.maximum(total, 1e-12), 0.0)
            for k in range(j - i):
                known = own.langs and valid[i + k] and has_letter(data[at[k] : at[k + 1]])
                names.append(own.langs[best[k]] if known else NONE)
                scores.append(float(part[k]) if known else 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return arrow_map(rows, decide, f"{schema}, lang_pred string, score double")
