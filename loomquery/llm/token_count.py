"""Token counts of whole texts, by Arrow batches that return lengths only.

A batch is cut into chunks balanced by bytes; a chunk's texts, however long,
are split at white space, where this kind of tokenizer never joins tokens,
and each different word of a chunk is encoded once. Counts, never token ids,
leave the function.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import over_batches
from loomquery.llm._text import SPACED, Known, buffers, chunks, grouped, split_words

#: Bytes of text in a chunk, words handed to the library at once, and known words that a task holds.
CHUNK = 2 << 20
WORDS_AT_ONCE = 20_000
HELD = 1 << 20


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run in parallel, the library needn't
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def breaks_at_spaces(path: str) -> bool:
    """Whether no token and no special string of the vocabulary can span ASCII white space.

    True if texts are lowered and matched by a pattern that removes what is
    between matches; otherwise whole texts are encoded.
    """
    import json

    t = json.loads(tokenizer(path).to_str())
    pre, norm = t.get("pre_tokenizer") or {}, t.get("normalizer") or {}
    steps = pre.get("pretokenizers", [pre])
    split = steps[0]
    removed = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and "^\\s" in split.get("pattern", {}).get("Regex", "")
    local = {"NFC", "Lowercase", "Replace"} >= {x["type"] for x in norm.get("normalizers", [norm]) if x}
    plain = not any(c.isspace() for a in t.get("added_tokens", []) for c in a["content"]) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in t.get("added_tokens", []))
    return bool(removed and local and plain)


def lengths(texts: list[str], path: str) -> np.ndarray:
    own = tokenizer(path)
    return np.array([len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)], dtype=np.int64)


class Counter:
    """Token counts of texts; a task's different words are encoded once, as long as no more than HELD are known.

    Words are told apart by their 128-bit keys, which most words are themselves.
    """

    def __init__(self, path: str):
        self.path = path
        self.known, self.counts = Known(), np.zeros(0, np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts bounded by offsets."""
        if not breaks_at_spaces(self.path):
            return lengths([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], self.path)
        words = split_words(data, offsets, SPACED, lower=False)
        if not len(words.start):
            return np.zeros(len(offsets) - 1, np.int64)
        if len(self.counts) > HELD:
            self.__init__(self.path)
        keys = np.stack(words.keys())
        at, own = grouped(*keys)
        number = self.known.find(*keys[:, at])
        new = at[number < 0]
        found = [lengths([words.word(k).decode() for k in new[i : i + WORDS_AT_ONCE]], self.path) for i in range(0, len(new), WORDS_AT_ONCE)]
        number[number < 0] = len(self.counts) + np.arange(len(new))
        self.counts = np.concatenate([self.counts, *found])
        self.known.add(*keys[:, new], number[number >= len(self.counts) - len(new)])
        return np.bincount(words.text_of(), weights=self.counts[number[own]], minlength=len(offsets) - 1).astype(np.int64)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of df: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows each give a row; other columns of df are ignored; an empty
    table gives an empty result. Texts of any length are counted whole.
    """

    def count(batches):
        own = Counter(path)
        for batch in batches:
            data, offsets, _ = buffers(batch.column(1))
            counts = np.concatenate([np.zeros(0, np.int64), *(own.count(data, offsets[i : j + 1]) for i, j in chunks(offsets, CHUNK))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    out = over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
