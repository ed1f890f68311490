"""Quality classification by a regularised quadratic discriminant.

Each text becomes a vector of transformed document statistics. Two classes
have a mean and a covariance each, shrunk towards the pooled covariance and
its diagonal; a score is the logistic of the difference of the log densities,
whose Mahalanobis distances come from cached Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import arrow_map, over_batches
from loomquery.llm._text import SPACED, buffers, chunks, split_words, sums

THRESHOLD = 0.3
FEATURES = 18

_UPPER, _LOWERED, _DIGIT, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWERED[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = ~(_UPPER | _LOWERED | _DIGIT | _SPACE | _HIGH)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def _runs(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """1 where an element equals its predecessor in the same text."""
    same = np.zeros(len(value), np.int64)
    same[1:] = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    return same


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text; all are defined for an empty one."""
    n = len(offsets) - 1
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    words = split_words(data, offsets, SPACED, lower=False)
    n_words, n_bytes = words.counts.astype(float), np.diff(at).astype(float)
    part = lambda table: sums(table[raw].astype(np.int64), at) / np.maximum(n_bytes, 1)
    per_word = lambda x: sums(x.astype(np.int64), words.first) / np.maximum(n_words, 1)
    length = words.end - words.start
    h, text = words.hashes(), words.text_of()
    pair = h ^ (text.astype(np.uint64) << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    fresh = np.zeros(len(h), np.int64)
    fresh[np.unique(pair, return_index=True)[1]] = 1
    line_of = np.cumsum(raw == 10)
    lines = sums((raw == 10).astype(np.int64), at) + 1.0
    line_end = np.zeros(len(h), bool)
    if len(h):
        line_end[:-1] = line_of[words.start[1:] - 1] != line_of[words.end[:-1] - 1]
    first_byte, last_byte = raw[words.start], raw[words.end - 1]
    all_upper = sums_by(words, _UPPER[raw], at) == length
    mean_length = sums(length, words.first) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(per_word(length**2) - mean_length**2, 0))
    root = lambda x: np.sqrt(x + 1e-4)
    columns = [
        np.log1p(n_words), np.log1p(mean_length), np.log1p(spread), np.log1p(n_words / lines),
        root(part(_UPPER)), root(part(_DIGIT)), root(part(_SYMBOL & ~_STOP)), root(part(_STOP)), part(_SPACE),
        root(per_word(_SYMBOL[last_byte] & ~_STOP[last_byte])), root(per_word(_SYMBOL[first_byte])),
        root(per_word((length > 1) & all_upper)), root(per_word(length == 1)), root(per_word(length > 12)),
        sums(fresh, words.first) / np.maximum(n_words, 1) * np.log1p(n_words) / 5, root(per_word(_runs(h, text))),
        root(per_word(_STOP[last_byte])), root(part(np.arange(256) == ord("|"))),
    ]
    return np.column_stack(columns) if n else np.zeros((0, FEATURES))


def sums_by(words, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[words.end] - total[words.start]


def batch_features(column: pa.Array) -> np.ndarray:
    data, offsets, _ = buffers(column)
    return np.concatenate([features(data, offsets[i : j + 1]) for i, j in chunks(offsets)])


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of two classes, and the offset of the scores."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offset: float

    @classmethod
    def fit(cls, count: list[float], total: list[np.ndarray], outer: list[np.ndarray], shrink: float = 0.1, ridge: float = 0.02, scale: float = 1.0) -> Discriminant:
        """From each class's number of rows, sum and sum of outer products. A class without rows takes the other's."""
        d = len(total[0])
        if not sum(count):
            return cls([np.zeros(d)] * 2, [np.eye(d)] * 2, 0.0)
        means, covs = [], []
        for c in (0, 1):
            own = c if count[c] else 1 - c
            mean = total[own] / count[own]
            means.append(mean)
            covs.append(outer[own] / count[own] - np.outer(mean, mean))
        pooled = sum(n * s for n, s in zip(count, covs, strict=True)) / sum(count)
        base = np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factors, logs = [], []
        for n, cov in zip(count, covs, strict=True):
            part = shrink + (1 - shrink) * d / (d + n)  # few rows lean on the pooled covariance
            own = (1 - ridge) * ((1 - part) * cov + part * pooled) + ridge * base
            low = np.linalg.cholesky(own)
            factors.append(np.linalg.inv(low))
            logs.append(2 * np.log(np.diag(low)).sum())
        prior = np.log((count[1] + 1) / (count[0] + 1))
        return cls(means, factors, 0.5 * (logs[0] - logs[1]) + prior)

    def scores(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(0.5 * (far[0] - far[1]) + self.offset, -60, 60)))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """A discriminant from every row of df that labels marks 0 or 1.

    Rows join on the id; null ids, texts and labels don't take part. A row
    that is labelled twice counts twice. Sums, not rows, reach the driver.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")

    def measure(batch: pa.RecordBatch):
        x = batch_features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["id", "x"])

    def gather(batches):
        count, total, outer = [0.0, 0.0], [np.zeros(FEATURES) for _ in "01"], [np.zeros((FEATURES, FEATURES)) for _ in "01"]
        for batch in batches:
            y = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, FEATURES)
            for c in (0, 1):
                own = x[y == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0)
                outer[c] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(count), pa.array([t.tolist() for t in total]), pa.array([o.ravel().tolist() for o in outer])], ["y", "n", "total", "outer"])

    kind = df.schema[id_col].dataType.simpleString()
    measured = arrow_map(texts, measure, f"id {kind}, x array<double>")
    sums_ = over_batches(measured.join(marks, "id").select("y", "x"), gather, "y long, n double, total array<double>, outer array<double>")
    summed = sums_.groupBy("y").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(FEATURES)],
        *[F.sum(F.col("outer")[i]).alias(f"o{i}") for i in range(FEATURES * FEATURES)],
    )
    count, total, outer = [0.0, 0.0], [np.zeros(FEATURES) for _ in "01"], [np.zeros((FEATURES, FEATURES)) for _ in "01"]
    for r in summed.collect():  # two rows
        count[r["y"]] = r["n"]
        total[r["y"]] = np.array([r[f"t{i}"] for i in range(FEATURES)])
        outer[r["y"]] = np.array([r[f"o{i}"] for i in range(FEATURES * FEATURES)]).reshape(FEATURES, FEATURES)
    return Discriminant.fit(count, total, outer)


def score(df: DataFrame, model: Discriminant, *keep: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of each row with score and predicted (1 if score >= threshold). Null and empty texts score alike.

    A kept column of one of these names gives way to it. Repeated rows each
    give a row; an empty table gives an empty result.
    """
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def decide(batch: pa.RecordBatch):
        s = model.scores(batch_features(batch.column(len(keep))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return arrow_map(rows, decide, f"{schema}, score double, predicted int")


def keep_good(df: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score threshold or more, unchanged."""
    at = df.columns.index(text_col)

    def decide(batch: pa.RecordBatch):
        yield batch.filter(pa.array(model.scores(batch_features(batch.column(at))) >= threshold))

    return arrow_map(df, decide, df.schema)
