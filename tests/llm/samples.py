"""Small tables with every odd case, and plain versions of the shared rules."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_WORDS = "the of and to in stream river mountain careful quiet window garden paper signal copper violet engine harbour".split()


def prose(seed: int, n: int, words=None) -> str:
    rng = random.Random(seed)
    out = [rng.choice(words or _WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    return " ".join(out).replace(". ", ".\n")


def edited(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def texts() -> list:
    """(doc_id, text): nulls, empties, long ones, repeats, equal and near copies."""
    base = prose(1, 120)
    rows = [(i, prose(100 + i, 20 + 7 * i)) for i in range(8)]
    rows += [(20, base), (21, base), (22, base.upper()), (23, edited(base, 3, 2)), (24, edited(base, 4, 4)), (25, edited(base, 5, 30))]
    rows += [(30, None), (31, ""), (32, "  \n\t "), (33, "one"), (34, "ONE"), (35, "one two"), (36, "one two three"), (37, "one two three four"), (38, "!!! ... 123")]
    rows += [(40, prose(7, 6000)), (41, "x" * 50_000), (42, "école öffnen 中文 😀 ﬁ nbsp ▁ <|endoftext|> \x00 \x0b end"), (43, base), (None, base), (None, None), (20, base)]
    return rows


def frame(spark, rows=None, more: bool = True):
    """A documents table with columns whose names an operator could use itself."""
    from pyspark.sql import functions as F

    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if more:
        df = df.withColumns({c: F.lit(7) for c in ("id", "key", "row", "spans", "score", "cls", "n_tokens", "bucket", "kept", "base", "tokens", "__text")})
    return df.repartition(3)


def lowered(text) -> bytes:
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def words(text) -> list:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", lowered(text)) if w]
