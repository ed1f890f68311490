"""Token counts and SentencePiece, against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomquery.llm import sentencepiece_bpe as sp
from loomquery.llm import token_count
from loomquery.llm._text import buffers, chunks
from tests.llm.samples import frame, texts
from tests.llm.test_text import thue_morse

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def mixed(n):
    rng = random.Random(n)
    alphabet = " aeth nrsoi▁\n\t.,;:()#*$%0123456789éüßñç中文😀🤖ﬁIİ\x00<0x0A></s>ABC_=-+'Σςабв日本語"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    rows = texts() + [(1000 + i, t) for i, t in enumerate(mixed(1)[:300])] + [(5000, "a <|startoftext|>b<|endoftext|> c it's don't '  s")]
    got = token_count.token_counts(frame(spark, rows), path, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert token_count.token_counts(frame(spark, []), path).count() == 0


def test_encoding_equals_the_library():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    values = ["", " ", "  ", "a", "   x  y    ", "\n\n", "▁▁a ▁b", "</s><s><unk>", "x" * 300, " " * 3000 + "x", "a" * 4000 + " " + "éЖ" * 500, "        def f(x):\n            return x\n\n\n", None, *mixed(2)]
    data, offsets, _ = buffers(pa.array(values, pa.string()))
    encoder = sp.Encoder(sp.Vocabulary.load(MODEL))
    got = []
    for i, j in chunks(offsets, 2000):
        flat, counts = encoder.encode(data, offsets[i : j + 1])
        flat = flat.tolist()
        for n in counts.tolist():
            got.append(flat[:n])
            flat = flat[n:]
    assert got == [own.encode(v or "") for v in values]


def test_round_trip(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = texts()
    encoded = sp.encode(frame(spark, rows), MODEL, "doc_id", "text").withColumnRenamed("text", "original")
    got = sp.decode(encoded, MODEL, "doc_id", "original", "ids").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (None if r.original is None else r.original.replace("▁", " "))
        assert r.ids == (None if r.original is None else own.encode(r.original))
    assert sp.encode(frame(spark, []), MODEL, "doc_id").count() == 0
    spelled = {r.doc_id: r.decoded for r in sp.encode(frame(spark, rows), MODEL, "doc_id", spell=True).collect()}
    assert all(spelled[i] == (None if t is None else t.replace("▁", " ")) for i, t in rows if i is not None)


def test_long_merges_equal_short_search():
    """The queue of merges gives what trying all pairs would."""
    v = sp.Vocabulary.load(MODEL)
    for text in mixed(3)[:100]:
        now = [c.encode() for c in text.replace("▁", " ")]
        while True:
            best = min(((v.rank[v.ids[a + b]], k) for k, (a, b) in enumerate(zip(now[:-1], now[1:], strict=True)) if a + b in v.ids), default=None)
            if best is None:
                break
            now[best[1] : best[1] + 2] = [now[best[1]] + now[best[1] + 1]]
        assert [p for _, p in v.merges(text.replace("▁", " ").encode())[0]] == now


def test_words_that_polynomials_cannot_tell_apart(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    x, y = thue_morse(2048, "th", "er")
    rows = [(1, f"{x} {y}"), (2, f"{y} {x} {y}"), (3, x), (4, y)]
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    counted = {r.doc_id: r.n_tokens for r in token_count.token_counts(frame(spark, rows), path).collect()}
    assert counted == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in rows}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = {r.doc_id: r.ids for r in sp.encode(frame(spark, rows), MODEL, "doc_id").collect()}
    assert encoded == {i: library.encode(t) for i, t in rows}


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(6)
    for raw in [b"", b"a", b"banana" * 30, b"\x00" * 40, b"ab\x00\x00" * 25, b"x" * 3000, bytes(rng.randrange(3) for _ in range(2000))]:
        order, _ = sp.suffix_array(np.frombuffer(raw, np.uint8))
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
