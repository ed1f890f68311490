import random

import pytest

from loomquery.llm import minhash
from loomquery.llm._store import Store
from loomquery.llm.components import components
from tests.llm.samples import edited, frame, prose, texts, words
from tests.llm.test_text import thue_morse


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return sorted([(i, len(shingles(t, k)), i if i is None else top(i), i is None or top(i) == i) for i, t in rows], key=str)


def check(spark, rows, k, **options):
    got = minhash.near_duplicates(frame(spark, rows), shingle=k, **options).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, k)


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    check(spark, texts(), k)


def test_groups_of_near_copies(spark):
    """Copies at many distances, so that links lie on both sides of the bound."""
    rng = random.Random(5)
    rows, base = [], [prose(900 + g, 150, [f"w{i}" for i in range(4000)]) for g in range(4)]
    for i in range(160):
        rows.append((i, edited(base[i % 4], i, rng.randrange(0, 14))))
    check(spark, rows, 4)


def test_blocks_lose_no_link(spark, monkeypatch):
    """Large buckets go through blocks; small limits make these buckets large."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = prose(77, 150, [f"v{i}" for i in range(4000)])
    rows = [(i, edited(base, 50 + i, 4 + i % 9)) for i in range(90)]
    check(spark, rows, 4)


def test_empty_and_keep(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    df = frame(spark)
    kept = minhash.keep_one(df)
    want = {r[0] for r in brute(texts(), 5) if r[3]}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), Store(spark, "test")).collect()}
    assert got == {(x, top(x)) for a, b in links if a is not None and a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Store(spark, "test")).count() == 0


def test_ids_with_different_texts(spark):
    a, b, c, d = (prose(900 + i, 60) for i in range(4))
    rows = [(5, a), (5, b), (7, a), (3, b), (9, c), (9, d), (9, c), (10, d), (11, prose(990, 60))]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3), (9, 9), (10, 9), (11, 11)} and len(got) == len(rows)
    kept = minhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 9, 9, 9, 11]


def test_words_that_polynomials_cannot_tell_apart(spark):
    x, y = thue_morse(2048, "a", "b")
    rows = [(1, f"{x} {y}"), (2, f"{y} {x}"), (3, x), (4, y), (5, " ".join([x, y, x, x, y, y, x, y, x])), (6, " ".join([x] * 9))]
    check(spark, rows, 2)
