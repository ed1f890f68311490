import hashlib
import re

import numpy as np

from loomquery.llm import decontaminate as dc
from tests.llm.samples import frame, lowered, prose, texts


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = ",".join(sorted(str(x) for x in found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def tables(spark):
    rows = texts()
    passage, other = rows[3][1], prose(500, 30)
    rows += [(60, f"start {passage} end"), (61, f"{passage} {other}"), (62, f"a {other.upper()} b"), (63, "tiny"), (64, " ".join(passage.split()[:8])), (65, " ".join(passage.split()[:7])), (66, "one two three four. 9!")]
    items = [(1, passage), (2, other), (3, None), (4, "!!"), (5, "tiny"), (6, passage[:80]), (10, passage), (7, "two three"), (None, "one two")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS words")


def test_against_brute_force(spark):
    rows, items, table = tables(spark)
    want = brute(rows, [x for x in items if x[0] is not None])
    for size in (dc.SET_BYTES, 400):  # in one set and in many
        got = dc.digest(dc.scan(frame(spark, rows), table, set_bytes=size)).collect()
        assert sorted([tuple(r) for r in got], key=str) == want


def test_stage(spark):
    rows, items, table = tables(spark)
    df = frame(spark, rows)
    got = {r.doc_id: r for r in dc.decontaminate(df, table).collect()}
    counts = {r[0]: r for r in brute(rows, [x for x in items if x[0] is not None])}
    assert dc.decontaminate(df, table).columns == df.columns
    for i, text in rows:
        if i is None or i == 20:
            continue
        if counts[i][5]:
            assert i not in got
        elif counts[i][3]:
            assert got[i].n_chars == len(got[i].text) < len(text)
            assert got[i].text == "" or brute([(i, got[i].text)], [x for x in items if x[0] is not None])[0][1] == counts[i][1] - counts[i][2]
        else:
            assert got[i].text == text


def test_without_rows(spark):
    _, _, table = tables(spark)
    assert dc.scan(frame(spark, []), table).count() == 0
    assert dc.digest(dc.scan(frame(spark), table.limit(0))).filter("n_hit > 0 OR contaminated").count() == 0
    assert dc.decontaminate(frame(spark), table.limit(0)).count() == len(texts())


def test_windows_of_one_hash(monkeypatch):
    """Windows are told apart by their words where their hashes are one."""
    many = dc.Windows([(i, prose(i, 400)) for i in range(50)], 8)
    assert many.nbytes < 50 * 400 * dc.WORD_BYTES + (1 << 20)
    texts_ = [(1, "a b c d e f g h"), (2, "i j k l m n o p"), (3, "a b c d e f g h"), (4, "q r s t u v w x y"), (5, "short one")]
    for one in (False, True):
        if one:
            monkeypatch.setattr(dc, "window_hashes", lambda h, n: np.full(max(0, len(h) - n + 1), 7, np.uint64))
        own = dc.Windows(texts_, 8)
        raw = "x a b c d e f g h y short one i j k l m n o z r s t u v w x y".encode()
        hit, found = own.scan(dc.split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), dc.ALNUM))
        assert found == [{1, 3, 4, 5}] and hit.sum() == 18
