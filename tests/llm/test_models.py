"""Language model, quality classifier and language identification."""

import collections
import math
import pathlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomquery.llm import langid, quality, registry, suffix_lm
from loomquery.llm._store import CLEANUP, Store
from tests.llm.samples import frame, prose, texts, words

FOLDER = "/root/testdata/sf0.01"


def test_base_scores_equal_plain_counts(spark):
    rows = texts() * 2 + [(i + 200, prose(i, 60) + " a line that comes again and again") for i in range(60)]
    df = frame(spark, rows)
    store = Store(spark, "test")
    tree, counts = suffix_lm.train(df.filter("doc_id % 5 <> 0"), store)
    got = suffix_lm.score(df, tree, counts, store, "doc_id").collect()
    seen = collections.Counter(w for i, t in rows if i is not None and i % 5 for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    want = sorted([(i, len(words(t)) + 1, sum(seen[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 5)) for i, t in rows], key=str)
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got], key=str) == want
    assert all(math.isfinite(r.score) for r in got)


def test_tree_predicts_repeats_and_sums_to_one(spark):
    rows = [(i, prose(i, 80) + " alpha beta gamma delta epsilon " + prose(i + 500, 40)) for i in range(300)]
    df, store = frame(spark, rows), Store(spark, "test")
    tree, counts = suffix_lm.train(df, store)
    r = {x.doc_id: x for x in suffix_lm.score(df, tree, counts, store, "doc_id").collect()}
    assert np.mean([x.score - x.base_score for x in r.values()]) > 5
    # from every context, the probabilities of all words (and of an unknown one) add up to one
    data = np.frombuffer(b"beta gamma", np.uint8)
    vocabulary = [w for w in {w for _, t in rows for w in words(t)}]
    base = {w: 0 for w in vocabulary}
    seen = collections.Counter(w for _, t in rows for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    total = 0.0
    for w in [*vocabulary, b"neverseen", None]:
        text = b"beta gamma" + (b" " + w if w is not None else b"")
        data = np.frombuffer(text, np.uint8)
        tokens, _, _, gain = tree.gains(data, np.array([0, len(data)]))
        total += (seen[w] + 0.1) / (n + 0.1 * (v + 1)) * 10 ** gain[2]
    assert base is not None and total == pytest.approx(1, abs=1e-6)


def test_untrained_and_empty(spark):
    store = Store(spark, "test")
    none = frame(spark, [])
    tree, counts = suffix_lm.train(none, store)
    assert suffix_lm.score(none, tree, counts, store, "doc_id").count() == 0
    assert all(math.isfinite(r.score) for r in suffix_lm.score(frame(spark), tree, counts, store, "doc_id").collect())


def test_held_out_likelihood(spark):
    rows = registry.QUERIES["op5_suffix_lm"](spark, FOLDER).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_held_out_quality(spark):
    scored = registry.QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.99 and np.mean([1 - r.predicted for r in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_edges(spark):
    df = frame(spark)
    marks = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (None, 1), (4, None), (5, 7), (30, 0)], "doc_id long, quality int")
    for labels in (marks, marks.filter("quality = 1"), marks.limit(0)):
        model = quality.train(df, labels)
        rows = quality.score(df, model, "doc_id").collect()
        assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {round(r["score"], 9) for r in rows if r.doc_id in (30, 31)}
    assert len(empty) == 1
    assert quality.score(frame(spark, []), model, "doc_id").count() == 0
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.score(df, model, "doc_id", "score").columns == ["doc_id", "score", "predicted"]


def test_quality_matches_plain_densities():
    rng = np.random.default_rng(3)
    x = [rng.normal(0, 1, (200, 4)), rng.normal(1, 2, (300, 4))]
    model = quality.Discriminant.fit([200.0, 300.0], [a.sum(0) for a in x], [a.T @ a for a in x])
    points = rng.normal(0, 2, (20, 4))
    logs = []
    for m, f in zip(model.means, model.factors, strict=True):
        cov = np.linalg.inv(f.T @ f)
        d = points - m
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(301 / 201))))
    assert np.allclose(model.scores(points), want)


def test_held_out_languages(spark):
    rows = registry.QUERIES["op10_language_id"](spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99 and len(rows) == len(truth)


def test_language_edges(spark):
    df = frame(spark).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")))
    filters = langid.train(df)
    assert filters.langs == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(df, filters, "doc_id").collect()}
    for i in (30, 31, 32, 38):
        assert (got[i].lang_pred, got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[42].lang_pred in ("de", "en")
    assert langid.identify(df.withColumn("lang_pred", F.lit(1)), filters, "doc_id", "score", "lang_pred").columns == ["doc_id", "lang_pred", "score"]
    none = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none, "doc_id").collect()} == {"und"}
    assert langid.identify(frame(spark, []), filters, "doc_id").count() == 0


def test_filters_hold_more_than_64_languages():
    names = [f"l{i:03}" for i in range(70)]
    masks = np.zeros((2, 1 << 12), np.uint64)
    gram = np.arange(1000, 1070, dtype=np.uint32)
    for i in range(70):
        for at in langid._slots(gram[i : i + 1], 1 << 12, 3):
            masks[i // 64][at] |= np.uint64(1 << (i % 64))
    counts = langid.Filters(names, masks, 3).counts(gram, np.arange(71))
    assert (counts.argmax(axis=1) == np.arange(70)).all()


def test_tree_grows_with_the_corpus(spark):
    contexts = {}
    for size in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").withColumn("held_out", registry.held_out(10))
        tree, _ = suffix_lm.train(docs.filter("NOT held_out"), Store(spark, "test"))
        contexts[size] = tree.nodes.filter("alpha <> 0").count()
    assert contexts["sf0.1"] > 10 * contexts["sf0.01"]  # ten times the tokens; by shares of all tokens it was 4


def test_nodes_that_are_joined_add_what_nodes_in_place_do(spark, monkeypatch):
    rows = [(i, prose(i, 80) + " alpha beta gamma delta epsilon " + prose(i + 500, 40)) for i in range(300)]
    df, store = frame(spark, rows), Store(spark, "test")
    scores = []
    for share in (1e-6, 0.01):  # with the second, only the most frequent nodes are in place
        monkeypatch.setattr(suffix_lm, "MIN_WORD", share)
        tree, counts = suffix_lm.train(df, store)
        got = {r.doc_id: r.score for r in suffix_lm.score(df, tree, counts, store, "doc_id").collect()}
        data = np.frombuffer(rows[7][1].encode(), np.uint8)
        gain = tree.gains(data, np.array([0, len(data)]))[3].sum()
        scores.append([got[i] for i, _ in rows] + [gain])
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_filters_hold_every_ngram(spark):
    rows = [(i, prose(i, 400), "en") for i in range(40)] + [(98, "qzxv", "en"), (99, "wkjp", "de")]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    data = np.frombuffer("".join(t for _, t, x in rows if x == "en").encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for _, t, x in rows if x == "en"])
    gram, _ = langid.grams(data, offsets)
    at = langid._slots(gram, filters.masks.shape[1], filters.probes)
    assert all(((filters.masks[0][a] >> np.uint64(filters.langs.index("en"))) & np.uint64(1)).all() for a in at)


def test_questions_and_answers_take_less_than_the_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_lm, "MIN_WORD", 1e-4)  # most nodes and words are asked for, as in a large corpus
    cut, written = Store.cut, []

    def sized(self, df, name, *partition_by, **more):
        table = cut(self, df, name, *partition_by, **more)
        if name in ("measured", "answers"):
            written.extend(x.stat().st_size for x in pathlib.Path(table._loomquery_path.removeprefix("file:")).rglob("*.parquet"))
        return table

    monkeypatch.setattr(Store, "cut", sized)
    assert registry.QUERIES["op5_suffix_lm"](spark, FOLDER).count() == 1000
    assert 0 < sum(written) < 0.9 * pathlib.Path(f"{FOLDER}/documents.parquet").stat().st_size  # 1.30 as plain lists and keys


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    ascending = np.sort(rng.integers(0, 1 << 64, 5000, np.uint64))
    for values in (ascending, ascending[:0], ascending[:1], np.array([0, 0, 2**64 - 1], np.uint64)):
        blobs = pa.array([suffix_lm._packed(values), suffix_lm._packed_up(values)], pa.binary())
        assert (suffix_lm._unpacked(blobs[0]) == values).all() and (suffix_lm._unpacked_up(blobs[1]) == values).all()
        assert len(suffix_lm._unpacked(blobs[0])) == len(suffix_lm._unpacked_up(blobs[1])) == len(values)
    for values in (rng.normal(size=100), np.array([1, -7, 2**31 - 1], np.int32)):
        assert (suffix_lm._unpacked(pa.scalar(suffix_lm._packed(values)), values.dtype.type) == values).all()


def test_cut_leaves_no_shuffle_files(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {str(x) for d in dirs for x in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}

    store, before = Store(spark, "test"), files()
    df = frame(spark, [(i, prose(i, 80)) for i in range(100)], more=False)
    table = store.cut(df.groupBy("text").count(), "counts", clean=True)
    for _ in range(50):  # they are removed in the background
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and table.count() == 100
    assert spark.conf.get(CLEANUP) == "false"
