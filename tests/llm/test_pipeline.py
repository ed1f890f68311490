"""The pipeline's stages, and the operators' queries against SQL."""

import re

import pytest

import corpus_pipeline
from loomquery.llm import registry
from tests.llm.samples import words
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_minhash import brute as groups
from tests.llm.test_native import brute as secrets
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], FOLDER)


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema) if name != corpus_pipeline.STAGES[-1][0] else stage(spark, docs, FOLDER)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    quality, unique, clean, redacted, encoded = kept.values()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(i in quality for i, q in labels.items() if q == 1) / sum(q == 1 for q in labels.values()) > 0.98
    assert set(unique) == {i for i, _, c, keep in groups([(i, r.text) for i, r in quality.items()], 5) if keep}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    found = {r[0]: r for r in windows([(i, r.text) for i, r in unique.items()], items)}
    assert set(clean) == {i for i, r in found.items() if not r[5]}
    for i, r in clean.items():
        assert r.text == unique[i].text or found[i][3] and len(words(r.text)) < len(words(unique[i].text))
    assert set(redacted) == set(clean)
    for i, r in redacted.items():
        assert not secrets(r.text) and (r.text == clean[i].text or "[SECRET]" in r.text) and r.n_chars == len(r.text)
        if not secrets(clean[i].text):
            assert r.text == clean[i].text or "[SECRET]" in r.text
    assert set(encoded) == set(redacted) and all(r.round_trip for r in encoded.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(encoded)
