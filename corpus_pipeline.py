"""The corpus pipeline: five stages over documents, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from loomquery.llm import decontaminate, minhash, quality, secrets, sentencepiece_bpe
from loomquery.llm._store import Store


def quality_classifier(spark, docs, sf_dir):
    """Learn from every labelled document, and drop what scores below the threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup(spark, docs, sf_dir):
    """Keep the document of the least id in each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Drop documents with windows of two or more benchmark items; cut the hit spans out of those with one."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs, sf_dir):
    """Replace secrets by a mark."""
    return secrets.redact(docs)


def sentencepiece(spark, docs, sf_dir):
    """Encode the texts; round_trip says whether decoding gives a text back (with plain spaces for space signs)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_bpe.encode(docs, path, "doc_id", "lang", "source", "n_chars", "text", spell=True)
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(sentencepiece_bpe.SPACE), F.lit(" ")))
    return encoded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The classifier and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.cut(docs, "documents")
    return docs
