"""The operators' queries over the corpus tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return put


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, id_col: str = "doc_id"):
    """Whether the CRC-32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == 0, F.lit(False))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
FROM m""")
def op1_warc(spark, sf_dir):
    from loomquery.llm import warc
    from loomquery.llm._store import Store

    folder = Store(spark, "warc").path("archives")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM docs),
classes AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
grams AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (SELECT x.rep AS a, y.rep AS b FROM grams x JOIN grams y ON x.g = y.g AND x.rep < y.rep
          GROUP BY x.rep, y.rep HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS seen FROM classes UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a),
comp AS (SELECT node AS rep, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN comp ON comp.rep = c.rep""")
def op2_near_duplicates(spark, sf_dir):
    from loomquery.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query(f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op3_decontamination(spark, sf_dir):
    from loomquery.llm import decontaminate

    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query()
def op4_sentencepiece(spark, sf_dir):
    import public_tokenizers
    from loomquery.llm import sentencepiece_bpe as sp

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sp.encode(table(spark, sf_dir, "documents"), path, "doc_id", "text", spell=True)
    return encoded.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.replace("text", F.lit(sp.SPACE), F.lit(" "))).alias("round_trip"),
    )


@query()
def op5_suffix_lm(spark, sf_dir):
    from loomquery.llm import suffix_lm
    from loomquery.llm._store import Store

    store = Store(spark, "suffix_lm")
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(10))
    tree, counts = suffix_lm.train(docs.filter(~F.col("held_out")), store)
    out = suffix_lm.score(docs, tree, counts, store, "doc_id", "held_out")
    store.drop(counts, tree.nodes)  # all that was asked of them is answered
    return out


@query()
def op6_quality_classifier(spark, sf_dir):
    from loomquery.llm import quality

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(5))
    model = quality.train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "doc_id", "held_out")


@query()
def op7_fingerprints(spark, sf_dir):
    from loomquery.llm import merkle

    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op8_secret_scan(spark, sf_dir):
    from loomquery.llm import secrets

    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query()
def op9_token_counts(spark, sf_dir):
    import public_tokenizers
    from loomquery.llm import token_count

    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op10_language_id(spark, sf_dir):
    from loomquery.llm import langid

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(5))
    filters = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs, filters, "doc_id", "held_out")
