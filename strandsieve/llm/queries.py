"""The registered queries of the corpus operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, embeddings, exact_dedup, html_text, lexical, matroska, packing, simhash, substring, token_files, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_packing, op4_token_files, op5_substring_dedup, op6_exact_dedup, op7_simhash, op8_main_text, op9_matroska, op10_warc, op11_centroids, op12_lexical_search, op13_near_vectors)}


def _centroid_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Rounds of assignment and means, one after the other, over rows of one component each."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT cluster, i, x AS c FROM x JOIN seeds USING (vec_id) WHERE cluster < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS distance FROM x JOIN c{r} USING (i) GROUP BY vec_id, cluster),
a{r} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS place FROM d{r}) WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT cluster, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN s{r} USING (cluster, i))""")
    return f"""WITH {", ".join(parts)},
h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (cluster)"""


SQL = {
    "op5_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM starts),
low AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN low USING (s) WHERE m < doc_id),
per AS (SELECT doc_id, list(j) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(words) AS n, list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS k FROM w LEFT JOIN per USING (doc_id))
SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    # base32 by hand: each letter stands for five bits, which lie in two hex digits
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS low FROM p),
d AS (SELECT *, list_transform(range(1, 41), lambda k: strpos('0123456789abcdef', substr(x, k, 1)) - 1) AS v FROM g)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[5 * i // 4 + 1] * 16 + v[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to
FROM d
""",
    "op11_centroids": _centroid_sql(),
    "op12_lexical_search": """
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sought AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
total AS MATERIALIZED (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM words WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM sought) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
size AS (SELECT doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM words, total WHERE len(w) > 0),
score AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
          FROM tf JOIN sought USING (term) JOIN weight USING (term) JOIN size USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 50
""",
    "op13_near_vectors": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                     WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
low AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
links AS (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN links USING (vec_id)
""",
}
