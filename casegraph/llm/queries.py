"""The subpackage's queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import table

TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, generate_subscripts(e, 1) AS d, unnest(e) AS w FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.fingerprint import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("matches")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.chat import collapse_and_render

    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH d AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
    '<|im_start|>' || replace(role, '<|im_', '< |im_') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS rendered FROM d),
p AS (
  SELECT *, md5(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY k)) AS h,
    sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY k) - length(rendered) AS start,
    count(*) OVER (PARTITION BY conv_id) AS n FROM o),
w AS (SELECT min(conv_id) AS conv_id, n, h, count(*) AS copies FROM p WHERE k = n - 1 GROUP BY n, h),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k + 1 = w.n AND p.h = w.h AND p.k + 1 < p.n))
SELECT p.conv_id, CAST(p.k AS INTEGER) AS turn_index, p.role, p.rendered, CAST(p.start AS BIGINT) AS start, CAST(p.n AS INTEGER) AS n_turns, m.copies
FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    told = identify(docs, train(docs, ~out))
    return told.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.vector_codes import digest, encode

    return digest(encode(table(spark, sf_dir, "embeddings")))


_VECTORS = """
  SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS r FROM (
    SELECT *, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more})"""


def _floor(total: str, n: str) -> str:
    return f"CAST(({total} - (({total} % {n}) + {n}) % {n}) // {n} AS BIGINT)"


def _op11_sql(rounds: int = 2) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (
  SELECT r, p, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM t JOIN b{k} USING (p, i) GROUP BY r, p, k),
a{k} AS MATERIALIZED (SELECT r, p, min(d) AS d, min(k) FILTER (d = m) AS k FROM (SELECT *, min(d) OVER (PARTITION BY r, p) AS m FROM d{k}) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, k, i, count(*) AS n, sum(x) AS s FROM t JOIN a{k} USING (r, p) GROUP BY p, k, i),
b{k + 1} AS MATERIALIZED (
  SELECT p, k, i, CASE WHEN n IS NULL THEN c ELSE {_floor("s", "n")} END AS c FROM b{k} LEFT JOIN s{k} USING (p, k, i))""")
    return f"""
WITH v AS MATERIALIZED ({_VECTORS.format(order="vec_id, e", scale=256, more="")}),
u AS (SELECT r, unnest(range(len(e))) AS q, len(e) // 16 AS w, unnest(e) AS x FROM v),
t AS MATERIALIZED (SELECT r, q // w AS p, q % w AS i, x FROM u),
b0 AS (SELECT p, r AS k, i, x AS c FROM t WHERE r < 64),
{", ".join(steps)},
o AS (SELECT r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, i)) FROM b{rounds}) AS codebooks_sha256
FROM o JOIN v USING (r)
"""


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.clustering import cluster, digest

    return digest(cluster(table(spark, sf_dir, "embeddings")))


def _op12_sql(rounds: int = 10) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM t JOIN c{k} USING (i) GROUP BY r, k),
a{k} AS MATERIALIZED (SELECT r, min(d) AS d, min(k) FILTER (d = m) AS k FROM (SELECT *, min(d) OVER (PARTITION BY r) AS m FROM d{k}) GROUP BY r)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT k, i, count(*) AS n, sum(x) AS s FROM t JOIN a{k} USING (r) GROUP BY k, i),
c{k + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN c ELSE {_floor("s", "n")} END AS c FROM c{k} LEFT JOIN s{k} USING (k, i))""")
    return f"""
WITH v AS MATERIALIZED ({_VECTORS.format(order="sha256('3:' || vec_id), e", scale=1024, more=" AND len(embedding) = 64")}),
t AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(e) AS x FROM v),
c0 AS (SELECT r AS k, i, x AS c FROM t WHERE r < 8),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (k)
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casegraph.llm.warc import page_records, write_packages

    return page_records(write_packages(table(spark, sf_dir, "pages")))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p),
b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1) AS x FROM w),
-- eight base32 digits from five bytes, ten hexadecimal digits
n AS (SELECT *, list_transform(range(4), lambda k: list_reduce(x[10 * k + 1 : 10 * k + 10], lambda a, d: 16 * a + d)) AS g FROM b)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM n
"""


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_exact_topk": op2_exact_topk,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_fingerprints": op4_fingerprints,
        "op5_html_extraction": op5_html_extraction,
        "op6_license_scan": op6_license_scan,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_language_id": op8_language_id,
        "op9_simhash_golay": op9_simhash_golay,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_vector_codes": op11_vector_codes,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": OP2_SQL,
        "op7_chat_formatting": OP7_SQL,
        "op11_vector_codes": _op11_sql(),
        "op12_centroid_clusters": _op12_sql(),
        "op13_warc": OP13_SQL,
    }
