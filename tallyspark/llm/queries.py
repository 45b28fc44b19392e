"""Queries of the operators over the driver's tables, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import alignment, bpe, centroids, ctph, language, line_quality, packing, pii, repeats, secrets, simhash, url_filter, warc
from tallyspark.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scanned(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.text_items(_table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.written_archives(warc.planned(_table(spark, sf_dir, "pages"))), "archives")
    records = warc.read_records(archives, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_quality.judged(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *line_quality.NAMES, "base_failed", "kept")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages")).drop("score")


def op10_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_next(_table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(_table(spark, sf_dir, "documents"), vocabulary_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_simhash, op3_bpe, op4_packing, op5_warc, op6_quality, op7_repeats, op8_secrets, op9_urls, op10_ctph, op11_language, op12_alignment, op13_centroids, pipeline)
}

ORACLES = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > least THEN least END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)
    """,
    "op6_quality": """
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), windows AS (
            SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
        ), raw_lines AS (
            SELECT doc_id, host, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)
        ), own_lines AS (
            SELECT doc_id, host, line, w FROM raw_lines WHERE len(w) > 0
        ), duplicates AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM own_lines GROUP BY 1
        ), lines AS (
            SELECT doc_id, host, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, sum(len(w)) AS words
            FROM own_lines GROUP BY ALL
        ), digests AS (
            SELECT doc_id, md5(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS document FROM d
        ), common AS (
            SELECT host, line FROM lines JOIN digests USING (doc_id) GROUP BY host, line HAVING count(DISTINCT document) > 20
        ), removed AS (
            SELECT doc_id, sum(words) AS n FROM lines JOIN common USING (host, line) GROUP BY 1
        ), counts AS (
            SELECT d.doc_id, len(w) AS n_words, CAST(length(replace(array_to_string(w, ' '), ' ', '')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   coalesce(duplicates.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS gone
            FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN duplicates USING (doc_id) LEFT JOIN removed USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone <= 0.6 * n_words AS kept
        FROM counts
    """,
    "op7_repeats": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k
            FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)
        ), repeated AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
            FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM strings) WHERE c > 1
        ), runs AS (
            SELECT doc_id, min(i) AS a, max(i) + 200 AS b
            FROM (SELECT *, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM repeated)
            GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM runs
        ), cut AS (
            SELECT doc_id, sum(b - a) AS n, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head
            FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op13_centroids": """
        WITH kept AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), parts AS (
            SELECT row, unnest(range(1, 65)) AS i, unnest(q) AS x FROM kept
        ), first AS (
            SELECT row, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS cluster FROM kept
            QUALIFY cluster < 16
        ), places0 AS (
            SELECT cluster, i, x FROM first JOIN parts USING (row)
        ), near1 AS (
            SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN places0 c USING (i) GROUP BY 1, 2
        ), own1 AS (
            SELECT row, cluster, d FROM near1 QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
        ), means1 AS (
            SELECT cluster, i, sum(x) AS s, count(*) AS n FROM own1 JOIN parts USING (row) GROUP BY 1, 2
        ), places1 AS (
            SELECT p.cluster, p.i, CASE WHEN m.n IS NULL THEN p.x ELSE CAST(s - ((s % n) + n) % n AS HUGEINT) // n END AS x
            FROM places0 p LEFT JOIN means1 m USING (cluster, i)
        ), near2 AS (
            SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN places1 c USING (i) GROUP BY 1, 2
        ), own2 AS (
            SELECT row, cluster, d FROM near2 QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
        ), means2 AS (
            SELECT cluster, i, sum(x) AS s, count(*) AS n FROM own2 JOIN parts USING (row) GROUP BY 1, 2
        ), places2 AS (
            SELECT p.cluster, p.i, CASE WHEN m.n IS NULL THEN p.x ELSE CAST(s - ((s % n) + n) % n AS HUGEINT) // n END AS x
            FROM places1 p LEFT JOIN means2 m USING (cluster, i)
        ), near3 AS (
            SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN places2 c USING (i) GROUP BY 1, 2
        ), own3 AS (
            SELECT row, cluster, d FROM near3 QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
        ), means3 AS (
            SELECT cluster, i, sum(x) AS s, count(*) AS n FROM own3 JOIN parts USING (row) GROUP BY 1, 2
        ), places3 AS (
            SELECT p.cluster, p.i, CASE WHEN m.n IS NULL THEN p.x ELSE CAST(s - ((s % n) + n) % n AS HUGEINT) // n END AS x
            FROM places2 p LEFT JOIN means3 m USING (cluster, i)
        ), near4 AS (
            SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN places3 c USING (i) GROUP BY 1, 2
        ), own4 AS (
            SELECT row, cluster, d FROM near4 QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
        ), inertias AS (
            SELECT cluster, sum(d) AS s FROM own4 GROUP BY 1
        ), digests AS (
            SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM places3 GROUP BY 1
        )
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia,
               CAST((SELECT sum(s) FROM inertias) AS BIGINT) AS inertia, centroid_sha256
        FROM own4 JOIN kept USING (row) JOIN inertias USING (cluster) JOIN digests USING (cluster)
    """,
}
