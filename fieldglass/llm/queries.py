"""One query per corpus operator over the whole tables, and its SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import bpe_round_trip
from .clustering import weighted_lloyd
from .lexical import ranked
from .ngram_join import ngram_join
from .packing import pack
from .pii import BASE, personal_data, spans_text
from .quality import judge
from .simhash import simhash_join
from .sstable import read_shards, write_shards
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_byte_substrings
from .warc import merged_index, read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(merged_index(write_archives(table(spark, sf_dir, "pages"))))


def op2_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), end=2))


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", spans_text(F.col("spans")).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), window=4096, end=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_byte_substrings(table(spark, sf_dir, "documents"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join(table(spark, sf_dir, "documents"), n=3, radius=3)


def op13_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


QUERIES = {f.__name__: f for f in (op1_warc_index_merge, op2_balanced_posting_lists, op3_ngram_join, op4_sstable, op5_distribution_divergence, op6_substring_dedup, op7_pair_index_bpe, op8_contextual_pii, op9_best_fit_packing, op10_suffix_dedup, op11_ranked_search, op12_bit_sliced_simhash, op13_weighted_lloyd)}
SQL: dict[str, str] = {
    "op1_warc_index_merge": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages WHERE page_id IS NOT NULL),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS response FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < response THEN response END AS refers_to
        FROM d""",
    "op3_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(u) AS c FROM r GROUP BY v) c USING (doc_id)""",
    "op6_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
        d AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM d),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
        a AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM l),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM a) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
        i AS (SELECT p.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS impact FROM p JOIN l USING (doc_id) JOIN w USING (term), c),
        s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM i JOIN a USING (term) GROUP BY ALL HAVING score > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 50""",
    "op13_weighted_lloyd": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, q AS c FROM (SELECT q, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),
        """
    + "".join(
        f"""a{i} AS MATERIALIZED (SELECT vec_id, q, cluster, distance FROM (SELECT vec_id, q, cluster, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS distance FROM v, c{i})
               QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1),
        """
        + (
            f"""m{i} AS (SELECT cluster, list(x ORDER BY d) AS c FROM (SELECT cluster, d, floor(sum(q[d]) / count(*)) AS x FROM (SELECT cluster, q, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY ALL) GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster)),
        """
            if i < 5
            else ""
        )
        for i in range(6)
    )
    + """f AS (SELECT cluster, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c5)
        SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               centroid_sha256, count(*) OVER (PARTITION BY q) AS copies
        FROM a5 JOIN f USING (cluster)""",
}
