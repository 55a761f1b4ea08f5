"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, jaccard, langid, line_dedup, packing, pii, stream_dedup, toxicity, url_filter
from .common import held_out, save, table, tune

#: Rules of the URL filter.
URL_RULES = [
    url_filter.rule("org/", "allow"),
    url_filter.rule("example.org/es/", "block"),
    url_filter.rule("example.org/en/1", "block"),
    url_filter.rule("com/fr/", "allow"),
    url_filter.rule("com/de/", "block"),
]
#: Key of the surrogates; a real run passes its own.
PII_KEY = "surrogates of the registered query"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules first; the rest by a model of the small labelled table that comes with the filter."""
    tune(spark)
    model = url_filter.train(url_filter.labelled_sample(url_filter.labelled_urls(spark)))
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pii.replace(table(spark, sf_dir, "documents"), PII_KEY, counts=True).select("doc_id", "text", "n_entities")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op5_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(save(toxicity.sample(docs, table(spark, sf_dir, "labels")), "toxicity-sample"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs, counts=True).select("doc_id", "lines_dropped", F.col("text").alias("clean_text"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_block_matrix_join": op5_block_matrix_join,
    "op6_stream_dedup": op6_stream_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op5_block_matrix_join": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
    """,
    "op6_stream_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm
    """,
    "op7_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
        tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        linked AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (n + m - k)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON r.other = l.a)
        SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = sets.doc_id) AS component_id FROM sets
    """,
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, coalesce(source, '') AS host, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
        marked AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines),
        totals AS (SELECT coalesce(source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
        pages AS (SELECT host, t, count(DISTINCT doc_id) AS pages FROM marked WHERE t <> '' GROUP BY host, t),
        drops AS (SELECT p.host, p.t FROM pages p JOIN totals USING (host) WHERE p.pages > 0.1 * host_pages),
        judged AS (SELECT m.*, d.t IS NOT NULL AS dropped FROM marked m LEFT JOIN drops d ON m.host = d.host AND m.t = d.t),
        docs AS (
            SELECT doc_id, sum(dropped::INT) AS n, count(*) FILTER (NOT dropped AND t <> '') AS rest, string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped) AS kept
            FROM judged GROUP BY doc_id)
        SELECT d.doc_id, CAST(CASE WHEN n > 0 AND rest > 0 THEN n ELSE 0 END AS BIGINT) AS lines_dropped,
               CASE WHEN n > 0 AND rest > 0 THEN kept ELSE text END AS clean_text
        FROM documents d LEFT JOIN docs USING (doc_id)
    """,
}
