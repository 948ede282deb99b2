"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, jaccard_join, langid, media, mixing, packing, sharding, tokens, url_filter, url_sql
from .common import table


#: Target shares of tokens by domain.
TARGETS = {"high": 0.8, "low": 0.18, "toxic": 0.02}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, domains = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)
    names = F.array(*map(F.lit, domains))
    return rated.select("doc_id", "tokens", names.alias("domains"), "posterior", "rate", "copies", "gap")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_pages(pages, html_text.learn(pages))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.record_sizes(table(spark, sf_dir, "documents"))
    out = sharding.shard_records(sizes, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.digest(stored)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), capacity=1024)
    return packing.pack(pieces, capacity=1024)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "url_filter.*").withColumn("purity", F.round("purity", 9))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), rule="start")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_html_extraction, op3_sharding, op4_jaccard_join, op5_embedding_dedup, op6_media_columns, op7_packing, op8_url_filters, op9_language_id, op10_token_counts)
}

ORACLES: dict[str, str] = {
    "op8_url_filters": url_sql.judge_sql(),
    "op4_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        g AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
            FROM w),
        o AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM g) GROUP BY g),
        s AS (SELECT rep, n, unnest(g) AS s FROM o WHERE n > 0),
        c AS (
            SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
            FROM s a JOIN s b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep),
        e AS (SELECT a, b FROM c WHERE 100 * i >= 85 * (na + nb - i)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
        SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles,
               CASE WHEN len(g.g) = 0 THEN g.doc_id ELSE least(o.rep, coalesce(m.m, o.rep)) END AS component_id
        FROM g LEFT JOIN o ON o.g = list_sort(g.g) LEFT JOIN m ON m.a = o.rep""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_cosine_similarity(a.e, b.e) >= 0.93),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(c.c, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
