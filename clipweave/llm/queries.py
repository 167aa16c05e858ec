"""One query per operator of this subpackage, with production parameters over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.chat_tree import conversation_digests, format_conversations, prefix_tree, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = format_conversations(rows)
    return conversation_digests(read_back(formatted, prefix_tree(formatted)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents")).drop("n_points")


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.bpe import encode

    out = encode(_read(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.language_id import identify, train

    docs = _read(spark, sf_dir, "documents")
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 3
    identifier = train(docs.where(fold("doc_id") != 1).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), identifier)
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).drop("source", "copies")


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.top_k import top_k

    return top_k(_read(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.quality import features, score, train
    from clipweave.llm.shared import materialize

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    stats = materialize(features(_read(spark, sf_dir, "documents").select("doc_id", "text")), "quality_stats")
    ensemble = train(stats, _read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality"))
    return score(stats, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: op10's rules, fixed by its contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.url_templates import filter_urls

    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.simhash import simhash_groups

    return simhash_groups(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.spelling import spelling_groups, word_counts

    return spelling_groups(word_counts(_read(spark, sf_dir, "documents"), every=97))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.llm.repair import damaged, repair_report

    rows = _read(spark, sf_dir, "conversations")
    return repair_report(rows, damaged(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_prefix_tree": op1_chat_prefix_tree,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe_transducer": op4_bpe_transducer,
    "op5_warc_segments": op5_warc_segments,
    "op6_language_id": op6_language_id,
    "op7_source_mixing": op7_source_mixing,
    "op8_bit_sliced_top_k": op8_bit_sliced_top_k,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_templates": op10_url_templates,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_NORM} AS norm FROM documents),
        r AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
    "op5_warc_segments": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op8_bit_sliced_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}
