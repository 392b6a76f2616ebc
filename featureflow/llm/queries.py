"""Queries opN_<name> and pipeline of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featureflow.llm.common import read


def op1_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.exact_topk import grid, top_k

    return top_k(grid(read(spark, sf_dir, "embeddings")), k=20, every=20)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written and read back; what the rows carry is derived from the texts in the files."""
    from pyspark.sql import functions as F

    from featureflow.llm.common import scratch
    from featureflow.llm.sharding import read_shards, write_shards

    at = scratch(spark, "shards")
    write_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), at, n_shards=24, seed=7)
    text = F.coalesce("text", F.lit(""))
    return read_shards(spark, at).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.secrets import scan

    return scan(read(spark, sf_dir, "documents"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.quality import assess

    return assess(read(spark, sf_dir, "documents"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.common import scratch
    from featureflow.llm.warc import archive_pages, read_warc

    at = scratch(spark, "warc")
    archive_pages(read(spark, sf_dir, "pages"), at)
    return read_warc(spark, at)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from featureflow.llm.langid import predict, remainder, train

    documents = read(spark, sf_dir, "documents")
    model = train(documents, remainder(F.col("doc_id")) != 2)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featureflow.llm.bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), rank_path())


def op10_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings and examples are written, and the digests taken from what is read back."""
    from featureflow.llm.chat import digests, expand, format_conversations, with_control_case
    from featureflow.llm.common import materialise

    turns = with_control_case(read(spark, sf_dir, "conversations"))
    return digests(materialise(format_conversations(turns), "chats"), materialise(expand(turns), "examples"))


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
        ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS s FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS MATERIALIZED (
    SELECT a, b FROM (SELECT e.doc_id AS a, f.doc_id AS b, count(*) AS n_both FROM e JOIN e f ON e.x = f.x AND e.doc_id <> f.doc_id GROUP BY ALL) q
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 85 * (na.n_shingles + nb.n_shingles - n_both)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP7_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < original THEN original END AS refers_to FROM p LEFT JOIN o USING (payload_digest)
"""

OP10_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\<>\[\]]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<>\[\]]', '', 'g')) + 6 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": OP2_SQL, "op3_exact_topk": OP3_SQL, "op7_arc_to_warc": OP7_SQL, "op10_chat_prefix_target": OP10_SQL}
