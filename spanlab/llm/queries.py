"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_ids=False, keep_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.mark(_docs(spark, sf_dir))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram

    return ngram.score(_docs(spark, sf_dir))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing, shared

    rows = shared.put(mixing.sizes(_docs(spark, sf_dir)), "sizes")
    return mixing.plan(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    pages = media.resolve(media.parse(media.page_of(docs), "doc_id", "html"), media.store(docs))
    shown = pages.select("doc_id", F.size("items").alias("n_items"), F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i"))
    return shown.select("doc_id", "i.media.*", "i.position", "i.caption", "n_items")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.group(_docs(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(_docs(spark, sf_dir), labels).select("doc_id", "log_ratio", "key", "kept")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed

    return embed.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat, shared

    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{text}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{text}'")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = shared.put(chat.chains(turns), "messages")
    done = chat.format_paths(messages, chat.paths(messages))
    back = chat.read_back(F.col("formatted"))
    whole = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.col("mask"), lambda m: chat.unescape(F.substr("formatted", m["start"].cast("int") + 1, m["length"].cast("int")))), "")
    return done.select(F.col("leaf.conv_id").alias("conv_id"), "formatted", back.alias("turns"), chat.loss_mask(F.col("formatted")).alias("mask")).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with a null doc_id is not held out: it is learned from."""
    from . import language

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    langs, model = language.fit(docs.where(~held))
    return language.predict(docs.select("doc_id", "text", held), langs, model).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_suffix, op3_lm, op4_mix, op5_media, op6_jaccard, op7_quality, op8_embeddings, op9_chat, op10_language)}

ORACLE_SQL = {
    "op8_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM ok),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT v.vec_id, coalesce(c, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(low.b, v.vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN cnt ON cnt.a = v.vec_id""",
    "op9_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n_text,
             length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n_text + n_role + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
