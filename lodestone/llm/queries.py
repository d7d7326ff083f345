"""The registered queries of this folder, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat_tree, oracles, pii, token_files, toxicity
from .collocations import collocations
from .common import crc_mod
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .lm_scoring import lm_score
from .mixing import mix_sources
from .ngram_join import ngram_join
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_columns(bpe.encode(docs, rank_file(), decoded=True))


def op4_pii(spark, sf_dir):
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_embedding_dedup(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"), 0.9)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.learn_and_score(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("evidence", " ").alias("evidence"))


def op10_chat_tree(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = oracles.SAYS
    more = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, turn, role, '{says}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    nodes, membership = chat_tree.prefix_tree(told.unionByName(more), rank_file())
    return chat_tree.digest_columns(chat_tree.read_back(nodes, membership, rank_file()))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents")).drop("text_sha256")


def op9_lm_score(spark, sf_dir):
    return lm_score(table(spark, sf_dir, "documents"), order=3)


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir):
    import public_tokenizers

    files = token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || md5('17:' || doc_id)[1:10])::BIGINT AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((r - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight)::DOUBLE AS target FROM l
), j AS (
  SELECT d.doc_id, d.size::BIGINT AS size, t.source_size::BIGINT AS source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  ((budget // source_size) * size + greatest(0, least(size, budget % source_size - before)))::BIGINT END AS taken FROM j
"""

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_chat_tree": op10_chat_tree,
    "op8_ngram_join": op8_ngram_join,
    "op9_lm_score": op9_lm_score,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL = {
    "op5_embedding_dedup": oracles.OP5_SQL,
    "op8_ngram_join": oracles.OP8_SQL,
    "op10_chat_tree": oracles.OP10_SQL,
    "op2_mix_sources": OP2_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_collocations": oracles.OP11_SQL,
    "op12_spelling_variants": oracles.OP12_SQL,
}
