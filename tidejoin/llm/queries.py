"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, langid, lines, mixing, packing, secrets, sharding, simhash, spotsigs, tokens, variants
from .common import prepare, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digest(rows, tokenizer_path("byte_bpe_50k.json")).drop("n_tokens", "loss_tokens")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.length("kept_text").cast("long").alias("kept_chars"), F.md5("kept_text").alias("kept_md5"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_output, op2_chat_format, op3_decontamination, op4_balanced_shards, op5_simhash, op6_secret_scan, op7_spotsigs, op8_line_dedup, op9_source_mix, op10_language_id, op11_spelling_variants, op12_fill_in_middle, op13_retrieval_packing)
}

_ESCAPED = "(length({x}) + length({x}) - length(replace({x}, '\\', ''))" + "".join(f" + (length({{x}}) - length(replace({{x}}, '{c}', ''))) // {len(c)}" for c in ("<turn>", "<text>", "</turn>", "<|endoftext|>")) + ")"

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + {_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op8_line_dedup": f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line) AS k FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {lines.SITES}),
m AS (SELECT l.*, b.k IS NULL AS kept FROM l LEFT JOIN b ON trim(l.line) = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_md5
FROM m GROUP BY doc_id""",
    "op12_fill_in_middle": f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fim.TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM x),
t AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM t""",
}

__all__ = ["ORACLE_SQL", "QUERIES", "prepare", "tokenizer_path"]
