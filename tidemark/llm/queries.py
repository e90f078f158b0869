"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear, chat, exact, mixing, onebit, packing, repeats, simhash, tokenfile, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score_documents(_table(spark, sf_dir, "documents"))


def op2_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokenfile.token_table(_table(spark, sf_dir, "documents"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Added to the conversations: both turns hold control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read(rows.unionByName(planted))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.find_copies(_table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_bilinear_scores, op2_onebit_neighbours, op3_packing, op4_token_files, op5_chat_formatting, op6_simhash, op7_mixing, op8_exact_dedup, op9_repeats, op10_toxicity)}

_ESCAPE = r"regexp_replace(regexp_replace({0}, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')"

ORACLES = {
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op5_chat_formatting": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
        e AS (SELECT *, {_ESCAPE.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} AS r2, {_ESCAPE.format("text")} AS t2 FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(7 + sum(14 + length(r2) + length(t2)) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
