"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm import bpe, brown, chat, exact, licenses, minhash, nbsvm, quality_rules, ranked_search, spelling, substring, toxicity
from vitals.llm.tables import table

VOCABULARY = "byte_bpe_50k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score_quality(docs, model).select(
        "doc_id",
        (toxicity.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bpe.pack_powers_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(turns.unionByName(probe))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, index).select(
        "doc_id",
        (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "evidence",
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash": op5_minhash,
    "op6_packing": op6_packing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL = {
    "op11_spelling_variants": spelling.spelling_sql(),
    "op12_ranked_search": ranked_search.ranked_search_sql(),
    "op3_license_scan": licenses.license_sql(),
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), '') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op7_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, length(regexp_replace(text, '<(\\*)(/?s>)|\[(\\*)(/?(?:INST|ROLE)\])', '_\1\3\\\2\4', 'g')) AS n_text,
                   length(regexp_replace(role, '<(\\*)(/?s>)|\[(\\*)(/?(?:INST|ROLE)\])', '_\1\3\\\2\4', 'g')) AS n_role
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n_text + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE n_role + 28 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op5_minhash": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        k AS (SELECT n.doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s JOIN n USING (doc_id) GROUP BY n.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
        m AS (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY id)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept,
               coalesce(min(m.doc_id) OVER (PARTITION BY coalesce(k.k, CAST(m.doc_id AS VARCHAR))), m.doc_id) AS class_id
        FROM m LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
