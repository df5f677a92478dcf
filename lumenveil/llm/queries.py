"""The corpus operators' queries, as __spark_entry__.py registers them, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fim, langid, linededup, neardup, packing, periodic, quality, sharding, substring, tokencount, warc
from .common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica is a copy of pages in which ids that leave 7 by 89 are cut by a character and ids that leave 5 by 97 are lost."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cut = F.when(F.col("page_id") % 89 == 7, F.expr("substring(html, 2)")).otherwise(F.col("html"))
    return warc.audit(pages, pages.where("coalesce(page_id % 97 <> 5, true)").withColumn("html", cut))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    texts = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.surplus(read_table(spark, sf_dir, "documents")).drop("key")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(read_table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return decontaminate.Decontaminator(docs, read_table(spark, sf_dir, "benchmark")).leaks(docs)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), **packing.PRODUCTION)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read_table(spark, sf_dir, "documents"), 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(read_table(spark, sf_dir, "documents"))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.rearranged(read_table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op8_near_duplicates": op8_near_duplicates,
    "op3_warc_fixity": op3_warc_fixity,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op4_language_id": op4_language_id,
    "op7_token_counts": op7_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}
_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

_CUT = """m AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
    h AS (SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS a, ('0x' || s[9:16])::BIGINT AS b, ('0x' || s[17:24])::BIGINT AS c, ('0x' || s[25:32])::BIGINT AS d FROM m),
    f AS (SELECT doc_id, t, n, least(a % (n + 1), b % (n + 1)) AS i, greatest(a % (n + 1), b % (n + 1)) AS j,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c % 100 >= 90 THEN 'plain' WHEN d % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substring(t, 1, i) AS pre, substring(t, i + 1, j - i) AS mid, substring(t, j + 1) AS suf FROM f)"""

ORACLE_SQL: dict[str, str] = {
    "op13_fill_in_middle": f"""WITH {_CUT} SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op3_warc_fixity": f"""
        WITH a AS (SELECT page_id, {_RECORD} AS r FROM pages),
        placed AS (SELECT page_id, page_id >> 12 AS file_no, sha256(r) AS expected, strlen(r) AS length,
            CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY page_id >> 12 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM a),
        b AS (SELECT page_id, sha256({_RECORD}) AS found FROM (SELECT page_id, url, CASE WHEN page_id % 89 = 7 THEN substr(html, 2) ELSE html END AS html FROM pages WHERE page_id % 97 <> 5))
        SELECT page_id, file_no, "offset", length, CASE WHEN found IS NULL THEN 'lost' ELSE 'damaged' END AS problem, expected, found
        FROM placed LEFT JOIN b USING (page_id) WHERE found IS DISTINCT FROM expected""",
    "op6_chat_formatting": """
        WITH c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
        p AS (SELECT DISTINCT l[1:i] AS pl FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
        k AS (SELECT min(conv_id) AS conv_id FROM c WHERE l NOT IN (SELECT pl FROM p) GROUP BY l)
        SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered FROM conversations WHERE conv_id IN (SELECT conv_id FROM k)""",
}
