"""The registered queries of this subpackage, thin over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, decontam, linededup, packing, quality, secrets, simhash, suffix, tokens, warc
from .common import materialize, table

VOCABULARY = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written from all conversations, parsed and rendered again by a model of half of them."""
    raw = chat.transcripts(table(spark, sf_dir, "conversations"))
    held_out = F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(2)) == 1
    return chat.render(chat.parse(raw, chat.fit(chat.labelled(raw.where(~held_out)))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.fit(secrets.example_findings(spark), secrets.dictionary(public_tokenizers.path(VOCABULARY)))
    return secrets.scan(table(spark, sf_dir, "documents"), forest)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality(docs, labels).select("doc_id", *quality.BASE, "base_failed", "kept")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica with damaged bytes (every 101st page), cut records (every 109th), lost ones (every 103rd) and added ones (every 107th)."""
    size = F.octet_length("record")
    hurt = (
        F.when(F.col("page_id") % 101 == 7, F.concat(F.substring("record", F.lit(1), size - 5), F.lit("?\r\n\r\n").cast("binary")))
        .when(F.col("page_id") % 109 == 13, F.substring("record", F.lit(1), size - 10)).otherwise(F.col("record"))
    )
    # digests of both replicas are taken where the records lie; only they move
    rows = warc.stored(table(spark, sf_dir, "pages")).withColumn("record", hurt)
    rows = warc.placed(rows.select("rid", "archive", "part", "page_id", "url", "length", "sha256", size.cast("long").alias("r_length"), F.sha2("record", 256).alias("r_sha256")))
    rows = materialize(rows.withColumn("end", F.sum("length").over(Window.partitionBy("archive", "part"))))
    place = ["archive", "part", "offset", "page_id"]
    held = rows.where("page_id is null or page_id % 103 <> 5").select(*place, F.col("r_length").alias("length"), F.col("r_sha256").alias("sha256"))
    added = rows.where("page_id % 107 = 11").withColumn("offset", F.col("end") + F.col("offset")).select(*place, "length", "sha256")
    return warc.audit(rows.select(*place, "length", "sha256"), held.unionByName(added))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_chat_formatting, op3_secret_scan, op4_benchmark_decontamination, op5_simhash_near_dedup,
        op6_token_counts, op7_quality_rules, op8_warc_fixity, op9_line_dedup, op10_suffix_array_dedup,
    )
}

# The audit's answer by plain comparison of every record.
_OP8 = """
WITH rec AS (
  SELECT page_id, page_id // 1000 AS archive, url,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || html AS body
  FROM pages),
full_rec AS (
  SELECT page_id, archive, url,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) ||
         'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) ||
         'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10) ||
         'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body AS head
  FROM rec),
placed AS (
  SELECT page_id, archive, CAST(0 AS INTEGER) AS part, head, CAST(strlen(head) + 4 AS BIGINT) AS length,
         CAST(coalesce(sum(strlen(head) + 4) OVER (PARTITION BY archive ORDER BY page_id, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place,
         CAST(sum(strlen(head) + 4) OVER (PARTITION BY archive) AS BIGINT) AS total,
         sha256(head || chr(13) || chr(10) || chr(13) || chr(10)) AS good
  FROM full_rec)
SELECT archive, part, place AS "offset", page_id, length, good AS expected,
       CASE WHEN page_id % 101 = 7 THEN sha256(left(head, length(head) - 1) || '?' || chr(13) || chr(10) || chr(13) || chr(10))
            ELSE sha256(left(head, length(head) - 6)) END AS actual,
       'damaged' AS state
FROM placed WHERE (page_id % 101 = 7 OR page_id % 109 = 13) AND page_id % 103 <> 5
UNION ALL
SELECT archive, part, place, page_id, length, good, NULL, 'missing' FROM placed WHERE page_id % 103 = 5
UNION ALL
SELECT archive, part, total + place, page_id, length, NULL, good, 'extra' FROM placed WHERE page_id % 107 = 11
"""

# The other queries hash with XXH64, use a tokenizer, align or fit a model: SQL can't express them; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_warc_fixity": _OP8}
