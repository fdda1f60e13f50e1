"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

1. quality rules: documents that fail the base rules or the likelihood ratio go;
2. line dedup: common blocks go from the later document, and documents of
   which nothing but white space is left go with them;
3. SimHash near-dedup: of each group the document with the least id stays;
4. benchmark decontamination: documents that hold a test item go;
5. best-fit packing: what is left, as pieces of sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import decontam, linededup, packing, quality, simhash
from deltaloom.llm.common import shared_path, table

VOCABULARY = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have no words and go; repeated rows are judged alike."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses nothing stays as it is, also if it is empty; one that is left with white space only goes."""
    out = linededup.line_dedup(docs, rows=True).where((F.col("n_removed") == 0) | (F.length(F.translate("text", " \t\n\x0b\f\r", "")) > 0))
    cut = F.col("n_removed") > 0
    own = {"text": F.when(cut, F.col("text")), "n_chars": F.when(cut, F.char_length("text").cast("long"))}
    return out.select([F.coalesce(own[c], F.col(f"row.`{c}`")).alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 of five-word shingle sets the document with the least id stays."""
    return simhash.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left; a null text is one end token."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

# the likelihood ratio, the alignment and the fingerprints' groups have no SQL form; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = shared_path(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
