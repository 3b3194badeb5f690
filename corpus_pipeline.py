"""A corpus pipeline of five stages over `documents`; each stage's rows are written and read again as the next one's documents.

1. quality rules: documents outside the compression bands, or failing the base rule, go;
2. line dedup: lines that an earlier similar line stands for go, and documents that lose all their lines;
3. near-dedup: of each group of near-duplicates (five words, 0.8) the document of the smallest id stays;
4. secret scans: spans of secrets are replaced;
5. packing: what is left, cut into pieces and packed into sequences of 2048 tokens.

The first four return the columns of `documents`; n_chars follows the text.

Near-dedup takes the setting of pipelines, shingles of five words; the query of that operator takes two. Copies that differ in few words have often lost their
common lines in stage 2 already, so that stage 3 finds fewer of them than the query does.

Defined results: null, empty and blank texts, and those under 50 words, fail the base rule of stage 1 and go. Documents that stage 2 leaves without a word go.
Rows with one id and one text are one document in stages 2 and 3; a null id takes part, and comes first in stage 2. Texts of any length are taken whole. Other columns
are carried up to packing, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import line_dedup, near_dedup, packing, quality_rules, secret_scan
from strandlog.llm.common import table, written


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(line_dedup.cleaned(docs).where(F.col("text").rlike(r"\S")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(secret_scan.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: zstandard, MinHash, digests of spans and tokenisation have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
