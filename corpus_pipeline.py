"""Corpus pipeline: quality rules, near-dedup, decontamination, personal data, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of documents.  Extra columns of the input go, whatever their names.  An empty table
passes all stages as one.  Null and empty texts and those of fewer than 50 words go in the first stage;
texts of any length are read whole.  Rows without an id are judged but never linked, and rows that repeat
an id share the fate of that id in near_dedup and decontamination; of equal texts the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segrank.llm import bpe, common, decontaminate, pii, quality, shingles
from segrank.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; cutoffs are proven on the labelled ones."""
    return quality.keep_good(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike by 0.8 or more) the document of the smallest id."""
    return shingles.drop_near_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    from pyspark.sql import functions as F

    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.token_digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Byte-pair ids are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them is written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        common.release(before)  # nothing reads it any more; the table of documents itself is not one of ours
    return STAGES[-1][1](spark, docs, sf_dir)
