"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents; the last returns doc_id, n_tokens and ids.

Defined cases, for every stage: an empty table gives an empty one; doc_ids may be null or repeated, and rows count one by one (only
near_duplicates drops repeated rows); columns beyond text and doc_id may be null, and further columns pass through, whatever
their names. A null text counts as empty: it has the score of an empty text, is a near copy of other texts without words, holds
no test item and no personal data (and stays null), and has no tokens.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from steploom.llm import bpe, decontam, fm, jaccard, pii
from steploom.llm.common import documents, finished, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go; with no labelled row all stay."""
    return fm.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays, that of the least doc_id (null last, equal ones by a hash of their columns)."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; with no test items all stay."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, and n_chars counts the new text."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, of every document."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the tagger.
ORACLE_SQL = None


def state_of(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the files of the tables that the stages read: their paths, sizes and times."""
    said = []
    for table in ("documents", "labels", "benchmark"):
        try:
            files = spark.read.parquet(f"{sf_dir}/{table}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        # Summed where the files are, so that their number does not matter.
        said.append((table, *files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()))
    return str(said)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents. With a folder, each stage is written there, and a run that failed goes on after the stages it had finished.

    A stage's folder is named by a digest of the files of the input and of the stages up to it, so a run over other input, or with other stages, takes
    none of what an earlier one left there. What it no longer needs stays until it is deleted.
    """
    docs, digest = documents(spark, sf_dir), folder and state_of(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        digest = digest and hashlib.sha256(f"{digest} {name} {stage.__module__}.{stage.__qualname__}".encode()).hexdigest()
        path = digest and f"{folder}/{i}-{name}-{digest[:16]}"
        docs = spark.read.parquet(path) if path and finished(spark, path) else stored(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
