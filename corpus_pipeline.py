"""Corpus pipeline: five stages from the documents table to token digests.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm.common import load
from constella.session import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose tail probability is too low go."""
    from constella.llm.ordinal_quality import select

    return select(docs, load(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the document with the smallest id of each group stays
    (documents without words or an id are groups of their own)."""
    from constella.llm.ngram_join import near_duplicates

    groups = near_duplicates(docs)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    first = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    return first


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated passages are cut out of the texts."""
    from constella.llm.suffix_dedup import cut_repeats

    return cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sources are replicated to equal shares of bytes."""
    from constella.llm.poisson_mix import mix

    return mix(docs).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token digests of every row."""
    import public_tokenizers

    from constella.llm.byte_bpe import encode
    from constella.llm.queries import BYTE_BPE

    return encode(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, full=False)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", ngram_jaccard_join),
          ("suffix-array dedup", suffix_array_dedup), ("mixing sources to target weights", source_mix),
          ("byte-level BPE", byte_bpe)]

#: SQL cannot train the classifier nor run the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; intermediate tables go to the
    shared folder of spark.checkpoint.dir."""
    docs = load(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
