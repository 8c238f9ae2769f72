"""A corpus pipeline over documents: toxicity, line dedup, near-dedup, decontamination, then sampled encodings.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. The last returns up to two sampled segmentations of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.llm import decontam, line_dedup, near_copies, sentencepiece_sampling, toxicity
from lumenta.llm.common import read, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except in one of them; every document stays, and n_chars follows its text."""
    out = line_dedup.deduplicated(docs, counts=False)
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of 0.8 or more) the document with the least doc_id stays."""
    return near_copies.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of sampled segmentations of every document that is left."""
    return sentencepiece_sampling.encoded(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_common_lines), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: Models, similarities and samples can't be expressed in SQL; tests/llm/test_pipeline.py compares each stage and the whole with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes on its way goes once its rows are written
            docs = table(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
