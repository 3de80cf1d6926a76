"""The corpus pipeline: documents through quality, toxicity, line dedup, near duplicates, packing.

Each stage works on all rows that the one before kept; all but the last return the columns of
documents. Stages are written as Parquet and read again, so a lost executor costs one stage at most.

Defined results: a null text counts as an empty one; rows without a label are scored like all others;
rows with equal texts are scored alike, and of their group one stays, that of the least doc_id; rows
that share a doc_id are told apart by their texts in line dedup, and near duplicates keep all or none
of them; a row with a null doc_id goes through all stages and is never a near duplicate; texts of any
length are worked on whole; columns of any other name are carried to the last stage, which returns
pieces; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import labelled, line_dedup, ngram_join, packing, quality, toxicity
from ledgerspark.llm.queries import GOOD_FROM, TOKENIZER, TOXIC_FROM, read
from ledgerspark.llm.shared import free_name, materialize, release


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "quality")
    return quality.score_quality(docs, model, score).where(F.col(score) >= GOOD_FROM).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages do not reach the rejecting score."""
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "toxic")
    return toxicity.score_toxicity(docs, model, score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, n_lines=free_name(docs, "lines"), n_dropped=free_name(docs, "dropped"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[length.alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("line_dedup", unique_lines), ("near_duplicates", one_of_each), ("packing", packed)]

#: Trained models, similarity components and a genetic algorithm have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; each stage's table goes when the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return docs
