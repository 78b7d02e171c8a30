"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.llm import common, cotraining, line_dedup, ngram_join, packing, sketch, suffix_dedup

#: Columns of ``documents``; all stages but the last hand them on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Share of a source's documents over which a line is boilerplate.  A source is larger than a host, so it is below the
#: operator's 0.1: in documents of sf0.1 one line stands on 8.6 to 13.2 % of every source, no other on over 4.8 %.
LINE_RATIO = 0.07


def _with_text(df: DataFrame, text) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good; columns as given."""
    scores = cotraining.classify(docs, common.table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scores.where("kept").select(*COLUMNS)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that stand in over ``LINE_RATIO`` of a source's documents.  A document stays,
    whatever is left of it; null text stays null; documents without source are left alone."""
    return _with_text(line_dedup.drop(docs.select(*COLUMNS), F.col("source"), F.col("text"), ratio=LINE_RATIO), F.col("lines.kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles the one with the smallest id.  Documents without
    words or without id are linked with nothing and stay; rows of one id stay or go together."""
    gone = common.saved(ngram_join.join(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct())
    maybe, known = sketch.among(gone), docs.where("doc_id is not null")
    # few documents go, so only those and few others move; merged at every size, as both sides grow
    stay = known.where(maybe("doc_id")).join(gone.hint("merge"), "doc_id", "left_anti")
    return stay.select(*COLUMNS).union(known.where(~maybe("doc_id")).select(*COLUMNS)).union(docs.where("doc_id is null").select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the bytes of strings of 200 bytes that occur elsewhere too; characters cut in two go
    whole.  A document stays, whatever is left of it; null text becomes empty."""
    out = suffix_dedup.dedup(docs, carry=("lang", "source"), as_text=True)
    return _with_text(out, F.col("kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", boilerplate),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("best_fit_packing", packed),
]

#: The fitted classifier, the suffix arrays and the packing are beyond SQL; tests hold the
#: stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before wrote."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
