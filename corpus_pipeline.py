"""A training-corpus pipeline of five operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  The first
four return the columns of ``documents``; the last returns the encoded corpus.

Odd rows: the first stage drops texts that are null or without letters, whose language cannot be
told; documents with a null doc_id pass all stages, compared with nothing, and are encoded under
the id 0.  Repeated rows of one doc_id stay or go together.  Further columns pass the first four
stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, langid, linededup, mergedropout, neardup
from weftline.llm._spark import table, written

#: The public vocabulary of the last stage; a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labels teach go, and those without letters."""
    return langid.keep_accepted(docs, langid.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that three or more documents hold stay in the last of them only."""
    return linededup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8): that of the smallest id."""
    return neardup.dedup(docs, size=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, n_tokens, ids, lossless."""
    return mergedropout.encode(docs, MODEL_FILE)


STAGES = [("language id", language), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("sentencepiece", tokens)]

#: Models, components and segmentation are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
