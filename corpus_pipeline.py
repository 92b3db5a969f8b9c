"""A training-data pipeline over ``documents``.

Stages, in order; each works on all that the one before kept:

1. toxicity: documents predicted toxic go;
2. line dedup: lines that repeat or nearly repeat an earlier line go, documents stay;
3. n-gram Jaccard join: one document of each group of near duplicates stays;
4. mixing: documents are sampled towards the target weights;
5. SentencePiece: the ids of every remaining text, with the digests of ids and decoded text.

The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.common import written
from logloom.llm.op2_toxicity import toxicity_stage
from logloom.llm.op3_mixing import mixing_stage
from logloom.llm.op4_line_dedup import line_dedup_stage
from logloom.llm.op5_sentencepiece import sentencepiece_stage
from logloom.llm.op10_ngram_join import ngram_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL can't express the trained classifier, the sketches and the tokenizer; tests/llm holds the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
