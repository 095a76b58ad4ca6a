"""The corpus pipeline: documents, stage by stage, to pieces for training.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All
but the last return the columns of documents, so stages can be left out or run again
from what is written between them.

Defined results for odd input: a null text has no language and goes in the first stage;
null doc_ids pass every stage by their text alone; rows that repeat a doc_id are judged
each by its own text, and of equal rows one stays; extra columns stay; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import decontaminate, langid, near_dedup, pieces, secrets
from motionlake.llm.common import scratch, stored, table

SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous."""
    found = langid.predicted(docs, langid.train(docs))
    return found.filter(~F.col("ambiguous") & (F.col("lang_pred") != langid.UNKNOWN)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return near_dedup.deduplicated(docs, shingle=SHINGLE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.cleaned(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs, but for the text its piece ids and whether decoding these gives the text again."""
    return pieces.coded(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", secret_spans),
    ("sentencepiece", to_pieces),
]

#: Language models and tokenizers have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what earlier ones have written goes, but for what is still read."""
    docs = table(spark, sf_dir, "documents")
    *early, (name, stage), (_, last) = STAGES
    with scratch(spark) as keep:
        for label, step in early:
            docs = stored(step(spark, docs, sf_dir), label)
        docs = keep(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
