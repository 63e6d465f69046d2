"""Corpus pipeline: what turns raw documents into a clean corpus and its token counts.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. Toxic documents go; repeated runs of lines are deleted from the texts; of each
group of near copies one document stays; documents that hold a benchmark item go;
the rest is encoded.

All stages take null ids and texts, empty and very long texts, repeated rows, an empty
table and further columns of any name; all but the last return the columns they got.
Each row is judged by its own text: rows without id, or of one id with different texts,
don't touch each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parimutuel.llm import bpe, decontaminate, lines, simhash, toxicity
from parimutuel.llm.common import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; a null text is judged as an empty one. Nothing goes where no label is toxic."""
    return toxicity.accepted(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier run; null and empty texts stay as they are, ties go to the smaller id."""
    return lines.deduplicated(docs)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies. Texts without words, null ones too, are one group; rows without id all stay."""
    return simhash.near_dedup(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and items without words are in none."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of counts and digests for every row; a null or empty text has no tokens."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("BPE encoding and decoding", encode),
]

#: The stages run Python over whole texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
