"""A training-data pipeline: quality filter, near-dedup, personal data masked, sources mixed, documents packed.

Each stage works on all rows of the one before; rows may have null or repeated ids and any further columns, whatever
their names, which all stages but the last hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, free_name, saved, table
from .mixing import mixed_documents
from .neardup import keep_first
from .packing import pack
from .pii import redact
from .quality import fit_quality, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, scores below one half go.

    Null and empty texts score by the bias alone; repeated rows are scored each; without labels all score one half and
    stay; rows with a null id are scored too, but have no label; an empty table gives no row.
    """
    score = free_name(docs.columns, "score")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similarity 0.8 or more on shingles of five words stays, that with the smallest id.

    Null ids come last in a group, and of several rows with one id the first; null and empty texts are in no group and
    stay; repeated rows are a group; an empty table gives no row.
    """
    return keep_first(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind; no document goes, and null texts stay null."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become what the mix takes of them; a part that is taken twice comes back in a second row of its document.

    Of null and empty texts nothing can be taken, so they go; null sources are one source; repeated rows are mixed each.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of at most 2048; null and empty texts are the end id alone, repeated rows packed each."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", mask_pii), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the classifier, the packing plan or the tokeniser; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows saved and read again before the next, after which they go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
