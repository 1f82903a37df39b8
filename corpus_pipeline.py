"""Raw documents to a token store: language, near-duplicates, benchmark leaks, mix, tokens.

Every stage takes all documents that the one before kept. All but the last return the columns of documents.

Nulls, empty texts and odd tables: a null or empty text is in no language and goes at the first stage. Later stages take
null texts as empty: they share a near-duplicate class, hold no benchmark item and have no words to mix. Rows without
an id belong to no class and stay; a null source is a source of its own. Rows that repeat a document share its class
and are mixed each by itself. Extra columns pass through whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm.common import file_place, stage, table
from cadastra.llm.curriculum import mixed
from cadastra.llm.decontaminate import decontaminated
from cadastra.llm.langid import in_a_language, samples
from cadastra.llm.near_dedup import one_of_each
from cadastra.llm.token_store import token_store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models from the labelled documents; what has no letter is in no language and goes. A null lang becomes the one found."""
    return in_a_language(docs, samples(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; the one cut at a source's target is rounded."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Content-addressed store of the token ids in the order of the staged mix, read back and verified."""
    return token_store(docs.withColumn("place", file_place()), order_col="place")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_store", tokens),
]

#: Alignment and tokenisation have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
