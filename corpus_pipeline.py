"""A corpus through five stages: toxicity, near-duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and gives a frame, which is written and read again as
the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.bpe import RANKS_FILE, token_table
from cohortline.llm.common import bound_batches, ship, table, written
from cohortline.llm.minhash import keep_one_near_copy
from cohortline.llm.mixing import mixed_documents
from cohortline.llm.secret_scan import redacted
from cohortline.llm.toxicity import toxicity, trained


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled ones among docs."""
    ship(spark)
    bound_batches(spark)
    model = trained(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity(F.col("text"), model) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word Jaccard similarity of 0.8 or more.

    Candidates come from SimHash fingerprints, as in op10, and from MinHash bands.
    """
    ship(spark)
    bound_batches(spark)
    return keep_one_near_copy(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced by a placeholder."""
    return redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    ship(spark)
    bound_batches(spark)
    return token_table(docs, public_tokenizers.path(RANKS_FILE))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: A trained classifier and byte pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
