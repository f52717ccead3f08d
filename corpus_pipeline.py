"""A training corpus from raw documents in five stages of ``siftline.llm``.

Each stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import mixing, packing, pii, quality, simhash
from siftline.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with all their columns.

    Null, empty and white texts go, as they have too few words; null and repeated ids,
    and repeated rows, are judged each by its text; very long texts count whole; of
    equally good cutoffs the most lenient holds; no rows give no rows; further
    columns, whatever their names, stay.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id, null last.

    Null, empty and white texts are copies of each other; of rows equal in id and
    text one stays; rows that share only an id are judged by their texts; texts of any
    length are compared whole; no rows give no rows; further columns stay.
    """
    return simhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks; ``n_chars`` follows the text.

    Null texts stay null and empty ones empty; repeated rows are masked alike; of
    overlapping spans the first's mark stands for both, of those that start together the
    shorter's; texts of any length are masked whole; no rows give no rows; further
    columns stay.
    """
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; documents without words, null texts among them, go; of
    equal ranks the lesser id goes first, null least; repeated rows are taken alike;
    texts of any length count whole; no rows give no rows; further columns stay.
    """
    return mixing.repeat_mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence.

    A null or empty text is one piece that holds the end id; repeated rows and ids are
    packed each on its own; pieces of one length are interchangeable; very long texts
    are cut; no rows give no rows; further columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Exact binomial bounds, components and packing are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
