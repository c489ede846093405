"""A training corpus from raw documents: five stages, each an operator of lumapair.llm.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; the stages
between write Parquet, so a lost executor costs no more than a stage's own tasks.
Within a stage narrow tables decide, and texts move through one shuffle (in `near`, only those of rows that may go).

Every stage takes nulls in any column, repeated rows and ids, texts of any length,
empty tables, and further columns of any name (with dots, or like a helper column).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumapair.llm import exact_dedup, language, mixing, packing, simhash
from lumapair.llm.membership import bit_filter, may_be_in
from lumapair.session import delete, drop_tables, materialize, shared_dir, ship


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go (null and empty texts too). Without a label to learn from, none can be told."""
    ship(spark)
    return language.identified(docs, language.train(docs, F.col("doc_id").isNotNull()))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside), the row with the smallest doc_id; if such rows repeat, the first by raw text and then by the other values."""
    ship(spark)
    return exact_dedup.distinct_rows(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles, the document with the smallest doc_id; rows without an id or without a word stay."""
    ship(spark)
    groups = simhash.near_groups(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    gone = materialize(groups.where("node <> component").select("node"), "near-gone")
    own = F.col(names[docs.columns.index("doc_id")])
    rows, packed = docs.toDF(*names), bit_filter(gone)
    # Only rows that may go are joined; all others stay where they are.
    asked = rows.where(may_be_in(packed, own.cast("long"))).join(gone, own == F.col("node"), "left_anti")
    return rows.where(~may_be_in(packed, own.cast("long"))).union(asked).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; those without a word are taken as often as their place in the order says."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence that each is in; a null text is empty, and repeated rows are packed each for itself."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identified),
    ("exact", deduplicated),
    ("near", near_deduplicated),
    ("mix", mixed),
    ("pack", packed),
]

#: Tokenizers, shingle sets and language models are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir. What a stage wrote besides its result, and the result before it, goes when its own is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        drop_tables(spark)
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
