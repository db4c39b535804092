"""From raw documents to packed training sequences: five stages over the whole table.

Each stage takes the documents its predecessor kept and returns a DataFrame; all
but the last return rows of ``documents`` with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressline.llm import decontaminate, exact_dedup, lang_id, ngram_join, queries
from pressline.llm.shared import remainder, staged, table, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, which no language can claim, go.

    The model learns as in the language query: from rows with a language whose
    id's crc32 leaves no remainder 2 by 4. Without such rows nothing is rejected
    but texts without letters.
    """
    pieces = lang_id.public_pieces(queries.PIECES)
    model = lang_id.fit(docs.where(remainder("doc_id", 4) != 2), pieces)
    return without(docs, lang_id.predict(docs, model).where("lang_pred = 'und' and not letters"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    return queries.packed(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", clean), ("packing", pack)]

#: The language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
