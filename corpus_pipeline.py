"""A corpus pipeline in five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
Null and empty texts, null ids, repeated rows, ties and further columns pass through every stage as its docstring says; an empty table gives an
empty one. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscribe.llm import bpe, lines, mixing, neardup, toxicity
from gridscribe.llm.common import cut, table


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels of these documents, does not reject.

    Null and empty texts and null ids stay, repeated rows stay or go together. Without labels of both classes nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not _rejected").select(*columns_of(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more of them share but for the last holder; n_chars, where it is a column, follows the text.

    A null text becomes empty. Rows of one id count as one document and are reassembled one by one; null ids keep all lines.
    """
    rows = lines.drop_repeated_lines(docs)
    size = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return rows.withColumns(size).select(*columns_of(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate class.

    Texts without words and null ids stay. Rows of one id are one document: they stay or go together.
    """
    return neardup.drop_near_duplicates(docs).select(*columns_of(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null sources are one source, the last. Texts without words have size 0 and are taken as often as their source's share says. Reruns give the same rows.
    """
    return mixing.emit(mixing.mix(docs)).select(*columns_of(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit), their number, and the text that they decode to.

    Null and empty texts have no ids and decode to an empty text. Each row by itself.
    """
    rows = bpe.round_trip(docs)
    return rows.select("doc_id", "lang", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_decoded").alias("text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL has no ordinal regression; stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage keeps is written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
