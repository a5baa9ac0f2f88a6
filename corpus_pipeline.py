"""The corpus pipeline: documents in, packed training sequences out.

Counted as part of the subpackage quillstone.llm. Each stage is a function of (spark,
docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, extra ones among them, whatever their names and cases.

Rows with a null doc_id go through every stage but that the second keeps one of each text among them; repeated rows do
until the second, which keeps one. A stage over an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import langid, mixing, packing, passages, simhash
from quillstone.llm.common import documents, remove, shared_dir
from quillstone.llm.registry import REST, WEIGHTS
from quillstone.session import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go; where lang is null it becomes the predicted one.

    Null and empty texts and texts without a letter go. Shorter ones than ``langid.TELLING`` bytes stay, as too little to
    judge by. Very long texts are read whole. Without any labelled row only texts without a letter go. Ties go to the language first by name.
    """
    ship(spark)
    return langid.identified(docs, langid.learn(docs))


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Null, empty and blank texts are one group. Of repeated rows one stays. Of rows with a null id one of each text stays.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def no_repeated_passage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; no document goes, though it may be left with no text.

    Null texts stay null. Texts of fewer words, and rows with a null id, stay as they are. Of equal passages that of the least id stays.
    """
    ship(spark)
    return passages.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; none is dropped or repeated.

    A null source, and sources without a weight, are one stream. Ties of a source's order go by id and source.
    """
    ship(spark)
    return mixing.in_order(docs, WEIGHTS, REST)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its ids and its sequence; sequences of a length are numbered along the mix, the order of the files' rows.

    A null text gives one piece, the end id alone. Very long texts are packed whole, piece by piece.
    """
    ship(spark)
    at = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return packing.pack(docs.select("*", *at), along=("_file", "_row"))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_near_duplicate),
    ("substring dedup", no_repeated_passage),
    ("mixing sources", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, kept until the next one is written."""
    docs = documents(spark, sf_dir)
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{top}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, f"{top}/{i - 1}")
    return docs


#: No SQL says what a learned model, a graph's components or a tokenizer do.
ORACLE_SQL = None
