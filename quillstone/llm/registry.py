"""The queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import ship

from . import attention, fm, jpeg, langid, licenses, mixing, negatives, packing, passages, simhash, spotsigs, urls, vafile
from .common import documents


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(documents(spark, sf_dir, "pages"), urls.RULES)


#: Production target weights of the mix; sources not listed share the rest.
WEIGHTS = {f"src{i}": 0.0375 for i in range(20)} | {"src0": 0.1, "src1": 0.15, "src2": 0.1, "src3": 0.05}
REST = 0.05


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), WEIGHTS, REST)


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fm.score(docs, fm.learn(docs, documents(spark, sf_dir, "labels")))


def op4_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).withColumn("spans", F.to_json("spans"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(documents(spark, sf_dir))


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs))


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(documents(spark, sf_dir))


def op11_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.compress(documents(spark, sf_dir, "embeddings"))


def op12_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(documents(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


OPERATORS = (
    op1_url_trust,
    op2_pfair_mix,
    op3_quality_fm,
    op4_pack_binary,
    op5_spotsigs,
    op6_license_scan,
    op7_progressive_jpeg,
    op8_cross_parsing,
    op9_simhash_pigeonring,
    op10_compact_windows,
    op11_va_file,
    op12_attention,
    op13_hard_negatives,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_trust": urls.oracle(), "op11_va_file": vafile.oracle(), "op13_hard_negatives": negatives.oracle()}
