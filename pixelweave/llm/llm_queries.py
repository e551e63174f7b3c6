"""The thin queries over the operators: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing, tokens

    rows = packing.pieces(table(spark, sf_dir, "documents"), tokens.public_path(), packing.CAPACITY, end_id=0)
    return packing.pack(rows, packing.CAPACITY)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files, tokens

    manifest = token_files.write_files(table(spark, sf_dir, "documents"), tokens.public_path(), vocabulary=49_408, end_id=2)
    return token_files.read_files(manifest)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    return urls.judge(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language
    from .common import held_out

    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import curves

    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.build_derivatives(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import held_out

    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filters, op2_best_fit_packing, op3_token_files, op4_language_id, op5_quality_rules, op6_simhash, op7_source_mixing, op8_nearest_neighbours, op9_warc_derivatives, op10_toxicity)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import curves, mixing, quality, urls

    return {
        "op1_url_filters": urls.oracle(),
        "op5_quality_rules": quality.oracle(),
        "op7_source_mixing": mixing.oracle(),
        "op8_nearest_neighbours": curves.oracle(),
    }
