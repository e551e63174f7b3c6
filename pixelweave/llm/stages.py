"""Stages of the corpus pipeline: each keeps, drops or repeats whole documents.

All but the last return the columns of their input, whatever these are called,
as long as ``doc_id``, ``text`` and (where a stage needs them) ``lang`` and
``source`` are among them; columns travel by place. Each judges all its input.

Defined cases: a null or empty text has no letter and no word, so language ID
and the quality rules drop it. Repeated rows are judged each; near-duplicates
keep one row of them, and mixing repeats each by itself. A null doc_id never
names a group, so a row with an id stays in its place if the group has one. An
empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, packing, quality, simhash, tokens
from .common import materialise

#: A language must explain a text at least this well against the others.
MIN_SCORE = 0.5


def _at(docs: DataFrame, name: str) -> str:
    """Where a needed column travels; it may be spelt in another case."""
    names = docs.columns
    return f"kept_{names.index(name) if name in names else [c.lower() for c in names].index(name.lower())}"


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns by name, and all columns by place, as kept_0, kept_1, ..."""
    return docs.toDF(*_places(docs)).select(*[F.col(_at(docs, n)).alias(n) for n in needed], *_places(docs))


def _places(docs: DataFrame) -> list[str]:
    return [f"kept_{k}" for k in range(len(docs.columns))]


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*_places(docs)).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those no language claims."""
    rows = _carried(docs, "doc_id", "text", "lang")
    found = language.identify(rows, language.fit(rows), keep=_places(docs))
    return _restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a base rule or a certified cutoff."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counted = materialise(quality.text_statistics(_carried(docs, "doc_id", "text"), keep=["doc_id", *_places(docs)]), "counted")
    cutoffs = quality.choose_cutoffs(counted.withColumn("doc_id", F.col("doc_id").cast("long")), labels)
    return _restored(quality.judge(counted, cutoffs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the smallest doc_id, and one row of that."""
    rows = materialise(docs.toDF(*_places(docs)).withColumn("row", F.monotonically_increasing_id()), "numbered")
    texts = rows.select(F.col("row").alias("doc_id"), F.col(_at(docs, "text")).alias("text"))
    prints = materialise(simhash.fingerprints(texts).withColumnRenamed("doc_id", "row"), "fingerprints")
    ids = rows.select("row", F.col(_at(docs, "doc_id")).cast("long").alias("doc_id"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    per_print = prints.join(ids, "row").groupBy("fp").agg(F.min(first).alias("first"))
    labelled = simhash.label(per_print).groupBy("root").agg(F.min("first").alias("first"))
    return _restored(rows.join(labelled.select(F.col("first.row").alias("row")), "row", "left_semi"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest whole document."""
    mixed = mixing.mix(_carried(docs, "doc_id", "text", "source"), keep=_places(docs))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return _restored(mixed.select("*", F.explode(copies).alias("copy")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequence and offset."""
    return packing.pack(packing.pieces(docs, tokens.public_path(), packing.CAPACITY, end_id=0), packing.CAPACITY)
