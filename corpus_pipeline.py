"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

Defined cases: documents with a null, empty or blank text leave at the first
stage; a null doc_id passes all stages; repeated rows are judged each and leave
one row at the near-duplicate stage, which keeps the smallest doc_id of a group
and one row of that; a long text is judged whole; an empty table gives an empty
result; extra columns, whatever their names, travel to the last stage. Tables
that stages and ``run`` write stay below the shared folder until
``pixelweave.plans.workspace.cleanup``, as the result reads from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import stages
from pixelweave.llm.common import materialise

STAGES = [
    ("language ID", stages.language_id),
    ("quality rules", stages.quality_rules),
    ("SimHash near-dedup", stages.near_duplicates),
    ("mixing sources to target weights", stages.mix),
    ("best-fit packing", stages.pack),
]

#: SQL has neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
