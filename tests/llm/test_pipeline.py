"""The pipeline's stages: each against a plain version over the same rows."""

from collections import Counter

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import awkward, brute_components, brute_fingerprint, brute_statistics, check_sequences, small_tables

from pixelweave.llm import stages


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = stages.language_id(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert not multiset(kept) - multiset(docs)
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.count() >= 0.98 * lettered

    good = stages.quality_rules(spark, docs, DATA)
    want = [r for r in docs.collect() for n, _, _, _, repeats in [brute_statistics(r["text"])] if n >= 20 and 100 * repeats <= 30 * n]
    assert good.columns == docs.columns and not multiset(good) - Counter(tuple(r) for r in want)
    assert good.count() >= 0.95 * len(want)

    single = stages.near_duplicates(spark, docs, DATA)
    rows = docs.orderBy("doc_id").collect()
    roots = brute_components([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows])
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(roots))

    mixed = stages.mix(spark, docs, DATA)
    assert mixed.columns == docs.columns and not set(multiset(mixed)) - set(multiset(docs)) and max(multiset(mixed).values()) <= 2


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    docs = awkward(spark)
    folder = small_tables(spark, tmp_path, docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    twice = stages.near_duplicates(spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in twice)[1] == 1


def test_columns_of_any_name_pass_every_stage(spark, tmp_path):
    """Dots, blanks, names that stages use themselves, and the same name in another case."""
    docs = awkward(spark)
    folder = small_tables(spark, tmp_path, docs)
    names = ["a.b", "row_number_", "row", "kept_0", "kept_doc_id", "copy", "TEXT", "column 1", "deal", "mark", "score", "fp", "", "`"]
    wide = docs.toDF("doc_id", "text", "lang", "source", *names[:5]).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names[5:])])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, wide, folder), stage(spark, docs, folder)
        assert got.columns == wide.columns, name
        ids = lambda df: Counter(tuple(r)[:4] for r in df.collect())
        assert ids(got) == ids(plain), name
        assert not set(map(tuple, got.collect())) - set(map(tuple, wide.collect())), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA).toPandas()
    check_sequences(got)
    assert len(got) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
