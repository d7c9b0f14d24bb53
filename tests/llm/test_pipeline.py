"""The pipeline's stages, one after another, on the smallest tables and on odd rows."""

import pytest

from tests.llm.common import ODD, frame, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = docs.cache()
        sizes.append(docs.count())
    assert n >= sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0 and sizes[1] < n
    texts = [r["text"] for r in docs.collect()]
    assert any("<EMAIL>" in t or "<IP>" in t for t in texts) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_run_packs_what_is_left(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    first = out.groupBy("sequence_id").sum("length").collect()
    assert all(r["sum(length)"] <= 2048 for r in first)


def test_odd_rows_pass_through(spark, sf_dir):
    docs = frame(spark, [*ODD, prose(1, 80, 3000), prose(2, 80, 3000)]).withColumnRenamed("rejected", "component_id")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == len(ODD) + 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(ODD) + 2
    kept = corpus_pipeline.STAGES[0][1](spark, frame(spark, [None, "", "Les mots et le texte", "123"]), sf_dir)
    assert [r["text"] for r in kept.collect()] == ["Les mots et le texte"]


def test_near_copies_below_nine_tenths_go(spark, sf_dir):
    """Documents of 400 words with 7 changed: 0.84 on 5-word shingles, 0.898 on 3-word ones."""
    text = prose(7, 400, 3000).split()
    near = [f"new{i}" if i % 55 == 20 else w for i, w in enumerate(text)]
    docs = frame(spark, [" ".join(text), " ".join(near), prose(8, 400, 3000)])
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["distinct"](spark, docs, sf_dir).collect()) == [0, 2]


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """2000 rows of long texts in one batch took an executor's memory."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tidelog.llm import shared

    def rows(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    texts = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    with shared.scratch(spark):
        sizes = [r["n"] for r in shared.settle(texts.mapInArrow(rows, "n long")).collect()]
    assert sum(sizes) == 48 and max(sizes) < 24
