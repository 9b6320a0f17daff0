"""The order that the mixing stage makes is what the pipeline returns."""

import pytest
from pyspark.sql import functions as F

from lexispark.llm import pfair
from lexispark.session import settle, with_place


@pytest.fixture()
def many_files(spark):
    """Readers pack small splits and order them by size; each range partition stays a file of its own."""
    settings = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k",
                "spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _docs(spark):
    return spark.createDataFrame(
        [(i, "word " * (1 + i * 7 % 90) + str(i), "en", f"s{min(i % 10, 4)}", 5) for i in range(1500)],
        "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stored", [True, False])
def test_positions_are_those_of_the_mix(many_files, stored):
    import corpus_pipeline as pipeline

    docs = _docs(many_files)
    mixed = pipeline.source_mix(many_files, docs, "")
    if stored:
        mixed = settle(mixed)
        assert len(mixed.inputFiles()) > 5
    got = {r.doc_id: r.position for r in pipeline.byte_bpe(many_files, mixed, "").collect()}
    assert got == {r.doc_id: r.position for r in pfair.mix_sources(docs).collect()}


def test_place_of_stored_rows(many_files, tmp_path):
    """Several files of one task, shard numbers of unequal width, and a table without rows."""
    many_files.range(1000, numPartitions=7).write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/t")
    got = with_place(many_files.read.parquet(f"{tmp_path}/t"), "at").collect()
    assert len(got) == 1000 and all(r.at == r.id + 1 for r in got)
    assert with_place(settle(many_files.range(0)), "at").count() == 0
    moved = with_place(settle(many_files.range(50, numPartitions=4)).where("id % 2 = 0").select(F.col("id")), "at").collect()
    assert sorted(r["at"] for r in moved) == list(range(1, 26))
