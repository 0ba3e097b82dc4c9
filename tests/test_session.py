"""Scratch tables and the runs kept for a folder."""

from __future__ import annotations

import os
import shutil

from rowforge import session
from rowforge.llm.components import connected_components
from rowforge.session import durable_narrow
from rowforge.sources.files import file_state


def test_scratch_tables_go_when_their_block_ends(spark, tmp_path):
    outer = session.durable(spark.range(3))
    other = tmp_path / "not_ours"
    other.mkdir()
    with session.scratch(spark):
        inner = session.durable(outer.withColumn("x", outer["id"] + 1))
        folder = inner.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("///", "/")
        assert inner.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder) and other.exists()
    assert outer.count() == 3


def test_clean_up_forgets_what_it_removed(spark):
    held = len(session._SCRATCH[spark.sparkContext.applicationId])
    path = session.scratch_path(spark, "never-written")
    assert session.clean_up(spark, held) == 1
    assert path not in session._SCRATCH[spark.sparkContext.applicationId]
    assert session.clean_up(spark, held) == 0


def test_file_state_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    first = file_state(spark, path)
    assert first and file_state(spark, path) == first
    shutil.rmtree(path)
    spark.range(6).write.parquet(path)
    assert file_state(spark, path) != first
    assert file_state(spark, str(tmp_path / "absent")) == ()


def test_narrow_steps_write_few_files(spark):
    """However many partitions a shuffle has, and with every row in one of them."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        edges = spark.range(0, 4000, 2).selectExpr("id + 1 u", "id v")
        for found in (durable_narrow(edges.distinct()), connected_components(edges)):
            assert 8 <= len(found.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, found.collect())) == sorted((i, i - i % 2) for i in range(4000))
        assert durable_narrow(edges.limit(0)).collect() == []
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
