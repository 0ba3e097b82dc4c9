"""The pipeline's stages, each against what it must do to its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from rowforge.llm import mixing, quality

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stages(spark, docs):
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], DIR).cache())
    return frames


def test_stages_are_those_agreed():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "near-duplicates", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first, judged, spoken, single, mixed, packed = stages(spark, docs)
    for frame in (judged, spoken, single, mixed):
        assert frame.columns == docs.columns
    ids = [[r["doc_id"] for r in f.select("doc_id").collect()] for f in (first, judged, spoken, single, mixed, packed)]
    kept = {r["doc_id"] for r in quality.quality(docs).where("q.kept").select("row.doc_id").collect()}
    assert sorted(ids[1]) == sorted(kept) and 0 < len(ids[1]) < len(ids[0])
    assert set(ids[2]) <= set(ids[1]) and len(ids[2]) > 0.95 * len(ids[1])
    assert set(ids[3]) <= set(ids[2]) and len(set(ids[3])) == len(ids[3])

    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert sorted(ids[4]) == sorted(i for i, n in copies.items() for _ in range(n))
    words = sum(len(WORD.findall(t or "")) for t in texts.values())
    taken = sum(len(WORD.findall(texts[i] or "")) for i in ids[4])
    assert 0.9 * 1.5 * words <= taken <= 1.5 * words

    places = {}
    for r in packed.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in packed.where("piece = 0").collect()) == sorted(ids[4])
    for some in places.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 2048
    for frame in (judged, spoken, single, mixed, packed):
        frame.unpersist()


def test_near_duplicates_agree_with_brute_force(spark):
    """One document of each group of 0.8 or more, also between 0.80 and 0.85."""
    rng = random.Random(6)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 6, 8):
            copy = list(words)
            for at in rng.sample(range(200), edits):
                copy[at] = f"x{base}-{edits}-{at}"
            rows.append(" ".join(copy))
    split = [t.split() for t in rows]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in split]
    group, between = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            between += 80 * union <= 100 * shared < 85 * union
            if 100 * shared >= 80 * union:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert between > 20
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))


def test_run_gives_the_rows_of_the_stages(spark):
    got = corpus_pipeline.run(spark, DIR)
    again = corpus_pipeline.run(spark, DIR)
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"], r["length"])
    assert sorted(map(key, got.collect())) == sorted(map(key, again.collect()))


def test_odd_rows_and_other_columns(spark):
    text = " ".join(f"the{i} of word{i} and thing{i} in the town" for i in range(40))
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "y"), (None, text.upper(), "en", None, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    frames = stages(spark, docs)
    assert [f.columns for f in frames[:5]] == [docs.columns] * 5
    assert [(r["doc_id"], r["row"]) for r in frames[3].collect()] == [(1, "x")]
    empty = stages(spark, docs.limit(0))
    assert [f.count() for f in empty] == [0] * 6


def test_texts_go_to_python_by_a_few_megabytes(spark):
    """Every stage sees to it, as each may be the first one of a session."""
    text = F.repeat(F.lit("abcd "), 1000)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    few = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        for key in corpus_pipeline.LEAN_CONF:
            spark.conf.unset(key)
        stage(spark, few, DIR)
        most = docs.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]
        assert most < 5_000_000
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256


def test_near_duplicates_move_texts_once(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "g h i j k l", 2), (None, "m n o p q r", 3), (None, "m n o p q r", 3), (2, None, 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = [r["n"] for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    # nothing is dealt anew between the join with the kept ids and the choice among equal rows
    assert "Exchange" not in plan[: plan.index("LeftSemi")]
    assert sorted(found) == [1, 2, 3, 4, 5]
