"""From documents to training sequences: the stages, in order, each on all that its
predecessor kept. Stages are written as Parquet in between, so a lost executor or a
failed stage costs that stage only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowforge.llm import language, mixing, neardup, packing, quality
from rowforge.llm.common import read
from rowforge.session import configure, durable

#: Per cent of the union that near duplicates share in the pipeline.
NEAR = 80

#: What the stages need beside the defaults: an executor runs them one after the other, so
#: what scans and Python workers of one stage hold on to is missing in the next. Texts go
#: through scans by hundreds and to Python by a few megabytes, not by thousands of rows.
LEAN_CONF = {
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """Puts the settings of the stages on the session."""
    configure(spark)
    for key, value in LEAN_CONF.items():
        spark.conf.set(key, value)
    return spark


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ready(spark)
    return quality.drop_low_quality(docs)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents close to a language, learned from those that carry one."""
    ready(spark)
    return language.drop_rejected(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    ready(spark)
    return neardup.drop_near_duplicates(docs, threshold=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    ready(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in the training sequences."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids cannot be had in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
