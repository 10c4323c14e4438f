"""Documents to packed training sequences: five stages, each written as Parquet and read again by the next one.

Decisions come to the texts as bitmaps by chunk, so no stage exchanges a text. A stage's scratch tables are removed when the next
one begins and reads what was written of it: one pipeline at a time in a session.

Stages keep the columns of their input (the last returns packed pieces), take nulls, empty and repeated rows as
their operators say, and give no rows for no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import langid, mix, pack, quality, simhash
from siftmill.llm.common import bit, bitmaps, decided, laid_out, next_stage, numbered, remove, shared_dir, shielded, table, written
from siftmill.llm.queries import tokenizer_path

#: Documents whose language is less likely than this, or that have none, go.
LEAST_LANGUAGE_SCORE = 0.5
#: Pre-tokens in a generation of a worker's memory: fewer than alone, as executors still hold what the stages before took.
REMEMBERED = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    next_stage(docs, spark)
    return quality.assess(docs, whole=True).filter("_kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones teach: no less likely than LEAST_LANGUAGE_SCORE beside the others, and
    with n-grams as usual in it; ``lang`` stays as given."""
    next_stage(docs, spark)
    own, restored = shielded(docs, ("doc_id", "text", "lang"))
    found = langid.judged(own).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & (F.col("fit") >= F.col("least_fit")))
    return found.select(*restored)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, of repeated rows one."""
    next_stage(docs, spark)
    own, restored = shielded(docs, ("doc_id", "text"))
    rows = laid_out(numbered(own), "_chunk", "numbered")
    found = simhash.near_duplicates(rows, carry=("_chunk", "_pos"))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("_row", F.col("_chunk") * 32_768 + F.col("_pos"))
    stay = first.groupBy("root").agg(F.min("_row").alias("_row")).select(F.expr("_row div 32768").alias("_chunk"), (F.col("_row") % 32_768).alias("_pos"))
    maps = written(bitmaps(stay, _stays=F.lit(True)), "stay")
    return decided(rows, maps).filter(bit(F.col("_stays"), F.col("_pos"))).select(*restored)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    next_stage(docs, spark)
    return mix.mix(docs, whole=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, placed in sequences of 1024."""
    next_stage(docs, spark)
    return pack.pack(docs, tokenizer_path(), end_id=0, max_len=1024, remember=REMEMBERED)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Estimates, models and tokenizers cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    next_stage(None, spark)
    return docs
