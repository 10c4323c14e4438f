"""Incremental scans: new or changed files land in a table and are scanned as they arrive.

A file is known by project and path. Beside the findings, each micro-batch writes one slim row per file that it scanned, with
the digest of its text: the file's version. A file whose text is the one that was scanned last costs a join of digests and
nothing else; a changed one is scanned, and its new version hides all findings of earlier ones. Nothing that is stored
is ever rewritten; ``compact`` folds the versions of a long stream into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from siftmill.operators.catalog import rule_catalog
from siftmill.operators.line_rules import text_rule_hits
from siftmill.plans import findings
from siftmill.plans.scan import facts_of, file_hits
from siftmill.schemas import ISSUES
from siftmill.session import materialize, scratch
from siftmill.sources.layout import lay_out

_VERSIONS = "project_id string, path string, digest string, batch bigint"


def stream_text_hits(files: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """Text rules keep no state, so the batch plan is the streaming plan."""
    return text_rule_hits(files, rule_ids, snippets=True)


def start_text_scan(files: DataFrame, target: str, checkpoint: str, rule_ids: list[str] | None = None) -> StreamingQuery:
    """Append text hits of all files that have landed, then stop (``availableNow``)."""
    return (
        stream_text_hits(files, rule_ids).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def _digest() -> Column:
    """Digest of a text; NULL for a NULL text, which says that the file is gone."""
    return F.sha2("text", 256)


def versions(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The last version of every file (of batches before the given one): (project_id, path, digest, batch)."""
    try:
        rows = spark.read.schema(_VERSIONS).parquet(f"{target}/versions")
    except AnalysisException:  # the first batch
        rows = spark.createDataFrame([], _VERSIONS)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    newest = rows.groupBy("project_id", "path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["project_id", "path", "batch"]).select("project_id", "path", "digest", "batch")


def _changed(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a micro-batch whose text isn't the one scanned last; of a file that landed several times the newest text."""
    order = [F.col("modified").desc_nulls_last()] if "modified" in batch.columns else []
    newest = F.row_number().over(Window.partitionBy("project_id", "path").orderBy(*order, "digest"))
    marked = lay_out(batch.withColumn("digest", _digest())).withColumn("_n", newest).filter("_n = 1").drop("_n")
    last = known.select("project_id", "path", F.col("digest").alias("known"), F.lit(True).alias("met"))
    return marked.join(last, ["project_id", "path"], "left").filter(F.col("met").isNull() | ~F.col("digest").eqNullSafe(F.col("known"))).drop("known", "met")


def start_full_scan(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """All single-file kinds over the files that are new or changed, one micro-batch after the other.

    A batch is written under its own number, the versions last: a batch that runs again after a failure replaces its own
    output, and no finding is read whose version isn't there. A column ``modified`` orders texts of one file that land together.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            files = _changed(batch, versions(spark, target, number))
            hits = materialize(file_hits(files, facts_of(files)), "hits")
            issues = findings.to_issues(hits, rule_catalog(spark), f"stream-{number}", F.current_timestamp())
            issues.write.mode("overwrite").parquet(f"{target}/issues/batch={number}")
            files.select("project_id", "path", "digest").write.mode("overwrite").parquet(f"{target}/versions/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_issues(spark: SparkSession, target: str) -> DataFrame:
    """Findings of the last version of every file."""
    rows = spark.read.schema(f"{ISSUES}, batch bigint").parquet(f"{target}/issues")
    last = versions(spark, target).filter("digest is not null").select("project_id", F.col("path").alias("file"), "batch")
    return rows.join(last, ["project_id", "file", "batch"]).drop("batch")


def compact(spark: SparkSession, target: str, into: str) -> None:
    """Write the current findings and versions to a new folder, as its first batch; the stream goes on there with its checkpoint.

    Files that are gone leave no version. Earlier batches would count as replayed there, so this is for streams at rest.
    """
    last = versions(spark, target).filter("digest is not null")
    number = last.agg(F.max("batch")).first()[0] or 0
    current_issues(spark, target).write.mode("overwrite").parquet(f"{into}/issues/batch={number}")
    last.drop("batch").write.mode("overwrite").parquet(f"{into}/versions/batch={number}")
