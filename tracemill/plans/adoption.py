"""Which advice was taken: findings that instruction files have silenced since they were surfaced.

Receipts are a table of a folder a run (run, finding_id, kind, marker_heading, content_fingerprint): SURFACED
when a finding was shown, SUPPRESSED when it was first seen to be silenced by its markers. A run reads the
receipts of earlier runs only and replaces its own folder, so a run that is done again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import settings
from .rules import Signals, evaluate

RECEIPT = "finding_id string, kind string, marker_heading string, content_fingerprint string, run long"


def receipts(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """The receipts of all runs before a run; none where nothing was written yet."""
    empty = spark.createDataFrame([], RECEIPT)
    found = [f"{folder}/run={n}" for n in _runs(spark, folder) if n < before]
    return spark.read.option("basePath", folder).schema(RECEIPT).parquet(*found) if found else empty


def _runs(spark: SparkSession, folder: str) -> list[int]:
    """The runs that have a folder, by the folder's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))


def transitions(findings: DataFrame, live_config: DataFrame, prior: DataFrame) -> DataFrame:
    """finding_id, kind, marker_heading and content_fingerprint of the findings that instruction files silence now.

    findings: id of all that the rules say before any setting silences them. kind is SUPPRESSED for one that was
    surfaced since it was last suppressed, and ORGANIC for one that never was surfaced; what is suppressed already
    gives nothing.
    """
    ids = findings.select(F.col("id").alias("finding_id")).distinct()
    by_setting = settings.answered(live_config.filter(F.col("key") != settings.INSTRUCTIONS)).withColumnRenamed("id", "finding_id")
    by_any = settings.answered(live_config).withColumnRenamed("id", "finding_id")
    silenced = ids.join(by_any, "finding_id", "left_semi").join(by_setting, "finding_id", "left_anti")
    last = prior.groupBy("finding_id").agg(F.max_by("kind", F.struct("run", (F.col("kind") == "SUPPRESSED"))).alias("last"), F.count_if(F.col("kind") == "SURFACED").alias("shown"))
    texts = live_config.filter(F.col("key") == settings.INSTRUCTIONS)
    merged = texts.agg(F.array_join(F.array_sort(F.collect_list("value")), "\n\n").alias("text"))  # a few files
    marks = live_config.sparkSession.createDataFrame([(i, f"(?i){h}") for i, h, _ in settings.MARKERS], "finding_id string, heading string")
    lines = merged.select(F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).filter(F.col("line").rlike(r"^#{1,6}\s+"))
    named = lines.crossJoin(F.broadcast(marks)).filter(F.expr("line RLIKE heading")).groupBy("finding_id").agg(F.min_by("line", "n").alias("line"))  # headings by a few dozen marks
    rows = silenced.join(last, "finding_id", "left").filter("last IS NULL OR last <> 'SUPPRESSED'").join(named, "finding_id", "left").crossJoin(F.broadcast(merged))
    kind = F.when(F.coalesce("shown", F.lit(0)) > 0, "SUPPRESSED").otherwise("ORGANIC")
    return rows.select("finding_id", kind.alias("kind"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("marker_heading"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_fingerprint"))


def record(s: Signals, folder: str, run: int) -> DataFrame:
    """Evaluate the rules once, write the run's receipts below folder, and return its transitions.

    What the rules say and no setting silences is surfaced; a finding that is not surfaced yet gets no
    suppression from a run's own rows.
    """
    spark = next(iter(s.tables.values())).sparkSession
    bare = Signals(s.now, {k: v for k, v in s.tables.items() if k != "live_config"}, s.features)
    found = evaluate(bare.prepared())
    config = s.live_config if s.has("live_config") else spark.createDataFrame([], "key string, value string")
    moved = transitions(found, config, receipts(spark, folder, run))
    shown = found.select(F.col("id").alias("finding_id")).distinct().join(settings.answered(config).withColumnRenamed("id", "finding_id"), "finding_id", "left_anti")
    none = F.lit(None).cast("string")
    rows = shown.select("finding_id", F.lit("SURFACED").alias("kind"), none.alias("marker_heading"), none.alias("content_fingerprint")).unionByName(moved.filter("kind = 'SUPPRESSED'"))
    rows.write.mode("overwrite").parquet(f"{folder}/run={run}")
    return moved
