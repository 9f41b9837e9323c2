"""Writing graphs and documents, and reading session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A session event, one JSON object per line.
SESSION_SCHEMA = (
    "project string, kind string, toolName string, command string, files array<string>, tests array<string>, targetConfidence string, contextPackStatus string, staleWarning boolean"
)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Vertices by project, edges by type, as Parquet tables below a folder.

    Readers that name a project or a type read only its directories, and within a file the sorted keys give narrow
    statistics, which stand for the indexes of a store. A project that holds a large part of all rows is written by
    several tasks: rows are dealt by a hash of the key within a project, at most ``rows_per_file`` to a file. Null
    projects have a directory of their own. Empty tables are written as such.
    """
    n = nodes.withColumn("project", F.coalesce("project_context", F.lit("")))
    (
        n.repartition("project", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("project", "id")
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("project").parquet(f"{path.rstrip('/')}/nodes")
    )
    e = edges.withColumn("edge_type", F.col("type"))
    (
        e.repartition("edge_type", F.pmod(F.xxhash64("src"), F.lit(8))).sortWithinPartitions("edge_type", "src")
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("edge_type").parquet(f"{path.rstrip('/')}/edges")
    )


def read_graph(spark: SparkSession, path: str, project: str | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A written graph; a project or edge types prune the directories that are read."""
    n, e = spark.read.parquet(f"{path.rstrip('/')}/nodes"), spark.read.parquet(f"{path.rstrip('/')}/edges")
    if project is not None:
        n = n.where(F.col("project") == project)
    if types is not None:
        e = e.where(F.col("edge_type").isin(types))
    return n.drop("project"), e.drop("edge_type")


def checked(rows: DataFrame, required: list[str], allowed: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of an ingest: bad ones lack a required value or have one that is not allowed (in any letter
    case), and say which column is at fault first. The rows of a batch stand for themselves; none stops the others."""
    fault = F.lit(None).cast("string")
    for c, values in reversed(list((allowed or {}).items())):
        fault = F.when(F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin([v.lower() for v in values]), c).otherwise(fault)
    for c in reversed(required):
        fault = F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c).otherwise(fault)
    marked = rows.withColumn("fault", fault)
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null")


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, broken) of session files with one JSON object per line; blank lines are passed over, keys are read in
    any letter case, and a line that is no object is reported with its file and number of bytes."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file")).where("line != ''")
    parsed = lines.withColumn("e", F.from_json("line", SESSION_SCHEMA, {"mode": "PERMISSIVE", "allowTrailingComma": "true"}))
    empty = F.col("e").isNull() | (F.to_json("e") == "{}") & ~F.col("line").rlike(r"^\{\s*\}$")
    good = parsed.where(~empty).select(
        "e.project", "e.kind", F.col("e.toolName").alias("tool_name"), "e.command", F.coalesce("e.files", F.array().cast("array<string>")).alias("files"),
        F.coalesce("e.tests", F.array().cast("array<string>")).alias("tests"), F.col("e.targetConfidence").alias("target_confidence"),
        F.col("e.contextPackStatus").alias("context_pack_status"), F.coalesce("e.staleWarning", F.lit(False)).alias("stale_warning"),
    )
    return good, parsed.where(empty).select("file", F.length("line").alias("chars"))
