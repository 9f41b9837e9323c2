"""Keyed changes of stored tables: upserts, deletes and incremental plans, as joins of old and new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import in_force


def upsert_nodes(old: DataFrame, new: DataFrame, now: Column, columns: list[str]) -> DataFrame:
    """The node table after an ingest: ``id``, the columns, ``source_hash``, ``created_at``, ``updated_at``,
    ``last_indexed_at`` and ``change_count``.

    Content has changed if either hash is missing or they differ; only then ``updated_at`` moves and
    ``change_count`` grows. A new id counts one change. Of several new rows of an id the last (``ingest_no``)
    counts. Rows with a null id are left out.
    """
    fresh = in_force(new, [*columns, "source_hash"], newest=("ingest_no",))
    o = old.select("id", *[F.col(c).alias(f"o_{c}") for c in [*columns, "source_hash", "created_at", "updated_at", "last_indexed_at", "change_count"]])
    n = fresh.withColumn("is_new", F.lit(True))
    j = o.join(n, "id", "full")
    came, was = F.coalesce("is_new", F.lit(False)), F.col("o_created_at").isNotNull()
    changed = came & (F.col("source_hash").isNull() | F.col("o_source_hash").isNull() | (F.col("source_hash") != F.col("o_source_hash")))
    return j.select(
        "id", *[F.when(came, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in [*columns, "source_hash"]],
        F.when(was, F.col("o_created_at")).otherwise(now).alias("created_at"),
        F.when(changed | ~was, now).otherwise(F.col("o_updated_at")).alias("updated_at"),
        F.when(came, now).otherwise(F.col("o_last_indexed_at")).alias("last_indexed_at"),
        (F.coalesce("o_change_count", F.lit(0)) + F.when(changed, 1).otherwise(0)).cast("long").alias("change_count"),
    )


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by (src, type, dst), new ones replacing old; new edges with a missing end are skipped."""
    ids = nodes.select("id")
    ok = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = ok.groupBy("src", "type", "dst").agg(F.max_by("confidence", "edge_no").alias("confidence"))
    kept = old.select("src", "type", "dst", "confidence").join(last, ["src", "type", "dst"], "left_anti")
    return kept.unionByName(last)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids of ``gone`` and the edges at them."""
    g = gone.select("id").distinct()
    left = edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(g, "id", "left_anti"), left


def delete_project(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes, edges, nodes.where(F.lower("project_context") == project.strip().lower()))


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of the given file paths, compared in any letter case."""
    low = paths.select(F.lower("path").alias("low")).distinct()
    return delete_nodes(nodes, edges, nodes.withColumn("low", F.lower("file_path")).join(low, "low", "left_semi"))


def delete_kinds(nodes: DataFrame, edges: DataFrame, types: list[str], project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of some types (diagnostics, configuration), of one project if named, and without the
    configuration keys that nothing is linked with any more once configuration goes."""
    gone = nodes.where(F.col("type").isin(types))
    if project is not None:
        gone = gone.where(F.lower("project_context") == project.strip().lower())
    n, e = delete_nodes(nodes, edges, gone)
    if "ConfigurationEntry" in types and "ConfigurationKey" not in types:
        used = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        n, e = delete_nodes(n, e, n.where("type = 'ConfigurationKey'").join(used, "id", "left_anti"))
    return n, e


def delete_all(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.limit(0), edges.limit(0)


def delete_batches(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without the wanted ids, and how many of each type went: ``type, deleted``. The batch is one
    set however large, joined away at once; ids that are unknown or given twice count nothing."""
    hit = nodes.join(gone.select("id").distinct(), "id", "left_semi")
    n, e = delete_nodes(nodes, edges, gone)
    return n, e, hit.groupBy("type").agg(F.count("*").alias("deleted"))


def incremental_plan(before: DataFrame, now: DataFrame, force: bool = False) -> DataFrame:
    """``path, action``: changed or deleted files from ``path, hash`` of both states; equal ones are left out.

    With ``force``, or if nothing is known from before, all present files are changed and none is deleted.
    """
    a = before.select(F.lower("path").alias("key"), F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    b = now.select(F.lower("path").alias("key"), "path", "hash")
    if force or before.isEmpty():
        return b.select("path", F.lit("changed").alias("action"))
    j = a.join(b, "key", "full")
    action = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull() | ~F.col("hash").eqNullSafe(F.col("old_hash")), "changed")
    return j.select(F.coalesce("path", "old_path").alias("path"), action.alias("action")).where("action is not null")


def replace_keywords(has: DataFrame, new: DataFrame) -> DataFrame:
    """Keyword rows with those of each newly extracted record replaced."""
    return has.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def save_classes(classes: DataFrame, new: DataFrame) -> DataFrame:
    """Stored keyword classes updated by keyword."""
    return classes.join(new.select("keyword"), "keyword", "left_anti").unionByName(new)


def unchanged_texts(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids whose keyword text has the stored checksum: SHA-256 of ``source:text`` lines in the order of sources."""
    line = F.concat(F.col("source"), F.lit(":"), F.col("text"), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", line.alias("line")))), lambda x: x["line"]), "")
    return sources.groupBy("id").agg(F.sha2(text, 256).alias("checksum")).join(stored, ["id", "checksum"], "left_semi").select("id")


def add_contexts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Change contexts are written once: rows whose id is known are left out."""
    one = new.groupBy("id").agg(F.min(F.struct(*[c for c in new.columns if c != "id"])).alias("r")).select("id", "r.*")
    return stored.unionByName(one.join(stored.select("id"), "id", "left_anti"))


def context_status(contexts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, status`` of change contexts against the node they are about."""
    n = nodes.select(F.col("id").alias("node_id"), F.col("source_hash").alias("hash_now"), F.lit(True).alias("there"))
    return contexts.join(n, "node_id", "left").select(
        "id",
        F.when(F.col("there").isNull(), "orphaned").when(F.col("hash_then").isNull() | F.col("hash_now").isNull(), "hash-unknown")
        .when(F.col("hash_then") == F.col("hash_now"), "graph-unchanged").otherwise("target-changed").alias("status"),
    )


def merge_partial_types(nodes: DataFrame) -> DataFrame:
    """Several rows of one id as one: first file, all lines, longest summary."""
    return nodes.where("id is not null").groupBy("id").agg(
        F.min("file_path").alias("file_path"), F.sum("line_count").alias("line_count"), F.min("line_number").alias("line_number"),
        F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("summary"), F.count("*").alias("parts"),
    )


def external_link(nodes: DataFrame, edges: DataFrame, node_id: str, concept: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """A concept node and a Uses edge to it, if the node exists and they do not yet."""
    cid = f"ExternalConcept:{concept}"
    known = nodes.where(F.col("id") == node_id).select(F.lit(cid).alias("id"), F.lit(concept).alias("name"), F.lit("ExternalConcept").alias("type"), F.lit(kind).alias("external_kind"))
    more_n = known.join(nodes.select("id"), "id", "left_anti")
    link = known.select(F.lit(node_id).alias("src"), F.col("id").alias("dst"), F.lit("Uses").alias("type"), F.lit(1.0).alias("confidence"))
    return nodes.unionByName(more_n, allowMissingColumns=True), edges.unionByName(link.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti"), allowMissingColumns=True)
