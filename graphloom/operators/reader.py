"""The generic read model: validated filters, sorting and paging over nodes and relationships."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_DEPTH = 100, 3
SORT_FIELDS = {"id": "id", "name": "name", "type": "type", "filePath": "file_path", "lineCount": "line_count", "updatedAt": "updated_at"}


def property_name(name: str) -> str:
    """The name, if it is a plain identifier."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a property name: {name!r}")
    return name


def page(df: DataFrame, skip: int, limit: int) -> DataFrame:
    """Rows after ``skip``, at most ``limit`` and never more than MOST_ROWS."""
    if skip < 0 or limit <= 0:
        raise ValueError("skip must not be negative and limit must be positive")
    return df.offset(skip).limit(min(limit, MOST_ROWS))


def depth_of(depth: int) -> int:
    if depth <= 0:
        raise ValueError("depth must be positive")
    return min(depth, MOST_DEPTH)


def order_by(field_name: str | None, descending: bool = False) -> list[Column]:
    """Columns to sort by, the id last; unknown fields are an error."""
    if field_name is None:
        return [F.asc("id")]
    if field_name not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {field_name!r}")
    c = SORT_FIELDS[field_name]
    return [F.desc_nulls_first(c) if descending else F.asc_nulls_last(c), F.asc("id")]


@dataclass
class NodeFilter:
    labels: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    project: str | None = None
    equals: dict[str, str] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    keyword: str | None = None


def nodes(df: DataFrame, f: NodeFilter, sort: str | None = None, descending: bool = False, skip: int = 0, limit: int = 100, has_keyword: DataFrame | None = None) -> DataFrame:
    """A page of nodes. Filters that are not given are no predicates, so the others reach the scan."""
    if f.labels:
        df = df.where(F.col("type").isin(f.labels))
    if f.ids:
        df = df.where(F.col("id").isin(f.ids))
    if (f.project or "").strip():
        df = df.where(F.lower("project_context") == f.project.strip().lower())
    for k, v in f.equals.items():
        df = df.where(F.col(property_name(k)).cast("string") == v)
    for k, v in f.contains.items():
        df = df.where(F.contains(F.lower(F.col(property_name(k)).cast("string")), F.lit(v.lower())))
    if f.keyword and has_keyword is not None:
        df = df.join(has_keyword.where(F.col("keyword") == f.keyword.lower()).select("id").distinct(), "id", "left_semi")
    return page(df.orderBy(*order_by(sort, descending)), skip, limit)


def relationships(edges: DataFrame, node_df: DataFrame, types: list[str] | None = None, src: str | None = None, dst: str | None = None, project: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of edges, a project matching either end."""
    df = edges
    if types:
        df = df.where(F.col("type").isin(types))
    if src:
        df = df.where(F.col("src") == src)
    if dst:
        df = df.where(F.col("dst") == dst)
    if (project or "").strip():
        mine = node_df.where(F.lower("project_context") == project.strip().lower()).select("id")
        a = df.join(mine.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "type")
        b = df.join(mine.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")
        df = a.unionByName(b).distinct()
    return page(df.select("src", "dst", "type").orderBy("src", "type", "dst"), skip, limit)


def labels(df: DataFrame) -> DataFrame:
    return df.where("type is not null").select("type").distinct()


def node(df: DataFrame, node_id: str) -> DataFrame:
    return df.where(F.col("id") == node_id)


RESERVED = ["id", "name", "type", "embedding"]


def property_rows(df: DataFrame, most: int = 64) -> DataFrame:
    """``id, key, value, kind``: properties of each node by key, reserved ones left out, at most ``most``."""
    entries = F.slice(F.array_sort(F.map_entries(F.map_filter("properties", lambda k, v: ~k.isin(RESERVED)))), 1, most)
    v = F.col("e.value")
    kind = (
        F.when(v.isNull(), "Null").when(F.lower(v).isin("true", "false"), "Boolean").when(v.rlike("^-?[0-9]{1,18}$"), "Integer")
        .when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), "Float").otherwise("String")
    )
    return df.select("id", F.explode(entries).alias("e")).select("id", F.col("e.key").alias("key"), v.alias("value"), kind.alias("kind"))
