"""Configuration: files flattened to keys, definitions and usages of keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import config_key, mask_value


def flatten_json(value, prefix: str = "") -> list[tuple[str, str]]:
    """(path, text) of each leaf; parts of a path are joined by colons, list items by number."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flatten_json(v, f"{prefix}:{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flatten_json(v, f"{prefix}:{i}" if prefix else str(i))]
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return [(prefix, text)]


def flatten_yaml(text: str) -> list[tuple[str, str]]:
    """Leaves of plain block YAML: maps, lists and scalars by indentation; ``KEY=VALUE`` items are split."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[int, str]] = []
    counters: dict[str, int] = {}
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip())
        body = line.strip()
        item = body.startswith("- ") or body == "-"
        while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not (item and not stack[-1][1].isdigit()))):
            stack.pop()
        parent = ":".join(k for _, k in stack)
        if item:
            n = counters.get(parent, 0)
            counters[parent] = n + 1
            body = body[1:].strip()
            if "=" in body and ":" not in body.split("=")[0]:
                k, v = body.split("=", 1)
                out.append((f"{parent}:{k}" if parent else k, v.strip("\"'")))
                continue
            if not body or (": " in body or body.endswith(":")):
                stack.append((indent, str(n)))
                parent = ":".join(k for _, k in stack)
                indent += 2
                if not body:
                    continue
            else:
                out.append((f"{parent}:{n}" if parent else str(n), body.strip("\"'")))
                continue
        key, _, value = body.partition(":")
        key, value = key.strip("\"' "), value.strip()
        if value:
            out.append((f"{parent}:{key}" if parent else key, value.strip("\"'")))
        else:
            stack.append((indent, key))
    return out


def flatten_env(text: str) -> list[tuple[str, str]]:
    rows = []
    for line in text.splitlines():
        s = line.strip()
        if s and not s.startswith("#") and "=" in s:
            k, v = s.removeprefix("export ").split("=", 1)
            rows.append((k.strip(), v.strip().strip("\"'")))
    return rows


def flatten_file(path: str, text: str) -> list[tuple[str, str]]:
    """Leaves of a configuration file by its ending; none if it cannot be read."""
    low = path.lower()
    try:
        if low.endswith(".json"):
            return flatten_json(json.loads(text))
        if low.endswith((".yml", ".yaml")):
            return flatten_yaml(text)
        if low.endswith(".env") or "/.env" in "/" + low:
            return flatten_env(text)
    except ValueError:
        return []
    return []


def settings(files: DataFrame) -> DataFrame:
    """``path, raw_key, key, preview`` of every entry of the files ``path, content``; secrets are masked."""
    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, k, v) for p, t in zip(f["path"], f["content"]) if p and t for k, v in flatten_file(p, t)]
            yield pd.DataFrame(rows, columns=["path", "raw_key", "value"])

    e = files.select("path", "content").mapInPandas(flat, "path string, raw_key string, value string").withColumn("key", config_key(F.col("raw_key")))
    return e.select("path", "raw_key", "key", mask_value(F.col("key"), F.col("value")).alias("preview"))


def definitions(nodes: DataFrame, edges: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """Files and entries that define or override a key."""
    t = lambda kind, c: nodes.where(F.col("type") == kind).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.col("file_path").alias(f"{c}_path"))
    k = t("ConfigurationKey", "key").where(F.lower("key_name") == key.strip().lower())
    e1 = edges.where(F.col("type").isin("DefinesConfig", "OverridesConfig")).select(F.col("src").alias("entry"), F.col("dst").alias("key"), F.col("type").alias("relation"))
    e2 = edges.where("type = 'DefinesConfig'").select(F.col("src").alias("file"), F.col("dst").alias("entry"))
    return (
        e1.join(k, "key").join(t("ConfigurationEntry", "entry"), "entry").join(e2, "entry").join(t("ConfigurationFile", "file"), "file")
        .orderBy("file_path", "entry_name", "entry").select("file", "entry", "key", "relation").limit(limit)
    )


def usages(nodes: DataFrame, edges: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """Consumers of a key; bindings of a parent section count with at most 0.75 confidence."""
    parts = [p.strip() for p in key.split(":") if p.strip()]
    sections = [":".join(parts[:i]).lower() for i in range(1, len(parts))]
    low = key.strip().lower()
    k = nodes.where("type = 'ConfigurationKey'").select(F.col("id").alias("dst"), F.lower("name").alias("k"))
    e = edges.where(F.col("type").isin("ReadsConfig", "BindsConfig")).join(k, "dst")
    hit = (F.col("k") == low) | ((F.col("type") == "BindsConfig") & F.col("k").isin(sections) if sections else F.lit(False))
    c = F.when(F.col("k") == low, F.col("confidence")).otherwise(F.least(F.coalesce("confidence", F.lit(0.75)), F.lit(0.75)))
    n = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("p"), F.col("line_number").alias("l"), F.col("name").alias("n"))
    return e.where(hit).join(n, "src").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "p", "l", "n", "src").select("src", "dst", "type", c.alias("confidence")).limit(limit)
