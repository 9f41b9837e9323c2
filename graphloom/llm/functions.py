"""Pairs of code and description from function rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versions import in_force
from .comments import describe

_PAIR = pa.schema([("id", pa.string()), ("name", pa.string()), ("code", pa.string()), ("description", pa.string()), ("origin", pa.string())])


def _pair(batches):
    for b in batches:
        rows = []
        for i, name, summary, snippet in zip(*(b.column(k).to_pylist() for k in range(4))):
            told = describe(name, summary, snippet)
            if told:
                rows.append((i, name, snippet, *told))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PAIR)], schema=_PAIR)


def of_type(column: str, kind: str):
    return F.lower(F.trim(F.col(column))) == kind.lower()


def function_pairs(nodes: DataFrame, kind: str = "Method") -> DataFrame:
    """``id, name, code, description, origin`` of functions whose documentation says something.

    Of the rows in force those of the type are read, in any letter case. Without code (null, empty or comments
    only) there is no pair, whatever the documentation. The summary is the description if it says something,
    else the comments directly above the function in the snippet (``origin`` tells which). Only the texts of
    rows of the type are shuffled; each row is then judged alone.
    """
    row = F.when(of_type("type", kind), F.struct("name", "summary", "source_snippet"))
    mine = in_force(nodes, [row.alias("r")]).where("r is not null").select("id", "r.*")
    return mine.mapInArrow(_pair, "id string, name string, code string, description string, origin string")
