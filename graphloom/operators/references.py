"""References to records that do not exist, at the time the reference was made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace

NO_DAY = "0001-01-01"


def _filled(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike("(?U)^\\s*$")


def reference_ends(
    edges: DataFrame, row: str, columns: Sequence[str], at: str
) -> DataFrame:
    """One row per non-null, non-blank reference: row number, column, id and time."""
    ends = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("id")) for c in columns])
    return (
        edges.select(F.col(row).alias("row_no"), F.col(at).alias("t"), F.explode(ends).alias("e"))
        .select("row_no", "t", "e.side", "e.id")
        .where(_filled(F.col("id")))
        .withColumn("day", F.coalesce(F.to_date("t"), F.lit(NO_DAY).cast("date")))
    )


def _state(refs: DataFrame, marks: DataFrame, slot: str) -> DataFrame:
    """What is known of each referenced (id, slot): the last index and deletion before the slot, and whether
    there is one within it (busy). ``marks``: id, slot, t, up. Times of a slot are combined before the shuffle,
    so the window over an id holds one row per slot of the calendar, however often the id is referred to."""
    up, down = F.when(F.col("up"), F.col("t")), F.when(~F.col("up"), F.col("t"))
    per_slot = (
        refs.select("id", slot).distinct()
        .select("id", slot, F.lit(None).cast(marks.schema["t"].dataType).alias("t"), F.lit(None).cast("boolean").alias("up"), F.lit(1).alias("ref"))
        .unionByName(marks.select("id", slot, "t", "up", F.lit(0).alias("ref")))
        .groupBy("id", slot)
        .agg(F.max(up).alias("up_s"), F.max(down).alias("down_s"), F.max("ref").alias("ref"))
    )
    before = Window.partitionBy("id").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_slot.select(
            "id", slot, "ref",
            F.max("up_s").over(before).alias("up0"),
            F.max("down_s").over(before).alias("down0"),
            (F.col("up_s").isNotNull() | F.col("down_s").isNotNull()).alias("busy"),
        )
        .where("ref = 1")
        # What is present throughout the slot needs no further look.
        .where("busy or up0 is null or down0 > up0")
        .select("id", slot, "up0", "down0", "busy")
    )


def missing_references(
    edges: DataFrame,
    nodes: DataFrame,
    deletions: DataFrame,
    fixed: DataFrame,
    row: str = "edge_no",
    columns: Sequence[str] = ("src", "dst"),
    at: str = "indexed_at",
) -> DataFrame:
    """Every reference whose id is not present when the referring row was indexed.

    Returns ``row_no, side, id, t, reason``; reason is ``never`` (no such key in any parent table),
    ``later`` (first indexed after the reference) or ``deleted``.

    Distinct (id, day) keys of the references are taken first (combined before the shuffle, so a popular id
    costs one key per day) and anti-joined with the distinct parent keys. Keys that have a parent get the
    state at the start of the day from a running maximum over that id's days, and the verdict is joined back to
    the references. References on a day with an index or deletion of their id are decided in the same way by the
    minute, and only those of such a minute row by row, within (id, minute). So a hot id is spread over its days,
    a hot day over its minutes.

    Null or blank ids are no references. A reference without a time is present only in ``fixed``, because no
    row is known to precede it. Nodes or deletions with a null id or time prove nothing. Equal rows count
    each; a deletion at the very time of indexing does not remove the node. Empty tables give empty results.
    """
    refs = reference_ends(edges, row, columns, at)
    kind = refs.schema["t"].dataType  # with or without a zone, as the references have it
    seen = nodes.where(F.col("id").isNotNull() & F.col("last_indexed_at").isNotNull()).select(
        "id", F.col("last_indexed_at").cast(kind).alias("t"), F.lit(True).alias("up")
    )
    gone = deletions.where(F.col("node_id").isNotNull() & F.col("deleted_at").isNotNull()).select(
        F.col("node_id").alias("id"), F.col("deleted_at").cast(kind).alias("t"), F.lit(False).alias("up")
    )
    minute = lambda df: df.withColumn("minute", F.date_trunc("minute", "t").cast(kind))
    marks = seen.unionByName(gone).withColumn("day", F.to_date("t"))

    keys = refs.select("id", "day").distinct()
    always = fixed.where(F.col("id").isNotNull()).select("id").distinct()
    known = seen.select("id").distinct()
    wanted = keys.join(always, "id", "left_anti")
    none = F.lit(None).cast(kind)
    never = wanted.join(known, "id", "left_anti").select(
        "id", "day", none.alias("up0"), none.alias("down0"), F.lit(False).alias("busy"), F.lit(True).alias("never")
    )
    ws = Workspace(edges.sparkSession, "references")
    state = ws.cut(_state(wanted.join(known, "id", "left_semi"), marks, "day").withColumn("never", F.lit(False)).unionByName(never))
    by_day = refs.join(state, ["id", "day"])
    out = ["row_no", "side", "id", "t", "up0", "never"]
    quiet = by_day.where("not busy").select(*out)

    busy = ws.cut(minute(refs.join(state.where("busy").select("id", "day"), ["id", "day"], "left_semi").select("row_no", "side", "id", "t")))
    theirs = minute(marks.join(busy.select("id").distinct(), "id", "left_semi"))
    by_minute = busy.join(_state(busy, theirs, "minute"), ["id", "minute"])
    still = by_minute.where("not busy").select("row_no", "side", "id", "t", "up0", F.lit(False).alias("never"))

    close = by_minute.where("busy")
    both = close.select(
        "id", "minute", "t", "row_no", "side", "up0", "down0", none.alias("up_t"), none.alias("down_t")
    ).unionByName(
        theirs.join(close.select("id", "minute").distinct(), ["id", "minute"], "left_semi").select(
            "id", "minute", "t", F.lit(None).cast(close.schema["row_no"].dataType).alias("row_no"), F.lit(None).cast("string").alias("side"),
            none.alias("up0"), none.alias("down0"), F.when(F.col("up"), F.col("t")).alias("up_t"), F.when(~F.col("up"), F.col("t")).alias("down_t"),
        )
    )
    until = Window.partitionBy("id", "minute").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    row_by_row = (
        both.withColumn("up1", F.greatest("up0", F.max("up_t").over(until)))
        .withColumn("down1", F.greatest("down0", F.max("down_t").over(until)))
        .where("side is not null and (up1 is null or down1 > up1)")
        .select("row_no", "side", "id", "t", F.col("up1").alias("up0"), F.lit(False).alias("never"))
    )
    return quiet.unionByName(still).unionByName(row_by_row).select(
        "row_no", "side", "id", "t",
        F.when(F.col("never"), "never").when(F.col("up0").isNull(), "later").otherwise("deleted").alias("reason"),
    )


def missing_reference_report(
    edges: DataFrame,
    nodes: DataFrame,
    deletions: DataFrame,
    fixed: DataFrame,
    fixed_prefix: str = "ExternalConcept:",
) -> DataFrame:
    """Counts of references and missing references per column, table referred to and month.

    The table referred to is ``external_concepts`` if the id has that table's prefix, else ``nodes``. Rows
    without a time are reported under a null month. ``ids_missing`` counts distinct ids within the cell, from
    counts per id that are combined before the shuffle.
    """
    cell = ["side", "parent", "month"]

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "parent", F.when(F.col("id").startswith(fixed_prefix), "external_concepts").otherwise("nodes")
        ).withColumn("month", F.date_format("t", "yyyy-MM"))

    total = cells(reference_ends(edges, "edge_no", ("src", "dst"), "indexed_at")).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("refs")
    )
    bad = (
        cells(missing_references(edges, nodes, deletions, fixed))
        .groupBy(*cell, "id", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*cell, "id")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(F.when(F.col("reason") == r, F.col("n")).otherwise(0)).alias(r) for r in ("never", "later", "deleted")],
        )
        .groupBy(*cell)
        .agg(
            F.sum("n").alias("missing"), F.count(F.lit(1)).alias("ids_missing"),
            F.sum("never").alias("never_indexed"), F.sum("later").alias("indexed_later"), F.sum("deleted").alias("deleted"),
        )
    )
    bad = bad.select(*[F.col(c).alias(f"b_{c}") for c in cell], "missing", "ids_missing", "never_indexed", "indexed_later", "deleted")
    same = [total[c].eqNullSafe(bad[f"b_{c}"]) for c in cell]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return total.join(bad, same, "left").select(
        *cell, "refs", *[zero(c) for c in ("missing", "ids_missing", "never_indexed", "indexed_later", "deleted")]
    )
