"""Column expressions on names, paths, durations and colours."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def singular(c: Column) -> Column:
    """The singular of an English name: ``ies`` to ``y``, ``ses xes zes ches shes`` without ``es``, else without ``s``."""
    n = F.length(c)
    return (
        F.when(c.rlike("(?i)ies$") & (n > 3), F.concat(F.left(c, n - 3), F.lit("y"))).when(c.rlike("(?i)(ses|xes|zes|ches|shes)$"), F.left(c, n - 2))
        .when(c.rlike("(?i)s$") & (n > 1), F.left(c, n - 1)).otherwise(c)
    )


def without_suffix(c: Column, suffix: str) -> Column:
    """The name without a suffix in any letter case."""
    return F.regexp_replace(c, f"(?i){re.escape(suffix)}$", "")


def common_prefix(rows: DataFrame, key: str, column: str, separator: str) -> DataFrame:
    """``key, prefix``: the leading parts that all values of a key share, in any letter case, null if none; spelt as in
    the least value.

    The parts that the least and the greatest list of parts share are shared by all lists between them, so one
    aggregation with two values per key does, whatever the number of rows. Values without parts are left out.
    """
    parts = F.filter(F.split(column, re.escape(separator)), lambda x: F.trim(x) != "")
    low = F.transform(parts, lambda x: F.lower(F.trim(x)))
    g = rows.where(F.size(parts) > 0).groupBy(key).agg(F.min(low).alias("a"), F.max(low).alias("b"), F.min(F.struct(low.alias("l"), parts.alias("p"))).alias("first"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), n), lambda k: F.slice("a", 1, k) == F.slice("b", 1, k)), lambda x: x))
    return g.select(key, F.when(same > 0, F.array_join(F.slice("first.p", 1, same), separator)).alias("prefix"))


def window_seconds(c: Column, default: int = 86_400) -> Column:
    """Seconds of ``Nm``, ``Nh`` or ``Nd``; anything else is the default of a day."""
    n, unit = F.regexp_extract(F.lower(F.trim(c)), r"^(-?\d{1,9})([mhd])$", 1), F.regexp_extract(F.lower(F.trim(c)), r"^(-?\d{1,9})([mhd])$", 2)
    size = F.when(unit == "h", 3600).when(unit == "d", 86_400).otherwise(60)
    return F.when(n != "", F.expr("0").cast("long") + F.nullif(n, F.lit("")).cast("long") * size).otherwise(F.lit(default).cast("long"))


def glob_to_regex(pattern: str) -> str:
    """The regular expression, in any letter case, of a role pattern: ``**/`` is any directories or none, ``**``
    anything, ``*`` anything within a name. A leading ``**/`` may be absent from the path."""
    tokens = re.split(r"(\*\*/|\*\*|\*)", pattern.replace("\\", "/").strip())
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "(?i)^" + "".join(known.get(t, re.escape(t)) for t in tokens) + "$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether a path, with slashes of either kind, matches one of the patterns; false for null."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return reduce(lambda a, b: a | b, (p.rlike(glob_to_regex(x)) for x in patterns), F.lit(False))


def tool_names(text: Column) -> Column:
    """Names given in tool attributes of a source text."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'(?i)McpServerTool\s*\(\s*Name\s*=\s*"([^"]+)"\s*\)'), 1), lambda x: F.trim(x)), lambda x: x != ""))


#: What separates the terms of a feature's text.
TERM_BREAKS = " \t\r\n.,:;/\\-_`\"'()[]{}"


def feature_terms(texts: DataFrame, stop: list[str] | None = None, limit: int = 16) -> DataFrame:
    """``term, weight`` of ``text, weight`` rows: terms of four letters and more by the sum of the weights of their
    occurrences, the first ``limit``. Null and blank texts and weights of 0 or less count nothing."""
    cut = "[" + re.escape(TERM_BREAKS) + "]+"
    t = texts.where("weight > 0").select(F.explode(F.split(F.lower("text"), cut)).alias("term"), "weight").where(F.length("term") >= 4)
    if stop:
        t = t.where(~F.col("term").isin([x.lower() for x in stop]))
    return t.groupBy("term").agg(F.sum("weight").cast("long").alias("weight")).orderBy(F.desc("weight"), "term").limit(limit)


#: Named colours that style sheets of the index use.
NAMED_COLOURS = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "gray": "#808080", "grey": "#808080",
    "orange": "#ffa500", "purple": "#800080", "transparent": "#00000000",
}


def _bounded(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def colour(c: Column) -> Column:
    """(r, g, b, a) from 0 to 255 of a hex, rgb, rgba, hsl, hsla or named colour; null for anything else."""
    named = F.create_map(*[F.lit(x) for pair in NAMED_COLOURS.items() for x in pair])
    struct = lambda r, g, b, a: F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), a.cast("int").alias("a"))
    nothing = F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")

    def from_hex(h: Column) -> Column:
        byte = lambda k: F.conv(F.substring(h, k, 2), 16, 10)
        return F.when(F.length(h) == 8, struct(byte(1), byte(3), byte(5), byte(7))).otherwise(nothing)

    def hex_digits(v: Column) -> Column:
        h = F.regexp_extract(v, "^#([0-9a-f]{3,8})$", 1)
        wide = F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
        return _let(wide, lambda w: F.when(F.length(w) == 6, F.concat(w, F.lit("ff"))).otherwise(w))

    def parts(v: Column) -> Column:
        """The arguments of a call as (number, unit); empty if one is neither number, percentage nor degrees."""
        items = F.split(F.regexp_extract(v, r"^(?:rgb|hsl)a?\((.*)\)$", 1), ",")
        read = F.transform(items, lambda x: F.struct(
            F.nullif(F.regexp_extract(x, r"^\s*(-?[0-9]*\.?[0-9]+)(?:%|deg)?\s*$", 1), F.lit("")).cast("double").alias("x"), F.regexp_extract(x, r"(%|deg)?\s*$", 1).alias("unit"),
        ))
        return F.when(F.forall(read, lambda x: x["x"].isNotNull()) & F.size(read).isin(3, 4), read).otherwise(F.array().cast("array<struct<x:double,unit:string>>"))

    channel = lambda p: F.round(F.when(p["unit"] == "%", _bounded(p["x"], 0, 100) * 2.55).otherwise(_bounded(p["x"], 0, 255)))

    def alpha(p: Column) -> Column:
        return F.when(F.size(p) < 4, 255.0).otherwise(_let(p[3], lambda q: F.when(q["unit"] == "%", F.round(_bounded(q["x"], 0, 100) * 2.55)).when(q["x"] <= 1, F.round(_bounded(q["x"], 0, 1) * 255)).otherwise(F.round(_bounded(q["x"], 0, 255)))))

    def from_hsl(p: Column) -> Column:
        light, sat = _bounded(p[2]["x"], 0, 100) / 100, _bounded(p[1]["x"], 0, 100) / 100
        swing = sat * F.least(light, 1 - light)

        def shade(n: int) -> Column:
            k = F.pmod(F.lit(float(n)) + F.pmod(p[0]["x"], F.lit(360.0)) / 30, F.lit(12.0))
            return F.round(255 * (light - swing * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))))

        given = (p[1]["unit"] == "%") & (p[2]["unit"] == "%")
        return F.when(given, struct(shade(0), shade(8), shade(4), alpha(p))).otherwise(nothing)

    def read(v: Column) -> Column:
        from_call = lambda p: F.when(F.size(p) == 0, nothing).when(v.startswith("rgb"), struct(channel(p[0]), channel(p[1]), channel(p[2]), alpha(p))).otherwise(from_hsl(p))
        return F.when(v.startswith("#"), _let(hex_digits(v), from_hex)).otherwise(_let(parts(v), from_call))

    return _let(F.coalesce(F.try_element_at(named, F.lower(F.trim(c))), F.lower(F.trim(c)), F.lit("")), read)


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two (r, g, b, a) columns."""
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow(a[k] - b[k], 2) for k in "rgba"]))
