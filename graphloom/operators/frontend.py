"""Styles: extraction from markup and style sheets, cascade conflicts, warnings and near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import selector_specificity
from ..functions.scalars import colour


def class_attributes(pages: DataFrame) -> DataFrame:
    """``page, kind, name``: class and id attributes and style-sheet links of ``page, html``."""
    cls = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)\bclass(?:Name)?\s*=\s*[\"']([^\"']*)[\"']"), 1), lambda x: F.split(F.trim(x), r"\s+")))
    ids = F.regexp_extract_all("html", F.lit(r"(?i)\bid\s*=\s*[\"']([^\"']*)[\"']"), 1)
    links = F.regexp_extract_all("html", F.lit(r"(?i)<link\b[^>]*\bhref\s*=\s*[\"']([^\"']+\.css)[\"']"), 1)
    parts = [pages.select("page", F.lit(k).alias("kind"), F.explode(c).alias("name")) for k, c in (("class", cls), ("id", ids), ("stylesheet", links))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name != ''").distinct()


def declarations(sheets: DataFrame) -> DataFrame:
    """Declarations of ``file_path, css``: property, value, selector, order, specificity and target of each.

    The target is the last class or id of the selector. Comments are dropped; at-rules with inner rules are read
    as those rules.
    """
    text = F.regexp_replace("css", r"(?s)/\*.*?\*/", " ")
    rules = F.regexp_extract_all(text, F.lit(r"([^{}@;]+\{[^{}]*\})"), 1)
    r = sheets.select("file_path", F.posexplode(rules).alias("rule_no", "rule"))
    r = r.select("file_path", "rule_no", F.split(F.split("rule", r"\{")[0], ",").alias("sels"), F.regexp_replace(F.split("rule", r"\{")[1], r"\}\s*$", "").alias("body"))
    r = r.select("file_path", "rule_no", F.posexplode("sels").alias("sel_no", "selector"), "body").withColumn("selector", F.trim("selector"))
    d = r.select("file_path", "rule_no", "sel_no", "selector", F.posexplode(F.split("body", ";")).alias("decl_no", "decl")).where(F.col("decl").contains(":"))
    last = F.regexp_extract("selector", r"([.#][A-Za-z_-][A-Za-z0-9_-]*)(?:[:\[][^\s>+~]*)?$", 1)
    return d.select(
        "file_path", (F.col("rule_no") * 1000 + F.col("decl_no")).alias("source_order"), "selector", F.lower(F.trim(F.split("decl", ":", 2)[0])).alias("property"),
        F.trim(F.split("decl", ":", 2)[1]).alias("value"), selector_specificity(F.col("selector")).alias("spec"),
        F.when(last.startswith("."), "CssClass").when(last.startswith("#"), "CssId").alias("target_kind"), F.substring(last, 2, 1000).alias("target"),
    )


GROUP = ["file_path", "property", "target_kind", "target"]


def cascade_conflicts(d: DataFrame) -> DataFrame:
    """Pairs of declarations of one property for one target where one overrides the other.

    ``d``: id, the group columns, spec (struct of a, b, c), source_order, line. The later of two with equal
    specificity and order wins by line; equal in all, there is no conflict.
    """
    prio = lambda p: F.struct(F.col(f"{p}.spec"), F.col(f"{p}.source_order"), F.col(f"{p}.line"))
    j = d.where("target is not null").alias("w").join(d.alias("l"), GROUP).where(prio("w") > prio("l"))
    return j.select(*GROUP, F.col("w.id").alias("winner"), F.col("l.id").alias("loser"), F.when(F.col("w.spec") > F.col("l.spec"), "specificity").otherwise("order").alias("reason"))


def specificity_warnings(d: DataFrame, steps: int = 6) -> DataFrame:
    """Simple selectors beaten by a more specific one within a few steps of source order."""
    simple = F.col("s.selector") == F.concat(F.when(F.col("target_kind") == "CssClass", ".").otherwise("#"), F.col("target"))
    j = d.where("target is not null").alias("s").join(d.alias("c"), GROUP)
    near = F.abs(F.col("c.source_order") - F.col("s.source_order")) <= steps
    return j.where(simple & near & (F.col("c.spec") > F.col("s.spec")) & (F.col("c.id") != F.col("s.id"))).select(*GROUP, F.col("c.id").alias("stronger"), F.col("s.id").alias("simple"))


def value_in_units(value: Column) -> Column:
    """(number, unit) of a CSS value: rem and em as px, s as ms, rad and turn as deg; null unless a number."""
    n = F.regexp_extract(value, r"^\s*(-?[0-9]*\.?[0-9]+)\s*([a-z%]*)\s*$", 1)
    u = F.lower(F.regexp_extract(value, r"^\s*(-?[0-9]*\.?[0-9]+)\s*([a-zA-Z%]*)\s*$", 2))
    x = F.try_to_number(n, F.lit("S999999D999999")).cast("double")
    x = F.when(n != "", n.cast("double"))
    num = F.when(u.isin("rem", "em"), x * 16).when(u == "s", x * 1000).when(u == "turn", x * 360).when(u == "rad", x * 57.29577951308232).otherwise(x)
    unit = F.when(u.isin("rem", "em"), "px").when(u == "s", "ms").when(u.isin("turn", "rad"), "deg").otherwise(u)
    return F.struct(num.alias("number"), unit.alias("unit"))


#: How far two values of a unit may be apart to be near-duplicates.
TOLERANCE = {"px": 2.0, "%": 2.0, "deg": 3.0, "ms": 50.0}
RELATIVE = 0.08


def near_duplicate_styles(values: DataFrame) -> DataFrame:
    """``property, unit, leader, value, id`` clusters of near-equal numeric style values.

    In the order of the values, a value joins the current leader if it is within the unit's tolerance or 8 % of
    it, else it leads a new cluster. The distinct values of a (property, unit) are walked, not the rows: a fold
    over the sorted array of distinct values, whose number the style sheets' vocabulary bounds.
    """
    v = values.select("id", "property", value_in_units(F.col("value")).alias("v")).select("id", "property", "v.number", "v.unit").where("number is not null")
    tol = F.lit(0.0)
    for u, t in TOLERANCE.items():
        tol = F.when(F.col("unit") == u, t).otherwise(tol)
    per = v.groupBy("property", "unit").agg(F.array_sort(F.collect_set("number")).alias("xs")).withColumn("tol", tol)
    walk = F.aggregate(
        "xs", F.array().cast("array<struct<number:double,leader:double>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x.alias("number"),
            F.when((F.size(acc) > 0) & ((x - F.element_at(acc, -1)["leader"]) <= F.greatest(F.col("tol"), F.abs(F.element_at(acc, -1)["leader"]) * RELATIVE)), F.element_at(acc, -1)["leader"]).otherwise(x).alias("leader"),
        ))),
    )
    lead = per.select("property", "unit", F.explode(walk).alias("w")).select("property", "unit", "w.number", "w.leader")
    return v.join(lead, ["property", "unit", "number"]).select("property", "unit", "leader", "number", "id")


#: Fixed value: how far apart two colours may be to be near-duplicates.
COLOUR_TOLERANCE = 18.0


def near_duplicate_colours(values: DataFrame) -> DataFrame:
    """``property, leader, colour, id`` clusters of near-equal colours, as hex with alpha.

    In the order of their hex forms, a colour joins the first leader within the tolerance, else it leads. The distinct
    colours of a property are walked, not the rows; their number is bounded by the style sheets' vocabulary. Values
    that are no colour are left out.
    """
    v = values.select("id", "property", F.explode(F.array(colour(F.col("value")))).alias("c")).where("c is not null")
    byte = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    v = v.select("id", "property", F.concat(F.lit("#"), *[byte(F.col(f"c.{k}").cast("long")) for k in "rgba"]).alias("colour"), "c")
    per = v.groupBy("property").agg(F.array_sort(F.collect_set(F.struct("colour", "c"))).alias("xs"))
    far = lambda a, b: F.sqrt(sum((F.pow(a["c"][k].cast("double") - b["c"][k].cast("double"), 2) for k in "rgba"), F.lit(0.0)))
    kind = "struct<colour:string,c:struct<r:int,g:int,b:int,a:int>>"

    def step(acc, x):
        near = F.filter(acc["leaders"], lambda l: far(l, x) <= COLOUR_TOLERANCE)
        lead = F.when(F.size(near) > 0, near[0]).otherwise(x)
        return F.struct(
            F.when(F.size(near) > 0, acc["leaders"]).otherwise(F.concat(acc["leaders"], F.array(x))).alias("leaders"),
            F.concat(acc["out"], F.array(F.struct(x["colour"].alias("colour"), lead["colour"].alias("leader")))).alias("out"),
        )

    start = F.struct(F.array().cast(f"array<{kind}>").alias("leaders"), F.array().cast("array<struct<colour:string,leader:string>>").alias("out"))
    walked = per.select("property", F.explode(F.aggregate("xs", start, step, lambda a: a["out"])).alias("w")).select("property", "w.colour", "w.leader")
    return v.join(walked, ["property", "colour"]).select("property", "leader", "colour", "id")
