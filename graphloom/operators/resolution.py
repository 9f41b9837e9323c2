"""Resolving calls and type references to declarations, and accounting for the outcome; trust in index runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """``call_id, target, tier, disposition`` of each call.

    ``calls``: call_id, name, args, src_type, src_file, src_namespace, receiver (type or null), kind (one of
    Typed, This, Unqualified, Chained). ``methods``: id, name, required, total, variadic, owner, file, namespace.

    Candidates have the name and fit the number of arguments. Tiers are tried in order and one decides only if
    exactly one candidate is in it: receiver type; own type for unqualified and this calls; the sole candidate;
    same file; same namespace. A typed receiver that finds none ends there; chained calls are never resolved.

    No call meets its candidates one by one: declarations are summed up per name, tier key and signature, and looked
    up for the distinct names, keys and numbers of arguments that calls have.
    """
    fits = F.coalesce((F.col("required") <= F.col("args")) & (F.col("variadic") | (F.col("args") <= F.col("total"))), F.lit(False))
    keys = {"receiver": ("owner", F.col("receiver")), "own": ("owner", F.when(F.col("kind").isin("This", "Unqualified"), F.col("src_type"))), "sole": (None, None), "file": ("file", F.col("src_file")), "namespace": ("namespace", F.col("src_namespace"))}
    g = calls
    for t, (column, key) in keys.items():
        by = ["name"] if column is None else ["name", "key"]
        m = methods if column is None else methods.withColumn("key", F.col(column)).where("key is not null")
        signs = m.where("name is not null").groupBy(*by, "required", "total", "variadic").agg(F.count("*").alias("n"), F.max("id").alias("id"))
        # The name is only counted where no tier key narrows it.
        c = g if column is None else g.withColumn("key", key)
        asked = (c if column is None else c.where("key is not null")).where("name is not null").select(*by, "args").distinct()
        sums = [F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias(f"n_{t}"), F.max(F.when(fits, F.col("id"))).alias(f"t_{t}")]
        hit = asked.join(signs, by).groupBy(*by, "args").agg(*sums, *([F.sum("n").alias("named")] if column is None else []))
        hit = hit.withColumnsRenamed({k: f"h_{k}" for k in [*by, "args"]})
        on = F.col("args").eqNullSafe(F.col("h_args"))
        for k in by:
            on = on & (F.col(k) == F.col(f"h_{k}"))
        g = c.join(hit, on, "left").drop("key", *[f"h_{k}" for k in [*by, "args"]])
    one = lambda t: F.when(F.col(f"n_{t}") == 1, F.struct(F.col(f"t_{t}").alias("target"), F.lit(t).alias("tier")))
    typed = F.col("kind") == "Typed"
    found = F.when(F.col("kind") != "Chained", F.when(typed, one("receiver")).otherwise(F.coalesce(one("receiver"), one("own"), one("sole"), one("file"), one("namespace"))))
    disposition = (
        F.when(F.col("f").isNotNull(), "resolved").when(F.col("name").isNull() | F.col("args").isNull(), "indeterminate").when(F.coalesce("named", F.lit(0)) == 0, "external")
        .when(F.coalesce("n_sole", F.lit(0)) == 0, "unresolved").otherwise("indeterminate")
    )
    return g.withColumn("f", found).select("call_id", "f.target", "f.tier", disposition.alias("disposition"))


def resolve_types(refs: DataFrame, types: DataFrame) -> DataFrame:
    """``ref_id, target, disposition`` of type references: kept id, sole candidate, same namespace, same file.

    ``refs``: ref_id, target_id (or null), name, src_namespace, src_file. ``types``: id, name, namespace, file.
    """
    c = refs.join(types.select("id", F.col("name").alias("t_name"), F.col("namespace").alias("t_ns"), F.col("file").alias("t_file")), F.col("name") == F.col("t_name"), "left")
    g = c.groupBy("ref_id", "target_id").agg(
        F.count("id").alias("n"), F.max("id").alias("any"),
        F.count_if(F.col("t_ns") == F.col("src_namespace")).alias("n_ns"), F.max(F.when(F.col("t_ns") == F.col("src_namespace"), F.col("id"))).alias("in_ns"),
        F.count_if(F.col("t_file") == F.col("src_file")).alias("n_file"), F.max(F.when(F.col("t_file") == F.col("src_file"), F.col("id"))).alias("in_file"),
    )
    t = F.coalesce("target_id", F.when(F.col("n") == 1, F.col("any")), F.when(F.col("n_ns") == 1, F.col("in_ns")), F.when(F.col("n_file") == 1, F.col("in_file")))
    return g.select("ref_id", t.alias("target"), F.when(t.isNotNull(), "resolved").when(F.col("n") == 0, "external").otherwise("indeterminate").alias("disposition"))


def accounting(outcomes: DataFrame, samples: int = 3) -> DataFrame:
    """``disposition, reason, n, samples`` with the smallest ids as samples. The outcomes are worked out once."""
    outcomes = Workspace(outcomes.sparkSession, "accounting").cut(outcomes.select("id", "disposition", "reason"))
    w = Window.partitionBy("disposition", "reason").orderBy("id")
    few = outcomes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples).groupBy("disposition", "reason").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("samples"))
    n = outcomes.groupBy("disposition", "reason").agg(F.count("*").alias("n"))
    same = n["disposition"].eqNullSafe(few["disposition"]) & n["reason"].eqNullSafe(few["reason"])
    return n.join(few, same).select(n["disposition"], n["reason"], "n", "samples")


def relationship_trust(runs: DataFrame) -> DataFrame:
    """One row: confidence and totals over the latest run per language and scope.

    ``runs``: run_id, language, scope, completed_at, partial, schema_version, mode, scanned, ingested, resolved,
    unresolved, indeterminate, external, legacy. No runs give Unknown.
    """
    w = Window.partitionBy("language", "scope").orderBy(F.desc("completed_at"), F.desc("run_id"))
    r = runs.withColumn("k", F.row_number().over(w))
    full = runs.where("mode = 'full'").groupBy("language", "scope").agg(F.max_by("resolved", F.struct("completed_at", "run_id")).alias("full_resolved"))
    last = r.where("k = 1").join(full, ["language", "scope"], "left")
    thin = (F.col("mode") == "incremental") & (F.col("ingested") * 10 <= F.col("scanned")) & (F.col("resolved") * 2 < F.col("full_resolved"))
    low = F.col("partial") | ((F.col("schema_version") >= 2) & (F.col("unresolved") >= 1)) | F.coalesce(thin, F.lit(False))
    t = last.agg(
        F.count("*").alias("runs"), F.coalesce(F.max(low), F.lit(False)).alias("low"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("resolved", "unresolved", "indeterminate", "external", "legacy")],
    )
    level = F.when(F.col("runs") == 0, "Unknown").when(F.col("low"), "Low").when((F.col("indeterminate") > 0) | (F.col("legacy") > 0), "Medium").otherwise("High")
    return t.select(level.alias("confidence"), "runs", "resolved", "unresolved", "indeterminate", "external")


def reason_counts(runs: DataFrame, top: int = 3) -> DataFrame:
    """``reason, n, percent`` of the most frequent reasons in the runs' JSON counts; broken JSON counts nothing."""
    m = F.coalesce(F.from_json("reasons", "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    e = runs.select(F.explode(m).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
    total = e.agg(F.sum("n").alias("total"))
    return e.crossJoin(F.broadcast(total)).select("reason", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent")).orderBy(F.desc("n"), "reason").limit(top)


def overlap(a: Column, b: Column) -> Column:
    """Number of common entries of two arrays; null counts as empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))


def session_usefulness(events: DataFrame, changed: DataFrame) -> DataFrame:
    """Per session: suggestions, how many touch changed files, test runs, stale warnings, and a rating.

    ``events``: session, kind, tool, files array. ``changed``: session, files array.
    """
    e = events.join(changed.select("session", F.col("files").alias("changed")), "session", "left")
    hit = overlap(F.col("files"), F.col("changed"))
    g = e.groupBy("session").agg(
        F.count_if(F.col("kind") == "suggestion").alias("suggestions"), F.count_if((F.col("kind") == "suggestion") & (hit > 0)).alias("accepted"),
        F.count_if(F.col("kind") == "test").alias("tests"), F.count_if(F.col("kind") == "stale").alias("stale"),
    )
    rating = (
        F.when(F.col("suggestions") == 0, "unknown").when((F.col("accepted") * 2 >= F.col("suggestions")) & (F.col("tests") > 0), "high")
        .when(F.col("accepted") > 0, "partial").otherwise("low")
    )
    return g.select("session", "suggestions", "accepted", "tests", "stale", rating.alias("rating"))


def tool_precision(events: DataFrame, changed: DataFrame) -> DataFrame:
    """Accepted and ignored suggested files per tool."""
    s = events.where("kind = 'suggestion'").select("session", "tool", F.explode("files").alias("file")).distinct()
    c = changed.select("session", F.explode("files").alias("file")).distinct().withColumn("hit", F.lit(True))
    return s.join(c, ["session", "file"], "left").groupBy("tool").agg(F.count("hit").alias("accepted"), (F.count("*") - F.count("hit")).alias("ignored"))


#: Lines of compiler and linter output.
_TSC = r"^(.+?)\((\d+),(\d+)\):\s(error|warning)\s(TS\d+):\s(.+)$"
_LINT = r"^\s*(\d+):(\d+)\s+(error|warning|warn)\s+(.+?)\s+([@\w/-]+)$"


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """``tool, file, line, severity, code, message`` of compiler lines, and of linter lines below their file's line.

    ``lines``: output_id, n, text; the file of a linter line is the last path line above it.
    """
    t = F.rtrim("text")
    tsc = lines.where(t.rlike("(?i)" + _TSC)).select(
        F.lit("tsc").alias("tool"), *[F.regexp_extract(t, "(?i)" + _TSC, i).alias(a) for i, a in ((1, "file"), (2, "line"), (4, "severity"), (5, "code"), (6, "message"))]
    )
    path = F.when(~F.col("text").startswith(" ") & t.rlike(r"[/\\][^\s]+\.\w+$"), t)
    w = Window.partitionBy("output_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lint = lines.withColumn("file", F.last(path, True).over(w)).where(t.rlike("(?i)" + _LINT) & F.col("file").isNotNull()).select(
        F.lit("eslint").alias("tool"), "file", *[F.regexp_extract(t, "(?i)" + _LINT, i).alias(a) for i, a in ((1, "line"), (3, "severity"), (5, "code"), (4, "message"))]
    )
    return tsc.unionByName(lint).withColumn("line", F.col("line").cast("int")).withColumn("severity", F.lower("severity"))


def table_accesses(texts: DataFrame) -> DataFrame:
    """``id, operation, table_name`` of SQL named in a text column."""
    m = F.regexp_extract_all("text", F.lit(r"(?i)\b((?:select\b[^;\"]*?\bfrom|insert\s+into|update|delete\s+from)\s+[A-Za-z_][A-Za-z0-9_.]*)"), 1)
    x = texts.select("id", F.explode(m).alias("s"))
    op = F.lower(F.regexp_extract("s", r"(?i)^(select|insert|update|delete)", 1))
    return x.select("id", F.when(op == "select", "Read").otherwise("Write").alias("operation"), F.regexp_extract("s", r"([A-Za-z_][A-Za-z0-9_.]*)$", 1).alias("table_name")).distinct()


#: Calls of two query libraries and words of graph queries, by what they do.
_READS = ["findUnique", "findUniqueOrThrow", "findFirst", "findFirstOrThrow", "findMany", "count", "aggregate", "groupBy", "select", "first", "pluck"]
_WRITES = ["create", "createMany", "update", "updateMany", "upsert", "delete", "deleteMany", "insert", "del", "truncate", "increment", "decrement"]


def data_accesses(texts: DataFrame) -> DataFrame:
    """``id, provider, operation, name`` of tables, models and labels that source texts (``id, text``) access.

    Besides SQL (:func:`table_accesses`): model calls ``prisma.model.call(``, builder chains that begin with
    ``knex('table')`` or name it by ``from``, ``into`` or ``table`` (Write if any call of the chain writes), and labels
    and relationship types of graph queries (Write if the text creates, merges, sets or deletes). Recognised by
    regular expressions over the text, so a name that is computed is not found; null texts have none.
    """
    t = texts.where("text is not null").select("id", "text")
    kind = lambda c: F.when(c.isin(_WRITES), "Write").otherwise("Read")
    sql = table_accesses(t).select("id", F.lit("sql").alias("provider"), "operation", F.col("table_name").alias("name"))
    calls = "|".join(_READS + _WRITES)
    model = t.select("id", F.explode(F.regexp_extract_all("text", F.lit(rf"(?i:\bprisma(?:client)?)\.([A-Za-z_]\w*\.(?:{calls}))\s*\("), 1)).alias("x"))
    prisma = model.select("id", F.lit("prisma").alias("provider"), kind(F.substring_index("x", ".", -1)).alias("operation"), F.substring_index("x", ".", 1).alias("name"))
    named = r"(?:\bknex\s*\(|\.\s*(?:from|into|table)\s*\()\s*['\"`]([A-Za-z_][\w.]*)['\"`]"
    chain = t.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(\bknex\b[^;]*)"), 1)).alias("x"))
    writes = F.col("x").rlike(r"\.\s*(?:" + "|".join(_WRITES) + r")\s*\(")
    knex = chain.select("id", F.lit("knex").alias("provider"), F.when(writes, "Write").otherwise("Read").alias("operation"), F.explode(F.regexp_extract_all("x", F.lit(named), 1)).alias("name"))
    graph = t.where(F.col("text").rlike(r"(?i)\b(?:match|merge|create)\s*\("))
    labels = F.concat(
        F.regexp_extract_all("text", F.lit(r"\(\s*\w*\s*:\s*`?([A-Za-z_]\w*)`?"), 1), F.regexp_extract_all("text", F.lit(r"\[\s*\w*\s*:\s*`?([A-Za-z_]\w*)`?"), 1)
    )
    does = F.when(F.col("text").rlike(r"(?i)\b(?:merge|create)\s*\(|\bset\s+\w+\.|\bdelete\s+\w+"), "Write").otherwise("Read")
    cypher = graph.select("id", F.lit("cypher").alias("provider"), does.alias("operation"), F.explode(labels).alias("name"))
    return sql.unionByName(prisma).unionByName(knex).unionByName(cypher).distinct()
