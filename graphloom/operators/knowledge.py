"""Documents and keywords: extraction, statistics, classes, relatedness, search, chunks and references."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import collapse_path, cosine, is_keyword, route_template, tokens

#: Weight of a keyword's source by kind of record.
SOURCE_WEIGHTS = {
    "CodeNode": {"name": 1.0, "summary": 0.85, "namespace": 0.35, "filePath": 0.35, "type": 0.2},
    "ApiEndpoint": {"name": 1.0, "summary": 0.9, "namespace": 0.4, "filePath": 0.35, "type": 0.2},
    "Diagnostic": {"name": 0.65, "summary": 0.9, "namespace": 0.4, "filePath": 0.35, "type": 0.2},
    "ExternalConcept": {"name": 1.0, "summary": 0.6, "namespace": 0.2, "filePath": 0.2, "type": 0.2},
    "KnowledgeDocument": {"title": 1.0, "content": 0.6, "source": 0.35, "kind": 0.2},
}
#: Word lists of the keyword classes, in the order in which they are tried after noise and common.
CLASS_TERMS = {
    "DomainConcept": "lexical enrichment heuristic knowledge stale idempotent related".split(),
    "TechnicalConcept": "checksum token docker powershell json toml cancellation logging structured".split(),
    "ToolingConcept": "mcp cli sdk indexer codex doctor rebuild".split(),
    "ArchitectureConcept": "domain application infrastructure repository options configuration".split(),
    "DiagnosticConcept": "diagnostic diagnostics error warning severity lint verify".split(),
}
NOISE_TERMS = "only when same make want after without through existing never value name".split()
CLASS_FACTOR = {
    "DomainConcept": 1.4, "TechnicalConcept": 1.25, "ToolingConcept": 1.15, "ArchitectureConcept": 1.1, "DiagnosticConcept": 1.1, "CommonProjectTerm": 0.2,
}
CONFIDENCE_STOPS = (
    "cancellation token async task string int bool object void class interface method graph infrastructure repository service"
).split()


def keyword_sources(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, kind, source, text``: one row per text that keywords come from; blank texts are left out."""
    kind = F.when(F.col("type").isin("ApiEndpoint", "Diagnostic", "ExternalConcept"), F.col("type")).otherwise("CodeNode")
    parts = lambda pairs: F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(c).alias("text")) for s, c in pairs])).alias("p")
    n = nodes.select("id", kind.alias("kind"), parts([("name", "name"), ("summary", "summary"), ("namespace", "namespace"), ("filePath", "file_path"), ("type", "type")]))
    d = docs.select("id", F.lit("KnowledgeDocument").alias("kind"), parts([("title", "source"), ("content", "content"), ("source", "source"), ("kind", "doc_kind")]))
    both = n.unionByName(d).select("id", "kind", "p.source", "p.text")
    return both.where(F.col("text").isNotNull() & (F.trim("text") != ""))


def _weight() -> Column:
    pairs = [(f"{k}|{s}", w) for k, m in SOURCE_WEIGHTS.items() for s, w in m.items()]
    table = F.create_map(*[x for k, w in pairs for x in (F.lit(k), F.lit(w))])
    return F.coalesce(table[F.concat_ws("|", "kind", "source")], F.lit(0.2))


def extract_keywords(sources: DataFrame, most: int = 40) -> DataFrame:
    """``id, keyword, count, weight``: the best keywords of each record.

    weight = sum of the weights of the sources a token occurs in, times 1 + log10 of its occurrences. Counts are
    made per (record, source, token) first, so long texts shrink before the shuffle.
    """
    tok = sources.select("id", "kind", "source", F.explode(tokens(F.col("text"))).alias("keyword")).where(is_keyword(F.col("keyword")))
    per = tok.groupBy("id", "kind", "source", "keyword").agg(F.count("*").alias("n"))
    all_ = per.withColumn("w", _weight()).groupBy("id", "keyword").agg(F.sum("n").alias("count"), F.sum("w").alias("w"))
    scored = all_.withColumn("weight", F.round(F.col("w") * (1 + F.log10("count")), 4))
    best = Window.partitionBy("id").orderBy(F.desc("weight"), F.desc("count"), "keyword")
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("id", "keyword", "count", "weight")


def keyword_statistics(has: DataFrame) -> DataFrame:
    """Records and occurrences per keyword."""
    return has.groupBy("keyword").agg(F.count_distinct("id").alias("document_frequency"), F.sum("count").alias("total_frequency"))


def classify_keywords(stats: DataFrame, records: DataFrame, common: float = 0.35) -> DataFrame:
    """Class, common and noise flags and usefulness of each keyword; ``records`` has one row per record."""
    n = records.agg(F.count("*").alias("records"))
    is_common = F.coalesce(F.col("document_frequency") / F.nullif(F.col("records"), F.lit(0)), F.lit(0.0)) >= common
    kind = F.when(F.col("keyword").isin(NOISE_TERMS), "Noise").when(F.col("is_common"), "CommonProjectTerm")
    for name, words in CLASS_TERMS.items():
        kind = kind.when(F.col("keyword").isin(words), name)
    factor = F.lit(1.0)
    for name, f in CLASS_FACTOR.items():
        factor = F.when(F.col("classification") == name, f).otherwise(factor)
    base = F.col("total_frequency") / F.col("document_frequency")
    return (
        stats.crossJoin(F.broadcast(n))  # one row
        .withColumn("is_common", is_common).withColumn("classification", kind.otherwise("Unknown"))
        .withColumn("usefulness", F.when(F.col("classification") == "Noise", 0.0).otherwise(base * factor * F.when(F.col("is_common"), 0.35).otherwise(1.0)))
        .select("keyword", "document_frequency", "total_frequency", "classification", "is_common", (F.col("classification") == "Noise").alias("is_noise"), F.round("usefulness", 6).alias("usefulness"))
    )


def related_by_keywords(has: DataFrame, classes: DataFrame, source: str, records: int, shared: int = 3, score: float = 0.25, share: float = 0.35, limit: int = 20) -> DataFrame:
    """Records that share keywords with one: ``id, shared, score``, rare enough and not noise."""
    import math

    most = 1 if records <= 0 else math.ceil(records * share)
    mine = has.where(F.col("id") == source).select("keyword", F.col("weight").alias("w"))
    ok = classes.where((F.col("document_frequency") <= most) & ~F.col("is_noise")).select("keyword", "usefulness")
    hit = has.where(F.col("id") != source).join(mine.join(ok, "keyword"), "keyword")
    return (
        hit.groupBy("id").agg(F.count_distinct("keyword").alias("shared"), F.sum(F.col("w") * F.col("weight") * F.col("usefulness")).alias("s"), F.collect_set("keyword").alias("k"))
        .where((F.col("shared") >= shared) & (F.col("s") >= score)).withColumn("score", F.round("s", 4))
        .orderBy(F.desc("score"), F.desc("shared"), "id").limit(limit)
        .select("id", "shared", "score", F.array_join(F.slice(F.array_sort("k"), 1, 20), ",").alias("keywords"))
    )


def related_confidence(related: DataFrame, shared: int = 3, score: float = 0.25) -> DataFrame:
    """Related records with confidence high, medium or awareness."""
    stops = F.array(*[F.lit(x) for x in CONFIDENCE_STOPS])
    telling = F.size(F.array_except(F.split("keywords", ","), stops)) > 0
    return related.select(
        "id", "shared", "score",
        F.when(~telling, "awareness").when((F.col("shared") >= shared + 2) | (F.col("score") >= max(score + 0.35, 0.6)), "high")
        .when((F.col("shared") >= shared + 1) | (F.col("score") >= max(score + 0.15, 0.4)), "medium").otherwise("awareness").alias("confidence"),
    )


def bm25(records: DataFrame, text: Column, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of the records that best match a query, by BM25 over all records."""
    want = sorted(set(_query_tokens(query)))
    base = records.select("id", tokens(text).alias("t")).where("t is not null").withColumn("len", F.size("t"))
    all_ = base.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hits = base.select("id", "len", F.explode("t").alias("term")).where(F.col("term").isin(want)).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return (
        hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(all_)).groupBy("id").agg(F.round(F.sum(s), 6).alias("score"))
        .orderBy(F.desc("score"), "id").limit(limit)
    )


def _query_tokens(query: str) -> list[str]:
    import re

    q = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", query)
    return [x for x in re.split(r"[\W_]+", q.lower()) if x]


def node_scan(nodes: DataFrame, name: str | None = None, path: str | None = None, kind: str | None = None, project: str | None = None, limit: int = 100) -> DataFrame:
    """Nodes whose name and path contain texts, of a type and project; filters that are not given do not exist."""
    df = nodes
    for column, text in (("name", name), ("file_path", path)):
        if (text or "").strip():
            df = df.where(F.contains(F.lower(column), F.lit(text.strip().lower())))
    if kind:
        df = df.where(F.col("type") == kind)
    if (project or "").strip():
        df = df.where(F.lower("project_context") == project.strip().lower())
    return df.orderBy("id").select("id", "name", "type").limit(limit)


def document_list(docs: DataFrame, project: str | None = None, limit: int = 200) -> DataFrame:
    df = docs.where(F.coalesce("doc_kind", F.lit("")) != "human-cognitive-seed")
    if (project or "").strip():
        df = df.where(F.lower("project_context") == project.strip().lower())
    return df.orderBy(F.desc_nulls_last("updated_at"), "id").select("id", "source", "updated_at").limit(limit)


def chunks(docs: DataFrame, most: int = 4000) -> DataFrame:
    """``id, part, chunk``: paragraphs packed greedily into chunks; long paragraphs are cut.

    The state of the packing runs through a text, so it is done in Arrow batches of whole texts.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, c) for i, t in zip(f["id"], f["content"]) if t is not None for k, c in enumerate(split_chunks(t, most))]
            yield pd.DataFrame(rows, columns=["id", "part", "chunk"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "content").mapInPandas(cut, f"id {kind}, part int, chunk string")


def split_chunks(text: str, most: int) -> list[str]:
    """Chunks of at most ``most`` characters: whole paragraphs as they fit, a longer one in slices."""
    if len(text) <= most:
        return [text]
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    room: list[str] = []
    used = 0
    for p in filter(None, map(str.strip, plain.split("\n\n"))):
        fits = used + (2 if room else 0) + len(p) <= most
        if room and not fits:
            out.append("\n\n".join(room).strip())
            room, used = [], 0
        if len(p) > most:
            out += [s for s in (p[i : i + most].strip() for i in range(0, len(p), most)) if s]
            continue
        used += (2 if room else 0) + len(p)
        room.append(p)
    if room:
        out.append("\n\n".join(room).strip())
    return out or [plain[:most]]


def document_references(docs: DataFrame) -> DataFrame:
    """``id, kind, target``: files linked or named in code marks, and HTTP routes, of each document."""
    link = F.transform(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1), lambda x: F.regexp_replace(x, "#.*$", ""))
    link = F.filter(link, lambda x: (F.trim(x) != "") & ~F.lower(x).rlike("^(https?|mailto):"))
    code = F.regexp_extract_all("content", F.lit(r"`([A-Za-z0-9_./\\-]+\.(?:cs|tsx?|jsx?|html|css|json|ya?ml))`"), 1)
    route = F.transform(
        F.regexp_extract_all("content", F.lit(r"\b((?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[^\s`)\"']*)"), 1),
        lambda x: F.concat(F.split(x, r"\s+")[0], F.lit(" "), route_template(F.split(x, r"\s+")[1])),
    )
    parts = [docs.select("id", F.lit(k).alias("kind"), F.explode(c).alias("target")) for k, c in (("link", link), ("code", code), ("route", route))]
    files = parts[0].unionByName(parts[1]).withColumn("target", collapse_path(F.col("target")))
    return files.unionByName(parts[2]).where("target != ''").distinct()


def mentions(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, type, target``: Mentions of nodes and References to documents by id or source, from comma lists."""
    items = lambda c: F.explode(F.filter(F.transform(F.split(c, r"[,;|\r\n]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))
    m = docs.select("id", items("related_node_ids_csv").alias("target")).distinct().join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    want = docs.select("id", items("related_document_ids_csv").alias("key")).distinct()
    by_id = want.join(docs.select(F.col("id").alias("target")), F.col("key") == F.col("target")).select(want["id"], "target")
    src = docs.where("source is not null").select(F.col("source").alias("key"), F.col("id").alias("target"))
    by_source = want.join(src, "key").select("id", "target")
    r = by_id.unionByName(by_source).distinct()
    return m.select("id", F.lit("Mentions").alias("type"), "target").unionByName(r.select("id", F.lit("References").alias("type"), "target"))


def symbol_mentions(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, symbol, known``: PascalCase or dotted names in prose, outside code fences, and whether a node has the name."""
    prose = F.regexp_replace("content", r"(?s)```.*?```", " ")
    found = F.regexp_extract_all(prose, F.lit(r"`([A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*|\.[A-Za-z][A-Za-z0-9]*)+)`"), 1)
    s = docs.select("id", F.explode(F.array_distinct(found)).alias("symbol"))
    names = nodes.where("name is not null").select(F.col("name").alias("last")).distinct().withColumn("hit", F.lit(True))
    return s.withColumn("last", F.substring_index("symbol", ".", -1)).join(names, "last", "left").select("id", "symbol", F.coalesce("hit", F.lit(False)).alias("known"))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, label: int | None = None, strict: bool = True) -> DataFrame:
    """The k vectors nearest to one by cosine, a label filter before (strict) or after the top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    df = vectors if label is None or not strict else vectors.where(F.col("label") == label)
    top = df.select("id", "label", F.round(cosine(F.col("embedding"), q), 6).alias("cosine")).where("cosine is not null").orderBy(F.desc("cosine"), "id").limit(k)
    return top if label is None or strict else top.where(F.col("label") == label)


def similar_nodes(vectors: DataFrame, node: int, k: int = 10, primary: float = 0.85) -> DataFrame:
    """Nearest vectors of one node with score (1 + cosine) / 2, and whether they are of its family and near enough."""
    one = vectors.where(F.col("id") == node).select(F.col("embedding").alias("q"), F.col("label").alias("own")).limit(1)  # one row
    c = cosine(F.col("embedding"), F.col("q"))
    return (
        vectors.where(F.col("id") != node).crossJoin(F.broadcast(one)).select("id", F.round((1 + c) / 2, 6).alias("score"), (F.col("label") == F.col("own")).alias("same_family"))
        .orderBy(F.desc("score"), "id").limit(k).withColumn("is_primary", F.col("same_family") & (F.col("score") >= primary))
    )


def hybrid_search(vectors: DataFrame, node: int, near: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
    """Nearest vectors within a neighbourhood, cut to the neighbourhood after the top k + 1 or, if strict, before."""
    one = vectors.where(F.col("id") == node).select(F.col("embedding").alias("q")).limit(1)  # one row
    df = vectors.join(near, "id", "left_semi") if strict else vectors
    top = df.crossJoin(F.broadcast(one)).select("id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k + 1)
    return top if strict else top.join(near, "id", "left_semi")
