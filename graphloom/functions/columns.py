"""Column expressions shared by the operators, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path patterns of the file roles in the order in which they are tried.
_CODE = "(?:cs|tsx?|jsx?)"
ROLE_PATTERNS = {
    "BuildArtifact": ["^(?:.*/)?(?:bin|obj|node_modules|dist|build|coverage)/.*$"],
    "Snapshot": ["^(?:.*/)?[^/]*ModelSnapshot\\.cs$"],
    "Migration": ["^(?:.*/)?Migrations/(?:.*/)?[^/]*\\.cs$"],
    "Generated": ["^(?:.*/)?[^/]*\\.(?:g|generated|designer)\\.cs$", "^(?:.*/)?(?:openapi|graphql)\\.generated\\.ts$"],
    "Test": [
        f"^(?:.*/)?(?:tests?|__tests__)/(?:.*/)?[^/]*\\.{_CODE}$",
        "^(?:.*/)?[^/]*\\.Tests?/(?:.*/)?[^/]*\\.cs$",
        "^(?:.*/)?[^/]*Tests\\.cs$",
        "^(?:.*/)?[^/]*\\.(?:test|spec)\\.(?:tsx?|jsx?)$",
    ],
    "Configuration": [
        f"^(?:.*/)?[^/]*(?:Options?|Configurations?|Configs?|Settings?)\\.{_CODE}$",
        "^(?:.*/)?[^/]*\\.(?:configs?|configurations?|options?|settings?)\\.(?:tsx?|jsx?)$",
    ],
}
SOURCE_PATTERN = f"\\.{_CODE}$"


def path_role(path: Column) -> Column:
    """The role that a path shows; Unknown for null and blank paths."""
    p = F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    out = F.when(path.isNull() | (F.trim(p) == ""), "Unknown")
    for role, patterns in ROLE_PATTERNS.items():
        out = out.when(p.rlike("(?i)" + "|".join(patterns)), role)
    return out.when(p.rlike(SOURCE_PATTERN), "Source").otherwise("Unknown")


def path_role_sql(path: str) -> str:
    p = f"ltrim(replace({path}, '\\', '/'), '/')"
    whens = "".join(f" WHEN regexp_matches({p}, '(?i){'|'.join(x)}') THEN '{r}'" for r, x in ROLE_PATTERNS.items())
    return f"CASE WHEN {path} IS NULL OR trim({p}) = '' THEN 'Unknown'{whens} WHEN regexp_matches({p}, '{SOURCE_PATTERN}') THEN 'Source' ELSE 'Unknown' END"


def effective_role(path: Column, stored: Column) -> Column:
    """Test if the path says so, else the stored role unless unknown, else the path's."""
    by_path = path_role(path)
    return F.when(by_path == "Test", "Test").when(F.coalesce(stored, F.lit("Unknown")) != "Unknown", stored).otherwise(by_path)


def effective_role_sql(path: str, stored: str) -> str:
    by_path = path_role_sql(path)
    return f"CASE WHEN {by_path} = 'Test' THEN 'Test' WHEN coalesce({stored}, 'Unknown') <> 'Unknown' THEN {stored} ELSE {by_path} END"


#: Which roles an analysis profile looks at.
PROFILES = {
    "FullInventory": ["Source", "Test", "Migration", "Snapshot", "Generated", "BuildArtifact", "Configuration", "Unknown"],
    "DesignSmells": ["Source", "Unknown"],
    "TestShield": ["Source", "Test", "Unknown"],
    "CoverageGaps": ["Source", "Test", "Unknown"],
    "Architecture": ["Source", "Unknown"],
    "DuplicateDetection": ["Source", "Unknown"],
    "Documentation": ["Configuration", "Source", "Unknown"],
    "AgentContext": ["Source", "Test", "Configuration", "Unknown"],
}


def in_segment(value: Column, segment: str) -> Column:
    """Whether a dotted name has the segment, in any letter case."""
    return F.coalesce(F.concat(F.lit("."), F.lower(value), F.lit(".")).contains(f".{segment.lower()}."), F.lit(False))


def layer(namespace: Column, path: Column) -> Column:
    """Tests, Core, Application, Infrastructure, API or Unknown, by namespace or path."""
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    out = F.when(in_segment(namespace, "Test") | p.contains("/tests/"), "Tests")
    for name in ("Core", "Application", "Infrastructure"):
        out = out.when(in_segment(namespace, name) | p.contains(f"/{name.lower()}/"), name)
    return out.when(
        in_segment(namespace, "Api") | in_segment(namespace, "McpServer") | p.contains("/api/") | p.contains("/mcpserver/"), "API"
    ).otherwise("Unknown")


def layer_sql(namespace: str = "namespace", path: str = "file_path") -> str:
    seg = lambda s: f"coalesce(contains('.' || lower({namespace}) || '.', '.{s.lower()}.'), false)"
    p = f"lower(replace(coalesce({path}, ''), '\\', '/'))"
    whens = f"WHEN {seg('Test')} OR contains({p}, '/tests/') THEN 'Tests'"
    for n in ("Core", "Application", "Infrastructure"):
        whens += f" WHEN {seg(n)} OR contains({p}, '/{n.lower()}/') THEN '{n}'"
    return f"CASE {whens} WHEN {seg('Api')} OR {seg('McpServer')} OR contains({p}, '/api/') OR contains({p}, '/mcpserver/') THEN 'API' ELSE 'Unknown' END"


#: What the indexer must have supplied for a vertex type.
_CODE_TYPES = ["Class", "Struct", "Interface", "Method", "Delegate", "Property", "Field", "Event", "Indexer", "Operator", "Enum"]
NEEDS_PATH = [*_CODE_TYPES, "File", "Module", "ConfigurationFile", "ConfigurationEntry"]
NEEDS_LINE = _CODE_TYPES
NEEDS_HASH = [*_CODE_TYPES, "File", "Module", "ConfigurationFile"]


def freshness(prefix: str = "") -> Column:
    """High, Medium or Low confidence in what is stored about a vertex."""
    c = lambda n: F.col(prefix + n)
    has_path = F.coalesce(F.trim(c("file_path")) != "", F.lit(False))
    has_line = F.coalesce(c("line_number") > 0, F.lit(False)) | F.coalesce(c("line_count") > 0, F.lit(False))
    has_hash = F.coalesce(F.trim(c("source_hash")) != "", F.lit(False))
    need = lambda kinds: F.coalesce(c("type").isin(kinds), F.lit(False))
    return (
        F.when(c("updated_at").isNull() | (need(NEEDS_PATH) & ~has_path), "Low")
        .when((need(NEEDS_LINE) & ~has_line) | (need(NEEDS_HASH) & ~has_hash), "Medium").otherwise("High")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def spread_identifier(text: Column) -> Column:
    """Blanks at the inner boundaries of identifiers and instead of separators, but not of apostrophes."""
    t = F.regexp_replace(text, "[_\\-./\\\\:\\s]|(?!')\\p{P}", " ")
    t = F.regexp_replace(t, "(?<=\\p{Ll})(?=\\p{Lu})|(?<=\\p{L})(?=\\p{Nd})|(?<=\\p{Nd})(?=\\p{L})|(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})", " ")
    return t


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs of a text after spreading identifiers; null for null."""
    return F.filter(F.split(F.lower(spread_identifier(text)), "[^\\p{L}\\p{Nd}]+"), lambda x: x != "")


#: Words that are no keywords, and short ones that are.
STOPWORDS = (
    "the and for with from into this that new get set has had can use used using class record string bool void task async await public private "
    "internal static sealed return null true false"
).split()
SHORT_TERMS = "api mcp cli sdk jwt sql ast ef ts".split()


def is_keyword(token: Column, least: int = 4) -> Column:
    """Whether a token may be a keyword: no GUID, long hex run, number or stopword, and long enough."""
    return (
        ~token.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & ~token.rlike("^[0-9a-f]{16,}$")
        & ~token.rlike("^\\p{Nd}+$") & ~token.isin(STOPWORDS) & ((F.length(token) >= least) | token.isin(SHORT_TERMS))
    )


#: Parts of a key whose value is secret.
SECRET_TOKENS = ["password", "secret", "token", "apikey", "api_key", "connectionstring", "connection_string", "privatekey", "private_key"]


def mask_value(key: Column, value: Column) -> Column:
    """Empty for null and blank values, stars for those of a secret key, else the first 80 characters without quotes."""
    plain = F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "").when(F.lower(key).rlike("|".join(SECRET_TOKENS)), "***").otherwise(F.substring(plain, 1, 80))


def config_key(key: Column) -> Column:
    """A configuration key without outer quotes and blanks, double underscores as colons."""
    return F.replace(F.regexp_replace(F.trim(key), "^[\"']+|[\"']+$", ""), F.lit("__"), F.lit(":"))


def route_template(route: Column) -> Column:
    """A route without host, query and fragment, parameters as {param}, single slashes, in lower case."""
    r = F.regexp_replace(F.trim(route), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    r = F.regexp_replace(r, "[?#].*$", "")
    r = F.regexp_replace(r, "\\{[^}/]*\\}|(?<=/):[A-Za-z_][A-Za-z0-9_]*", "{param}")
    r = F.regexp_replace(F.concat(F.lit("/"), r), "/+", "/")
    r = F.lower(F.when(F.length(r) > 1, F.regexp_replace(r, "/$", "")).otherwise(r))
    return r


def collapse_path(path: Column) -> Column:
    """A relative path with forward slashes, ``.`` dropped and ``..`` resolved where something is above."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
    )
    return F.array_join(kept, "/")


def selector_specificity(selector: Column) -> Column:
    """(ids, classes with attributes and pseudo-classes, elements with pseudo-elements) of a CSS selector."""
    s = F.regexp_replace(selector, "\\[[^\\]]*\\]", ".attr")
    pseudo_elements = F.regexp_count(s, F.lit("::[A-Za-z-]+"))
    s2 = F.regexp_replace(s, "::[A-Za-z-]+", "")
    classes = F.regexp_count(s2, F.lit("\\.[A-Za-z_-][A-Za-z0-9_-]*")) + F.regexp_count(s2, F.lit(":[A-Za-z-]+"))
    ids = F.regexp_count(s2, F.lit("#[A-Za-z_-][A-Za-z0-9_-]*"))
    elements = F.regexp_count(F.regexp_replace(s2, "[#.:][A-Za-z_-][A-Za-z0-9_-]*(\\([^)]*\\))?", " "), F.lit("[A-Za-z][A-Za-z0-9-]*"))
    return F.struct(ids.alias("a"), classes.alias("b"), (elements + pseudo_elements).alias("c"))
