"""Files that are not hand-written: generated, minified, built, copied from others, or data.

Repositories declare such paths in attribute files (``linguist-generated``, ``linguist-vendored``); the nearest
directory and the last line win, for each attribute apart. From all paths that are declared, patterns are mined
(directories, pairs of directories, name endings) and applied to repositories without an attribute file. A file's
text and the reference items show the rest.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versions import in_force
from .functions import of_type

#: Directories into which build and package tools write or fetch, at any depth, and endings of names
#: they give. They stand for the attribute file of a repository without one.
VENDORED_DIRS = """
node_modules/ bower_components/ jspm_packages/ vendor/ third_party/ third-party/ thirdparty/ 3rdparty/
external/*[-.@][0-9]*/ externals/ extern/ packages/*.[0-9]*/ Pods/ Carthage/ site-packages/ .yarn/
""".split()
GENERATED_DIRS = """
bin/Debug/ bin/Release/ bin/x64/ bin/x86/ obj/ dist/ build/ out/ compiled/ .next/ .nuxt/ .output/
.svelte-kit/ .angular/ .parcel-cache/ .turbo/ coverage/ lcov-report/ storybook-static/ __generated__/
generated/ gen/ autogen/ __snapshots__/ __pycache__/ target/debug/ target/release/ target/classes/
target/generated-sources/
""".split()
GENERATED_NAMES = """
*.min.* *-min.js *-min.css *.bundle.js *.chunk.js
*.[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f]*.js *.map *.g.cs *.g.i.cs *.designer.cs
*.designer.vb *.generated.* *.gen.* *.pb.* *_pb.* *_pb2.py *_grpc.* *.freezed.dart *AssemblyInfo.cs
*.AssemblyAttributes.cs TemporaryGeneratedFile_* *ModelSnapshot.cs *.snap package-lock.json
""".split()
DEFAULT_ATTRIBUTES = "\n".join(
    [f"**/{d}** linguist-vendored" for d in VENDORED_DIRS] + [f"**/{d}** linguist-generated" for d in GENERATED_DIRS] + [f"{n} linguist-generated" for n in GENERATED_NAMES]
)
#: The attributes that count, and the roles an index gives to files that are not hand-written.
ATTRIBUTES = ("linguist-generated", "linguist-vendored")
NOT_WRITTEN = ("generated", "buildartifact", "snapshot")
#: Openings of a comment in which a tool says that it wrote the file.
_WRITTEN_BY_TOOL = re.compile(
    r"^(?:<auto-?generated\b|@generated\b|\[?(?:this (?:file|code|source|class|module) (?:was|is|has been) )?(?:auto(?:matically)?[- ]?)?(?:generated|produced|created|emitted|written|built) (?:code |file )?(?:by|from|with|using|via) (?:a |an |the )?[\w`.@-]+"
    r"|(?:this|the) (?:file|code|source|class|module|content) (?:was|is|has been|were) (?:auto|machine|automatically)[- ]?(?:generated|written|produced|created)"
    r"|code generated by\b|auto-?(?:matically )?[- ]?generated\b|machine[- ](?:generated|written|made)\b|generated (?:code|file|source|on|at|automatically)\b"
    r"|automatisch (?:erzeugt|generiert|erstellt)|(?:diese datei|dieser code) (?:wurde|ist) (?:automatisch|maschinell)?.{0,20}(?:erzeugt|generiert|erstellt)|maschinell erzeugt"
    r"|(?:ce|cette) (?:fichier|code|classe) (?:est|a été) (?:généré|produit)e?|généré(?:e)? (?:par|automatiquement)|fichier généré"
    r"|(?:este (?:archivo|fichero|código|arquivo|ficheiro) (?:ha sido|fue|es|foi) )?(?:generado|gerado|creado|criado) (?:por|autom[áa]ticamente|automaticamente)|archivo generado|arquivo gerado"
    r"|(?:questo file )?(?:è stato )?generato (?:da|automaticamente)|(?:dit bestand is )?(?:automatisch )?gegenereerd|wygenerowano|сгенерировано|自动生成|自動生成|此文件由"
    r"|do not (?:edit|modify|change)\b|don't edit\b)",
    re.I,
)
#: Words with which a person denies it or writes about such files.
_DENIED = re.compile(r"\b(?:nothing|not|never|isn'?t|wasn'?t|no longer|by hand|hand-?written|handwritten|ours|freely|edit me|was once|used to|instead of|replaces?|compares?|parses?|reads?|checks?|detects?|serves?|unlike)\b", re.I)
_NOT_EDIT = re.compile(r"do(?: |-)?n[o']t (?:edit|modify|change|touch)|not be (?:edited|modified|changed)", re.I)
#: A banner that names a package and its version.
_BANNER = re.compile(r"^(?:@license\s+|@preserve\s+)?@?[a-z][\w./-]*(?:\s+v?|@|\s*-\s*v)\d+\.\d+(?:\.\d+)*\b", re.I)
_RIGHTS = re.compile(r"licen[cs]e|\(c\)|©|copyright|contributors|released under|@preserve", re.I)
_NUMBER = re.compile(r"-?(?:0[xX][0-9A-Fa-f]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{80,}|(?<=[\"'])[0-9A-Fa-f]{6,}(?=[\"'])|(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}){8,}")
_SEPARATORS = re.compile(r"[\s,;:\[\](){}\"'`=]+")


def tidy_path(path: str | None) -> str:
    """The path with forward slashes, without empty and ``.`` parts; empty for null."""
    return "/".join(p for p in (path or "").strip().replace("\\", "/").split("/") if p and p != ".")


@lru_cache(4096)
def glob_regex(pattern: str) -> str | None:
    """The regular expression of an attribute-file pattern, over a path below the file's directory.

    A slash at the start or inside ties the pattern to that directory; else it is about names at any depth. ``**/``
    at the start, ``/**`` at the end and ``/**/`` stand for directories. A pattern with a trailing slash is about
    directories only and so about no file; it and the empty and negated patterns give None.
    """
    if not pattern or pattern.endswith("/") or pattern.startswith("!"):
        return None
    tied = "/" in pattern
    p = pattern.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and i and p[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            inner = p[i + 1 : end]
            no = inner[0] in "!^"
            out, i = out + "(?!/)[" + "^" * no + re.sub(r"([\\\[\]^&])", r"\\\1", inner[no:]) + "]", end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if tied else "^(?:.*/)?") + out + "$"


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\s+|$)')
_MACRO = "[attr]"


def _split_line(line: str) -> tuple[str, list[str]]:
    """The pattern of a line, unquoted, and its attributes."""
    m = _QUOTED.match(line)
    if not m:
        pattern, *rest = line.split()
        return pattern, rest
    known = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
    plain = re.sub(r"\\([0-7]{3}|.)", lambda x: chr(int(x[1], 8)) if len(x[1]) == 3 else known.get(x[1], x[1]), m[1])
    return plain, line[m.end() :].split()


def attribute_macros(text: str | None) -> dict[str, list[str]]:
    """Attributes that each macro of a top-level attribute file stands for; the last definition holds."""
    out = {}
    for line in (text or "").splitlines():
        name, *rest = line.strip().split() or [""]
        if name.startswith(_MACRO) and len(name) > len(_MACRO):
            out[name[len(_MACRO) :]] = rest
    return out


def attribute_rules(text: str | None, macros: dict[str, list[str]] | None = None) -> list[tuple[int, int, str, str, int]]:
    """Line, place in the line, regular expression, attribute and state of each rule about generated or vendored
    paths: 1 set, 0 unset or false, -1 unspecified again (``!``). Macros count where they are set."""
    rules = []
    for n, line in enumerate((text or "").splitlines()):
        line = line.strip()
        if not line or line.startswith(("#", _MACRO)):
            continue
        pattern, attributes = _split_line(line)
        regex = glob_regex(pattern)
        if regex is None:
            continue
        flat: list[str] = []

        def spread(names: list[str], within: tuple[str, ...] = ()) -> None:
            for a in names:
                flat.append(a)
                if macros and a in macros and a not in within:
                    spread(macros[a], (*within, a))

        spread(attributes)
        for k, a in enumerate(flat):
            m = re.fullmatch(r"([-!]?)([^=\s]+)(?:=(.*))?", a)
            if m and m[2] in ATTRIBUTES:
                off = m[1] == "-" or (m[3] is not None and m[3].lower() == "false")
                rules.append((n, k, regex, m[2], -1 if m[1] == "!" else 0 if off else 1))
    return rules


@lru_cache(1)
def _default() -> re.Pattern:
    """The built-in rules, for paths in any letter case."""
    return re.compile("|".join(f"(?:{r})" for _, _, r, _, state in attribute_rules(DEFAULT_ATTRIBUTES) if state == 1), re.I)


def head_comments(text: str) -> list[str]:
    """The lines of the comments before the first code, without comment signs. Directives are passed over."""
    out, inside = [], False
    for line in text.lstrip("﻿").splitlines():
        s = line.strip()
        if inside:
            end = s.find("*/")
            out.append(re.sub(r"^\*+\s?", "", s if end < 0 else s[:end]).strip())
            inside = end < 0
            if end >= 0 and s[end + 2 :].strip():
                break
        elif s.startswith("/*"):
            end = s.find("*/", 2)
            out.append(re.sub(r"^/\*+!?\s?", "", s if end < 0 else s[:end]).strip())
            inside = end < 0
            if end >= 0 and s[end + 2 :].strip():
                break
        elif re.match(r"//|--\s|;|'|<!--|#(?!nullable|pragma|region|endregion|if|endif|include|define|line)", s):
            out.append(re.sub(r"^(?://+!?|--+|;+|'+|<!--+|#+!?)\s?|\s*--+>$", "", s).strip())
        elif s and not s.startswith("#"):
            break
    return out


def text_sign(text: str | None) -> str | None:
    """What the text itself shows: generated, vendored, data, minified or nothing (null)."""
    if not text or not text.strip():
        return None
    head = head_comments(text)
    for line in head:
        if _WRITTEN_BY_TOOL.match(line) and not _DENIED.search(_NOT_EDIT.sub(" ", re.sub(r"(?i)nicht von hand|not by hand|by hand (?:will|is|are)", " ", line))):
            return "generated"
    if any(_BANNER.match(x) for x in head[:3]) and any(_RIGHTS.search(x) for x in head):
        return "vendored"
    body = text.strip()
    if len(body) >= 200:
        rest = _BLOB.sub(" ", body)
        data = len(body) - len(rest)
        rest2 = _NUMBER.sub(" ", rest)
        data += len(rest) - len(rest2)
        words = len(_SEPARATORS.sub("", rest2))
        if data > 2 * words:
            return "data"
        spaces = sum(map(body.count, " \t\n\r"))
        if spaces < 0.08 * len(body) and max(map(len, body.split("\n"))) >= 200:
            return "minified"
    if re.search(r"//[#@] sourceMappingURL=", body):
        return "minified"
    return None


def shingles(text: str | None, n: int = 5) -> set[int]:
    """Hashes of runs of n words of code, comments left out."""
    from hashlib import blake2b

    from .comments import split_comments

    if not text:
        return set()
    words = re.findall(r"\w+", split_comments(text)[0])
    return {
        int.from_bytes(blake2b("\0".join(words[i : i + n]).encode("utf-8"), digest_size=8).digest(), "big", signed=True)
        for i in range(len(words) - n + 1)
    }


def path_keys(path: str) -> list[str]:
    """What a pattern can be mined from, in any letter case: the directories of a path, pairs of them, the
    endings of its name."""
    *dirs, name = path.lower().split("/")
    keys = {f"{d}/" for d in dirs} | {f"{a}/{b}/" for a, b in zip(dirs, dirs[1:])}
    parts = name.split(".")
    if len(parts) > 2:
        keys.add("*." + ".".join(parts[1:]))
    m = re.search(r"[-_][a-z]+\.\w+$", name)
    if m:
        keys.add("*" + m[0])
    return sorted(keys)


_SIGN = pa.schema([
    ("id", pa.string()), ("project", pa.string()), ("path", pa.string()), ("role", pa.string()), ("blank", pa.bool_()),
    ("sign", pa.string()), ("listed", pa.bool_()), ("keys", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64())), ("rules", pa.string()),
])


def _signs(batches):
    default = _default()
    for b in batches:
        rows = []
        for i, project, path, role, text in zip(*(b.column(k).to_pylist() for k in range(5))):
            p = tidy_path(path)
            attributes = p.rsplit("/", 1)[-1] == ".gitattributes"
            rows.append({
                "id": i, "project": project or "", "path": p, "role": (role or "").strip().lower(), "blank": not (text or "").strip(),
                "sign": None if attributes else text_sign(text), "listed": bool(p and default.match(p)), "keys": path_keys(p) if p else [],
                "shingles": sorted(shingles(text)), "rules": text if attributes else None,
            })
        yield pa.RecordBatch.from_pylist(rows, schema=_SIGN)


def _item_shingles(batches):
    for b in batches:
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], names=["item", "shingles"])


_RULE = "project string, dir string, line int, place int, regex string, attribute string, state int"


def _rules(batches):
    for b in batches:
        rows = [
            {"project": pr, "dir": p.rsplit("/", 1)[0] + "/" if "/" in p else "", "line": n, "place": k, "regex": r, "attribute": a, "state": v}
            for pr, p, text, top in zip(*(b.column(k).to_pylist() for k in range(4)))
            for n, k, r, a, v in attribute_rules(text, attribute_macros(top))
        ]
        schema = pa.schema([
            ("project", pa.string()), ("dir", pa.string()), ("line", pa.int32()), ("place", pa.int32()), ("regex", pa.string()), ("attribute", pa.string()), ("state", pa.int32()),
        ])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


#: Parts into which the files of one directory are dealt when they meet its rules.
SALTS = 16


def declarations(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, declared`` of files (``id, project, path``) of which an attribute file (``project, path, rules``) says something.

    Of the rules of all attribute files above a path those that match are compared for each attribute: the deepest
    directory wins, then the last line, then the last place in the line. ``declared`` is true if an attribute ends
    up set, false if one ends up unset and none set; paths left unspecified have no row. Macros come from the
    attribute file at the top of the project. Files of one directory are dealt to several tasks.
    """
    top = sources.where("path = '.gitattributes'").groupBy("project").agg(F.max("rules").alias("top"))
    rules = sources.join(top, "project", "left").select("project", "path", "rules", "top").mapInArrow(_rules, _RULE)
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        files.where("path != ''").select("id", "project", "path", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(up).alias("dir"))
        .join(dealt, ["project", "dir", "salt"])
        .where(F.expr("substring(path, length(dir) + 1) rlike regex"))
        .groupBy("id", "attribute").agg(F.max_by("state", F.struct(F.length("dir"), "line", "place")).alias("state"))
        .groupBy("id").agg(F.max("state").alias("state")).where("state >= 0").select("id", (F.col("state") == 1).alias("declared"))
    )


def mined_patterns(declared: DataFrame, support: int, precision: float, projects: int) -> DataFrame:
    """``key`` of patterns (see :func:`path_keys`) that hold of at least ``support`` declared files in at least
    ``projects`` projects, ``precision`` of them declared not hand-written. ``declared``: ``project, keys, off``."""
    return (
        declared.select("project", F.explode("keys").alias("key"), F.col("off").cast("int").alias("e"))
        .groupBy("key", "project").agg(F.count("*").alias("n"), F.sum("e").alias("e"))
        .groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.count("*").alias("projects"))
        .where((F.col("n") >= support) & (F.col("projects") >= projects) & (F.col("e") >= precision * F.col("n"))).select("key")
    )


def not_hand_written(
    nodes: DataFrame, items: DataFrame, similarity: float = 0.8, support: int = 5, precision: float = 0.8, projects: int = 2, least_shingles: int = 10
) -> DataFrame:
    """``id, path, reason`` of the files in force that are not hand-written source.

    The reason is the first of: what the text shows (``generated``, ``vendored``, ``data``, ``minified``); ``copy``,
    if at least ``similarity`` of its five-word shingles (at least ``least_shingles``) stand in one reference item;
    ``declared`` by the attribute files of its project (:func:`declarations`); in projects without attribute files
    ``mined``, a pattern mined from declared paths (:func:`mined_patterns`), and ``listed``, the built-in patterns;
    ``role``, a stored role of generated, build artefact or snapshot where there is no text that could show otherwise.

    Paths are declared by attribute files and, in projects that have none, by the stored role: one of generated
    files or one of written files; an unknown or missing role declares nothing. Roles are out of date at times,
    hence a precision below 1. Files without a path are judged by text and role. Shingles are compared by an
    equi-join on the shingle, items first thinned to distinct ones. Ids are unique among the rows in force.
    """
    from ..plans.session import Workspace

    ws = Workspace(nodes.sparkSession, "files")
    row = F.when(of_type("type", "File"), F.struct("project_context", "file_path", "file_role", "source_snippet"))
    files = in_force(nodes, [row.alias("r")]).where("r is not null").select("id", "r.*")
    signs = ws.cut(
        files.mapInArrow(_signs, "id string, project string, path string, role string, blank boolean, sign string, listed boolean, keys array<string>, shingles array<bigint>, rules string")
    )
    ours = signs.where("rules is null")

    reference = items.select(F.col("item_id").alias("item"), "content").mapInArrow(_item_shingles, "item bigint, shingles array<bigint>")
    known = reference.select("item", F.explode("shingles").alias("h")).distinct()
    mine = ours.where(F.size("shingles") >= least_shingles).select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    copies = (
        mine.join(known, "h").groupBy("id", "item").agg(F.count("*").alias("same"), F.first("n").alias("n"))
        .where(F.col("same") >= similarity * F.col("n")).select("id").distinct().withColumn("copy", F.lit(True))
    )

    sources = signs.where("rules is not null").select("project", "path", "rules")
    declared = declarations(ours, sources)
    ruled = sources.select("project").distinct().withColumn("ruled", F.lit(True))
    known_paths = ours.join(declared, "id", "left").join(ruled, "project", "left").withColumn("ruled", F.coalesce("ruled", F.lit(False)))
    role_off = F.col("role").isin(*NOT_WRITTEN)
    stated = known_paths.where("path != '' and (ruled or role not in ('', 'unknown'))").select(
        "project", "keys", F.when(F.col("ruled"), F.coalesce("declared", F.lit(False))).otherwise(role_off).alias("off")
    )
    patterns = mined_patterns(stated, support, precision, projects)
    mined = (
        known_paths.where("not ruled").select("id", F.explode("keys").alias("key")).join(patterns, "key", "left_semi")
        .select("id").distinct().withColumn("mined", F.lit(True))
    )

    all_ = known_paths.join(copies, "id", "left").join(mined, "id", "left")
    reason = (
        F.when(F.col("sign").isNotNull(), F.col("sign"))
        .when(F.col("copy"), "copy")
        .when(F.col("declared"), "declared")
        .when(F.col("mined"), "mined")
        .when(F.col("listed") & ~F.col("ruled"), "listed")
        .when(role_off & F.col("blank") & F.coalesce(F.col("declared"), F.lit(True)), "role")
    )
    return all_.select("id", "path", reason.alias("reason")).where("reason is not null")
