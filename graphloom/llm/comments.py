"""Comments, functions and what a piece of documentation says."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

#: A comment, a string, or the start of neither. Strings are matched so that comment signs in them do not count.
_LEX = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))"""
    r"""|(?P<string>@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"^\s*(?:\[[^\]\n]*\]\s*|@[A-Za-z_][\w.]*(?:\([^)\n]*\))?\s*|#\s*(?:pragma|nullable|region|endregion|if|endif|line|warning)\b.*)+$")
_FUNCTION = re.compile(
    r"^[ \t]*(?:(?:export|default|async|public|private|protected|internal|static|override|virtual|sealed|abstract|partial|extern|unsafe|readonly|new)\s+)*"
    r"(?:function\s*\*?\s*(?P<f>[A-Za-z_$][\w$]*)\s*[(<]"
    r"|(?:const|let|var)\s+(?P<c>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^\n]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>"
    r"|(?:[A-Za-z_][\w<>,.\[\]? ]*\s+)?(?P<m>[A-Za-z_$][\w$]*)\s*(?:<[^>(\n]*>)?\([^;\n]*\)\s*(?::\s*[^{;=\n]+)?(?:where[^{\n]*)?(?:\{|=>|$))",
)
#: Fixed words: what looks like a call but heads no function.
_NO_FUNCTION = {"if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "else", "do", "new", "await", "throw", "typeof", "nameof", "fixed", "checked"}


def split_comments(source: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The source with comments blanked out, and the comments with their first and last line (from 0).

    Comments on adjacent lines with no code between belong together if both run to the end of the line.
    """
    spans = [m.span("comment") for m in _LEX.finditer(source) if m.group("comment") is not None]
    if not spans:
        return source, []
    code, at = [], 0
    for s, e in spans:
        code += [source[at:s], re.sub(r"[^\n]", " ", source[s:e])]
        at = e
    code.append(source[at:])
    line_at = [0]
    for ch in re.finditer("\n", source):
        line_at.append(ch.end())
    found: list[tuple[int, int, str]] = []
    for s, e in spans:
        a, b, text = bisect_right(line_at, s) - 1, bisect_right(line_at, e - 1) - 1, source[s:e]
        if found and text.startswith("//"):
            _, pb, before = found[-1]
            if before.startswith("//") and pb == a - 1 and not source[line_at[a] : s].strip():
                found[-1] = (found[-1][0], b, before + "\n" + text)
                continue
        found.append((a, b, text))
    return "".join(code), found


def functions(code_lines: list[str]) -> list[tuple[int, str]]:
    """Line and name of each function heading in source without comments."""
    out = []
    for i, line in enumerate(code_lines):
        m = _FUNCTION.match(line)
        name = m and (m["f"] or m["c"] or m["m"])
        if name and name not in _NO_FUNCTION and not line.lstrip().startswith(("return ", "await ", "throw ", "new ", "else ", ".")):
            out.append((i, name))
    return out


def assign(weight: dict[tuple[int, int], float]) -> dict[int, int]:
    """Row of each column in the matching of greatest total weight; only pairs with a positive weight can match.

    Rows and columns that hang together are solved apart by the Hungarian method, where every row may also stay
    alone at no weight. Of equal matchings the one of smaller rows and columns is taken.
    """
    by_row: dict[int, list[int]] = {}
    by_col: dict[int, list[int]] = {}
    for (r, c), w in sorted(weight.items()):
        if w > 0:
            by_row.setdefault(r, []).append(c)
            by_col.setdefault(c, []).append(r)
    out: dict[int, int] = {}
    left = dict.fromkeys(by_row)
    while left:
        rows, cols, todo = [], [], [next(iter(left))]
        seen = set()
        while todo:
            r = todo.pop()
            if r not in left:
                continue
            del left[r]
            rows.append(r)
            for c in by_row[r]:
                if c not in seen:
                    seen.add(c)
                    cols.append(c)
                    todo += by_col[c]
        rows.sort()
        cols.sort()
        cost = [[-weight.get((r, c), -1.0) for c in cols] + [0.0] * len(rows) for r in rows]
        out.update({cols[k]: rows[i] for i, k in enumerate(_hungarian(cost)) if k < len(cols) and cost[i][k] < 0})
    return out


def _hungarian(cost: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest assignment of all rows; not more rows than columns."""
    n, m = len(cost), len(cost[0])
    u, v, row_of, before = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        slack, done = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            done[at] = True
            r, step, to = row_of[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    d = cost[r - 1][j - 1] - u[r] - v[j]
                    if d < slack[j]:
                        slack[j], before[j] = d, at
                    if slack[j] < step:
                        step, to = slack[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    slack[j] -= step
            at = to
        while at:
            row_of[at], at = row_of[before[at]], before[at]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


_PARAM = re.compile(r"@(?:param|arg|argument)\s+(?:\{[^}]*\}\s*)?\[?([A-Za-z_$][\w$]*)|<param\s+name\s*=\s*\"([^\"]*)\"")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
#: Lines from a comment to a heading within which they are candidates, and the weight below which a link is implausible.
NEAR, PLAUSIBLE = 12, 0.5
#: Weights: the place of the comment (directly above; apart by blank lines; with code between or inside the body),
#: all its parameter tags fit or none does, it names the function or another one of the source, the row's own summary.
ABOVE, APART, ASTRAY, TAGS, NO_TAG, NAMED, OTHER_NAMED, SUMMARY = 1.0, 0.45, 0.2, 0.5, -0.4, 0.25, -0.3, 1.5


class Link(NamedTuple):
    """A description linked with a function."""

    line: int
    name: str
    text: str
    origin: str
    direct: bool
    weight: float
    own: bool


def _blocks(comments, lines, raw) -> list[tuple[int, int, list[str]]]:
    """Runs of comments with nothing but attributes and directives between them, with their first and last line."""
    out: list[tuple[int, int, list[str]]] = []
    for a, b, text in comments:
        if out and all(raw[i].strip() and (not lines[i].strip() or _ATTRIBUTE.match(lines[i])) for i in range(out[-1][1] + 1, a)) and a > out[-1][1]:
            out[-1] = (out[-1][0], b, [*out[-1][2], text])
        else:
            out.append((a, b, [text]))
    return out


def _weight(text: str, names: set[str], place: float, name: str, signature: set[str]) -> float:
    """How well the text of a comment and a function fit together."""
    w = place
    tags = {x or y for x, y in _PARAM.findall(text)}
    if tags:
        fit = len(tags & signature) / len(tags)
        w += TAGS * fit if fit else NO_TAG
    said = {x.lower() for x in _WORD.findall(text)}
    if name.lower() in said:
        w += NAMED
    elif said & names:
        w += OTHER_NAMED
    return w


def documented(source: str, name: str | None = None, summary: str | None = None) -> list[Link]:
    """The description of each function of the source that has one, in order of the functions.

    Candidates are the blocks of comments of which something is left once comments that say nothing are dropped
    (judged for the function at hand), and the summary for the function of the given name. A block is a candidate for
    every function up to NEAR lines away, above or below. Weights come from the place of the block, from its
    parameter tags against the heading and from the names it mentions; a link below PLAUSIBLE is rejected. Of the
    others the matching of greatest weight is kept: a function has one description, a block one function.
    ``direct`` says that only attributes stand between block and heading, ``own`` that it is the first function of
    the given name, or the first of all where no heading has the name. A source without a recognised heading
    is one function that starts at the first line of code.
    """
    code, comments = split_comments(source)
    lines, raw = code.split("\n"), source.split("\n")
    heads = functions(lines)
    if not heads or (name and not any(n == name for _, n in heads)):
        code_at = [i for i, x in enumerate(lines) if x.strip()]
        first = next((i for i in code_at if not _ATTRIBUTE.match(lines[i])), code_at[-1] if code_at else None)
        if first is not None and not any(i == first for i, _ in heads):
            heads = sorted([*heads, (first, name or "")])
    told: dict[tuple[int, int], str] = {}
    weight: dict[tuple[int, int], float] = {}
    direct: set[tuple[int, int]] = set()
    names = {n.lower() for _, n in heads}
    signatures = [set(_WORD.findall(" ".join(lines[h : h + 3]))) for h, _ in heads]
    at = [h for h, _ in heads]
    for k, (a, b, texts) in enumerate(_blocks(comments, lines, raw)):
        alone = not lines[a].strip()  # no code on its first line
        for c in range(bisect_left(at, a - NEAR), bisect_right(at, b + NEAR)):
            head, fn = heads[c]
            between = range(b + 1, head) if head > b else ()
            plain = alone and head > b and all(not lines[i].strip() or _ATTRIBUTE.match(lines[i]) for i in between)
            near = plain and all(raw[i].strip() for i in between)
            say = [clean(t) for t in texts if says_something(t, fn)]
            if not say:
                continue
            place = ABOVE if near else APART if plain else ASTRAY
            w = _weight("\n".join(texts), names - {fn.lower()}, place, fn, signatures[c])
            if w >= PLAUSIBLE:
                told[k, c], weight[k, c] = "\n".join(say), w
                if near:
                    direct.add((k, c))
    mine = next((c for c, (_, n) in enumerate(heads) if n == name), 0)
    if heads and says_something(summary, name):
        told[-1, mine], weight[-1, mine] = clean(summary), SUMMARY
        direct.add((-1, mine))
    return [
        Link(heads[c][0], heads[c][1], told[k, c], "summary" if k < 0 else "comment", (k, c) in direct, weight[k, c], c == mine)
        for c, k in sorted(assign(weight).items())
    ]


_LEGAL = re.compile(r"copyright|\(c\)\s|©|all rights reserved|licen[cs]ed? under|under the .{0,40}licen[cs]e|spdx-license|\blicen[cs]e\b.{0,30}\bversion\b|see (?:the )?(?:notice|licen[cs]e)\b", re.I)
_TOOL = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier|stylelint|biome|oxlint|istanbul|c8|v8|webpack|vite|noinspection|resharper|nosonar|sonar|pylint|noqa|nolint|codeql|coverage|"
    r"clang-format|ts-(?:ignore|nocheck|check|expect-error)|@ts-\w+|@formatter|pragma|globals?\b|jscpd|cspell|spell-?checker|#?\s*(?:end)?region\b|#?\s*sourcemappingurl|"
    r"vim?:|-\*-|auto-?generated|<auto-?generated|@generated|@internal\s*$|@override\s*$|suppress)",
    re.I,
)
_TAGS_OFF = re.compile(r"<(param|typeparam|exception|permission|seealso)\b[^>]*?(?:/>|>.*?</\1\s*>)", re.S | re.I)
_REF = re.compile(r"<(?:see|seealso|paramref|typeparamref)\b[^>]*?(?:cref|name|langword|href)\s*=\s*\"([^\"]*)\"[^>]*?/?>", re.I)
_INHERIT = re.compile(r"<inherit-?doc\b[^>]*?/?>|\{?@inherit-?doc\b[^}\s]*\}?", re.I)
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:return|throw|await|if|for|foreach|while|switch|case|var|let|const|import|using|public|private|protected|internal|static|export|new)\b.*[(){};=]"
    r"|^[\w.$\[\]]+\s*(?:[-+*/]?=|\+\+|--)\s*\S|^[\w.$]+\([^()]*\)[;,]?\s*$|^\s*[)\]}]+[;,]?\s*$|=>\s*$|^</?\w+>$|^\.\w+(?:<[^<>]*>)?\(.*\)[;,]?$|^return\s+[\w.]+$"
)
#: A heading on a line of its own, with a modifier or keyword before the name and parameters after it.
_HEADING = re.compile(
    r"^(?:(?:export|default|async|public|private|protected|internal|static|override|virtual|sealed|abstract|partial|extern|unsafe|readonly|new|function)\s+)+[\w<>,.\[\]?$ ]*\([^()]*\)\s*(?::\s*[\w<>\[\], |.]+)?$"
    r"|^(?:if|for|foreach|while|switch|catch|using|lock|else if|fixed|synchronized)\s*\(.*\)$|^(?:else|try|finally|do)$"
)
#: Phrases that stand where documentation should be.
_PLACEHOLDER = re.compile(
    r"(?:(?:to-?do|fix-?me|tbd|tba|xxx+|hack|wip)\b(?:[\s:.,-]+(?:(?:add|write|document|describe|complete|fill|finish|update|insert|provide|explain|improve)\w*|docs?|documentation|doc|comments?|descriptions?|summary|this|that|the|me|it|in|a|here|later|method|function|class|property|member|and|more|details?)\b)*"
    r"|n\.?/?a\.?|none|null|nil|empty|blank|undocumented|not documented(?: yet)?|no (?:documentation|docs?|description|summary|comment)s?(?: (?:available|provided|yet|given|here))?"
    r"|missing (?:documentation|docs?|description|summary|comment)|(?:documentation|docs?|description|summary|comment|text)(?: (?:is )?(?:goes here|missing|pending|here|to follow|needed|required|to be (?:added|written|done)))?"
    r"|to be (?:written|done|defined|documented|added|completed|determined|described)|(?:add|insert|enter|write|put|your|some) (?:your |a |the |some )?(?:description|docs?|documentation|summary|comment|text)(?: here)?"
    r"|(?:same|as) (?:as )?(?:above|below|before|the base|base)(?: (?:class|method))?|see (?:the )?(?:base(?: class| method| type)?|above|below|parent(?: class)?|interface|implementation|overload|remarks|summary|code|source|docs?|documentation)"
    r"|ditto|idem|lorem ipsum.*|placeholder|stub|test|foo|bar|asdf+|coming soon|self[- ]explanatory|obvious|work in progress|not implemented(?: yet)?|comment here|auto-?generated(?: method)?(?: stub)?)[\s.!?:]*",
    re.I,
)
#: Fixed words that add nothing to a name.
_FILLER = {
    "the", "a", "an", "this", "that", "these", "to", "of", "for", "and", "or", "in", "on", "by", "with", "from", "is", "are", "be", "its", "it", "which", "will", "does", "do", "used",
    "method", "function", "func", "procedure", "routine", "member", "operation", "helper", "constructor", "property", "class", "field", "async", "asynchronously", "summary",
    "description", "describe", "handler", "implementation", "implement", "perform", "execute", "call", "called", "simple", "simply", "just", "given", "specified", "value", "object", "instance", "new", "static", "documentation", "doc",
    "see", "also", "ref", "refs", "cf", "ticket", "issue", "bug", "commit", "jira", "fixes", "closes",
}
_POINTER = [
    re.compile(p)
    for p in (
        r"https?://\S+", r"(?i)\b(?:issue|ticket|bug|commit|pr|pull request|work item|revision|rev|change)\s*:?\s*#?\w*\d\w*", r"\[?\b[A-Za-z][A-Za-z0-9_]*-\d+\b\]?", r"\(?#\d+\)?", r"\((?:[0-9a-f]{5,40})\)", r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b", r"\b(?:[A-Z][a-z0-9]+){2,}\d+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\d+\b",
    )
]
_SEE = re.compile(r"(?i)^(?:@see|see(?: also)?|cf\.?|refer(?:s)? to|compare|defined in|documented (?:in|at|by)|copied from|moved to|link(?:ed)? to|same as|like|equivalent to|overload of|wrapper (?:for|of|around)|implements?|overrides?)\s*:?\s*(?:the\s+)?[\w.$<>#:/()\[\]-]+(?:\s*\([^)]*\))?(?:\s+(?:instead|above|below|for (?:details|more|documentation)))?\s*[.!]?$")


def clean(comment: str) -> str:
    """The prose of a comment or summary: no comment signs, markup or parameter descriptions."""
    out = []
    for line in comment.replace("\r", "\n").split("\n"):
        s = line.strip()
        s = re.sub(r"^(?:///+|//+!?|/\*+!?|<!--|\*+(?!/)|\*+/)\s?", "", s)
        s = re.sub(r"\s*(?:\*+/|-->)$", "", s)
        out.append(s.strip())
    text = "\n".join(out)
    text = _TAGS_OFF.sub(" ", text)
    text = re.sub(r"(?ms)^@(?:param|arg|argument|template|typeparam|type|throws|exception|see|since|version|author|deprecated)\b.*?(?=^@|^\s*$|\Z)", " ", text)
    text = _INHERIT.sub(" ", text)
    text = _REF.sub(lambda m: " " + re.sub(r"^[A-Z]:", "", m[1]) + " ", text)
    text = re.sub(r"\{@(?:link|linkcode|code|linkplain)\s+([^}|]*)[^}]*\}", r" \1 ", text)
    text = re.sub(r"(?m)^[ \t]*@(?:description|desc|summary|remarks|returns?|brief|fileoverview|example)\b", " ", text)
    text = re.sub(r"</?[A-Za-z][\w.:-]*(?:\s[^<>]*)?/?>", " ", text)
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", y).strip() for y in text.split("\n")) if x)


def stem(word: str) -> str:
    """A word without its verb or plural ending, the same for all forms of regular words."""
    w = word.lower()
    for end, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("oes", "o"), ("ing", ""), ("ed", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) + len(put) >= 3 and not (end == "s" and w.endswith("ss")):
            w = w[: len(w) - len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "lsz":
        w = w[:-1]
    return w[:-1] if w.endswith("e") else w


_FILLER_STEMS = {stem(w) for w in _FILLER}


def name_words(name: str | None) -> list[str]:
    """The words of an identifier."""
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", (name or "").rsplit(".", 1)[-1])


def says_something(text: str | None, name: str | None) -> bool:
    """Whether a comment or summary tells a reader more than the function's name.

    False for null and blank texts, placeholders, pointers elsewhere, restatements of the name, legal notices,
    region, tool and ruler marks, and code.
    """
    if not text or not text.strip():
        return False
    prose = clean(text)
    if not prose:
        return False
    lines = [x for x in prose.split("\n") if re.search(r"[^\W_]", x)]
    lines = [x for x in lines if not _TOOL.match(x)]
    if not lines:
        return False
    if _LEGAL.search(" ".join(lines[:3])):
        lines = [x for x in lines if not _LEGAL.search(x)]
        if len(" ".join(lines).split()) < 6:
            return False
    if all(_CODE_LINE.search(x) or _ATTRIBUTE.match(x) or _HEADING.match(x) for x in lines):
        return False
    flat = re.sub(r"\s+", " ", " ".join(lines)).strip()
    for p in _POINTER:
        flat = p.sub(" ", flat)
    flat = re.sub(r"\s+", " ", flat).strip(" \t-–—:;,*")
    if not re.search(r"[^\W_]", flat):
        return False
    if _PLACEHOLDER.fullmatch(flat) or _SEE.match(flat):
        return False
    named = {stem(w) for w in name_words(name)} | {stem(name or "")}
    whole = (name or "").lower()
    words = []
    for token in re.findall(r"[^\W_]+", flat):
        words += [token] if token.lower() == whole else name_words(token) or [token]
    left = [w for w in words if w.lower() != whole and stem(w) not in named and stem(w) not in _FILLER_STEMS and not w.isdigit()]
    return bool(left) and not _PLACEHOLDER.fullmatch(" ".join(left))


def has_code(source: str | None) -> bool:
    """Whether anything is left once comments are removed."""
    return bool(source) and bool(split_comments(source)[0].strip())


def describe(name: str | None, summary: str | None, source: str | None) -> tuple[str, str] | None:
    """(description, where it is from) of one function's row, or None if it has no code or says nothing.

    It is what :func:`documented` links with the function of the row's name, or with the first function where no
    heading has the name; a comment counts only directly above. The summary and the comments above compete.
    """
    if not has_code(source):
        return None
    return next(((x.text, x.origin) for x in documented(source, name, summary) if x.own and x.direct), None)
