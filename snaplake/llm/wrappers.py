"""Main text of web pages by wrappers: a union-free regular expression inferred for each host.

A page is a stream of tags and text slots, made well-formed (implied and missing end tags are added).
A host's wrapper starts as one page's stream and is aligned with the next pages' in turn: what only one
side has becomes an optional part, what stands several times in a row becomes a repeated part (single
elements or groups of up to four), and differing text becomes a slot. Wrappers are merged inside each
task first, then in salted groups of a host, then by host, so a host with a third of all pages arrives
as few small rows. In the finished wrapper the slots of the article are told from menus, notices and the
rest once per host, by the tags, names and share of link text of its parts, and text that is the same on
(nearly) every page is part of the template, no slot; pages are read with that. Inside an article or main
element only tags and names tell; text in repeated parts is never template.

Edge cases: null or empty html gives the empty text; a null url belongs to the host "", like a url without
one; a page without the wrapper's article (cut off, or of another kind) is read by its own wrapper.
Repeated rows are separate pages. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.store import stored

SALTS = 16
HELD_HOSTS = 2000
LINK_SHARE = 0.6
#: Text that is the same wherever it stands belongs to the template if it stands on this share of the host's pages.
TEMPLATE_SHARE = 0.9
#: Fewer pages than this do not tell template from text.
TEMPLATE_PAGES = 5

INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
     "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var")
)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Parts that are never main text, by tag, by role, and by words in class or id.
TAGS_OUT = frozenset(
    ("head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "template", "noscript", "dialog",
     "menu", "object", "canvas", "audio", "video", "fieldset", "label")
)
ROLES_OUT = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"))
WORDS_OUT = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
     "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
     "notice", "notices", "pagination", "pager", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "share",
     "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets")
)
HEADERS = frozenset(("header", "masthead"))
KEPT_WHATEVER_NAME = frozenset(("html", "body", "main", "article"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

OPEN, CLOSE, TEXT, BREAK = range(4)

#: Elements nested deeper than this are no parts of their own: their text is that of the part around them, in blocks
#: of its own as before, and what is out by name stays out.
DEPTH = 150
#: Sequences of parts whose lengths have a larger product than this are aligned at parts that occur once in both.
TABLE = 1 << 20


def _signature(name: str, attributes: str, within: bool) -> tuple[str, bool]:
    """How the wrapper names an element (tag, class, id and role without digits), and whether it is out by name.

    ``within`` tells that it stands in an article, where a header holds the headline.
    """
    out = name in TAGS_OUT or name == "header" and not within
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return name, out
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    words = set(_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    if name not in KEPT_WHATEVER_NAME:
        out |= bool(words & WORDS_OUT - HEADERS if within else words & WORDS_OUT)
    elif name == "article":
        out |= "comment" in words
    out |= found.get("role") in ROLES_OUT or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    named = [found[k] for k in ("class", "id", "role") if found.get(k)]
    return re.sub(r"\d+", "", " ".join([name, *named])), out


def events(page: str) -> Iterator[tuple]:
    """(OPEN, signature, out), (CLOSE,), (TEXT, raw, inside a link), (BREAK,) of a page, well-formed."""
    stack: list[str] = []
    shown: list[bool] = []  # whether an element of the stack has been opened as a part
    depth, articles, links, at = 0, 0, 0, 0

    def ended() -> tuple:
        nonlocal depth, articles
        articles -= stack.pop() in ("article", "main")
        was = shown.pop()
        depth -= was
        return (CLOSE if was else BREAK,)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield TEXT, page[at : m.start()], links > 0
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m[2] else 1))
            continue
        if name in VOID:
            yield (BREAK,)
            continue
        if m[2]:
            if name in stack:
                while stack[-1] != name:
                    yield ended()
                yield ended()
            links = 0
            continue
        for _ in range(_ended_by(name, stack)):
            yield ended()
        sign, out = _signature(name, m[4], articles > 0)
        part = depth < DEPTH or depth == DEPTH and out  # below an element that is out nothing else matters
        yield (OPEN, sign, out) if part else (BREAK,)
        stack.append(name)
        shown.append(part)
        depth += part
        articles += name in ("article", "main")
    if at < len(page):
        yield TEXT, page[at:], links > 0
    while stack:
        yield ended()


#: Elements an opening tag ends, if it stands directly in them; any but inline tags end a paragraph.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _ended_by(name: str, stack: list[str]) -> int:
    n = 1 if stack and stack[-1] == "p" else 0
    while n < len(stack) and stack[-1 - n] in _ENDS.get(name, ()):
        n += 1
    return n


# A part of a wrapper: [signature, optional, repeated, pages, characters, characters in links, out, parts];
# "#" is a text slot, whose parts stand for its whole text as long as that is the same everywhere, else nothing; a
# signature in parentheses is a group of neighbours that repeats together.
SIGN, OPTIONAL, REPEATED, PAGES, CHARS, LINKED, OUT, PARTS = range(8)


def _digest(text: str) -> str:
    """Length and 128-bit hash: equal for equal whole texts only."""
    return f"{len(text)}:{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def page_wrapper(page: str) -> list:
    """The wrapper of one page."""
    root = ["", 0, 0, 1, 0, 0, 0, []]
    stack = [root]
    for event in events(page):
        if event[0] == OPEN:
            part = [event[1], 0, 0, 1, 0, 0, int(event[2]), []]
            stack[-1][PARTS].append(part)
            stack.append(part)
        elif event[0] == CLOSE:
            part = stack.pop()
            part[PARTS] = fold(part[PARTS])
        elif event[0] == TEXT and (n := len(event[1].strip())):
            parts = stack[-1][PARTS]
            if not parts or parts[-1][SIGN] != "#":
                parts.append(["#", 0, 0, 1, 0, 0, 0, []])
            parts[-1][PARTS].append(_digest(event[1].strip()))
            parts[-1][CHARS] += n
            parts[-1][LINKED] += n if event[2] else 0
    root[PARTS] = fold(root[PARTS])
    return root


def merge(a: list, b: list, one_page: bool = False) -> list:
    """One part for two of the same signature, from different pages or from one."""
    sums = [max(a[PAGES], b[PAGES]) if one_page else a[PAGES] + b[PAGES], *(a[i] + b[i] for i in (CHARS, LINKED))]
    if a[SIGN] == "#":
        return ["#", a[OPTIONAL] | b[OPTIONAL], 0, *sums, 0, a[PARTS] if a[PARTS] == b[PARTS] else []]
    return [a[SIGN], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], *sums, a[OUT] | b[OUT], align(a[PARTS], b[PARTS], one_page)]


def fold(parts: list) -> list:
    """Neighbours in a page of equal signature become one repeated part; then groups of two to four that follow themselves."""
    out: list = []
    for part in parts:
        if out and out[-1][SIGN] == part[SIGN] != "#":
            out[-1] = merge(out[-1], part, one_page=True)
            out[-1][REPEATED] = 1
        else:
            out.append(part)
    for size in (2, 3, 4):
        signs = [p[SIGN] for p in out]
        i = 0
        while i + 2 * size <= len(out):
            unit = signs[i : i + size]
            if unit != signs[i + size : i + 2 * size]:
                i += 1
                continue
            body, n = out[i : i + size], 1
            while signs[i + n * size : i + (n + 1) * size] == unit:
                body = [merge(x, y, one_page=True) for x, y in zip(body, out[i + n * size : i + (n + 1) * size], strict=True)]
                n += 1
            out[i : i + n * size] = [_group(body, 1)]
            signs[i : i + n * size] = [out[i][SIGN]]
            i += 1
    return out


def _group(body: list, repeated: int) -> list:
    return [f"({'|'.join(p[SIGN] for p in body)})", 0, repeated, body[0][PAGES], 0, 0, 0, body]


def _grouped_like(parts: list, other: list) -> list:
    """Single occurrences of what repeats as a group on the other side become that group."""
    for group in other:
        if group[SIGN].startswith("("):
            unit = [p[SIGN] for p in group[PARTS]]
            for i in range(len(parts) - len(unit) + 1):
                if [p[SIGN] for p in parts[i : i + len(unit)]] == unit:
                    parts = [*parts[:i], _group(parts[i : i + len(unit)], 0), *parts[i + len(unit) :]]
    return parts


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal signatures, ascending on both sides: equal ends, and between them a longest ascending run of
    pairs of the k-th occurrences of a signature in both. Takes n log n steps."""
    n, m, head, tail = len(a), len(b), 0, 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(m - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    pairs = [(i, where[a[i]].pop()) for i in range(head, n - tail) if where.get(a[i])]
    tops: list[int] = []  # least ends of ascending runs by their length, and the pairs they end with
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    same = [(k, k) for k in range(head)]
    return same + run[::-1] + [(n - k, m - k) for k in range(tail, 0, -1)]


def align(a: list, b: list, one_page: bool = False) -> list:
    """Longest common alignment of two sequences; what has no partner becomes optional."""
    if [p[SIGN] for p in a] == [p[SIGN] for p in b]:
        return [merge(x, y, one_page) for x, y in zip(a, b, strict=True)]
    a, b = _grouped_like(a, b), _grouped_like(b, a)
    n, m = len(a), len(b)
    if n * m > TABLE:
        out, i, j = [], 0, 0
        for x, y in [*_anchors([p[SIGN] for p in a], [p[SIGN] for p in b]), (n, m)]:
            out += [[p[SIGN], 1, *p[REPEATED:]] for p in (*a[i:x], *b[j:y])]
            out += [merge(a[x], b[y], one_page)] if x < n else []
            i, j = x + 1, y + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIGN] == b[j][SIGN] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][SIGN] == b[j][SIGN]:
            out.append(merge(a[i], b[j], one_page))
            i, j = i + 1, j + 1
            continue
        if j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            part, i = a[i], i + 1
        else:
            part, j = b[j], j + 1
        out.append([part[SIGN], 1, *part[REPEATED:]])
    return out


def expression(part: list) -> str:
    """The wrapper as text, to read: tags, slots, and the marks ?, + and * behind optional and repeated parts."""
    mark = ("", "+", "?", "*")[2 * part[OPTIONAL] + part[REPEATED]]
    if part[SIGN] == "#":
        return "#" + mark
    inner = "".join(map(expression, part[PARTS]))
    if part[SIGN].startswith("("):
        return f"({inner}){mark}"
    return f"(<{part[SIGN]}>{inner}</>){mark}" if part[SIGN] else inner


def choose(wrapper: list) -> dict:
    """Paths of the parts that hold the article, and of parts within them that are left out."""
    outside: list[str] = []

    def mass(part: list) -> tuple[int, int]:
        chars, linked = part[CHARS], part[LINKED]
        for p in part[PARTS] if part[SIGN] != "#" else ():
            if not p[OUT]:
                c, k = mass(p)
                chars, linked = chars + c, linked + k
        return chars, linked

    def walk(part: list, path: str, whole, within: bool = False) -> Iterator[tuple[list, str]]:
        """Parts with their paths; parts of links are left out, but not within parts that are ``whole``."""
        for p in part[PARTS]:
            if p[OUT]:
                continue
            if p[SIGN].startswith("("):
                repeated.update(map(id, p[PARTS]) if p[REPEATED] or id(p) in repeated else ())
                yield from walk(p, path, whole, within)
            elif p[SIGN] != "#":
                here = f"{path}>{p[SIGN]}"
                chars, linked = mass(p)
                if not within and not whole(p) and tag(p) in ("ul", "ol", "div", "table", "section") and linked > LINK_SHARE * chars:
                    outside.append(here)
                    continue
                yield p, here
                repeated.update(map(id, p[PARTS]) if p[REPEATED] or id(p) in repeated else ())
                yield from walk(p, here, whole, within or whole(p))

    tag = lambda part: part[SIGN].split(" ")[0]
    repeated: set[int] = set()  # parts that lie in a repeated one
    for whole in (lambda p: tag(p) == "article", lambda p: tag(p) == "main" or p[SIGN].endswith(" main")):
        outside.clear()
        found = list(walk(wrapper, "", whole))
        main = [path for p, path in found if whole(p) and mass(p)[0]]
        if main:
            return {"main": main, "out": outside}
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * wrapper[PAGES])
    told: dict[str, bool] = {}  # whether all there is at a path is text of the template
    for p, path in found:
        fixed = bool(p[PARTS]) and all(s[SIGN] == "#" and s[PARTS] and s[PAGES] >= least for s in p[PARTS])
        told[path] = told.get(path, True) and fixed and not p[REPEATED] and id(p) not in repeated
    here = next(((p, path) for p, path in found if tag(p) == "body"), (wrapper, ""))  # a page may have no body tag
    while here is not None:  # down to the part whose own text, not that of one part of it, is most of the text
        main = [here[1]]
        inside = [(p, path) for p, path in found if path.startswith(here[1] + ">") and ">" not in path[len(here[1]) + 1 :]]
        inside = [(p, path) for p, path in inside if tag(p) in ("div", "section", "main", "td", "table", "tbody", "tr", "center")]
        total = mass(here[0])[0]
        here = next(((p, path) for p, path in inside if mass(p)[0] > 0.5 * total), None)
    mine = {path for path in told if any(path == m or path.startswith(m + ">") for m in main)}
    texts = {path for p, path in found if path in mine and any(s[SIGN] == "#" for s in p[PARTS])}
    template = {path for path in mine if told[path]}
    if texts - template:  # else the pages are copies of each other, and all of it is the article
        outside += sorted(template)
    return {"main": main, "out": outside}


def main_text(page: str, chosen: dict) -> str | None:
    """The text of the chosen parts: blocks in page order, white space as one blank. None if no part is there."""
    main, outside = set(chosen["main"]), set(chosen["out"])
    path, skipped, seen = [""], 0, "" in main
    inside = int(seen)
    block: list[str] = []
    found: list[str] = []

    def end_block() -> None:
        if block and (text := " ".join(entities.unescape("".join(block)).split())):
            found.append(text)
        block.clear()

    for event in events(page):
        kind = event[0]
        if kind == TEXT:
            if inside and not skipped:
                block.append(event[1])
            continue
        end_block()
        if kind == OPEN:
            here = f"{path[-1]}>{event[1]}"
            path.append(here)
            if skipped or event[2] or here in outside:
                skipped += 1
            elif inside or here in main:
                inside += 1
                seen = True
        elif kind == CLOSE:
            path.pop()
            if skipped:
                skipped -= 1
            elif inside:
                inside -= 1
    end_block()
    return " ".join(found) if seen else None


def read_page(page: str | None, chosen: str | None) -> str:
    if not page:
        return ""
    text = main_text(page, json.loads(chosen)) if chosen else None
    return text if text is not None else main_text(page, choose(page_wrapper(page))) or ""


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def infer(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, wrapper): ``pages`` has host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    one = page_wrapper(page)
                    held[host] = merge(held[host], one) if host in held else one
            if len(held) > HELD_HOSTS:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(map(json.dumps, held.values()), pa.string())], names=["host", "wrapper"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(group["wrapper"]):
            whole = json.loads(text) if whole is None else merge(whole, json.loads(text))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    found = pages.select("host", "html").mapInArrow(run, "host string, wrapper string")
    found = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    found = found.groupBy("host", "salt").applyInPandas(joined, "host string, wrapper string")
    return found.groupBy("host").applyInPandas(joined, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, main text and its length in code points."""
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    @F.pandas_udf("string")
    def chosen(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda w: json.dumps(choose(json.loads(w))))

    decided = stored(infer(hosted).select("host", chosen("wrapper").alias("chosen")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_page(p, c) for p, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    joined = hosted.join(decided, "host", "left").select("page_id", "url", "html", "chosen")
    kind = hosted.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
