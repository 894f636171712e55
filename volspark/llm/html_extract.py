"""HTML extraction by consensus host paths: each page scores its containers, hosts vote on generalised
tag-class paths in Spark, and pages are extracted again by their host's winning path."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, has_columns, text_slices
from .url_filter import host_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|<[A-Za-z][^>]*>""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img picture source map area".split()
)
_OUT = set("nav footer aside template object svg math button select option datalist dialog menu canvas audio video head".split())
_CLOSES = {  # an opening tag that ends an open one of these
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
_WORDS = (
    r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banners?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"footers?|cookies?|consent|notices?|alerts?|popups?|modals?|overlay|subscribe|subscription|newsletter|share|sharing|social|"
    r"related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|login|signup|search|widgets?|toolbar|"
    r"pagination|pager|copyright|disclaimer|hidden|gdpr|paywall|teaser)"
)
_NOISE = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])", re.I)
#: Running text is noise only by a whole name: ``notice``, but not ``notice-period``.
_WHOLE = re.compile(_WORDS, re.I)
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figcaption"}
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:headers?|masthead|topbar|top-bar|site-title)(?:$|[\s_-])", re.I)
_NEGATED = re.compile(r"\b(?:has|with|no|without|show|hide|js|col)[_-][\w-]+", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|page)(?:$|[\s_-])", re.I)
_POST = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_DIGITS = re.compile(r"\d+")

Block = tuple[str, int, str]  # path of its container, container's number, text


def _noise(tag: str, attrs: dict[str, str], within: bool, names: bool) -> bool:
    """Does an element hold no text of the article? By its tag, its attributes and, where ``names``
    holds, the words of its class and id (a form counts as so named)."""
    if tag in _OUT or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in _ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if tag == "form":
        return names
    if tag == "header" and not within:
        return True
    said = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if tag in _PROSE or tag in _INLINE:
        return names and any(map(_WHOLE.fullmatch, said.split()))
    said = _NEGATED.sub(" ", said)
    return names and (bool(_NOISE.search(said)) or not within and bool(_HEADER.search(said)))


def blocks(source: str) -> tuple[list[Block], dict[int, tuple[str, int, float, float]]]:
    """The text blocks outside noise, in page order, and the containers: number -> (path, parent's
    number, bonus of its name lowered by the share of its text that stands in links, that share).

    Words of classes are a hint only: where an element named as noise holds most of the page's running
    text (more than all that is left, and no list of readers' comments), the names are not heard for
    that element and those around it."""
    heard: set[int] = set()
    while True:
        found, nodes, named = _blocks(source, heard)
        left = sum(len(t) for _, _, t in found if len(t) >= 25)
        most = max(named, key=lambda n: named[n], default=None)
        if most is None or named[most] <= max(left, 250):
            return found, nodes
        heard.add(most)


def _blocks(source: str, heard: set[int]) -> tuple[list[Block], dict[int, tuple[str, int, float, float]], dict[int, int]]:
    """blocks(), and for each outermost element that its names alone make noise (but readers' comments)
    the running text that it holds. ``heard`` are the numbers of such elements to take for text."""
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, number, noise
    named: dict[int, int] = {}
    elements = owner = 0
    nodes: dict[int, tuple[str, int, float, float]] = {0: ("", -1, 0.0, 0.0)}
    out: list[Block] = []
    links: dict[int, int] = {}
    run: list[str] = []
    in_link = noisy = within = 0
    inline_noise: list[str] = []
    here = ("", 0)
    at, end = 0, len(source)

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append((here[0], here[1], text))

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if owner and m.start() - at >= 25:
            named[owner] += m.start() - at
        if m.start() > at and not noisy and not inline_noise:
            part = html.unescape(source[at : m.start()])
            run.append(part)
            if in_link:
                links[here[1]] = links.get(here[1], 0) + len(part)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not noisy and not inline_noise:
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag in _INLINE:
                if inline_noise and inline_noise[-1] == tag:
                    inline_noise.pop()
                if tag == "a":
                    in_link = 0
                continue
            flush()
            if any(s[0] == tag for s in stack):
                while True:
                    name, _, _, bad = stack.pop()
                    noisy -= bad
                    if not noisy:
                        owner = 0
                    within -= name in ("article", "main")
                    if name == tag:
                        break
                here = (stack[-1][1], stack[-1][2]) if stack else ("", 0)
                in_link = 0
                inline_noise.clear()
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in _INLINE:
            if tag in _VOID:
                continue
            if m[3] and not m[3].endswith("/"):
                attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])}
                # Names of a run inside a paragraph say nothing: it is a part of a sentence.
                if attrs and tag != "a" and _noise(tag, attrs, bool(within), not (stack and stack[-1][0] in _TEXTUAL)):
                    inline_noise.append(tag)
                elif inline_noise and inline_noise[-1] == tag:
                    inline_noise.append(tag)
            elif inline_noise and inline_noise[-1] == tag:
                inline_noise.append(tag)
            in_link |= tag == "a"
            continue
        flush()
        if tag in _VOID:
            continue
        if tag == "p" or tag in _CLOSES:
            while stack and stack[-1][0] in ("p", *_CLOSES.get(tag, ())):
                noisy -= stack.pop()[3]
        elif stack and stack[-1][0] == "p":
            noisy -= stack.pop()[3]
        if not noisy:
            owner = 0
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3] or "")}
        elements += 1
        bad = _noise(tag, attrs, bool(within), elements not in heard)
        if bad and not noisy and not _noise(tag, attrs, bool(within), False) and not _READERS.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
            owner = elements
            named[owner] = 0
        up = (stack[-1][1], stack[-1][2]) if stack else ("", 0)
        if tag in ("article", "main"):
            within += 1
        if tag in _TEXTUAL:
            here = up
        else:
            names = ".".join(sorted(_DIGITS.sub("#", attrs.get("class", "")).lower().split()))
            here = (f"{up[0]}/{tag}{'.' + names if names else ''}", len(nodes))
            bonus = 1.0 if tag in ("article", "main") else 0.5 * bool(_MAIN.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
            nodes[here[1]] = (here[0], up[1], bonus, 0.0)
        stack.append((tag, here[0], here[1], bad))
        noisy += bad
    if owner and end - at >= 25:
        named[owner] += end - at
    if at < end and not noisy and not inline_noise:
        run.append(html.unescape(source[at:end]))
    flush()
    inside = dict.fromkeys(nodes, 0)
    for _, n, text in out:
        inside[n] += len(text)
    linked = {n: links.get(n, 0) for n in nodes}
    for n in sorted(nodes, reverse=True):  # a parent's number is the lesser
        path, parent, bonus, _ = nodes[n]
        if parent >= 0:
            inside[parent] += inside[n]
            linked[parent] += linked[n]
        share = min(1.0, linked[n] / max(inside[n], 1))
        nodes[n] = (path, parent, (1 + bonus) * (1 - share) - 1, share)
    return out, nodes, named


#: Blocks of text; they are no containers, their text counts for what holds them.
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "td", "th", "tr", "caption", "figcaption", "address", "center"}


def scores(found: list[Block], nodes: dict[int, tuple[str, int, float, float]]) -> dict[str, float]:
    """Score of each container path: a block gives its length (short ones a third) to its container
    and half as much to each next ancestor; article, main and content names raise it, links lower it."""
    raw: dict[int, float] = {}
    for _, n, text in found:
        raw[n] = raw.get(n, 0.0) + (len(text) if len(text) >= 25 else len(text) / 3)
    for n in sorted(nodes, reverse=True):
        if n in raw and (up := nodes[n][1]) >= 0:
            raw[up] = raw.get(up, 0.0) + raw[n] / 2
    out: dict[str, float] = {}
    for n, s in raw.items():
        path, _, bonus, _ = nodes[n]
        out[path] = max(out.get(path, 0.0), s * max(0.1, 1 + bonus))
    return out


def lifted(own: dict[str, float], nodes: dict[int, tuple[str, int, float, float]]) -> dict[str, float]:
    """The scores, where a container inside an article stands for the outermost article around it; else
    for the main around it; else for the outermost container named post, entry, story or article."""
    rank: dict[int, tuple[int, int]] = {}  # container -> kind of what it stands for, and its number
    out: dict[str, float] = {}
    for n in sorted(nodes):
        path, parent, *_ = nodes[n]
        name = path[len(nodes[parent][0]) + 1 :] if parent >= 0 else ""
        tag, _, classes = name.partition(".")
        kind = 3 if tag == "article" else 2 if tag == "main" else 1 if _POST.search(classes.replace(".", " ")) else 0
        rank[n] = max((kind, n), rank.get(parent, (0, n)), key=lambda r: (r[0], -r[1]) if r[0] else (0, r[1]))
        if path in own:
            to = nodes[rank[n][1]][0]
            out[to] = max(out.get(to, 0.0), own[path])
    return out


def page_text(source: str, winner: str | None) -> str:
    """Blocks under containers of the winning path, or of the page's own best where it has none. Of
    several such containers, those of links for the most part (lists of columns that differ in a
    number alone) are left out, but never a container that is an article or main or is named as one."""
    found, nodes = blocks(source)
    if not found:
        return ""
    if winner is None or not any(p == winner or p.startswith(winner + "/") for p, _, _ in found):
        own = lifted(scores(found, nodes), nodes)
        winner = max(own, key=lambda p: (own[p], p))
    top: dict[int, int] = {}  # container -> the outermost of the winning path around it
    for n in sorted(nodes):
        path, parent, *_ = nodes[n]
        if (up := top.get(parent)) is not None or path == winner:
            top[n] = n if up is None else up
    last = winner.rsplit("/", 1)[-1]
    told = last.partition(".")[0] in ("article", "main") or bool(_POST.search(last.partition(".")[2].replace(".", " ")))
    mostly = set() if told else {n for n in set(top.values()) if nodes[n][3] > 0.5}
    if len(mostly) == len(set(top.values())):
        mostly = set()
    return " ".join(t for _, n, t in found if n in top and top[n] not in mostly)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: all container paths of every page, scored against its best, so that a
    long page has no more say than others."""
    out = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])
    wanted = arrow_schema(out)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            cols: tuple[list, list, list] = ([], [], [])
            for first, sources in text_slices(batch, "html"):
                for host, source in zip(hosts[first:], sources):
                    parts, nodes = blocks((source or b"").decode("utf-8", "replace"))
                    s = lifted(scores(parts, nodes), nodes)
                    best = max(s.values(), default=1.0)
                    for path in s:
                        for col, x in zip(cols, (host, path, s[path] / best)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, wanted)], schema=wanted)

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, out)


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the path of the largest summed score per host; ties to the lesser path. Votes
    are summed where they are cast, so a hot host sends a row for each path and task."""
    total = votes(pages).groupBy("host", "path").agg(F.sum(F.round(1e6 * F.col("score")).cast("long")).alias("s"))
    return total.groupBy("host").agg(F.min_by("path", F.struct(-F.col("s"), "path")).alias("path"))


def extract(pages: DataFrame, broadcast_hosts: int = 100_000) -> DataFrame:
    """page_id, url, text of every row: the article's blocks, joined by a space.

    Null or empty html, and pages of noise alone, give an empty text; null urls share the empty host;
    repeated rows are extracted alike; an empty table gives no rows. Winning paths of at most
    ``broadcast_hosts`` hosts are broadcast; more are joined by host, where Spark splits a hot one.
    """
    from .common import materialize

    rows = has_columns(pages, "page_id", "url", "html")
    won = materialize(winners(rows), "host-paths")
    if won.count() <= broadcast_hosts:
        won = F.broadcast(won)
    keyed = rows.withColumn("host", host_of(F.col("url"))).join(won, "host", "left").select("page_id", "url", "html", "path")
    out = T.StructType([*keyed.schema.fields[:2], T.StructField("text", T.StringType())])
    wanted = arrow_schema(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(3).to_pylist()
            for first, sources in text_slices(batch, "html"):
                made = [page_text((x or b"").decode("utf-8", "replace"), p) for x, p in zip(sources, paths[first:])]
                own = [batch.column(i).slice(first, len(made)).cast(wanted.field(i).type) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(made, wanted.field("text").type)], schema=wanted)

    return keyed.mapInArrow(each, out)
