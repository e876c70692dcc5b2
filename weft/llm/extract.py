"""HTML main text as the maximum-scoring subsequence of a page's words and tags.

Words score above zero, tags below; one linear scan finds the best contiguous region, and its blocks, less any elements
inside that score below zero, are the text. The weights are log-odds of the kinds of tokens within against outside of
articles, from a bounded sample of pages that label their own article by an <article> or <main> element, with the fixed
weights below as the prior; only their signs are given. The same pages tell which class and id words stand outside of
articles only: words under such elements score below zero too.

Elements that can't be the article's (scripts, forms, menus, and those whose class, id or role names nothing but
boilerplate) score below zero whatever they hold. Elements whose name may mean either (a section named discussion,
related-work or search-results) start at a loss and stay if their words outweigh it; headings and elements within a line
stay. Links count less than words, so lists of links lose. Within an article that the page marks as such, tags and
boilerplate cost next to nothing, so what follows a long advert there is kept; and a block that the region cuts is whole.

Null and empty pages, and pages without words, give an empty text. Unclosed and misnested tags are taken as they come;
unclosed boilerplate ends where an article begins or ends. Very long pages are read whole, in linear time, and no part of
a page is left out of learning. Equal scores go to the region that begins first, and of those the shortest. Repeated rows
give the same text; an empty table no rows. Of other columns only those in `keep` are read; they come out as they are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "select"}
BOILERPLATE = {"nav", "footer", "aside", "form", "head", "button", "dialog", "menu", "fieldset"}
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr"}
# Element names within formulas and drawings.
INLINE |= {"annotation", "circle", "defs", "desc", "ellipse", "g", "line", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "path", "polygon", "polyline", "rect", "semantics", "text", "tspan", "use"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Names of boilerplate in class, id and role; names that may mean boilerplate; and words that say nothing.
MARKS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "sidebar", "nav", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "popup", "modal", "login", "signup", "pagination", "pager", "toolbar", "complementary", "contentinfo", "alert"}
MAYBE = {"discussion", "related", "recommended", "recommendations", "search", "header", "share", "sharing", "social", "menu", "widget", "promotion", "subscription", "skip", "copyright", "overlay"}
PLAIN = {"area", "article", "articles", "bar", "block", "blog", "body", "bottom", "box", "button", "buttons", "container", "content", "entry", "global", "group", "icon", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "title", "top", "unit", "user", "wrap", "wrapper"}
#: Words that an element must outweigh: one that is named like boilerplate, and one whose name holds other words as well.
LOSS, LESS_LOSS = 8, 2
#: Prior weights, and how many tokens they count for against those of the sample.
FIXED = {"word": 1.0, "link": 0.1, "out": -1.0, "tag": -0.5, "a": -0.5, "li": -0.4, "/li": -0.2, "/a": -0.2, "p": -0.1, "/p": -0.1, "b": -0.1, "i": -0.1, "em": -0.1, "br": -0.1, "h1": -0.1, "h2": -0.1, "h3": -0.1}
PRIOR, TELLING = 200.0, 20
#: Names of so many of the nearest named elements above a word tell about it.
DEEP = 16

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
END = re.compile(r"""[>"']""")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def pieces(page: str):
    """(text, None, False, "") or ("", tag name, closing, attributes), in order and in linear time.

    A tag ends at the first ">" outside of quotes, or at the first ">" if no such one follows; comments, declarations and
    what stands in elements without text are skipped.
    """
    pos, n, quoted, absent = 0, len(page), True, set()
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            yield page[pos:], None, False, ""
            return
        if at > pos:
            yield page[pos:at], None, False, ""
        m = OPEN.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                pos = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:
                yield "<", None, False, ""
                pos = at + 1
            continue
        name, end, look = m[2].lower(), -1, m.end()
        while quoted:
            e = END.search(page, look)
            if e is None:
                quoted = False
            elif e[0] == ">":
                end = e.start()
                break
            else:
                close = page.find(e[0], e.end())
                quoted = close >= 0
                look = close + 1
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:
                return
        attrs, pos = page[m.end() : end], end + 1
        yield "", name, bool(m[1]), attrs
        if name in RAW and not m[1] and not attrs.rstrip().endswith("/"):
            close = None if name in absent else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
            if close:
                pos = close.end()
            else:
                absent.add(name)
                if name in ("script", "style", "textarea", "title"):
                    return


def marks(attrs: str) -> tuple[int, list[str]]:
    """What class, id, role and hiding say: -1 boilerplate, else the words to outweigh; and the names, split at case and signs."""
    worst, names = 0, []
    for k, v in ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'")
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and HIDDEN.search(v):
            return -1, names
        if k not in ("class", "id", "role"):
            continue
        for one in v.split():
            names.append(one.lower())
            said = {t for t in map(str.lower, NAME.findall(one)) if t not in PLAIN}
            if said and said <= MARKS | MAYBE:
                if said & MARKS:
                    return -1, names
                worst = max(worst, LOSS)
            elif said & (MARKS | MAYBE):
                worst = max(worst, LOSS if said & MARKS else LESS_LOSS)
    return worst, names


class Page:
    """kinds: word, link, out (words of boilerplate), " " (white space) or a tag's name ("/" first if closing); raw texts;
    numbers of words; whether in an article; the names above each run of words; and the elements that start at a loss."""

    def __init__(self, page: str):
        self.kinds, self.raw, self.words, self.article, self.names, self.losing = [], [], [], [], [], []
        article, links = 0, 0
        skip, depth = "", 0  # the boilerplate element open, and how deep its name nests
        held: list[list] = []  # open elements that have a name or a loss: tag, depth, names, loss, first token
        where: dict[str, list[int]] = {}  # their places, by tag
        near: tuple | set = ()
        for text, name, closing, attrs in pieces(page):
            if name is None:
                n = len(text.split())
                self._add(("out" if skip else "link" if links else "word") if n else " ", text, n, article, near if n else ())
                continue
            if name in ("article", "main"):
                article = max(0, article + (-1 if closing else 1))
                if skip not in ("article", "main"):
                    skip, depth, links = "", 0, 0
            if name == "body":
                skip, depth = "", 0
            if skip:
                if name == skip:
                    depth += -1 if closing else 1
                    if depth <= 0:
                        skip = ""
                elif skip == "p" and name not in INLINE:
                    skip = ""
            if stack := where.get(name):  # the nearest open element of that name that has a name or a loss
                k = stack[-1]
                held[k][1] += -1 if closing else name not in VOID
                if held[k][1] <= 0:
                    for tag, _, _, loss, first in reversed(held[k:]):
                        where[tag].pop()
                        if loss:
                            self.losing.append((first, len(self.kinds), loss))
                    del held[k:]
                    near = self._near(held)
            if not closing and name not in VOID and name not in ("html", "body"):
                loss, names = marks(attrs) if attrs else (0, [])
                own = name in ("article", "main") and article <= 1
                if not skip and (name in BOILERPLATE or name == "header" and not article or loss < 0 and not own):
                    skip, depth = name, 1
                if loss < 0 or own or name in HEADINGS or name in INLINE:
                    loss = 0
                if names or loss:
                    where.setdefault(name, []).append(len(held))
                    held.append([name, 1, names, loss, len(self.kinds)])
                    near = self._near(held)
            if name == "a":
                links = 0 if closing else 1
            elif name not in INLINE:
                links = 0
            self._add("/" * closing + name, "", -1 if skip or name in BOILERPLATE else 0, article, ())
        self.losing += [(first, len(self.kinds), loss) for _, _, _, loss, first in held if loss]

    @staticmethod
    def _near(held: list) -> set:
        """Names of the DEEP nearest elements that have some."""
        return {n for h in held[-DEEP:] for n in h[2]}

    def _add(self, kind: str, raw: str, words: int, article: int, names) -> None:
        self.kinds.append(kind)
        self.raw.append(raw)
        self.words.append(words)
        self.article.append(article > 0)
        self.names.append(names)

    def scores(self, weights: dict[str, float]) -> list[float]:
        """The score of each token. Elements that lose have their words scored as boilerplate, outer elements first."""
        out = []
        for kind, words, names, article in zip(self.kinds, self.words, self.names, self.article):
            if kind == " ":
                out.append(0.0)
            elif article and (kind == "out" or words <= 0):  # the page says itself that its article goes on here
                out.append(-0.01)
            elif words > 0:
                w = weights.get(kind, weights["tag"])
                w = min([w] + [weights["@" + n] for n in names if "@" + n in weights]) if names else w
                out.append(w * (1 if kind == "out" else words))
            else:
                out.append(weights.get(kind, weights["tag"]))
        own = [o if k in ("word", "link") else 0.0 for k, o in zip(self.kinds, out)]
        before = list(accumulate(own, initial=0.0))
        done = 0
        for first, end, loss in sorted(self.losing, key=lambda x: (x[0], -x[1])):
            if first >= done and before[end] - before[first] <= loss * weights["word"]:
                done = end
                for k in range(first, end):
                    if self.kinds[k] in ("word", "link"):
                        self.kinds[k], out[k] = "out", -0.01 if self.article[k] else weights["out"]
        return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of greatest sum, in one pass; (0, 0) where no sum is above zero."""
    best, where, run, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        run += s
        if run <= 0:
            run, start = 0.0, k + 1
        elif run > best:
            best, where = run, (start, k + 1)
    return where


def from_counts(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Log-odds of each kind inside against outside of articles, under a Dirichlet prior in proportion to its share in all;
    the fixed weights count for PRIOR tokens more. Words stay above zero and all else but links below; names (with "@") are
    kept where they stand outside only."""
    out = dict(FIXED)
    if not inside or not outside:
        return out
    a, b = (sum(n for k, n in side.items() if k[0] != "@") for side in (inside, outside))
    for kind in inside.keys() | outside.keys() | FIXED.keys():
        x, y = inside.get(kind, 0), outside.get(kind, 0)
        if kind[0] == "@":
            if not x and y >= TELLING:
                out[kind] = -math.log1p(y / TELLING)
        elif kind != " ":
            prior = FIXED.get(kind, FIXED["tag"])
            share = PRIOR / (PRIOR + x + y)
            both = b * (x + y) / (a + b) + 1e-3  # as many tokens again as stand outside, in proportion, for either side
            odds = share * prior + (1 - share) * (math.log((x + both) / (a + b)) - math.log((y + both) / (b + b)))
            out[kind] = max(0.25, odds) if kind == "word" else odds if kind == "link" else min(-0.05, odds)
    out["link"] = min(out["link"], out["word"] / 2)
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by two line feeds."""
    if not page:
        return ""
    found = Page(page)
    start, end = best_region(found.scores(weights))
    blocks, held = [], []
    within = lambda k: found.kinds[k] != "out" and (found.kinds[k] in ("word", "link", " ") or found.kinds[k] != "br" and found.kinds[k].lstrip("/") in INLINE)
    while start < end < len(found.kinds) and within(end):  # the block goes on
        end += 1
    while 0 < start < end and within(start) and within(start - 1):
        start -= 1

    def close():
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for k in range(start, end):
        kind = found.kinds[k]
        if kind in ("word", "link", " "):
            if not any("@" + n in weights for n in found.names[k]):
                held.append(found.raw[k])
        elif kind == "br":
            held.append(" ")
        elif kind != "out" and kind.lstrip("/") not in INLINE:
            close()
    close()
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), sample: int = 2000) -> DataFrame:
    """id, kept columns, text, n_chars for each page. At most about `sample` pages are learnt from."""
    body = F.col(html_col).cast("string")
    total = pages.count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 30))
    rows = pages.select(F.col(id_col), *keep, body.alias("_html"))
    learn = rows.where(F.xxhash64("_html", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) < share).select("_html")

    def count(batches):
        inside, outside = Counter(), Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                found = Page(page or "")
                if any(found.article):
                    for kind, words, names, article in zip(found.kinds, found.words, found.names, found.article):
                        side = inside if article else outside
                        side[kind] += max(1, words)
                        for n in names:
                            side["@" + n] += words
        kinds = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "a", "b"])

    # One row a tag name, and a name that stands outside of articles only, of the sample.
    counted = learn.mapInArrow(count, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = counted.where(~F.col("kind").startswith("@") | (F.col("a") == 0) & (F.col("b") >= TELLING)).collect()
    weights = from_counts({r.kind: r.a for r in counted if r.a}, {r.kind: r.b for r in counted if r.b})

    def run(batches):
        for b in batches:
            text = [extract(p, weights) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
