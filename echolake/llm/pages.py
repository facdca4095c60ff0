"""Main text of pages by consensus host paths.

A page is cut into blocks of text and elements. Elements are scored by all text below them less what stands in links. A page votes
for the lowest element that holds nearly all of its score, or the article or parent around it where only headings and paragraphs
are added, by its generalised path (tags and classes from the root, digits made equal). Votes are summed per host in Spark, and each
page is extracted again from the elements on its host's winning path, or from its own such element where it has none. Menus, footers, forms, scripts, adverts, notices, comments and the like never count; a class or
id counts as such a name if it is one or joins one with words of place or shape (`AFFIXES`), and not on an element that holds the
main element, the article with the page's title or most of the page's text outside links and comments.
A page header goes; inside the winning container its headings stay. An article without a heading of its own begins at the h1 before it, with what
stands between them outside links.

Rows count each for themselves, also repeated ones; equal votes go to the path that is last in order. Very long pages are read whole.

Null and empty pages give an empty text; markup that does not close, or text without markup, is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, stored

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas object select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike "
                   "strong sub sup time tt u var wbr br img".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead div article section body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a page that are not its article, by tag, role and words of class or id.
DROPPED = frozenset("nav footer aside form menu dialog".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
    "reply replies respond disqus share sharing social related recommended recommendations widget pagination pager copyright skip".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: What may stand beside a name in a class or id: "ad-slot" is an advert, "no-sidebar" or "comments-open" says something of the page.
AFFIXES = frozenset(
    "slot box block container wrapper wrap area list section unit bar item items link links button buttons icons panel inner outer content "
    "text body title head top bottom left right main primary secondary site page post posts global header form group row col column id js "
    "module media google mobile desktop user users reader readers visitor visitors thread threads feed author entry count".split())
#: What drops a figure by name; its other names say where it stands.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
DEPTH = 400
#: Share of a page's score below the element that counts as its article.
NEARLY = 0.95
#: Parts of a host's pages where many winners meet them.
SALTS = 16
PARTS = frozenset("p li pre blockquote td dd dt figcaption".split()) | HEADINGS


_MARKS = NAMES | {"header"}


def named(value: str, names: frozenset) -> set[str]:
    """The names that stand in a class or id beside nothing but names and affixes."""
    out = set()
    for token in value.lower().split():
        parts = set(_WORD.findall(token))
        if parts & names and parts <= names | NAMES | AFFIXES:
            out |= parts & names
    return out


class Page:
    """Elements (parent, path, tag, dropped) and blocks (text, characters in links, element, heading, in header) in page order."""

    def __init__(self, source: str):
        self.parent, self.path, self.tags, self.dropped, self.header = [-1], [""], [""], [False], [False]
        self._names: dict[int, set[str]] = {}
        self.blocks: list[tuple[str, int, int]] = []
        self._stack, self._open = [0], {}
        self._text: list[str] = []
        self._links: list[str] = []
        self._in_link = 0
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            self._add(source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            close, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if close:
                self._close(name)
            elif name in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(source, at)
                if name not in ("button", "select") or end:
                    at = end.end() if end else n
            else:
                self._start(name, rest)
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Drop elements by name, but those that hold the page's article, and hand down what is dropped and what is header."""
        n = len(self.path)
        if self._names:
            hard, comment, key, size = self.dropped[:], [False] * n, [False] * n, [0] * n
            inside = [False] * n
            for e in range(1, n):
                hard[e] |= hard[self.parent[e]]
                inside[e] = self.tags[e] == "article" or inside[self.parent[e]]
                key[e] = not hard[e] and (self.tags[e] == "main" or self.tags[e] == "h1" and inside[e])
            for e in range(n - 1, 0, -1):
                key[self.parent[e]] |= key[e]
            for e in range(1, n):
                comment[e] = comment[self.parent[e]] or not key[e] and bool(self._names.get(e, set()) & COMMENTS)
            for text, links, e in self.blocks:
                if not hard[e] and not comment[e]:
                    size[e] += max(0, len(text) - links)
            for e in range(n - 1, 0, -1):
                size[self.parent[e]] += size[e]
            for e, names in self._names.items():
                if key[e] or size[e] * 2 > size[0]:
                    continue
                self.dropped[e] |= bool(names & NAMES)
                self.header[e] |= "header" in names
        for e in range(1, n):
            self.dropped[e] |= self.dropped[self.parent[e]]
            self.header[e] |= self.header[self.parent[e]]

    def _add(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._in_link:
                self._links.append(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((text, len(" ".join(entities.unescape("".join(self._links)).split())), self._stack[-1]))
            self._text, self._links = [], []

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._add(" ")
            return
        if name in INLINE:
            self._in_link += name == "a"
            return
        self._flush()
        if name in VOID:
            return
        if self._open.get("p"):
            self._close("p")
        for other in CLOSES.get(name, ()):
            self._close(other, SCOPE)
        here = self._stack[-1]
        values = {a.lower(): (x or y or z) for a, x, y, z in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        label = values.get("class", "")
        words = named(label, _MARKS) | named(values.get("id") or "", _MARKS)
        dropped = name in DROPPED or values.get("role", "").lower() in ROLES \
            or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        if name in ("html", "body", "main", "article"):
            dropped = name == "article" and bool(words & {"comment", "comments", "reply", "ad", "advert", "promo", "related"})
            words = set()
        if name == "figure":
            words &= ADVERTS
        if words:
            self._names[len(self.path)] = words
        up = self.path[here]
        if len(up) > DEPTH:
            up = hashlib.md5(up.encode()).hexdigest()
        path = f"{up}>{name}" + "".join(f".{_DIGITS.sub('0', c)}" for c in sorted(set(label.split())))
        self.parent.append(here)
        self.path.append(path)
        self.tags.append(name)
        self.dropped.append(dropped)
        self.header.append(name == "header")
        self._stack.append(len(self.path) - 1)
        self._open[name] = self._open.get(name, 0) + 1

    def _close(self, name: str, scope=frozenset()) -> None:
        if name in INLINE:
            self._in_link = max(0, self._in_link - (name == "a"))
            return
        if not self._open.get(name):
            if name not in VOID:
                self._flush()
            return
        if scope:
            for e in reversed(self._stack):
                if self.tags[e] == name:
                    break
                if self.tags[e] in scope:
                    return
        self._flush()
        self._in_link = 0
        while True:
            tag = self.tags[self._stack.pop()]
            self._open[tag] -= 1
            if tag == name:
                break

    def article(self) -> int | None:
        """The element that holds the page's article; None without text."""
        n = len(self.path)
        score, plain, links_, other = [0.0] * n, [0] * n, [0] * n, [0] * n
        for text, links, e in self.blocks:
            if self.dropped[e] or self.header[e] and self.tags[e] not in HEADINGS:
                continue
            score[e] += max(0.0, len(text) - 2.0 * links)
            plain[e] += len(text)
            links_[e] += links
            other[e] += self.tags[e] not in PARTS
        for e in range(n - 1, 0, -1):
            for kind in (score, plain, links_, other):
                kind[self.parent[e]] += kind[e]
        if not plain[0]:
            return None
        amount = score if score[0] else plain
        best = 0
        for e in range(1, n):  # children come after their parents, and two siblings cannot both hold so much
            if self.parent[e] == best and amount[e] >= NEARLY * amount[0]:
                best = e
        if self.tags[best] in PARTS or self.tags[best] in ("ul", "ol"):
            best = self.parent[best]
        up, whole = best, best
        while up > 0 and self.tags[up] not in ("html", "body", "main"):
            if self.tags[up] == "article" and not self.dropped[up]:
                whole = up
                break
            up = self.parent[up]
        best = whole
        while (up := self.parent[best]) > 0 and self.tags[best] not in ("main", "body") and self.tags[up] not in ("html", "body"):
            more, linked = plain[up] - plain[best], links_[up] - links_[best]
            if other[up] > other[best] or linked * 3 > more:
                break
            best = up
        return best

    def text_of(self, roots: list[int]) -> str:
        """The text below some elements, in page order."""
        inside = [False] * len(self.path)
        for i in roots:
            inside[i] = True
        for i in range(1, len(self.path)):
            inside[i] |= inside[self.parent[i]]
        kept = [i for i, (_, _, e) in enumerate(self.blocks) if inside[e] and not self.dropped[e] and (not self.header[e] or self.tags[e] in HEADINGS)]
        return "\n\n".join(self.blocks[i][0] for i in self._title(kept) + kept)

    def _title(self, kept: list[int]) -> list[int]:
        """The blocks from the page's title on to an article that neither holds an h1 nor begins with a heading, links and headers left out."""
        if not kept or self.tags[self.blocks[kept[0]][2]] in HEADINGS or any(self.tags[self.blocks[i][2]] == "h1" for i in kept):
            return []
        out = []
        for i in range(kept[0] - 1, -1, -1):
            text, links, e = self.blocks[i]
            if self.dropped[e] or self.header[e] or links * 3 > len(text):
                continue
            out.append(i)
            if self.tags[e] == "h1":
                return out[::-1]
        return []


def votes(source: str) -> list[tuple[str, float]]:
    """The path of the page's article with its vote."""
    page = Page(source)
    e = page.article()
    return [] if e is None else [(page.path[e], 1.0)]


def main_text(source: str, path: str | None) -> str:
    page = Page(source)
    text = ""
    if path is not None:
        text = page.text_of([i for i in range(len(page.path)) if page.path[i] == path and not page.dropped[i]])
    if not text and (found := page.article()) is not None:
        text = page.text_of([found])
    return text


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add `text` and `n_chars`."""
    taken = [c for c in pages.columns if c not in ("text", "n_chars")]
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    by, part, best, both = (free_name(pages, c) for c in ("__host", "__part", "__path", "__both"))
    found = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType())]))
    kind = pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64())]))

    def vote(texts):
        return [pa.array([[{"path": p, "share": s} for p, s in votes(t)] for t in texts], kind)]

    cast = add_columns(pages.select(host.alias("host"), F.col(f"`{html}`").alias("html")), "html", [T.StructField("votes", found)], vote)
    sums = cast.select("host", F.explode("votes").alias("v")).groupBy("host", "v.path").agg(F.sum("v.share").alias("share"))
    winners = stored(sums.groupBy("host").agg(F.max(F.struct(F.round("share", 6), F.col("path"))).getField("path").alias("path")), "winners")
    # A stored table tells its size, so few winners go to the pages; many meet them by host, each host in SALTS parts.
    dealt = winners.select(F.col("host").alias(by), F.col("path").alias(best), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(part))
    salt = F.pmod(F.xxhash64(F.col(f"`{url}`"), F.col(f"`{html}`")), F.lit(SALTS)).cast("int")
    rows = pages.select(*[F.col(f"`{c}`") for c in taken], host.alias(by), salt.alias(part))
    joined = rows.join(dealt, [by, part], "left")
    source = joined.select(*[F.col(f"`{c}`") for c in taken], F.concat(F.coalesce(best, F.lit("")), F.lit("\n"), F.coalesce(F.col(f"`{html}`"), F.lit(""))).alias(both))

    def again(texts):
        made = []
        for t in texts:
            path, _, page = t.partition("\n")
            made.append(main_text(page, path or None))
        return [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]

    got = add_columns(source, both, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], again)
    return got.select(*[F.col(f"`{c}`") for c in taken], "text", "n_chars")
