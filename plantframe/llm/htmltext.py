"""Main text of web pages by consensus of a host's pages.

Every page proposes the tightest container that holds most of its prose. The proposals, as paths of tags and classes
with digits blanked, are counted per host, and each page is extracted with the paths that its host agrees on. A page
on which none of them occurs uses its own. Headings, leads and endings often stand outside of the tightest container:
on each page the path is widened to the article or main element around it, or as far as only such blocks are added.

A page is read once, from left to right, into flat lists of elements and blocks; time and memory grow with its length,
however broken or deep it is. What is no article, is decided after reading: class names and tags only suggest it, and
an element that holds the article is none of it whatever it is called.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantframe.session import stage

#: Share of a host's pages that a path needs; so at most five paths of a host are kept.
LEAST_SHARE = 0.2
#: Share of a page's prose that a container must hold to be proposed.
MOST_OF = 0.8
#: Winning paths of all hosts that go to every task, in bytes; more are joined.
SENT_BYTES = 64 << 20
#: Parts that the pages of each host are spread over when they are joined with its paths.
PARTS = 32
#: Weight of prose inside of article or main elements.
SEMANTIC = 3
#: A list whose text is linked to this share, with short links on average, is a menu.
LINKED, SHORT_LINK = 0.9, 40

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style noscript template iframe object svg math canvas audio video map select textarea button".split())
BOILERPLATE = set("nav footer aside form menu dialog search".split())
CONTAINERS = set("article body center div main section table tbody td tr".split())
#: Words of class names, ids and roles that mark what is no article.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies discussion disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signin signup social "
    "sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words of class names, ids and roles of containers that are parts of an article.
PARTS_OF_ARTICLE = set("abstract article body byline content conclusion deck dek entry headline heading intro introduction lead lede outro post standfirst subtitle summary text title".split())
#: First words of class names that say something about the page, not about the element.
OF_THE_PAGE = set("category format has is layout no not page single tag template theme type with without".split())
#: Words of what readers wrote; it is no article even where it is most of the page.
BY_READERS = set("comment comments discussion disqus replies respond".split())
FIELDS = set("input select textarea".split())
#: Elements whose content is no markup.
RAW = set("script style template noscript textarea title iframe".split())
#: Tags whose start ends an open element of the same kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements in which those ends stop.
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"=\s*([\"'])")
_ENDS = {tag: re.compile(f"</{tag}(?![a-zA-Z0-9])", re.I) for tag in RAW}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_NOISY, _READERS = 1, 2


def suspicion(tag: str, names: list[str]) -> int:
    """Whether class names, id and role suggest that an element is no article: ``_NOISY``, ``_READERS`` or 0.

    A name counts if at least half of its words do; names about the whole page don't.
    """
    found = 0
    for name in names if tag not in ("html", "body") else ():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in OF_THE_PAGE and len(words) > 1:
            continue
        if 2 * sum(w in NOISE for w in words) >= len(words):
            found |= _READERS if BY_READERS & set(words) else _NOISY
    return _READERS if found & _READERS else found


class Page:
    """Elements in the order of their starts, each with its parent's number, and blocks of text in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.step = ["html"], [-1], [0], ["html"]
        self.suspect, self.semantic, self.region, self.fields = [0], [False], [-1], [0]
        self.block_of: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._read(html)
        self._judge()

    def _start(self, tag: str, attributes: str, at: int) -> int:
        found = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes else {}
        classes = found.get("class", "").split()
        names = classes + [found[k] for k in ("id", "role") if k in found]
        words = {w.lower() for n in names for w in _WORD.findall(n)}
        me = len(self.tag)
        inside = self.semantic[at]
        self.tag.append(tag)
        self.parent.append(at)
        self.depth.append(self.depth[at] + 1)
        self.step.append(".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})]))
        self.semantic.append(inside or tag in ("article", "main") or found.get("role", "").lower() == "main")
        self.suspect.append((_NOISY if tag in BOILERPLATE or tag == "header" and not inside else 0) or suspicion(tag, names))
        # number of the nearest container that is not named as a part of an article
        self.region.append(me if tag in CONTAINERS and not words & PARTS_OF_ARTICLE else self.region[at])
        self.fields.append(0)
        return me

    def _read(self, html: str) -> None:
        at = owner = 0
        parts: list[str] = []
        linked, in_link, body = 0, False, False
        #: open elements by tag since the last list or table began; a new count for each of those
        scopes, opened = [Counter()], Counter()
        dead: set[str] = set()  # quotes that close nowhere behind this point

        def flush():
            nonlocal linked
            whole = " ".join("".join(parts).split())
            if whole:
                self.block_of.append(owner)
                self.text.append(whole)
                self.linked.append(linked)
            parts.clear()
            linked = 0

        def close(up: int) -> int:
            """Ends all elements up to and with one that is open; the number of what is then innermost."""
            here = at
            while True:
                opened[self.tag[here]] -= 1
                scopes[-1][self.tag[here]] -= 1
                if self.tag[here] in SCOPES:
                    scopes.pop()
                    scopes[-1][self.tag[here]] -= 1
                here, last = self.parent[here], here
                if last == up:
                    return here

        i, n = 0, len(html)
        while i < n:
            lt = html.find("<", i)
            lt = n if lt < 0 else lt
            if lt > i and self.tag[at] not in HIDDEN:
                part = unescape(html[i:lt])
                parts.append(part)
                linked += len(part) if in_link else 0
            if lt == n:
                break
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                i = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                i = n if end < 0 else end + 1
                continue
            match = _TAG.match(html, lt)
            if match is None:
                if self.tag[at] not in HIDDEN:
                    parts.append("<")
                i = lt + 1
                continue
            end = html.find(">", match.end())
            if end < 0:
                break  # no tag ends behind this point
            quoted = match.end()
            while quote := _QUOTE.search(html, quoted, end):
                shut = html.find(quote[1], quote.end()) if quote[1] not in dead else -1
                if shut < 0:
                    dead.add(quote[1])
                    break
                quoted = shut + 1
                if shut > end:
                    end = html.find(">", shut)
                    if end < 0:
                        break
            if end < 0:
                break
            i, tag, ending = end + 1, match[1].lower(), html[lt + 1] == "/"
            if tag in RAW and not ending:
                over = _ENDS[tag].search(html, i)
                if tag in FIELDS:
                    self.fields[at] += 1
                flush()
                stop = -1 if over is None else html.find(">", over.end())
                i = n if stop < 0 else stop + 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not ending
            elif tag in FIELDS and not ending:
                self.fields[at] += 1
                if tag == "select":
                    flush()
                    at = owner = self._start(tag, "", at)
                    opened[tag] += 1
                    scopes[-1][tag] += 1
                    scopes.append(Counter())
            elif tag in BLOCKS or tag in HIDDEN:
                flush()
                if ending:
                    if opened[tag] > 0:
                        up = at
                        while self.tag[up] != tag:
                            up = self.parent[up]
                        at = close(up)
                elif tag not in VOID and tag != "html" and not (tag == "body" and body):
                    body = body or tag == "body"
                    if self.tag[at] == "p":
                        at = close(at)
                    ends = CLOSES.get(tag, ())
                    while any(scopes[-1][t] > 0 for t in ends):
                        up = at
                        while self.tag[up] not in ends:
                            up = self.parent[up]
                        at = close(up)
                    at = self._start(tag, html[match.end() : end], at)
                    opened[tag] += 1
                    scopes[-1][tag] += 1
                    if tag in SCOPES:
                        scopes.append(Counter())
                owner, in_link = at, False
        flush()

    def _sums(self, values: list[float]) -> list[float]:
        """Values of blocks summed over each element and all inside it."""
        total = [0.0] * len(self.tag)
        for e, v in zip(self.block_of, values):
            total[e] += v
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def _judge(self) -> None:
        """Marks elements that are no article, and all inside them."""
        n = len(self.tag)
        prose = self._sums([max(0, len(t) - 2 * k) for t, k in zip(self.text, self.linked)])
        letters, links = self._sums([len(t) for t in self.text]), self._sums(self.linked)
        count = self._sums([1.0] * len(self.text))
        most = prose[0] / 2
        # the article: a main element, or an article element with half of the prose; what holds it is no noise
        holds, fields, chief = [False] * n, list(self.fields), False
        for e in range(n - 1, -1, -1):
            if self.tag[e] == "main" or self.tag[e] == "article" and prose[e] > most:
                if prose[e] > 0 and self.suspect[e] != _READERS:
                    holds[e] = chief = True
            if e:
                fields[self.parent[e]] += fields[e]
                holds[self.parent[e]] |= holds[e]
        self.noise = [False] * n
        for e in range(1, n):
            tag, suspect = self.tag[e], self.suspect[e]
            if tag == "form":
                own = fields[e] > 0 and not (prose[e] > most)
            elif suspect and tag not in BOILERPLATE and tag != "header":
                own = suspect == _READERS or chief or not prose[e] > most
            else:
                own = bool(suspect)
            menu = tag in ("ul", "ol", "dl") and count[e] > 1 and links[e] >= LINKED * letters[e] and letters[e] < SHORT_LINK * count[e]
            self.noise[e] = self.noise[self.parent[e]] or tag in HIDDEN or own and not holds[e] or menu
        keep = [i for i, e in enumerate(self.block_of) if not self.noise[e]]
        self.block_of = [self.block_of[i] for i in keep]
        self.text, self.linked = [self.text[i] for i in keep], [self.linked[i] for i in keep]

    def path(self, e: int) -> str:
        steps = []
        while e >= 0:
            steps.append(self.step[e])
            e = self.parent[e]
        return ">".join(reversed(steps))

    def proposal(self) -> int | None:
        """The deepest container with most of the page's prose, of several the first; none if there is no prose."""
        value = self._sums([max(0, len(t) - 2 * k) * (SEMANTIC if self.semantic[e] else 1) for e, t, k in zip(self.block_of, self.text, self.linked)])
        fit = [e for e, v in enumerate(value) if v >= MOST_OF * value[0] and self.tag[e] in CONTAINERS] if value[0] else []
        return max(fit, key=lambda e: (self.depth[e], -e)) if fit else None

    def below(self, path: str) -> tuple[int | None, list[bool]]:
        """The first element of a path with text inside it, and for each element whether it lies in one of the path."""
        steps = path.split(">")
        fits, inside = [False] * len(self.tag), [False] * len(self.tag)
        for e, up in enumerate(self.parent):
            d = self.depth[e]
            fits[e] = d < len(steps) and self.step[e] == steps[d] and (up < 0 or fits[up])
            inside[e] = up >= 0 and inside[up] or fits[e] and d == len(steps) - 1
        first = next((e for e in self.block_of if inside[e]), None)
        while first is not None and not (fits[first] and self.depth[first] == len(steps) - 1):
            first = self.parent[first]
        return first, inside

    def widened(self, start: int, inside: list[bool]) -> list[bool]:
        """Which blocks lie in the path or around it: up to the article or main element, and from there to the outermost
        ancestor below the body that adds only headings and prose in no container of its own."""
        chosen = [inside[e] for e in self.block_of]
        last = list(range(len(self.tag)))
        for e in range(len(last) - 1, 0, -1):
            last[self.parent[e]] = max(last[self.parent[e]], last[e])
        # blocks of an element and all inside it are neighbours
        low = high = next(i for i, e in enumerate(self.block_of) if start <= e <= last[start])
        up, pending = start, []
        while up >= 0 and (up == start or self.tag[up] not in ("body", "html")):
            added = []
            while low > 0 and up <= self.block_of[low - 1] <= last[up]:
                low -= 1
                added.append(low)
            while high < len(chosen) and up <= self.block_of[high] <= last[up]:
                added.append(high)
                high += 1
            added = [i for i in added if not chosen[i]]
            if not (up == start or self.semantic[up]):
                for i in added:
                    e = self.block_of[i]
                    prose = self.linked[i] * 2 < len(self.text[i]) or self.tag[e] in HEADINGS
                    if not prose or self.region[e] >= 0 and self.depth[self.region[e]] > self.depth[up]:
                        return chosen
            for i in added:
                chosen[i] = True
            up = self.parent[up]
        return chosen

    def main_text(self, paths: list[str]) -> str:
        """Blocks inside of the first of the paths that occurs with text, widened, joined by line feeds."""
        own = self.proposal() if paths else None
        for path in [*paths, *([self.path(own)] if own is not None else [])]:
            start, inside = self.below(path)
            if start is not None:
                return "\n".join(t for t, yes in zip(self.text, self.widened(start, inside)) if yes)
        return "\n".join(self.text)


def proposal(html: str) -> str | None:
    """Path of the container that a page proposes."""
    page = Page(html)
    found = page.proposal()
    return None if found is None else page.path(found)


def main_text(html: str, paths: list[str]) -> str:
    return Page(html).main_text(paths)


def extract(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``row`` (all columns of ``pages`` as a struct), ``text`` and ``n_chars`` of every page.

    Pages whose address has no host vote among themselves; of paths with as many votes, the smaller string comes
    first. Null or empty html gives the empty text. Rows are neither dropped nor merged; equal rows have equal texts.

    The winning paths, five of a host at most, go to every task if they are small; else they are joined.
    """

    @F.arrow_udf("string")
    def propose(html: pa.Array) -> pa.Array:
        return pa.array([proposal(h) if h else None for h in html.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def text_of(html: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([main_text(h, p or []) if h else "" for h, p in zip(html.to_pylist(), paths.to_pylist())], pa.string())

    host = F.lower(F.coalesce(F.try_parse_url(F.col(url_column), F.lit("HOST")), F.lit("")))
    votes = pages.select(host.alias("host"), propose(F.col(html_column)).alias("path")).groupBy("host", "path").count().filter("path IS NOT NULL")
    votes = stage(votes, "votes")
    cast = votes.groupBy("host").agg(F.sum("count").alias("all"))
    winners = (
        votes.join(cast, "host").filter(F.col("count") >= LEAST_SHARE * F.col("all")).groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("count"), "path"))).alias("ranked")).select("host", F.col("ranked.path").alias("paths"))
    )
    winners = stage(winners, "winners")
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length(F.concat_ws("", "paths")) + 64), F.lit(0))).first()[0]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), F.col(html_column).alias("html"))
    if size <= SENT_BYTES:
        met = rows.join(F.broadcast(winners), "host", "left")
    else:
        part = F.pmod(F.xxhash64("html"), F.lit(PARTS))
        copies = winners.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        met = rows.withColumn("part", part).join(copies, ["host", "part"], "left")
    texts = met.select("row", text_of("html", "paths").alias("text"))
    return texts.select("row", "text", F.length("text").cast("long").alias("n_chars"))
