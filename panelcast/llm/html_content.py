"""Main text of web pages: the contiguous region of highest score.

A page becomes a row of tokens. Elements that never hold the article (menus, forms, scripts, adverts, comments ...)
count nothing and give no text. Every other word scores by where it stands, every tag costs something, and a linear
scan finds the stretch of tokens with the largest sum; its words are the main text.

Weights come from labelled pages. A word's place is its nearest block element and whether it is in a link. An article or
main element that holds at least half of a page's words outside links is the page's article; a word is then inside or
outside of it, which goes into its feature next to the place. On pages without such an element (no mark, or marks on
teasers only) the place alone decides. Pages with an article label their own words: a feature's weight is the share of such
words that are article text, less a half, and a tag's cost is the share of such tags elsewhere. No mark is taken for
granted: every word and tag scores by its learned weight. At most about `fit_pages` pages, chosen by a hash, are used for fitting.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 2000
SMOOTHING = 1.0

#: HTML element names by role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "option", "math", "canvas"}
NEVER = {"head", "nav", "aside", "footer", "form", "button", "dialog", "menu", "fieldset", "label", "input", "figcaption"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figure", "h1",
         "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "main"}
#: Words in class, id and role attributes of parts that are not the article.
ASIDE = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
         "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "menubar",
         "modal", "nav", "navbar", "navigation", "newsletter", "notice", "paywall", "popup", "promo", "recommended",
         "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
         "sponsored", "subscribe", "teaser", "teasers", "toolbar", "widget"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z|(?P<text>[^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|$|/)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)


def _words_of(attributes: str, split: str) -> set[str]:
    return {w for found in ATTRIBUTE.findall(attributes) for w in re.split(split, "".join(found).lower())}


def _is_aside(name: str, attributes: str, in_container: bool) -> bool:
    """Whether an element starts a part without article text.

    An article is one where a whole name of its class, id or role says so: `comment` does, `post-with-comments` does not.
    """
    if name in NEVER or (name == "header" and not in_container):
        return True
    if not attributes or name in ("body", "html"):
        return False
    if HIDDEN.search(attributes):
        return True
    if name == "main":
        return False
    if name == "article":
        return any(w in ASIDE or w.startswith("comment") for w in _words_of(attributes, r"\s+"))
    return bool(_words_of(attributes, r"[^a-z]+") & ASIDE)


def _closed_by(name: str) -> tuple[str, ...]:
    if name == "li":
        return ("li",)
    if name in ("td", "th"):
        return ("td", "th")
    if name in ("tr", "dt", "dd", "option"):
        return (name,) if name == "tr" else ("dt", "dd")
    return ("p",) if name in BLOCK else ()


class _Open:
    """The open elements, with what words ask of them at hand: constant work per tag, however deep the nesting."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []  # name, whether it starts a part left out, number of the container
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are not inline
        self.containers: list[int] = []  # numbers of the open ones
        self.left_out = self.links = self.made = 0

    def push(self, name: str, aside: bool) -> None:
        place, number = len(self.stack), 0
        if name in CONTAINER:
            self.made += 1
            number = self.made
            self.containers.append(number)
        self.stack.append((name, aside, number))
        self.at.setdefault(name, []).append(place)
        if name not in INLINE:
            self.blocks.append(place)
        self.left_out += aside
        self.links += name == "a"

    def last(self, names: tuple[str, ...]) -> int:
        """Place of the innermost of these elements, -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, place: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.stack) > place:
            name, aside, number = self.stack.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            if number:
                self.containers.pop()
            self.left_out -= aside
            self.links -= name == "a"

    def outermost(self) -> int:
        return self.containers[0] if self.containers else 0

    def place(self) -> str:
        block = self.stack[self.blocks[-1]][0] if self.blocks else ""
        return f"{block if block in BLOCK else 'other'}{' link' if self.links else ''}"


def tokens(page: str):
    """(kind, value, place, container, words): text with its place, and tags; parts left out give nothing.

    kind is 'text' (words between two tags, all of one place, joined by a space), 'space' (white space at its ends), 'tag' or
    'break' (a tag that ends a block). place is the nearest block element, with a mark for links; container is the number of the outermost open article or main element, or 0.
    """
    opened = _Open()
    at, inside = 0, 0
    while at < len(page):
        found = TOKEN.match(page, at)
        if found is None:
            break
        at = found.end()
        text = found.group("text")
        if text is not None:
            if not opened.left_out:
                parts = [text]
                while at < len(page) and (more := TOKEN.match(page, at)) is not None and more.group("text") is not None:
                    parts.append(more.group("text"))  # a lone '<' is text
                    at = more.end()
                plain = entities.unescape("".join(parts))
                place = opened.place()
                if plain[:1].isspace():
                    yield "space", "", place, inside, 0
                words = plain.split()
                if words:
                    yield "text", " ".join(words), place, inside, len(words)
                    if plain[-1:].isspace():
                        yield "space", "", place, inside, 0
            continue
        name = (found.group("name") or found.group("name2") or "").lower()
        if not name:
            continue
        attributes = found.group("attrs") or found.group("attrs2") or ""
        if found.group("close") or found.group("close2"):
            place = opened.last((name,))
            if place >= 0:
                closed_aside = opened.stack[place][1]
                opened.close(place)
                inside = opened.outermost()
                if closed_aside:  # a part left out costs nothing, but still separates blocks
                    if not opened.left_out and name not in INLINE:
                        yield "space", "", "", 0, 0
                    continue
        else:
            ends = _closed_by(name)
            while ends and (place := opened.last(ends)) >= 0 and opened.blocks[-1] <= place:  # else it belongs to an outer block
                opened.close(place)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name not in VOID and not attributes.rstrip().endswith("/"):
                opened.push(name, _is_aside(name, attributes, bool(opened.containers)))
            inside = opened.outermost()
        if not opened.left_out:
            known = name if name in BLOCK or name in INLINE or name in VOID else "other"
            yield ("tag" if name in INLINE else "break"), known, "", inside, 0


def article_of(units: list) -> int:
    """The number of the outermost article or main element with at least half of the words outside links; 0 if there is none."""
    held: dict[int, int] = {}
    total = 0
    for kind, _, place, inside, words in units:
        if kind == "text" and not place.endswith("link"):
            total += words
            if inside:
                held[inside] = held.get(inside, 0) + words
    return min((number for number, words in held.items() if 2 * words >= total), default=0)


def _features(kind: str, value: str, place: str, side: str) -> tuple[str, ...]:
    """Names of the feature, the most special one first: with the side of the article, that side alone, the place alone."""
    if kind == "text":
        return (f"word {place} {side}", f"word * {side}", f"word {place}") if side else (f"word {place}",)
    if kind == "space":
        return ()
    return (f"tag {value} {side}", f"tag {value}") if side else (f"tag {value}",)


def _side(article: int, inside: int) -> str:
    return "" if not article else "in" if article == inside else "out"


def _count(batches):
    """How often each feature stands inside and outside the article of labelled pages."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for page in batch.column("html").to_pylist():
            units = list(tokens(page))
            article = article_of(units)
            if not article:
                continue
            for kind, value, place, inside, words in units:
                side = _side(article, inside)
                for feature in _features(kind, value, place, side):
                    counts.setdefault(feature, [0, 0])[side == "in"] += words or 1
    rows = [(f, a, b) for f, (a, b) in counts.items()]
    columns = list(zip(*rows)) if rows else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                      pa.array(columns[2], pa.int64())], names=["feature", "outside", "inside"])


def fit(pages: DataFrame, html: str = "html", fit_pages: int = FIT_PAGES) -> dict[str, float]:
    """Share of each feature that lies in an article. The features are few: element names, with and without a link."""
    labelled = pages.select(F.col(html).alias("html")).where(F.lower("html").rlike(r"<(article|main)[\s>]"))
    share = fit_pages / max(1, labelled.count())
    chosen = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = chosen.mapInArrow(_count, "feature string, outside bigint, inside bigint").groupBy("feature").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return {r["feature"]: (r["inside"] + SMOOTHING) / (r["inside"] + r["outside"] + 2 * SMOOTHING) for r in rows}


def scores(units: list, shares: dict[str, float]) -> list[float]:
    """What each unit adds to a region: each word its share less a half, tags a cost, white space nothing.

    The words of one text have one weight, so a best region never ends between them.
    """
    article, known, out = article_of(units), {}, []
    for kind, value, place, inside, words in units:
        if kind == "space":
            out.append(0.0)
            continue
        key = (place if kind == "text" else value, kind == "text", _side(article, inside))
        if key not in known:
            # unseen places count as running text unless they are links
            unseen = 0.5 if kind != "text" else 0.25 if place.endswith("link") else 0.75
            share = next((shares[f] for f in _features(kind, value, place, key[2]) if f in shares), unseen)
            known[key] = share - 0.5 if kind == "text" else -0.01 - 0.5 * (1 - share)
        out.append(known[key] * (words or 1))
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """The stretch [from, to) of the largest sum over 0; of equal ones the first. One pass."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for k, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, best_from, best_to = total, start, k + 1
    return best_from, best_to


def main_text(page: str | None, shares: dict[str, float]) -> str:
    """Text of the best region of a page: its blocks joined by spaces."""
    units = list(tokens(page or ""))
    best_from, best_to = best_region(scores(units, shares))
    out: list[str] = []
    gap = ""
    for kind, value, _, _, _ in units[best_from:best_to]:
        if kind == "text":
            out.append((gap if out else "") + value)
            gap = ""
        elif kind != "tag":
            gap = " "
    return "".join(out)


def _extract(shares: dict[str, float]):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, shares) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])
    return run


def extract(pages: DataFrame, keep: list[str], html: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """Columns `keep` of every page with `text` and `n_chars` (code points).

    Defined results: null, empty and wordless pages have empty text; malformed markup is read as browsers do as far as
    elements and text go, and a tag cut off by the end of the page is no text; of equal regions the first is taken;
    repeated rows give equal results; kept columns named like a result column are replaced by it. Pages of any length are read
    whole, in time that grows with their length; an empty table gives an empty one.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(*keep).alias("row"), F.col(html).alias("html"))
    out = rows.mapInArrow(_extract(fit(pages, html, fit_pages)),
                          f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars bigint")
    return out.select("row.*", "text", "n_chars")
