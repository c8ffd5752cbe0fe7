"""Main text of web pages by site style trees.

Pages of one host are merged into one style tree. Its elements are named by their path of tags and classes, by a
hash of the parent's name and their own, however deep they are. An element has presentations (the sequences of child tags it
shows) and contents (the text blocks directly in it). Presentations are counted over the pages of the host, contents over its
distinct bodies, so that copies of a page count once:

* A content found in n of M bodies has importance 1 - log_M(n): 1 if it is in one only, 0 if it is in all.
* The entropy of an element's presentations, in logarithms to base of the pages, is its presentation importance. With l
  presentations its importance is (1 - 0.9^l) * presentation importance + 0.9^l * mean importance of its own contents.

An element is noisy if it and all its contents are below the threshold. Contents below the threshold are the host's
boilerplate and are removed from each page, whatever they are in; an important content stays, whatever it is in, so an
element around others is never removed as such. What a page declares itself comes first: elements that are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments by tag, role, class or id are removed and are
no part of the tree, and only the article it marks (article, main, role main) is looked at. There a copy of an article, which
recurs with changes, must not be taken for boilerplate: blocks of noisy elements are removed, but recurring blocks of other
elements only if they are less than half of the rest, and an article of nothing but boilerplate is kept whole.

Only counts per (host, element, value, body) are shuffled, and they are summed before: a host with a third of all pages is no
hot key. Pages meet their host's boilerplate, a list of hashes, in a join on the host and one of its parts, at most 64;
the list is short, since a content must recur in M^0.75 bodies to be in it, and each part that has pages has a copy.

Defined results: null or empty html gives an empty text; a null url is a host of its own; pages of hosts with one
body go by what they declare; repeated rows are pages of their own with one body; a table without rows gives none. Pages are
parsed whole. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import saved

THRESHOLD, DECAY = 0.25, 0.9
#: Parts that a host's pages are dealt to when they meet its boilerplate, so that a hot host is no hot key.
SPREAD = 64

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never part of an article.
BARRED_TAGS = set("script style noscript template nav footer aside form iframe svg canvas object button select textarea menu dialog head title input label fieldset audio video".split())
BARRED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BARRED_NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comments comment commentlist respond replies disqus share sharing social related recommended widget widgets toolbar pagination pager login signup search skip masthead topbar".split())
#: Words that say only how a part is built, so that beside a barred word they leave it what it is.
PLAIN_NAMES = set("area bar block body box button buttons card cards col column container content cta desktop footer group grid head header heading icon icons inline inner item items left link links list main mobile outer page panel post posts right row section site slot small story stories article articles text title top bottom top unit user wrap wrapper".split())
#: Barred outside a marked article only.
BARRED_OUTSIDE = {"header"}
ARTICLE_TAGS = {"article", "main"}
#: Elements that hold a whole page, so their names (such as has-sidebar) say nothing about what is in them.
FRAMES = {"html", "body", "main"}
LAYOUT = re.compile(r"(?:has|with|no|without|is)[-_]", re.IGNORECASE)
#: A start tag of the key ends an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAME = re.compile(r"[a-z]+")
SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def hashed(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - 2**63


class Page(HTMLParser):
    """Text blocks of a page, each with its element and what the page declares about it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: (element, text, declared boilerplate, number of its marked article or 0)
        self.blocks: list[tuple[int, str, bool, int]] = []
        #: (element, hash of the child tags) of each element that is not declared boilerplate
        self.shapes: set[tuple[int, int]] = set()
        # tag, element, barred, article, child tags
        self.open: list[tuple[str, int, bool, int, list[str]]] = [("", 0, False, 0, [])]
        self.text: list[str] = []
        self.articles: list[str] = []
        self.feed(html)
        self.close()
        self.flush()
        while len(self.open) > 1:
            self.pop()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            _, element, barred, article, _ = self.open[-1]
            self.blocks.append((element, text, barred, article))

    def pop(self) -> None:
        _, element, barred, _, children = self.open.pop()
        if not barred:
            self.shapes.add((element, hashed(*children)))

    def declared(self, tag: str, own: dict[str, str]) -> bool:
        """Whether an element says by its tag, role, class, id or style that it is no part of an article."""
        words = [] if tag in FRAMES else [w for w in f"{own.get('class', '')} {own.get('id', '')}".split() if not LAYOUT.match(w)]
        named = [set(NAME.findall(SPLIT_CAMEL.sub("-", w).lower())) for w in words]
        if self.open[-1][3]:  # in an article a name must be about nothing else: share-buttons, but not share-price
            named = [n for n in named if n <= BARRED_NAMES | PLAIN_NAMES]
        names = set().union(*named)
        outside = not self.open[-1][3] and (tag in BARRED_OUTSIDE or bool(names & BARRED_OUTSIDE))
        unseen = "hidden" in own or "display:none" in own.get("style", "").replace(" ", "").lower()
        return outside or unseen or tag in BARRED_TAGS or own.get("role", "").lower() in BARRED_ROLES or bool(names & BARRED_NAMES)

    def handle_starttag(self, tag: str, attrs) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag in INLINE and (tag in VOID or not attrs or not self.declared(tag, own)):
            return  # part of the text around it
        self.flush()
        if tag not in INLINE:
            while len(self.open) > 1 and (self.open[-1][0] == "p" or self.open[-1][0] in CLOSES.get(tag, ()) or self.open[-1][0] in INLINE):
                self.pop()
        if tag in VOID:
            return
        _, parent, barred, article, children = self.open[-1]
        barred = barred or self.declared(tag, own)
        if not barred:
            children.append(tag)
        if not barred and (tag in ARTICLE_TAGS or own.get("role", "").lower() in ("main", "article")):
            self.articles.append("article" if tag == "article" or own.get("role", "").lower() == "article" else "main")
            article = len(self.articles)
        style = hashed(parent, tag, " ".join(sorted(own.get("class", "").split())), own.get("role", ""))
        self.open.append((tag, style, barred, article, []))

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.flush()
                while len(self.open) > i:
                    self.pop()
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def marked(self) -> list[tuple[int, str, bool, int]]:
        """The open blocks of the marked article, none if there is no such block. Where a page's main part holds more than twice
        as much text outside its articles as in them, these are only parts of it (such as teasers), and the whole main part is the article."""
        open_ = [b for b in self.blocks if not b[2] and b[3]]
        inside = [b for b in open_ if self.articles[b[3] - 1] == "article"]
        held = sum(len(b[1]) for b in inside)
        return inside if inside and 3 * held >= sum(len(b[1]) for b in open_) else open_

    def body(self) -> int:
        """Hash of the marked article's text or, without one, of all open blocks: the same for copies in other surroundings."""
        return hashed(*(text for _, text, _, _ in self.marked() or [b for b in self.blocks if not b[2]]))

    def main_text(self, low: set[int]) -> str:
        """The blocks of the marked article, or else of the page, that are no boilerplate, in page order."""
        marked = self.marked()
        if not marked:
            return " ".join(text for element, text, barred, _ in self.blocks if not barred and not (low and content_key(element, text) in low))
        left = [(text, content_key(element, text) in low) for element, text, _, _ in marked if element not in low] if low else []
        own = [text for text, recurs in left if not recurs]
        if 2 * sum(map(len, own)) >= sum(len(text) for text, _ in left):
            left = [(text, False) for text in own]
        return " ".join([text for text, _ in left] or [text for _, text, _, _ in marked])


def content_key(element: int, text: str) -> int:
    return hashed(element, text)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


PAGE, CONTENT, SHAPE = 0, 1, 2


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, html in zip(*batch.columns, strict=True):
            page = Page(html.as_py() or "")
            body = page.body()
            rows = [(PAGE, 0, body, 0)]
            rows += [(CONTENT, element, key, body) for element, key in {(e, content_key(e, text)) for e, text, barred, _ in page.blocks if not barred}]
            rows += [(SHAPE, element, key, 0) for element, key in page.shapes]
            kinds, elements, values, bodies = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), pa.array(kinds, pa.int8()), *(pa.array(c, pa.int64()) for c in (elements, values, bodies))], names=["host", "kind", "element", "value", "body"])


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Importance of contents (host, element, value, n, k, importance) and of elements (host, element, importance, most), from (host, html).

    ``n`` is the number of bodies with a value, ``most`` the importance of an element's most important content. Values of one
    body only are many and alike, so they are one row for each element: ``k`` of them, without a value.
    """
    by_body = pages.mapInArrow(_nodes, "host string, kind tinyint, element bigint, value bigint, body bigint").groupBy("host", "kind", "element", "value", "body").agg(F.count("*").alias("rows"))
    counted = by_body.groupBy("host", "kind", "element", "value").agg(F.sum(F.when(F.col("kind") == CONTENT, 1).otherwise(F.col("rows"))).alias("n"))
    kept = F.when(F.col("n") > 1, F.col("value"))
    tree = saved(counted.groupBy("host", "kind", "element", kept.alias("value"), "n").agg(F.count("*").alias("k")))  # read three times, made once
    sizes = tree.where(F.col("kind") == PAGE).groupBy("host").agg(F.sum("k").alias("bodies"), F.sum(F.col("n") * F.col("k")).alias("pages")).where(F.col("bodies") > 1)
    sized = tree.join(sizes, "host")
    times = F.col("n") * F.col("k")
    contents = sized.where(F.col("kind") == CONTENT).select("host", "element", "value", "n", "k", (1 - F.log("n") / F.log("bodies")).alias("importance"))
    own = contents.groupBy("host", "element").agg((F.sum(times * F.col("importance")) / F.sum(times)).alias("content_importance"), F.max("importance").alias("most"))
    entropy = (F.log(F.sum(times)) - F.sum(times * F.log("n")) / F.sum(times)) / F.log(F.max("pages"))
    shapes = sized.where(F.col("kind") == SHAPE).groupBy("host", "element").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy)).alias("entropy"), F.sum("k").alias("l"))
    share = F.pow(F.lit(DECAY), F.col("l"))
    elements = own.join(shapes, ["host", "element"]).select("host", "element", ((1 - share) * F.col("entropy") + share * F.col("content_importance")).alias("importance"), "most")
    return contents, elements


def boilerplate(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, low: hashes of the host's contents below the threshold, and of the elements below it that hold no other contents."""
    contents, elements = style_tree(pages)
    noisy = elements.where((F.col("importance") < threshold) & (F.col("most") < threshold))
    low = contents.where(F.col("importance") < threshold).select("host", F.col("value").alias("low")).union(noisy.select("host", F.col("element").alias("low")))
    return low.groupBy("host").agg(F.collect_set("low").alias("low"))


@F.arrow_udf(T.StringType())
def _main_text(html: pa.Array, low: pa.Array) -> pa.Array:
    return pa.array([Page(h.as_py() or "").main_text(set(x.as_py() or ())) for h, x in zip(html, low, strict=True)], pa.string())


def main_texts(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text of each row of (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).alias("part"))
    low = boilerplate(rows.select("host", "html"), threshold).join(rows.select("host", "part").distinct(), "host")
    return rows.join(low, ["host", "part"], "left").select("page_id", "url", _main_text("html", "low").alias("text"))
