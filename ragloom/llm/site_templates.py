"""Main text of web pages, with the templates of their sites removed.

Every element's subtree is hashed. Spark counts on how many pages of its host a
hash occurs; subtrees that recur on many pages are the site's, not the page's,
and are deleted, along with regions that are never main text by their tag or
role. Inside a page's article only boxes count as template, never its paragraphs
and headings, as articles may quote or copy each other. Copies of a page or of an
article count once, and what holds the article or most of the text is no template.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import frozen

# Nothing is given back once matched, so that a tag without an end is read once.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: What may begin behind the last ">" of a page.
_UNENDED = re.compile(r"<!--.*|<!\[CDATA\[(.*)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Element kinds of HTML and words that name regions of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object audio video canvas".split())
RAW_TEXT = frozenset("script style textarea title iframe".split())  # these end at their end tag alone
NEVER = frozenset("head nav footer aside form button select option fieldset dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
BOXES = frozenset("aside details div dl figure footer form header ol section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
ITEMS = frozenset("body html caption td th tr tbody thead tfoot li dd dt".split())
CLOSES_P = BLOCKS - ITEMS
SCOPES = frozenset("ul ol dl table select body html".split())
REGION_WORDS = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie "
                         "cookies consent gdpr notice popup modal newsletter subscribe subscription breadcrumb "
                         "breadcrumbs share sharing social related recommended sidebar widget menu nav navbar "
                         "navigation footer masthead pagination pager toolbar comment comments disqus respond "
                         "replies".split())
# Words that may stand beside a region word in one class or id that names the region.
PART_WORDS = frozenset("a actions area areas article articles bar block body bottom box button buttons card cards "
                       "center col column container content desktop fixed flex footer form global grid group header "
                       "heading holder icon icons inline inner item items label large leaderboard left link links "
                       "list main mobile module news outer overlay page pages panel post posts primary rail region "
                       "right row secondary section signup site slot small stack sticky stories story strip title "
                       "top unit ui wrap wrapper zone".split())
REGION_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu "
                         "menubar toolbar".split())

SALTS = 16  # parts that a template of all pages of a host is dealt in


@dataclass(frozen=True)
class Settings:
    """A subtree is a template if it occurs on ``least_pages`` pages of different content of
    its host, however many pages the host has. Hosts with up to ``listed`` templates have
    them joined as one list, others page by page, each with its own."""
    least_pages: int = 4
    listed: int = 1000


@dataclass
class Element:
    tag: str
    refused: bool  # never main text, by tag or role (or by name, once name_regions has run)
    main: bool
    named: bool = False  # a class or id names a region
    parts: list = field(default_factory=list)  # texts and elements in order
    key: int = 0
    size: int = 0
    kept: int = 0  # characters outside refused elements
    holds: bool = False  # is or contains an article or main


def _names_region(names: str) -> bool:
    """Whether a class or id, taken whole, names a region: "post-comments", not "comment-history"."""
    for name in names.split():
        words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
        if not REGION_WORDS.isdisjoint(words) and all(w in REGION_WORDS or w in PART_WORDS for w in words):
            return True
    return False


def _opened(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    refused, main, named = tag in NEVER, tag in ("article", "main"), False
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden":
                refused = True
            elif name == "role":
                refused |= value in REGION_ROLES
                main |= value == "main"
            else:
                named |= tag not in ("body", "html") and _names_region(value)
    return refused, main, named


class _Open:
    """The stack of open elements, with the places of each tag in it."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, element: Element) -> None:
        self.stack[-1].parts.append(element)
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def cut(self, at: int) -> None:
        """Close the element at a place of the stack and all inside it."""
        for element in self.stack[at:]:
            self.places[element.tag].pop()
        del self.stack[at:]

    def innermost(self, tags) -> int:
        """Place of the innermost open element of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> Element:
    """A forgiving element tree: ends that are missing are implied, as browsers do.

    Takes time in proportion to the page, however deep it nests and whatever it leaves open."""
    root = Element("#root", False, False)
    open_, at, size, last_end = _Open(root), 0, len(page), page.rfind(">")

    def text(piece: str) -> None:
        if piece:
            open_.stack[-1].parts.append(html.unescape(piece) if "&" in piece else piece)

    while at < size:
        found = (_TAG if at <= last_end else _UNENDED).search(page, at)
        if not found:
            if at <= last_end:  # no tag ends; a comment may still begin
                last_end = at - 1
                continue
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        if found.re is _UNENDED:
            text(found[1] or "")
            break
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        if found[1] or found[4]:
            place = open_.innermost((tag,))
            if place:
                open_.cut(place)
            continue
        if tag in RAW:
            if tag in RAW_TEXT or not found[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            open_.stack[-1].parts.append(Element(tag, True, False))
            continue
        if tag in CLOSES_P:
            place = open_.innermost(("p",))
            if place > open_.innermost(SCOPES):
                open_.cut(place)
        if tag in SIBLINGS:
            place = open_.innermost(SIBLINGS[tag])
            if place > open_.innermost(SCOPES):
                open_.cut(place)
        refused, main, named = _opened(tag, found[3] or found[6] or "")
        open_.push(Element(tag, refused, main, named))
    return root


def _walk(root: Element):
    """Elements after all that they contain, without recursion (pages nest deeply)."""
    todo, order = [root], []
    while todo:
        element = todo.pop()
        order.append(element)
        todo += [p for p in element.parts if isinstance(p, Element)]
    return reversed(order)


def hash_subtrees(root: Element) -> None:
    """Sets key (a hash of tag, texts and children), size, kept and holds of every element."""
    for element in _walk(root):
        digest = hashlib.blake2b(element.tag.encode(), digest_size=8)
        element.holds = element.main
        for part in element.parts:
            if isinstance(part, Element):
                digest.update(part.key.to_bytes(8, "little", signed=True))
                element.size += part.size
                element.kept += part.kept
                element.holds |= part.holds
            else:
                words = " ".join(part.split())
                digest.update(b"\0" + words.encode("utf-8", "replace"))
                element.size += len(words)
                element.kept += len(words)
        if element.refused:
            element.kept = 0
        element.key = int.from_bytes(digest.digest(), "little", signed=True)


def name_regions(root: Element) -> None:
    """Refuses elements whose class or id names a region, unless they are the page's text.

    These hold the only article or main of the page, or all text of the page or article
    they are in.
    """
    plain, todo = False, [root]
    while todo and not plain:
        element = todo.pop()
        if not (element.refused or element.named):
            plain = element.main
            todo += [p for p in element.parts if isinstance(p, Element)]
    changed = False
    places: list[tuple[Element, Element | None]] = [(root, None)]
    while places:
        element, article = places.pop()
        if element.named and not element.refused and (article or plain or not element.holds) and (
                element.kept < (article or root).kept):
            element.refused = changed = True
        if not element.refused:
            inside = article or (element if element.main else None)
            places += [(p, inside) for p in element.parts if isinstance(p, Element)]
    if changed:
        for element in _walk(root):
            own = sum(len(" ".join(p.split())) if isinstance(p, str) else p.kept for p in element.parts)
            element.kept = 0 if element.refused else own


def _bulk(root: Element) -> Element:
    """The innermost element with most of the page's text: what stands for a missing article."""
    bulk, found = root, root
    while found:
        bulk = found
        found = next((p for p in bulk.parts if isinstance(p, Element) and 2 * p.kept > root.kept), None)
    return bulk


def _candidates(root: Element):
    """(element, its article or None) for what may be a template of the site.

    These are all elements outside articles and boxes inside them. On pages without
    an article it is the blocks outside the bulk of the text, and boxes inside it.
    Elements that hold an article or most of the text are none.
    """
    bulk = None if root.holds else _bulk(root)
    if bulk and bulk.tag in ("#root", "html", "body"):
        bulk = None
    todo = [(root, None)]
    while todo:
        element, article = todo.pop()
        inside = article or (element if element.main or element is bulk else None)
        if element.size and not element.holds and 2 * element.kept <= root.kept and (
                element.tag in BOXES and 2 * element.size < article.size if article
                else element.tag not in ("#root", "html", "body") and (root.holds or element.tag in BLOCKS - ITEMS)):
            yield element, article
        todo += [(p, inside) for p in element.parts if isinstance(p, Element)]


def _sketch(article: Element, boxes: set[int]) -> int:
    """Smallest hash of 8 words in a row outside the boxes: mostly equal for near copies."""
    pieces, todo = [], [article]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            pieces.append(part)
        elif id(part) not in boxes and not part.refused:
            todo += reversed(part.parts)
    words = " ".join(pieces).encode("utf-8", "replace").split()
    if not words:
        return article.key
    return min(zlib.crc32(b" ".join(words[i:i + 8])) for i in range(max(len(words) - 7, 1)))


def subtree_places(page: str) -> dict[int, int]:
    """A number for the content around each candidate's key: equal where a page is a copy.

    Inside an article that is its own text, elsewhere the page; a page has one for a key.
    """
    root = parse(page)
    hash_subtrees(root)
    name_regions(root)
    found = list(_candidates(root))
    boxes = {id(e) for e, article in found if article}
    whole = root.key
    if root.holds:  # what surrounds an article is told apart by the page as it was sent
        whole = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest(),
                               "little", signed=True)
    sketches: dict[int, int] = {}
    places: dict[int, int] = {}
    for element, article in found:
        place = whole
        if article:
            if id(article) not in sketches:
                sketches[id(article)] = _sketch(article, boxes)
            place = sketches[id(article)]
        places[element.key] = min(place, places.get(element.key, place))
    return places


def subtree_keys(page: str) -> set[int]:
    return set(subtree_places(page))


def main_text(page: str, templates) -> tuple[str, int]:
    """Blocks of the article (else of main, else of the page) in page order, joined by one
    space; and the characters of the templates that were deleted first."""
    root = parse(page)
    hash_subtrees(root)
    name_regions(root)
    known = set(templates)
    dropped = {id(e) for e, _ in _candidates(root) if e.key in known} if known else set()
    deleted, todo = 0, [root]
    while todo and dropped:
        element = todo.pop()
        if id(element) in dropped:
            deleted += element.size
        else:
            todo += [p for p in element.parts if isinstance(p, Element)]

    def kept(element: Element) -> bool:
        return not (element.refused or id(element) in dropped)

    def mains(tags) -> list[Element]:
        found, todo = [], [root]
        while todo:
            element = todo.pop()
            if element is not root and not kept(element) and element.tag not in ("body", "html"):
                continue
            if element.main and (tags is None or element.tag in tags):
                found.append(element)
            else:
                todo += [p for p in reversed(element.parts) if isinstance(p, Element)]
        return found

    places = mains({"article"}) or mains(None) or [root]
    pieces: list[str] = []
    for place in places:
        todo: list = [place]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                pieces.append(part)
                continue
            if part.tag == "br" or part.tag == "hr" or part.tag in BLOCKS:
                pieces.append(" ")
            if part is not place and part is not root and not kept(part):
                continue
            if part.tag == "header" and part is not place and place is root:
                continue
            if part.tag in BLOCKS:
                todo.append(" ")
            todo += reversed(part.parts)
    return " ".join("".join(pieces).split()), deleted


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def recurring_keys(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, key) from a table (host, html): hashes on many pages of different content of the host."""
    def places(batches):
        for batch in batches:
            rows = {(host, key, place) for host, page in zip(batch["host"], batch["html"])
                    for key, place in subtree_places(page or "").items()}
            if rows:
                hosts, keys, contents = zip(*rows)
                yield pd.DataFrame({"host": hosts, "key": keys, "place": contents})

    # Equal rows meet first, then a hash's partial counts: no host or hash is gathered in a task.
    return (pages.select("host", "html").mapInPandas(places, "host string, key long, place long").distinct()
            .groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= settings.least_pages)
            .select("host", "key"))


def site_templates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, pages, templates) from a table (host, html): hashes recurring on many pages of the host.

    Copies of a page count once for a hash, however many there are.
    """
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lists = recurring_keys(pages, settings).groupBy("host").agg(F.collect_list("key").alias("templates"))
    return hosts.join(lists, "host", "left")


def _own_templates(source: DataFrame, keys: DataFrame) -> DataFrame:
    """(host, digest, templates) of the pages of (host, html, digest) that have any of the keys (host, key).

    Pages are dealt by their digest and keys by a salt, so neither a host nor a template of
    all its pages is one task.
    """
    def places(batches):
        for batch in batches:
            rows = [(host, digest, key, digest[0] % SALTS)
                    for host, page, digest in zip(batch["host"], batch["html"], map(bytes, batch["digest"]))
                    for key in subtree_keys(page)]
            if rows:
                hosts, digests, found, salts = zip(*rows)
                yield pd.DataFrame({"host": hosts, "digest": digests, "key": found, "salt": salts})

    held = source.mapInPandas(places, "host string, digest binary, key long, salt int")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (held.join(salted, ["host", "key", "salt"]).groupBy("host", "digest")
            .agg(F.collect_set("key").alias("templates")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  settings: Settings = Settings()) -> DataFrame:
    """Main text of every page: id, url, text (empty if none), n_chars and template_chars.

    Templates of the host are deleted first and the article is read from what remains; regions
    told by tag, role or class go as well, which is all that hosts of few pages have.
    ``template_chars`` counts the characters of deleted templates.

    Null html is an empty page; a url without a host has no templates removed but
    keeps the rules by tag and role. Repeated rows count as pages of their own and
    give repeated results; an empty table gives no rows; other columns are not
    looked at.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                          F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
                          F.nullif(host_of(F.col(url_col)), F.lit("")).alias("host"))
    hosted = source.filter("host is not null")
    keys = frozen(recurring_keys(hosted, settings))
    hosts = frozen(hosted.groupBy("host").agg(F.count("*").alias("pages"))
                   .join(keys.groupBy("host").agg(F.count("*").alias("n")), "host"))
    total = hosted.count()
    short = F.col("n") <= settings.listed
    lists = keys.join(hosts.filter(short), "host").groupBy("host").agg(
        F.first("pages").alias("pages"), F.collect_list("key").alias("templates"))
    # Hosts with a thousandth of all pages are a thousand at most, with lists of bounded length:
    # their pages stay where they are. All other hosts are small keys of a shuffled join.
    large = F.broadcast(lists.filter(F.col("pages") * 1000 >= total).drop("pages"))
    small = lists.filter(F.col("pages") * 1000 < total).drop("pages")
    long = hosts.filter(~short).select("host")
    known = source.join(large, "host").unionByName(
        source.join(F.broadcast(hosts.filter(short & (F.col("pages") * 1000 >= total)).select("host")), "host",
                    "left_anti").join(long, "host", "left_anti").join(small, "host", "left"))
    if not long.isEmpty():
        digested = source.join(long, "host", "left_semi").withColumn(
            "digest", F.unhex(F.md5(F.encode("html", "UTF-8"))))
        own = _own_templates(digested.select("host", "html", "digest"), keys.join(long, "host", "left_semi"))
        known = known.unionByName(digested.join(own, ["host", "digest"], "left").drop("digest"))

    @F.pandas_udf("struct<text string, template_chars long>")
    def extracted(page: pd.Series, templates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(p or "", () if t is None else np.asarray(t).tolist())
                             for p, t in zip(page, templates)], columns=["text", "template_chars"])

    found = known.select("id", "url", extracted("html", "templates").alias("found"))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("found.text").alias("text"),
                        F.length("found.text").cast("long").alias("n_chars"),
                        F.col("found.template_chars").alias("template_chars"))
