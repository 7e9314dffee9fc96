"""HTML extraction with site template removal.

Every page is parsed to a tree whose element subtrees are hashed twice: by content (tags and text) and by shape (tags,
names and nesting; text, links and the number of equal neighbours left out).  Spark counts, per host, on how many
different contents each hash occurs; subtrees that recur across many are the site's template and are deleted.  The
content hash stands for any block outside the article, and for containers inside; the shape hash finds apparatus whose
words change from page to page (reader comments, sidebars, notices), so it stands only for elements that are apparatus
by tag, role or name, inside articles by a name that no part of an article has, or that hold hardly more than links.

A host of few pages gives no counts.  What its tag, role or whole class name shows to hold no article text
(navigation, adverts, forms, scripts ...) therefore goes on every page, after the templates.  The rest of the article is
returned block by block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, staged, texts_of

#: A subtree is template if it occurs with at least so many different contents of its host, and at least this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: Template subtrees (host, hash) that are broadcast, at most (about 100 bytes each); above it, they are joined to the pages.
BROADCAST_TEMPLATES = 100_000
#: Ways in which equal pages are split for that join.
SALTS = 16

# Fixed values of HTML: elements without content, with raw content, that end a paragraph, and that never hold article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("head script style textarea title noscript iframe template nav aside form button select option input svg canvas object embed dialog menu xmp noembed noframes footer audio video datalist".split())
SCOPES = frozenset("article aside blockquote body caption dd details div fieldset figure footer form header html li main nav ol section table tbody td th tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select", "datalist"), "tbody": ("table",), "tfoot": ("table",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Whole classes and ids that never hold article text; their elements go wherever they are.
UNMISTAKABLE = frozenset("ad ads advert adverts advertisement advertisements adsense cookie-notice cookie-banner cookie-consent gdpr-notice consent-banner newsletter-signup breadcrumb breadcrumbs pagination navbar site-header site-footer comments comment-list comment-section commentlist user-comments reader-comments sidebar related-links site-notice disqus_thread share-buttons social-share".split())
#: Words of a class or id that may name apparatus: such an element goes where it recurs on its host, inside articles too.
APPARATUS = frozenset("ad ads adv advert adverts advertisement adsense advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar aside rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar masthead topbar header footer colophon comment comments commentlist respond replies disqus discussion share sharing social related recommended recommendations login search skip".split())
#: Those of them that never name a part of an article: such an element goes inside an article, too, if its shape recurs.
WITHIN = frozenset("ad ads adv advert adverts advertisement adsense advertising sponsored promo cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar comment comments commentlist respond replies disqus sharing social related recommended recommendations login".split())
#: Elements that count as template inside an article, too; its paragraphs and headings are content however often they recur.
CONTAINERS = frozenset("div section aside ul ol dl table figure header footer nav form".split())
#: A menu: a container with so many links at least, and at least this share of its text in them.
LISTS, MENU_LINKS, MENU_SHARE = frozenset("div section ul ol dl table center header".split()), 3, 0.8

#: A well-formed tag: nothing in it needs a second look, and a failed match ends inside the tag.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'=<>`/]++))?+)*+)\s*+(/?)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`/]+)))?""")
_TAG_NAME, _GAP, _ATTRIBUTE_NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*+", r"[\s/]*+", r"[^\s/>][^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]++"))
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("apparatus", "chars", "digest", "items", "linked", "links", "names", "shape", "suspect", "tag", "within")

    def __init__(self, tag: str, apparatus: bool, suspect: bool = False, names: str = ""):
        self.tag, self.apparatus, self.suspect, self.names, self.items = tag, apparatus, suspect, names, []
        self.within = suspect and any(w.lower() in WITHIN for w in _NAME.findall(names))
        self.digest = self.shape = self.chars = self.linked = self.links = 0

    def seal(self) -> None:
        """Hashes of the subtree, once it is complete; what a text weighs, and how much of it is in links."""
        content, shape = [self.tag], [self.tag, self.names]
        for x in self.items:
            if isinstance(x, str):
                text = x.strip()
                self.chars += len(text)
                content.append(text)
                part = "t" if text else ""
            else:
                if not x.apparatus:
                    self.chars += x.chars
                    self.linked += x.linked
                    self.links += x.links
                content.append(format(x.digest, "x"))
                part = format(x.shape, "x")
            if part and part != shape[-1]:
                shape.append(part)
        if self.tag == "a":
            self.linked, self.links = self.chars, 1
        self.digest = xxhash.xxh3_64_intdigest("\x1f".join(content).encode("utf-8", "surrogatepass"))
        self.shape = xxhash.xxh3_64_intdigest("\x1f".join(shape).encode("utf-8", "surrogatepass"), 1)

    def is_menu(self) -> bool:
        return self.links >= MENU_LINKS and self.tag in LISTS and self.linked >= MENU_SHARE * self.chars


def is_apparatus(tag: str, attributes: list[tuple[str, str]]) -> tuple[bool, bool, str]:
    """Whether an element is apparatus in any case, whether it is if it recurs, and its names without digits."""
    if tag in DROPPED:
        return True, False, ""
    suspect, names = False, ""
    for name, value in attributes:
        name = name.lower()
        if name in ("class", "id"):
            names += " " + _DIGITS.sub("", value)
        if name in ("class", "id") and tag not in ("html", "body", "article", "main", "p", "h1", "h2", "h3"):
            if any(w in UNMISTAKABLE for w in value.lower().split()):
                return True, False, names
            suspect = suspect or any(w.lower() in APPARATUS for w in _NAME.findall(value))
        elif name in ("class", "id") and tag == "article" and any(w in ("comment", "comments", "reply") for w in value.lower().split()):
            return True, False, names
        elif (name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False, names
    return False, suspect, names


def tag_at(page: str, at: int) -> tuple[str, list[tuple[str, str]], bool, int] | None:
    """(name, attributes, closed in itself, end) of the tag whose name begins at ``at``, as browsers read it; None if it never ends.

    Quotes open a value only after "="; a bare value runs to white space or ">".
    """
    m = _TAG_NAME.match(page, at)
    tag, at, found = m[0], m.end(), []
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return tag, found, page[at - 1] == "/", at + 1
        m = _ATTRIBUTE_NAME.match(page, at)
        name, value, at = m[0], "", m.end()
        if m := _EQUALS.match(page, at):
            at = m.end()
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            elif m := _BARE.match(page, at):
                value, at = m[0], m.end()
        found.append((name, value))


def tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]], bool, int]]:
    """(kind, text or tag name, attributes, closed in itself, end) of a page's texts and tags, in one pass.

    ``kind`` is "text", "open" or "close".  Comments and declarations give nothing.  A tag, comment or declaration that
    never ends takes the rest of the page with it, as in browsers.  The caller may send the place to go on from.
    """
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        while 0 <= start and not (page[start + 1 : start + 2].isascii() and (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("!", "?", "/"))):
            start = page.find("<", start + 1)  # a "<" before anything else is text
        if start != at:
            end = n if start < 0 else start
            yield "text", page[at:end], [], False, end
            at = end
            continue
        sign = page[at + 1]
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.find(">", at) + 1
            else:
                m = _COMMENT_END.search(page, at + 4)
                at = m.end() if m else n
        elif sign in "!?" or (sign == "/" and not (page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha())):
            at = page.find(">", at) + 1 or n
        else:
            if m := _TAG.match(page, at):
                tag, found, closed, at = m[2], [(name, next((v for v in values if v), "")) for name, *values in _ATTRIBUTE.findall(m[3])] if m[3] else [], bool(m[4]), m.end()
            elif (read := tag_at(page, at + (2 if sign == "/" else 1))) is None:
                return
            else:
                tag, found, closed, at = read
            at = (yield "close" if sign == "/" else "open", tag.lower(), found, closed, at) or at


def parse(page: str) -> Node:
    """The page's tree, every node sealed."""
    root = Node("#root", False)
    stack, depth = [root], Counter()

    def close(n: int) -> None:
        while len(stack) > n:
            node = stack.pop()
            depth[node.tag] -= 1
            node.seal()

    def open_at(tags: tuple[str, ...], stops: frozenset | tuple) -> int:
        if not any(depth[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stops:
                return 0
        return 0

    read, back = tokens(page), None
    while True:
        try:
            kind, tag, attributes, closed, at = read.send(back)
        except StopIteration:
            break
        back = None
        if kind == "text":
            stack[-1].items.append(tag)
            continue
        if kind == "close":
            i = open_at((tag,), ("table", "td", "th") if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "article", "body", "html", "main", "div", "section") else ())
            if i:
                close(i)
            continue
        if tag in BLOCKS and (i := open_at(("p",), SCOPES)):
            close(i)
        if tag in CLOSES:
            while i := open_at(CLOSES[tag], HOLDS[tag]):
                close(i)
        node = Node(tag, *is_apparatus(tag, attributes))
        stack[-1].items.append(node)
        if tag in VOID or (closed and tag not in BLOCKS and tag not in RAW):
            continue
        stack.append(node)
        depth[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            node.items.append(page[at : end.start() if end else len(page)])
            close(len(stack) - 1)
            back = page.find(">", end.end() - 1) + 1 if end else 0
            back = back or len(page)
    close(1)
    return root


def articles(root: Node) -> list[Node]:
    """The outermost article (or else main) elements that are no apparatus; the whole tree if there is none."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.apparatus:
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                todo += [x for x in reversed(node.items) if isinstance(x, Node)]
        if found:
            return found
    return [root]


def candidates(node: Node, within: bool) -> list[int]:
    """The hashes by which the counts may delete an element; ``within``: inside an article."""
    if node.tag in ("#root", "html", "body", "article", "main"):
        return [node.shape] if node.apparatus else []
    found = []
    if node.items and (node.apparatus or node.suspect or node.tag in (CONTAINERS if within else BLOCKS)):
        found.append(node.digest)
    if node.apparatus or (node.within if within else node.suspect or node.tag == "header" or node.is_menu()):
        found.append(node.shape)
    return found


def prune(root: Node, template: frozenset[int] | set[int], inside: bool) -> tuple[int, int]:
    """Deletes template subtrees, then what is apparatus in any case; returns how many elements fell to each.

    A header outside articles is the site's.
    """
    by_count = by_rule = 0
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        kept: list[Node | str] = []
        for x in node.items:
            if isinstance(x, str):
                kept.append(x)
                continue
            if template and any(h in template for h in candidates(x, within)):
                by_count += 1
            elif x.apparatus or (x.tag == "header" and not within):
                by_rule += 1
            else:
                kept.append(x)
                todo.append((x, within or (inside and x.tag in ("article", "main"))))
                continue
            kept.append(" ")
        node.items = kept
    return by_count, by_rule


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks under ``roots``."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(text)

    todo: list[Node | str | None] = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag in ("br", "td", "th"):
            parts.append(" ")
            todo += reversed(x.items)
        elif x.tag in BLOCKS:
            flush()
            todo.append(None)
            todo += reversed(x.items)
        else:
            todo += reversed(x.items)
    flush()
    return out


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    root = parse(page)
    prune(root, template, articles(root) != [root])
    return "\n\n".join(blocks(articles(root)))


def subtrees(page: str) -> tuple[int, set[int]]:
    """Hash of the page's content, and the hashes of the subtrees that could be template."""
    root = parse(page)
    inside = articles(root) != [root]
    out: set[int] = set()
    todo = [(x, False) for x in root.items if isinstance(x, Node)]
    while todo:
        node, within = todo.pop()
        out.update(candidates(node, within))
        if not node.apparatus:
            within = within or (inside and node.tag in ("article", "main"))
            todo += [(x, within) for x in node.items if isinstance(x, Node)]
    prune(root, frozenset(), inside)
    return xxhash.xxh3_64_intdigest("\n".join(blocks(articles(root))).encode("utf-8", "surrogatepass")), out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed_pages(pages: DataFrame) -> DataFrame:
    """(host, page, content, hashes) of every page; ``page`` is a hash of its html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            found = [subtrees(page) for page in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array([signed(c) for c, _ in found], pa.int64()), pa.array([[signed(h) for h in hs] for _, hs in found], pa.list_(pa.int64()))], ["host", "page", "content", "hashes"])

    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, content long, hashes array<long>")


def template_subtrees(hashed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur across the contents of a host, of the result of ``hashed_pages``.

    Copies of a page count once, so that an article met at many addresses is not taken for template.
    """
    seen = hashed.select("host", "content", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("hash")).distinct()
    counts = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("hash").isNull() | (F.col("n") >= min_pages))
    hosts = counts.where("hash is null").select("host", F.col("n").alias("contents"))
    return counts.where("hash is not null").join(hosts, "host").where(F.col("n") >= min_share * F.col("contents")).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Blocks are joined by an empty line, white space inside a block is one space, character references are decoded.
    A null or empty html, or one without article text, gives "" and 0.  Pages with a null url share one (unnamed)
    host.  Repeated rows stay; other columns do not matter; an empty table gives an empty result.

    Every page is parsed once to hash its subtrees, which are written to the shared folder (some 8 bytes for each
    element), and once to extract.  Beyond ``BROADCAST_TEMPLATES`` templates each page gets those that it holds by a
    join on (host, page), salted, as many rows may hold one page.
    """
    spark = pages.sparkSession
    ship(spark)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))).withColumn("page", F.xxhash64("html"))
    hashed = staged(hashed_pages(source), "subtrees")
    found = staged(template_subtrees(hashed), "templates")
    rows = found.limit(BROADCAST_TEMPLATES + 1).collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            if table is not None:
                sets = [table.value.get(h, frozenset()) for h in batch.column("host").to_pylist()]
            else:
                sets = [{h & ((1 << 64) - 1) for h in x or ()} for x in batch.column("template").to_pylist()]
            texts = [main_text(page, s) for page, s in zip(texts_of(batch, "html"), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = "page_id long, url string, text string, n_chars long"
    if len(rows) <= BROADCAST_TEMPLATES:
        by_host: dict[str, set[int]] = {}
        for r in rows:
            by_host.setdefault(r["host"], set()).add(r["hash"] & ((1 << 64) - 1))
        table = spark.sparkContext.broadcast({h: frozenset(s) for h, s in by_host.items()})
        return source.select("page_id", "url", "host", "html").mapInArrow(run, out)
    table = None
    held = hashed.select("host", "page", F.explode("hashes").alias("hash")).distinct().join(found, ["host", "hash"])
    lists = held.groupBy("host", "page").agg(F.collect_set("hash").alias("template"))  # no more than a page has elements
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(lists, ["host", "page", "salt"], "left").select("page_id", "url", "host", "html", "template").mapInArrow(run, out)
