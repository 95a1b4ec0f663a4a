"""Main text of web pages: site templates are found by counting element subtrees.

1. Each page is parsed; every container's subtree (tag, class, text, children) is hashed.
2. Spark counts, for each host and hash, on how many *different* pages the subtree
   stands: copies of a page (same main text) count once, so a copied article is not
   a template, while a menu, footer or advert of many articles is.
3. Subtrees on ``MIN_PAGES`` different pages of the host or more, and on ``HOST_SHARE`` of them, are
   deleted, as long as the page keeps prose of its own (``OWN_PROSE`` characters); a page that
   would not keeps the ones that hold over half of its text. Prose (paragraphs, headings, quotes) is
   never deleted for recurring, so a passage that many articles share stays; only lines that
   stand bare in the body, before or after everything else, go like other templates.
4. Hosts with few pages give no counts, so elements that say what they are (nav, footer,
   aside, form, script, class="ad", role="search" ...) go as well. A class says so only if all
   of its parts do ("cookie-notice", not "notice-of-award"), and an ambiguous one ("related",
   "discussion") only if the element holds no section of text: a heading with more prose than links.
5. Of what is left, the articles are the text, with the title and lead before the first one
   where it stands; without articles the main element, else the whole body.

Blocks keep page order and are joined by a blank line; white space inside a block
becomes one blank; character references are decoded.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, row_key, table
from .urls import host_of

MIN_PAGES = 5
HOST_SHARE = 0.01       # of a host's different pages
OWN_PROSE = 40          # characters

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
ABOUT = re.compile(r"(?:has|with|no|without|is)[-_]", re.I)      # "has-sidebar" isn't a sidebar

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
BLOCK = PROSE | frozenset(
    "address article aside body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form header hgroup hr html legend li main menu nav ol optgroup option search "
    "section summary table tbody tfoot thead tr ul".split())
CONTAINER = BLOCK - PROSE - frozenset(["html", "body", "hr", "li", "tr", "dt", "dd", "option"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table select article section div main body html".split())
DROP = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video nav footer aside "
    "form button select input textarea dialog menu search head title fieldset noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                       "menubar toolbar form status".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adbanner adcontainer "
    "adwrapper dfp taboola outbrain banner banners "
    "sponsor sponsored sponsors promo promos promotion promoted navigation nav navbar navi menu menus submenu "
    "breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share "
    "sharing social newsletter subscribe subscription signup signin login register cookie cookies consent "
    "gdpr notice notices notification notifications alert alerts popup popups modal modals overlay toast comment "
    "comments commentlist disqus respond discussion reply replies responses reactions footer foot footnav header masthead "
    "topbar toolbar skip search searchbox pagination pager paging copyright legal disclaimer paywall announcement "
    "announcements form forms feedback rating ratings".split())
SOFT = frozenset("header banner foot form forms related legal discussion respond responses notice notices disclaimer "
                 "rating ratings reactions feedback".split())       # not if they hold a section of text
NEUTRAL = frozenset(
    "a area article b bar block body bottom box btn button c card col column container content cta d div e el element "
    "entry f global group h head heading holder i icon id in inline inner item items js l label large layer layout left "
    "link links list local m main md mini mobile module mt nav-item new o outer p page panel part post posts primary pt "
    "q r region right row s secondary section set sf side single site slot small sm sticky strip t tab table text the "
    "thread title top u unit user v view w wide wp wrap wrapper x xl y z".split())       # say nothing either way
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_ARTICLES = frozenset("comment comments reply replies ad advert advertisement promo".split())


class Node:
    __slots__ = ("tag", "names", "says", "role", "kids", "up", "hidden", "size", "links", "prose", "hash")

    def __init__(self, tag: str, up: "Node | None", attrs: str = "") -> None:
        self.tag, self.up, self.kids = tag, up, []
        self.names: frozenset = frozenset()          # parts of class and id, for the subtree's hash
        self.says: frozenset = frozenset()           # those of names that say boilerplate with all their parts
        self.role, self.hidden = "", False
        self.size = self.links = self.prose = self.hash = 0
        if attrs:
            got = {}
            for m in ATTR.finditer(attrs):
                got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            named = [[x.lower() for x in NAME_PART.findall(name)] for key in ("class", "id")
                     for name in got.get(key, "").split() if not ABOUT.match(name)]
            self.names = frozenset(x for parts in named for x in parts)
            self.says = frozenset(x for parts in named if all(x in DROP_NAMES or x in NEUTRAL for x in parts)
                                  for x in parts if x in DROP_NAMES)
            self.role = got.get("role", "").lower()
            bare = re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", "=", attrs).lower().split()
            self.hidden = "hidden" in bare or got.get("aria-hidden", "").lower() == "true" \
                or "display:none" in got.get("style", "").lower().replace(" ", "")


def parse(page: str) -> Node:
    """A forgiving tree: unclosed elements end where their parent ends or where the next
    paragraph, item or cell begins; stray end tags are skipped."""
    root = at = Node("html", None)
    place, lower = 0, None
    for m in iter(lambda: TAG.search(page, place), None):
        if m.start() > place:
            at.kids.append(page[place:m.start()])
        place = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                at.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m["end"]:
            up = at
            while up is not None and up.tag != tag:
                up = up.up
            if up is not None and up.up is not None:
                at = up.up
            continue
        if tag == "html":
            continue
        if tag in BLOCK:                       # ends an open paragraph
            up = at
            while up is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.up
            if up is not None and up.tag == "p":
                at = up.up
        if tag in CLOSES:
            up = at
            while up is not None and up.tag not in CLOSES[tag] and up.tag not in SCOPE:
                up = up.up
            if up is not None and up.tag in CLOSES[tag]:
                at = up.up
        node = Node(tag, at, m["attrs"])
        at.kids.append(node)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):        # a character whose lower case is longer
                lower = re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = lower.find("</" + tag, place)
            end = len(page) if end < 0 else end
            node.kids.append(page[place:end])
            close = page.find(">", end)
            place = len(page) if close < 0 else close + 1
        elif tag not in VOID and not m["attrs"].endswith("/"):
            at = node
    if place < len(page):
        at.kids.append(page[place:])
    return root


def measure(root: Node) -> None:
    """Subtree hashes and sizes (all text, text of links, prose outside links), children first; no
    recursion, trees may be deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if not isinstance(k, str))
    for node in reversed(order):
        digest, size = xxhash.xxh64(node.tag + " " + " ".join(sorted(node.names))), 0
        if node.tag not in ("script", "style", "template"):
            for kid in node.kids:
                if isinstance(kid, str):
                    text = " ".join(kid.split())
                    digest.update(text.encode("utf-8", "replace"))
                    size += len(text)
                else:
                    digest.update(kid.hash.to_bytes(8, "big"))
                    size += kid.size
                    node.links += kid.links
                    node.prose += kid.prose
        if node.tag == "a":
            node.links = size
        if node.tag in PROSE:
            node.prose = size - node.links
        node.hash, node.size = digest.intdigest(), size


def _aside(article: Node) -> bool:
    return bool(article.says & ASIDE_ARTICLES)


def _holds(node: Node, tags: frozenset) -> bool:
    """Whether one of the elements is inside; articles that are comments or adverts don't count."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in tags and not (x.tag == "article" and _aside(x)):
            return True
        todo.extend(k for k in x.kids if not isinstance(k, str))
    return False


def _section_of_text(node: Node) -> bool:
    text = sum(x.prose for x in walk(node) if x.tag in PROSE and x.tag not in HEADINGS)
    return text > node.links and _holds(node, HEADINGS)


def says_boilerplate(node: Node) -> bool:
    """Whether the element itself says that it isn't main text."""
    if node.tag in DROP or node.hidden or node.role in DROP_ROLES:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag == "header":
        inside = node.up
        while inside is not None and inside.tag not in ("article", "main"):
            inside = inside.up
        return inside is None and not _holds(node, frozenset(["article", "main", "h1"]))
    if not node.says or node.tag in HEADINGS:
        return False
    if node.tag == "article":
        return _aside(node)
    if _holds(node, frozenset(["article", "main"])):
        return False
    return not (node.says <= SOFT and _section_of_text(node))


def region(root: Node, gone: set[int]) -> list[Node]:
    """The parts of the main text in page order: articles with what introduces the first one, else the
    main element that holds most text, else all."""
    articles: list[Node] = []
    mains: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in gone:
            continue
        if (node.tag == "article" or node.role == "article") and node.size:
            articles.append(node)                # an article inside an article is a part of it
            continue
        if (node.tag == "main" or node.role == "main") and node.size:
            mains.append(node)
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    if articles:
        return _lead(articles[0], gone) + articles
    return [max(mains, key=lambda n: n.size)] if mains else [root]


def _lead(article: Node, gone: set[int]) -> list[Node]:
    """Title and lead that stand before an article: prose and headers beside it, and beside what
    holds it inside a main element."""
    out: list[Node] = []
    node, inside = article, article.up
    while inside is not None and inside.tag not in ("body", "html"):
        before = inside.kids[:next(i for i, k in enumerate(inside.kids) if k is node)]
        out = [k for k in before if not isinstance(k, str) and id(k) not in gone
               and (k.tag in PROSE or k.tag in ("header", "hgroup") or (
                   k.tag == "div" and _holds(k, HEADINGS) and 2 * k.links < k.size))] + out
        if inside.tag == "main" or inside.role == "main":
            return out
        node, inside = inside, inside.up
    before = article.up.kids[:next(i for i, k in enumerate(article.up.kids) if k is article)] if article.up else []
    return [k for k in before if not isinstance(k, str) and id(k) not in gone
            and (k.tag in HEADINGS or k.tag in ("header", "hgroup") and _holds(k, HEADINGS))]


def blocks(tops: list[Node], gone: set[int]) -> list[str]:
    """Texts of the blocks of some elements in page order, without what is gone."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo: list = [x for top in reversed(tops) for x in (flush, top)]
    while todo:
        x = todo.pop()
        if x is flush:
            flush()
        elif isinstance(x, str):
            now.append(entities.unescape(x) if "&" in x else x)
        elif id(x) in gone:
            now.append(" ")
        elif x.tag in ("br", "wbr", "td", "th"):
            now.append("" if x.tag == "wbr" else " ")
            todo.extend(reversed(x.kids))
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(flush)
            todo.extend(reversed(x.kids))
    flush()
    return out


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))


def _bare(root: Node) -> list[Node]:
    """Prose elements that stand in the body itself."""
    body = next((k for k in root.kids if not isinstance(k, str) and k.tag == "body"), root)
    return [k for k in body.kids if not isinstance(k, str) and k.tag in PROSE and k.size]


def _edges(root: Node, gone: set[int], templates: frozenset[int]) -> set[int]:
    """Bare lines that recur, before or after everything that doesn't."""
    bare = {id(n) for n in _bare(root)}
    if not bare:
        return set()
    body = next((k for k in root.kids if not isinstance(k, str) and k.tag == "body"), root)
    kids = [k for k in body.kids if (k.strip() if isinstance(k, str) else k.size and id(k) not in gone)]
    out: set[int] = set()
    for order in (kids, kids[::-1]):
        for k in order:
            if isinstance(k, str) or id(k) not in bare or k.hash not in templates:
                break
            out.add(id(k))
    return out if len(out) < len(kids) else set()


def read(page: str, templates: frozenset[int] = frozenset()):
    """(tree, ids of what is gone, parts of the main text, how many subtrees went as templates)."""
    root = parse(page)
    measure(root)
    said = {id(n) for n in walk(root) if says_boilerplate(n)}
    main = region(root, said)
    protected = {id(n) for n in main}
    for up in main:
        while up is not None:
            protected.add(id(up))
            up = up.up
    again = [n for n in walk(root) if n.hash in templates and n.tag in CONTAINER and id(n) not in protected
             and id(n) not in said] if templates else []
    recurring = {id(n) for n in again}
    own = _own_prose(main, said | recurring)
    size = sum(n.size for n in main)
    if own < OWN_PROSE:
        recurring = {id(n) for n in again if 2 * n.size <= size}
    if templates:
        recurring |= _edges(root, said | recurring, templates)
    deleted = sum(n.hash in templates and (id(n) in recurring or id(n) in said) for n in walk(root)) if templates else 0
    return root, said | recurring, main, deleted


def _own_prose(main: list[Node], gone: set[int]) -> int:
    """Characters of prose outside links in what is left."""
    total, todo = 0, list(main)
    while todo:
        x = todo.pop()
        if id(x) not in gone:
            if x.tag in PROSE:
                total += x.prose
            else:
                todo.extend(k for k in x.kids if not isinstance(k, str))
    return total


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rk, host, subtree, main): each container's hash, with the hash of the page's main text."""
    for batch in batches:
        keys, hosts, hashes, mains = [], [], [], []
        for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not page:
                continue
            root, gone, main, _ = read(page)
            text = xxhash.xxh64_intdigest("\n".join(blocks(main, gone)).encode("utf-8", "replace"))
            found = {n.hash for n in walk(root) if n.tag in CONTAINER and n.size and n not in main}
            found |= {n.hash for n in _bare(root)}
            keys += [key] * len(found)
            hosts += [host] * len(found)
            hashes += [signed(h) for h in found]
            mains += [signed(text)] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()),
             pa.array(mains, pa.int64())], names=["rk", "host", "subtree", "main"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = (1 << 64) - 1
    for batch in batches:
        texts, counts, dropped = [], [], []
        for page, known in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist()):
            parts, n = [], 0
            if page:
                root, gone, main, n = read(page, frozenset(h & mask for h in known or ()))
                parts = blocks(main, gone)
            texts.append("\n\n".join(parts))
            counts.append(len(parts))
            dropped.append(n)
        keep = [i for i, name in enumerate(batch.schema.names) if name not in ("html", "templates")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep]
            + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
               pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
            names=[batch.schema.names[i] for i in keep] + ["text", "n_chars", "n_blocks", "n_templates"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = HOST_SHARE) -> DataFrame:
    """(rk, subtree) of each page's subtrees that recur on ``min_pages`` different pages of
    its host, and on a ``share`` of them. ``pages``: (rk, host, html)."""
    found = cut_lineage(pages.transform(map_batches, _subtrees, "rk long, host string, subtree long, main long"), "subtrees")
    hosts = found.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = (found.select("host", "subtree", "main").distinct().groupBy("host", "subtree")
             .agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).join(hosts, "host")
             .filter(F.col("n") >= share * F.col("pages")).select("host", "subtree"))
    return found.select("rk", "host", "subtree").join(often, ["host", "subtree"]).select("rk", "subtree")


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
               min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_templates) of each row.

    Null or empty html has empty text. Rows without a host (null url) share the empty
    host. Repeated rows are one page to the counts and are all returned. An empty table
    gives an empty result.
    """
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        row_key(id, url, html).alias("rk"))
    kinds = dict(rows.dtypes)
    known = (site_templates(rows.select("rk", host_of(F.col("url")).alias("host"), "html"), min_pages)
             .groupBy("rk").agg(F.collect_set("subtree").alias("templates")))
    return rows.join(known, "rk", "left").select("page_id", "url", "html", "templates").transform(map_batches,
        _texts, f"page_id {kinds['page_id']}, url string, text string, n_chars long, n_blocks long, "
                "n_templates long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))
