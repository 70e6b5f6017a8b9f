"""Main text of web pages: site templates found by subtree hashes, and what marks itself as no content.

Each page is parsed into elements (end tags may lack). Every element outside the article gets a hash of
its tag and contents; Spark counts, for each host, on how many pages each hash occurs, and elements that recur on many
pages of their host are deleted first of all: where they are needs no name. What they cannot show, as it is on one page or
differs from page to page, is deleted by tag, role, class or id: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. What is left of the article (<article>, else <main>, else the body) is
the text: a line for each block, white space in it made one space.

A class or id says that an element is no content if one of its names is such a word (comments), or is made of such words
and words of layout (site-footer, left-sidebar-2); other names that merely contain one (social-science) say nothing. A
form that holds an article, or most of the page's paragraphs, is the page's frame and no form.

Paragraphs, headings and list items of an article are content even if other pages have them too; in there only boxes
(div, section, list, table and so on) can be templates. Of several articles the longest is never a template; a
teaser that recurs is. Copies of one page count once: pages of a host whose blocks
are all equal are one page; pages that differ in any block are different pages, however long the blocks they share.

A subtree is a template if it is on min_pages pages of its host and either on min_share of them or on min_support: a
section of a large host has templates of its own, which are on many pages and yet on a small share of them. On a host of
too few pages for that, it is one if it is on few_pages pages that are over half of the host's.

Only (host, subtree hash, page hash) triples are shuffled, made distinct before. The templates of a host may be many.
While all are few they are broadcast, one set for a host that each Python worker keeps; beyond that they meet the pages
in a join on (host, salt), and of a host's array only what is on the page itself goes on with it.

Defined cases: null and empty html give an empty text; text outside any element counts as body; a null or odd url has
the host ''; an unfinished tag at the end is dropped; an unknown character reference stays as it is; repeated rows
repeat results; an empty table gives no rows; columns that are not needed are ignored; a long page takes time in
proportion to its length, however its tags nest or fail to.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator, Set

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, stored, table

#: An element is a template if it is on at least so many pages of the host and on this share of them ...
MIN_PAGES = 5
MIN_SHARE = 0.2
#: ... or on so many pages, whatever their share. It decides on hosts of over MIN_SUPPORT / MIN_SHARE = 250 pages.
MIN_SUPPORT = 50
#: ... or, on a small host, on so many pages that are over half of its pages.
FEW_PAGES = 3
#: (host, hash) rows that are broadcast at most: about 3 MB.
BROADCAST_ROWS = 200_000
SALTS = 32

#: Fixed values of HTML: elements without end tag, elements that break lines, text that is no markup, implied ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: What is no content by its tag, by its role, and by a word of its class or id.
DROP_TAGS = set("nav footer aside form script style noscript template button select textarea iframe object svg canvas dialog menu head title".split())
DROP_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login widget "
    "pagination pager toolbar skip".split()
)
#: Words that say where or how an element lies, beside one of the words above.
LAYOUT = set(
    "site page main global top bottom left right inner outer first second primary secondary box block bar list area section "
    "wrapper wrap container content col column row module item group region panel slot unit zone post entry article text links link title message strip".split()
)
#: With header, only these: an entry-header is an article's own.
LAYOUT_OF_HEADER = set("site page main global top bottom wrapper wrap container bar".split())
#: Boxes that may be templates even inside an article.
BOXES = set("div section ul ol dl table figure details fieldset center".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.IGNORECASE)
_PART = re.compile(r"[-_]+")


class Element:
    __slots__ = ("attributes", "children", "frame", "hash", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.hash, self.frame = tag, attributes, [], 0, False

    def marked(self) -> dict[str, str]:
        if not self.attributes:
            return {}
        return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(self.attributes)}

    def no_content(self, inside: bool) -> bool:
        """Whether it says of itself that it is no content; an article may have a header of its own."""
        if self.tag in DROP_TAGS and not self.frame or self.tag == "header" and not inside:
            return True
        marks = self.marked()
        if not marks or self.tag in ("html", "body", "article", "main") and "comment" not in marks.get("class", ""):
            return False
        names = (marks.get("class", "") + " " + marks.get("id", "")).split()
        return any(tells(x, inside) for x in names) or marks.get("role", "") in DROP_ROLES or "hidden" in marks or marks.get("aria-hidden") == "true"


def tells(name: str, inside: bool) -> bool:
    """Whether a class or id says that its element is no content."""
    parts = [x for x in _PART.split(name) if x and not x.isdigit()]
    told = [x for x in parts if x.rstrip("0123456789") in DROP_WORDS]
    if not told or inside and set(told) == {"header"}:
        return False
    layout = LAYOUT_OF_HEADER if set(told) <= {"header", "masthead"} else LAYOUT
    return all(x in layout for x in parts if x not in told)


def parse(text: str) -> Element:
    root = Element("#root")
    stack = [root]
    #: Places in the stack of the open elements of each tag, so that none is looked for in vain.
    places: dict[str, list[int]] = defaultdict(list)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    at, last = 0, text.rfind(">") + 1  # no tag ends beyond the last >
    while True:
        m = _TOKEN.search(text, at, last)
        if not m:
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
            at = len(text)  # never closed
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in BLOCK and places["p"]:  # a block ends an open paragraph, which is always the innermost open block
            close(places["p"][-1])
        if tag in CLOSED_BY:
            ends, bounds = CLOSED_BY[tag]
            end = max((places[x][-1] for x in ends if places[x]), default=0)
            if end > max((places[x][-1] for x in bounds if places[x]), default=0):
                close(end)
        element = Element(tag, m[3])
        stack[-1].children.append(element)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            element.children.append(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
            continue
        places[tag].append(len(stack))
        stack.append(element)
    rest = text[at:]
    if unfinished := re.search(r"<(?:[A-Za-z/!?]|\Z)", rest[rest.rfind(">") + 1 :]):
        rest = rest[: rest.rfind(">") + 1 + unfinished.start()]
    if rest:
        stack[-1].children.append(rest)
    find_frames(root)
    return root


def find_frames(root: Element) -> None:
    """Mark the forms that hold an article, or whose paragraphs are over half of the page's text."""
    order: list[tuple[Element, bool]] = []
    todo = [(root, False)]
    while todo:
        node, in_p = todo.pop()
        order.append((node, in_p))
        todo += [(c, in_p or node.tag == "p") for c in node.children if isinstance(c, Element)]
    if not any(node.tag == "form" for node, _ in order):
        return
    sums: dict[int, tuple[int, int, bool]] = {}
    for node, in_p in reversed(order):  # children before parents
        of = [sums[id(c)] for c in node.children if isinstance(c, Element)]
        own = 0 if node.tag in RAW else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        in_paragraphs = sum(x[1] for x in of) + (own if in_p or node.tag == "p" else 0)
        sums[id(node)] = own + sum(x[0] for x in of), in_paragraphs, node.tag in ("article", "main") or any(x[2] for x in of)
    for node, _ in order:
        if node.tag == "form":
            _, in_paragraphs, main = sums[id(node)]
            node.frame = main or 2 * in_paragraphs > sums[id(root)][0]


def blocks(element: Element, inside: bool, out: list[list[str]]) -> None:
    """Append the text of an element, its blocks apart. No recursion deeper than the stack allows: it walks a list."""
    todo: list[tuple[Element | str | None, bool]] = [(element, inside)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            out.append([])
        elif isinstance(node, str):
            out[-1].append(node)
        elif node is not element and node.no_content(inside):
            if node.tag in BLOCK:
                out.append([])
            else:
                out[-1].append(" ")
        elif node.tag == "br":
            out[-1].append(" ")
        else:
            edge = [(None, inside)] if node.tag in BLOCK else []
            todo += edge
            todo += [(c, inside) for c in reversed(node.children)]
            todo += edge


def joined(parts: list[list[str]]) -> list[str]:
    lines = (" ".join(html.unescape("".join(p)).split()) for p in parts if p)
    return [line for line in lines if line]


def articles(root: Element) -> tuple[list[Element], bool]:
    """Where the main text is: outermost articles, else main elements, else everything; whether it was marked."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    todo: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while todo:
        node, in_article, in_main = todo.pop()
        if node is not root and node.no_content(in_article or in_main):
            continue
        if node.tag == "article" and not in_article:
            found["article"].append(node)
            in_article = True
        elif (node.tag == "main" or node.attributes and node.marked().get("role") == "main") and not in_main:
            found["main"].append(node)
            in_main = True
        todo += [(c, in_article, in_main) for c in reversed(node.children) if isinstance(c, Element)]
    if found["article"]:
        return found["article"], True
    return (found["main"], True) if found["main"] else ([root], False)


def hash_subtrees(root: Element, mains: list[Element]) -> list[int]:
    """Set the hash of every element with text that may be a template, and return these; mains are the page's articles."""
    inside_of = {id(x) for x in mains}
    order: list[tuple[Element, bool]] = []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or id(node) in inside_of
        todo += [(c, inside) for c in node.children if isinstance(c, Element)]
    may, hashes, sizes = [], {}, {}
    for node, inside in reversed(order):  # children before parents
        parts = [hashes.get(id(c), "") if isinstance(c, Element) else " ".join(c.split()) for c in node.children]
        filled = [p for p in parts if p]
        if not filled:
            continue
        value = xxhash.xxh64_intdigest(f"{node.tag}({'|'.join(filled)})") >> 1 or 1
        hashes[id(node)] = f"{value:x}"
        sizes[id(node)] = sum(sizes.get(id(c), 0) if isinstance(c, Element) else len(c) for c in node.children)
        if node.tag in BLOCK and node.tag not in ("html", "body", "head", "title") and (not inside or node.tag in BOXES):
            node.hash = value
    longest = max(mains, key=lambda x: sizes.get(id(x), 0), default=None)
    holds = _holding(root, longest) if longest is not None else set()
    for node, _ in order:
        if id(node) in holds:
            node.hash = 0
        elif node.hash:
            may.append(node.hash)
    return may


def _holding(root: Element, inner: Element) -> set[int]:
    """The element and those that it lies in."""
    above: dict[int, Element] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node is inner:
            break
        for c in node.children:
            if isinstance(c, Element):
                above[id(c)] = node
                todo.append(c)
    found = {id(inner)}
    while id(inner) in above:
        inner = above[id(inner)]
        found.add(id(inner))
    return found


def hashed(source: str) -> tuple[Element, list[int], str]:
    """A page's tree, the hashes of what may be a template in it, and the text that tells it from other pages."""
    root = parse(source)
    mains, marked = articles(root)
    parts: list[list[str]] = [[]]
    for main in mains:
        blocks(main, marked, parts)
    return root, hash_subtrees(root, mains if marked else []), "\n".join(joined(parts))


def main_text(source: str, dropped: Set[int]) -> tuple[str, int]:
    """The text without the templates, and how many elements were deleted as templates."""
    root = parse(source)
    mains, marked = articles(root)
    deleted = 0
    if dropped:
        hash_subtrees(root, mains if marked else [])
        deleted = delete(root, dropped)
        mains, marked = articles(root)
    parts: list[list[str]] = [[]]
    for main in mains:
        blocks(main, marked, parts)
        parts.append([])
    return "\n".join(joined(parts)), deleted


def delete(root: Element, dropped: Set[int]) -> int:
    """Put nothing in the place of each outermost element whose hash is dropped."""
    deleted, todo = 0, [root]
    while todo:
        node = todo.pop()
        for k, c in enumerate(node.children):
            if isinstance(c, Element):
                if c.hash in dropped:
                    node.children[k] = GONE
                    deleted += 1
                elif c is not GONE:
                    todo.append(c)
    return deleted


#: What stands for a deleted block: it still parts its neighbours.
GONE = Element("div")


def host_of(url: str) -> str:
    return f"lower(coalesce(regexp_extract(`{url}`, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"


def site_templates(pages: DataFrame, html_column: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_support: int = MIN_SUPPORT, few_pages: int = FEW_PAGES) -> DataFrame:
    """(host, subtree, pages, host_pages) of the subtrees that recur."""
    ship(pages.sparkSession)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages_of, hashes = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, own, told = hashed(source or "")
                page, may = xxhash.xxh64_intdigest(told) >> 1, set(own)
                may.add(0)  # stands for the page itself
                hashes += may
                hosts += [host] * len(may)
                pages_of += [page] * len(may)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(pages_of, pa.int64())], ["host", "subtree", "page"])

    rows = pages.selectExpr(f"{host_of(url)} AS host", f"`{html_column}` AS html").mapInArrow(subtrees, "host string, subtree long, page long")
    counts = stored(rows.distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(f"subtree = 0 OR pages >= {min(min_pages, few_pages)}"), "subtrees")
    totals = counts.where("subtree = 0").select(F.col("host").alias("_host"), F.col("pages").alias("host_pages"))
    found = counts.where("subtree <> 0").join(totals, F.col("host") == F.col("_host"))
    n, of = F.col("pages"), F.col("host_pages")
    enough = (n >= min_pages) & ((n >= min_share * of) | (n >= min_support)) | (n >= few_pages) & (2 * n > of)
    return found.where(enough).select("host", "subtree", "pages", "host_pages")


def extract_text(
    pages: DataFrame, html_column: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
    broadcast_rows: int = BROADCAST_ROWS, min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates) of every row; n_templates counts the elements deleted as templates."""
    ship(pages.sparkSession)
    found = stored(site_templates(pages, html_column, url, min_pages, min_share, min_support), "templates")
    few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = pages.selectExpr("page_id", f"`{url}` AS url", f"`{html_column}` AS html", f"{host_of(url)} AS host")
    if few:
        sets = defaultdict(set)
        for r in found.select("host", "subtree").toLocalIterator():
            sets[r["host"]].add(r["subtree"])
        kept = pages.sparkSession.sparkContext.broadcast(dict(sets))
        rows = rows.select("page_id", "url", "html", "host")
    else:
        kept = None
        sets = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("subtree").alias("_subtrees"))
        salted = sets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.mapInArrow(_own_subtrees, "page_id long, url string, html string, host string, _own array<long>")
        rows = rows.withColumn("_of", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, (F.col("host") == F.col("_host")) & (F.col("_of") == F.col("_salt")), "left")
        rows = rows.select("page_id", "url", "html", F.array_intersect("_own", "_subtrees").alias("_dropped"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, deleted = [], []
            for source, of in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                dropped = kept.value.get(of, frozenset()) if kept else set(of or ())
                text, n = main_text(source or "", dropped)
                texts.append(text)
                deleted.append(n)
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), lengths, pa.array(deleted, pa.int64())], ["page_id", "url", "text", "n_chars", "n_templates"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_templates long")


def _own_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the hashes of what may be a template in each."""
    for batch in batches:
        own = []
        for source in batch.column(2).to_pylist():
            own.append(hashed(source or "")[1])
        columns = [batch.column(0).cast(pa.int64()), *batch.columns[1:], pa.array(own, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "html", "host", "_own"])


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
