"""Main text of web pages, by removal of what a site repeats.

Pages are read into element trees. Every block subtree has a hash, and Spark counts the hashes by host; subtrees that recur across many pages of their host are
its template and go. What markup itself declares not to be content goes as well.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.encoding import long_array
from pricetide.llm.text import map_arrow, strings
from pricetide.session import stage

# A subtree is the template's if it is on so many pages of a host, and on so large a part
# of them: the first share is for containers outside the main content, the second for
# paragraphs and headings, and for containers inside it. So many pages are enough for a
# container outside, however small their share.
MIN_PAGES = 3
MANY_PAGES = 50
MIN_SHARE = 0.02
MIN_SHARE_OF_TEXT = 0.5
# Recurring subtrees of all hosts that are broadcast, some 60 MB in a worker.
MOST_TEMPLATES = 500_000
MASK = (1 << 64) - 1

MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
# A tag as it should be, without a second try of any part of it.
TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?>\s++[^\s\"'<>/=]++(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s\"'<>=`]++))?+)*+)\s*+(/?)>"
)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
# A stretch of a tag up to an attribute's value and that value: only there do quotes count.
STRETCH = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>]*+))?+")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template".split())
# Elements that are never part of an article.
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]|\Z", re.I) for tag in RAW}
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option input label fieldset dialog menu "
    "object embed canvas video audio map datalist progress meter".split()
)
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul caption aside br".split()
)
CLOSED_BY_BLOCK = BLOCKS - {"br"}
CONTENT = frozenset(["article", "main"])
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
# Single cells and items, which go only with what they are part of.
SINGLE = frozenset("li dt dd td th".split())
NEVER_TEMPLATE = CONTENT | {"html", "body", "br", "hr"}
# Words of class, id and role that name what surrounds an article. Outside the main content
# one of them is enough. Inside, a name must consist of them and of what goes with them,
# and the weak ones leave it to the host's counts.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "topbar toolbar comment comments commentlist disqus reply replies respond share sharing social "
    "related recommended recommendations widget widgets pagination pager skip search "
    "complementary contentinfo dialog toc copyright legal disclaimer tags byline".split()
)
WEAK = frozenset("legal disclaimer copyright tags byline toc search skip dialog".split())
GOES_WITH = frozenset(
    "list box container wrapper wrap section item items block area slot unit top bottom left right "
    "inner outer bar link links panel button buttons reader user post posts article page site story "
    "content main text body group row col form thread feed inline mobile desktop sticky fixed js".split()
)
# Articles that are not the page's own.
OTHER_ARTICLES = frozenset("teaser card preview thumbnail".split())
PLACES = re.compile("^(?:top|main|site|page|left|right|side|sub|global|primary|secondary)(?=[a-z]{3})")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_words(name: str) -> list[str]:
    """The words of one name, without a place in front that is written with it."""
    words = (w.lower() for w in WORD_PARTS.findall(name))
    return [rest if (rest := PLACES.sub("", w)) in AROUND else w for w in words]


class Element:
    __slots__ = ("tag", "names", "hidden", "parts", "digest")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag = tag
        self.hidden = False
        names = []
        for kind, a, b, c in ATTRIBUTE.findall(attrs) if attrs else ():
            kind, value = kind.lower(), a or b or c
            if kind in ("class", "id"):
                names.append(value)
            elif kind == "role":
                names.append(value.lower())
            elif kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
                self.hidden = True
            elif kind == "style" and NO_DISPLAY.search(value):
                self.hidden = True
        self.names = " ".join(names)
        self.parts: list[Element | str] = []
        self.digest = 0

    def around(self, inside: bool) -> bool:
        """Whether the markup says that this is not content; ``inside`` the main content it
        says so less easily."""
        if self.tag in DROPPED or self.hidden or (self.tag == "header" and not inside):
            return True
        if self.tag in ("html", "body", "main") or not self.names:
            return False
        article = self.tag == "article"
        for name in self.names.split():
            words = name_words(name)
            found = AROUND.intersection(words)
            if article and not OTHER_ARTICLES.isdisjoint(words):
                return True
            if found and not (inside or article):
                return True
            if found - WEAK and all(w in AROUND or w in GOES_WITH or w.isdigit() for w in words):
                return True
        return False

    def suspect(self) -> bool:
        """Whether its names hint that this is not content."""
        return any(not AROUND.isdisjoint(name_words(name)) for name in self.names.split())


def parse(page: str) -> Element:
    """The element tree of a page, in one pass; never fails, whatever the markup.

    A tag or comment that the page does not end goes up to its end, as in browsers.
    """
    root = Element("html")
    stack, at = [root], 0
    while at < len(page):
        found = MARKUP.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].parts.append(text)
        if not found:
            break
        start = found.start()
        if page[start + 1] in "!?":
            mark = "-->" if found[0] == "<!--" else ">"
            end = page.find(mark, found.end())
            at = len(page) if end < 0 else end + len(mark)
            continue
        whole = TAG.match(page, start)
        if whole:
            close, tag, attrs, empty = whole.groups()
            at = whole.end()
        else:
            close, tag = NAME.match(page, start).groups()
            first = at = start + 1 + len(close) + len(tag)
            while at < len(page) and page[at] != ">":
                at = STRETCH.match(page, at).end()
            if at == len(page):
                break
            attrs = page[first:at]
            empty = attrs.endswith("/")
            at += 1
        tag = tag.lower()
        if close:
            _close(stack, tag)
            continue
        _open(stack, tag)
        element = Element(tag, attrs)
        stack[-1].parts.append(element)
        if tag in RAW and not empty:
            end = RAW_END[tag].search(page, at).start()
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and not empty:
            stack.append(element)
    return root


def _open(stack: list[Element], tag: str) -> None:
    """Close what a new element of the tag ends without an end tag."""
    if tag in CLOSED_BY_BLOCK:
        # A paragraph ends with what is open inside it.
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in BLOCKS:
                break
    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag)
    if same and len(stack) > 1 and stack[-1].tag in same:
        stack.pop()
        if tag == "tr" and len(stack) > 1 and stack[-1].tag == "tr":
            stack.pop()


def _close(stack: list[Element], tag: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            del stack[depth:]
            return


def walk(root: Element) -> list[tuple[Element, Element | None, bool]]:
    """All elements in page order, the main content each is inside, and whether it holds any."""
    out: list[tuple[Element, Element | None]] = []
    todo: list[tuple[Element, Element | None]] = [(root, None)]
    while todo:
        element, inside = todo.pop()
        out.append((element, inside))
        inside = inside or (element if element.tag in CONTENT else None)
        todo += [(p, inside) for p in element.parts[::-1] if isinstance(p, Element)]
    holds: dict[int, bool] = {}
    for element, _ in reversed(out):  # the inner ones first
        content = element.tag in CONTENT
        digest = [f"{element.tag} {element.names}"]
        for part in element.parts:
            if isinstance(part, str):
                digest.append(" ".join(part.split()))
            else:
                content = content or holds[id(part)]
                digest.append(str(part.digest))
        holds[id(element)] = content
        element.digest = xxhash.xxh3_64_intdigest("\0".join(digest).encode("utf-8", "replace"))
    return [(e, inside, holds[id(e)]) for e, inside in out]


def template_candidates(page: str) -> tuple[int, dict[int, tuple[bool, int]]]:
    """A hash of the whole page, and those of the block subtrees that may be a template's,
    with whether each needs the larger share and the hash of what it was found in: for
    paragraphs inside the main content that content, else the page.

    What holds the main content is never a candidate, nor are single cells and items.
    """
    root = parse(page)
    found: dict[int, tuple[bool, int]] = {}
    for element, inside, holds in walk(root):
        text = element.tag in TEXT_BLOCKS
        if element.tag in BLOCKS - NEVER_TEMPLATE - SINGLE and not holds:
            around = inside.digest if inside and text else root.digest
            strict, known = found.get(element.digest, (True, around))
            # Outside the content as well, the page counts.
            around = root.digest if root.digest in (around, known) else known
            more = bool(inside or text) and not (inside and element.suspect())
            found[element.digest] = (strict and more, around)
    return root.digest, found


def own_words(body: Element, template: frozenset[int] | set[int]) -> frozenset[int]:
    """Hashes of the template's paragraphs in an article that is mostly of such: a copy."""
    recurring: set[int] = set()
    size = {False: 0, True: 0}
    todo = [(body, False)]
    while todo:
        part, gone = todo.pop()
        if isinstance(part, str):
            size[gone] += len("".join(part.split()))
        elif not part.around(True):
            if part.tag in TEXT_BLOCKS and part.digest in template:
                recurring.add(part.digest)
                gone = True
            todo += [(p, gone) for p in part.parts]
    return frozenset(recurring) if size[True] > size[False] else frozenset()


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """What is left without the template and what is declared not to be content: the
    page's articles, or else all of it; blocks are joined by line ends."""
    root = parse(page)
    if template:
        walk(root)
    bodies, todo = [], [root]
    while todo:
        element = todo.pop()
        if element.around(False):
            continue
        if element.tag in CONTENT:
            bodies.append(element)
        else:
            todo += [p for p in element.parts[::-1] if isinstance(p, Element)]
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    copied = frozenset().union(*(own_words(body, template) for body in bodies)) if template else frozenset()
    todo, own = (bodies or [root])[::-1], {id(body) for body in bodies}
    while todo:
        part = todo.pop()
        if part is None:
            end_block()
        elif isinstance(part, str):
            line.append(part)
        elif (id(part) not in own and part.around(bool(bodies))) or (
            part.digest in template and part.tag not in NEVER_TEMPLATE and part.digest not in copied
        ):
            if part.tag in BLOCKS:
                end_block()
        else:
            if part.tag in BLOCKS:
                end_block()
                todo.append(None)
            todo += part.parts[::-1]
    end_block()
    return "\n".join(blocks)


def extract_pages(
    df: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    min_share_of_text: float = MIN_SHARE_OF_TEXT,
    many_pages: int = MANY_PAGES,
    most_templates: int = MOST_TEMPLATES,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """The main text of every page, from its whole HTML.

    A block subtree is its host's template if it recurs on at least ``min_pages`` pages of
    the host and on ``min_share`` of them, or on ``many_pages``; for paragraphs and
    headings, and for containers inside ``<article>`` or ``<main>``, on
    ``min_share_of_text``. Identical pages count once; for paragraphs inside the article,
    identical articles do, and none goes from an article most of whose text would go, as
    it is a copy. Single cells and list items go only with what they are part of. With the
    template go elements that
    by tag, class, id or role are navigation, footers, forms, scripts, adverts, notices or
    comments. Of a page with articles, they are what stays. Character references are
    decoded, white space inside a block becomes one space, and blocks are joined in page
    order by one ``\\n``. Returns ``page_id``, ``url``, ``text`` and ``n_chars``.

    A null or empty page has an empty text. A page whose URL is null or has no host
    belongs to the host "". Ids play no part: repeated and null ones come out as others do.
    A tag or quote that is not closed goes to the end of the page, as in browsers. Other
    columns are not read.

    Up to ``most_templates`` recurring subtrees are sent to all executors; more are joined
    to their pages.
    """
    host = F.lower(
        F.regexp_extract(F.coalesce(df[url], F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    )
    pages = df.select(
        df[page_id].cast("long").alias("page_id"),
        df[url].alias("url"),
        df[html].alias("html"),
        host.alias("host"),
    )

    # Rows with the same host and HTML share what is found.
    pages = pages.withColumn("version", F.xxhash64("html"))

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(3)]
        for value in strings(batch.column(2)):
            digest, found = template_candidates(value)
            # The page itself, so that pages without candidates count for their host.
            around = [digest, *(a for _, a in found.values())]
            row = ([0, *found], [True, *(larger for larger, _ in found.values())], around)
            for column, values in zip(columns, row, strict=True):
                column.append(values)
        hashes, strict, around = columns
        signed = lambda rows: pa.array([np.array(r, np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64()))
        out = [batch.column(0), batch.column(1), signed(hashes), pa.array(strict, pa.list_(pa.bool_())), signed(around)]
        return pa.RecordBatch.from_arrays(out, names=["host", "version", "hash", "strict", "page"])

    schema = "host string, version long, hash array<long>, strict array<boolean>, page array<long>"
    subtrees = stage(map_arrow(pages.select("host", "version", "html"), candidates, schema), "page-subtrees")
    one = F.arrays_zip("hash", "strict", "page")
    # Grouped by page first: a large host's rows are split by it, and copies of a page
    # become one. Then each task sends one sum for each subtree.
    counted = (
        subtrees.select("host", F.inline(one))
        .groupBy("host", "hash", "page")
        .agg(F.min("strict").alias("strict"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("strict").alias("strict"))
        .filter((F.col("n") >= min_pages) | (F.col("hash") == 0))
    )
    counted = stage(counted, "subtree-counts")
    sizes = counted.filter("hash = 0").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("strict"), min_share_of_text).otherwise(min_share)
    recurring = (
        counted.filter((F.col("hash") != 0) & (F.col("n") >= min_pages))
        .join(sizes, "host")
        .filter((F.col("n") >= F.col("pages") * share) | (~F.col("strict") & (F.col("n") >= many_pages)))
        .select("host", "hash")
    )
    recurring = stage(recurring, "templates")
    if recurring.count() <= most_templates:
        # Few enough to be sent to all executors, so that no HTML is shuffled.
        of_host: dict[str, set[int]] = {}
        for row in recurring.collect():
            of_host.setdefault(row["host"], set()).add(row["hash"] & MASK)
        sent = df.sparkSession.sparkContext.broadcast(of_host)
        joined = pages.select("page_id", "url", "html", "host")
    else:
        sent = None
        own = subtrees.select("host", "version", F.explode("hash").alias("hash")).join(recurring, ["host", "hash"])
        own = own.groupBy("host", "version").agg(F.collect_set("hash").alias("template"))
        joined = pages.join(own, ["host", "version"], "left").select("page_id", "url", "html", "template")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = batch.column(3).to_pylist()
        if sent is not None:
            templates = [sent.value.get(host, frozenset()) for host in last]
        else:
            templates = [{h & MASK for h in found or ()} for found in last]
        texts = [main_text(*pair) for pair in zip(strings(batch.column(2)), templates, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        columns.append(long_array([len(t) for t in texts]))
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, rows, "page_id long, url string, text string, n_chars long")
