"""Main text of web pages, with site templates removed.

Every page is read into elements.  Each block element outside main content gets a
hash of its whole subtree (tags and texts), and so does each article or main
element as a whole; Spark counts, for each host, the distinct pages that hold it
(copies of a whole page count once), and subtrees found on many are deleted
before the text is taken.  Nothing inside an article or main element, and nothing
that holds one, is deleted as a template, and an article that many pages hold goes
only where the page has another one: copies keep their text.

The main text is that of the page's articles, else of its main element, else of
its body.  What page structure itself names (menus, headers, footers, sidebars,
forms, scripts, styles) goes by its tag or role; names of classes and ids are used
for what is left: outside main content those of :data:`_DROP_NAMES`, inside it only
those of adverts, notices about cookies, and comments.  Character references are decoded, white space
becomes one space, blocks join by one space.  A form, header or named element that
holds an article is a wrapper and stays; a menu, sidebar or footer that holds one
is passed by if the page has another.  A null or empty page gives an
empty text; broken markup is read as far as it goes, and elements may be nested
to any depth; repeated rows count once each, as pages of their own.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .tables import bounded_batches
from .url_filter import host_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[!?][^>]*>""", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_RAW = frozenset("script style template textarea title iframe noscript svg math canvas object select xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption dl dt dd table caption tbody thead tfoot tr td th".split())
_BLOCK = _PROSE | frozenset("html body main article section div header footer nav aside ul ol li form fieldset address center details summary hgroup dialog menu search br hr".split())
_DROP_TAGS = frozenset("nav footer aside form button dialog menu head search".split())
#: Tags and roles that aren't wrappers of a page: an article in one is a teaser, unless the page has no other.
_APART = frozenset("nav footer aside button dialog menu head search".split())
_APART_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of class names and ids that mark what is not the article.
_DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"comments?|commentlist|replies|respond|disqus|discussion|sidebar|side|widget\w*|rail|menu|nav|navbar|navigation|breadcrumbs?|topbar|masthead|header|footer|copyright|"
    r"share|sharing|social|related|recommend\w*|pagination|pager|skip|toolbar|search|form)(?:$|[\s_-])",
    re.I,
)
#: The same inside main content, as whole words of a class: all else there is the author's.
_DROP_INSIDE = re.compile(r"(?:^|\s)(?:ads?|advert\w*|adsense|adslot|ad-[\w-]*|sponsor\w*|promo\w*|cookie[\w-]*|consent[\w-]*|newsletter[\w-]*|comments?|comment-?(?:list|section|form|thread|area)|replies|disqus\w*)(?:$|\s)", re.I)
#: These go inside main content if most of their text is links.
_DROP_LINKS = re.compile(r"(?:^|\s)(?:sidebar|related[\w-]*|share[\w-]*|sharing|social[\w-]*|tags?|breadcrumbs?|pagination|pager|toc)(?:$|\s)", re.I)

#: Classes of articles that are comments or advertising themselves.
_ASIDE_ARTICLE = re.compile(r"(?:^|\s)(?:comment\S*|repl(?:y|ies)\S*|ads?|advert\S*|sponsor\S*|promo\S*|teaser\S*|related\S*)(?:\s|$)", re.I)


class Element:
    """tag, marks (class, id and role), role, parts (texts and elements) and, after ``hashed``, the subtree's hash, whether it holds main content, and its characters of text, in all and in links."""

    __slots__ = ("tag", "marks", "role", "parts", "hash", "holds", "size", "linked")

    def __init__(self, tag: str, marks: str = "", role: str = "") -> None:
        self.tag, self.marks, self.role, self.parts, self.hash, self.holds, self.size, self.linked = tag, marks, role, [], None, False, 0, 0

    def is_main(self) -> bool:
        return self.tag in ("article", "main") or self.role == "main"

    def beside(self) -> bool:
        """An article that is a comment, an advert or a teaser."""
        return self.tag == "article" and bool(self.marks) and bool(_ASIDE_ARTICLE.search(self.marks))

    def apart(self) -> bool:
        return self.tag in _APART or self.role in _APART_ROLES

    def dropped(self, in_article: bool) -> bool:
        if self.tag in _DROP_TAGS or self.role in _DROP_ROLES or self.tag == "header" and not in_article:
            return True
        if self.tag == "article":  # its own classes tell of much besides
            return self.beside()
        if not self.marks or self.tag in ("html", "body", "main") or in_article and self.tag == "header":
            return False
        if in_article:
            return bool(_DROP_INSIDE.search(self.marks)) or 2 * self.linked > self.size and bool(_DROP_LINKS.search(self.marks))
        return bool(_DROP_NAMES.search(self.marks))


def read_page(source: str) -> Element:
    """The page's elements; scripts, styles and the like, and comments, are left out."""
    root = Element("html")
    stack, at, n = [root], 0, len(source)
    while at < n:
        token = _TOKEN.search(source, at)
        if token is None:
            stack[-1].parts.append(source[at:])
            break
        if token.start() > at:
            stack[-1].parts.append(source[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in _BLOCK and stack[depth].tag in _BLOCK:
                    break
            continue
        if tag in _RAW and not token[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag == "html":
            continue
        if tag in _BLOCK:  # a block ends an open paragraph and what stands in it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" and tag != "br" or stack[depth].tag == tag == "li":
                    del stack[depth:]
                    break
                if stack[depth].tag in _BLOCK:
                    break
        marks = role = ""
        if token[3]:
            for name, value in _MARK.findall(token[3]):
                value = value.strip("\"'")
                if name.lower() == "role":
                    role = value.lower()
                else:
                    marks += " " + value
        element = Element(tag, marks, role)
        stack[-1].parts.append(element)
        if tag not in _VOID and not token[3].endswith("/"):
            stack.append(element)
    return root


def hashed(page: Element) -> int:
    """Sets the hashes of all subtrees (tags, and texts with white space made one) from the leaves up, and returns the page's."""
    order, todo = [], [page]
    while todo:
        element = todo.pop()
        order.append(element)
        todo += [p for p in element.parts if not isinstance(p, str)]
    for element in reversed(order):
        told, elements = [element.tag], [p for p in element.parts if not isinstance(p, str)]
        own = [" ".join(p.split()) for p in element.parts if isinstance(p, str)]
        told += [" ".join(p.split()) if isinstance(p, str) else str(p.hash) for p in element.parts]
        element.hash = xxhash.xxh64_intdigest("\0".join(told)) - (1 << 63)
        element.holds = element.is_main() and not element.beside() or any(p.holds for p in elements)
        element.size = sum(map(len, own)) + sum(p.size for p in elements)
        element.linked = element.size if element.tag == "a" else sum(p.linked for p in elements)
    return page.hash


def template_hashes(page: Element) -> set[int]:
    """Hashes of the subtrees that may be templates: main elements as a whole, and block elements with parts that neither are in one nor hold one."""
    hashed(page)
    out, todo = set(), [page]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, str):
                continue
            if part.is_main():
                out.add(part.hash)
                continue
            if part.tag in _BLOCK and part.tag != "body" and part.parts and not part.holds:
                out.add(part.hash)
            todo.append(part)
    return out


def _find(page: Element, tags: tuple[str, ...], anywhere: bool = False) -> list[Element]:
    """The outermost elements of these tags (or of role main).  What holds none is passed by if it is dropped, and so are (but for ``anywhere``) menus, sidebars, footers and the like."""
    out, todo = [], [page]
    while todo:
        element = todo.pop()
        if element is not page and (element.tag in tags or "main" in tags and element.role == "main"):
            out.append(element)
            continue
        for part in reversed(element.parts):
            if not isinstance(part, str) and not part.beside() and not (part.dropped(False) and (not part.holds or part.apart() and not anywhere)):
                todo.append(part)
    return out


def page_text(page: Element, templates: set[int] = frozenset()) -> str:
    """The main text; ``templates`` are hashes of subtrees to leave out.

    Without an article or main element a form, or what a name tells of, that holds
    more than half of the page's text is its content all the same.
    """
    hashed(page)
    roots = next((found for anywhere in (False, True) for tag in ("article", "main") if (found := _find(page, (tag,), anywhere))), [page])
    roots = [r for r in roots if r.hash not in templates] or roots
    pieces: list[str] = []

    def out(part: Element, inside: bool) -> bool:
        if inside:
            return part.dropped(True)
        if part.dropped(False) and (part.apart() or part.tag == "header" or 2 * (part.size - part.linked) <= page.size - page.linked):
            return True
        return part.hash in templates

    def take(element: Element, inside: bool) -> None:
        todo: list = [element]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                pieces.append(part)
                continue
            if part is not element and out(part, inside):
                continue
            block = part.tag in _BLOCK
            todo += [" "] * block + part.parts[::-1] + [" "] * block

    for root in roots:
        take(root, root is not page)
    return " ".join(html.unescape("".join(pieces)).split())


def extract(pages: DataFrame, min_pages: int = 10, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of each row of ``pages``.

    A subtree is a template of its host if at least ``min_pages`` pages hold it
    that differ in tags or texts.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))

    def subtrees(batches):
        for batch in batches:
            found, wholes = [], []
            for source in batch.column("html").to_pylist():
                page = read_page(source)
                found.append(sorted(template_hashes(page)))
                wholes.append(page.hash)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), pa.array(wholes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "host", "page", "hashes"])

    host = F.xxhash64(host_of(F.col("url"))).alias("host")
    held = kept(rows.select("key", host, "html").mapInArrow(subtrees, "key long, host long, page long, hashes array<long>"))
    once = held.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))  # pages of one hash have the same subtrees
    counts = once.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").count()
    common = counts.where(F.col("count") >= min_pages).select("host", "hash")
    own = held.select("key", "host", F.explode("hashes").alias("hash")).join(common, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("templates"))

    def texts(batches):
        for batch in batches:
            out = [page_text(read_page(source), set(templates or ())) for source, templates in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = dict(rows.dtypes)
    return rows.join(own, "key", "left").select("page_id", "url", "html", "templates").mapInArrow(texts, f"page_id {kind['page_id']}, url string, text string")
