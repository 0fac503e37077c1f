"""Main text of web pages with site template removal.

Element subtrees are hashed bottom-up in two ways: with their text, and by their shape (tags, classes and
ids along the path from the root and below, runs of equal children once, no text). Each page sends its
distinct hashes, and Spark counts them for each host; what recurs across many pages of its host is part of
the site's template and is deleted: a menu or a footer whose words differ from page to page has the same
shape everywhere. Content has a recurring shape, too, so shapes count only outside the page's core: its
articles or main elements, or else the innermost container that holds over half of the page's text; and
never for headings. The core and what is inside it goes if it recurs with its text; where the core itself does (a
page of mostly boilerplate), shapes do not count. Pages with the same main element count once, so a group of
copied pages does not turn its own text into a template.

What is left is reduced to the article by the roles of its elements. Outside articles, words in classes and
ids tell the roles (for hosts of too few pages to have a template); inside, only tags and whole class names.

At most ``subtrees of a page / share`` subtrees of a host can recur on that share of its pages, so the list
that travels back to a host's pages is short, however many pages it has.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_batches

#: A subtree is template if it recurs on this many different pages of a host and on this share of them.
MIN_PAGES, SHARE = 10, 0.5
#: Parts that the pages of a host are dealt to when they meet their template, so that a hot host is no one task.
SALTS = 64

#: A value is quoted only right after its equals sign; a quote anywhere else is a character, and > ends the tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]++|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
_DROPPED = frozenset("nav footer aside form script style textarea title xmp iframe noembed noframes noscript template svg math button select option dialog menu head object audio video canvas".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_ASIDE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|banner|ads?|advert|adverts|advertisement|promo|sponsor|sponsored|cookies?|consent|gdpr|notice|notices|alert|comments?|disqus|respond|reactions|share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|toolbar|pagination|skip-link|search|contentinfo|complementary|dialog)(?:$|[\s_-])", re.I)

#: Inside an article, class names and ids that are one of these as a whole.
_ASIDE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner ad ads advert adverts advertisement promo sponsor sponsored cookie cookies consent gdpr notice notices "
    "alert comment comments reader-comments comment-list comments-list comment-section comments-section user-comments disqus disqus_thread respond reactions share sharing social share-buttons social-share "
    "related related-posts related-articles recommended newsletter newsletter-signup subscribe signup popup modal overlay toolbar pagination skip-link search search-form contentinfo complementary dialog cookie-banner cookie-notice".split()
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar|logo|branding)(?:$|[\s_-])", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    marks: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # elements and texts, in page order
    digest: int = 0  # of the subtree with its text
    shape: int = 0  # of the path to it and the tags below it; 0 where shapes do not count
    size: int = 0  # characters of text below it


def parse(page: str) -> Element:
    """A forgiving tree: unclosed and misnested tags close as browsers close them, near enough for text."""
    root = Element("#root")
    stack = [root]
    at = 0
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m.group(1)
        if tag is None:
            continue
        tag = tag.lower()
        if page.startswith("</", m.start()):
            _close(stack, tag)
            continue
        _open(stack, tag)
        marks, hidden = _marks(m.group(2)) if m.group(2) else ("", False)
        element = Element(tag, marks, hidden)
        stack[-1].children.append(element)
        if tag in _RAW and not m.group(2).rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID:
            stack.append(element)
    return root


def _marks(attributes: str) -> tuple[str, bool]:
    marks, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name in ("class", "id", "role"):
            marks.append(value)
    return html.unescape(" ".join(marks)), hidden


def _open(stack: list[Element], tag: str) -> None:
    if tag in _CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in _BLOCK:
                break
    if tag in _SIBLINGS:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in _SIBLINGS[tag]:
                del stack[i:]
                break
            if stack[i].tag in _FENCES[tag]:
                break


def _close(stack: list[Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in _BLOCK and stack[i].tag in _BLOCK:
            return  # an inline end tag does not close the block around it


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
_NOT_COUNTED = frozenset(("html", "body", "head", "#root"))
_MASK = (1 << 64) - 1


def core_of(root: Element) -> list[Element]:
    """The page's core; sizes must be known. Its articles, else its main elements, or else the innermost container
    (an element with blocks in it) that holds over half of the text."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.tag == wanted and e.size:
                found.append(e)
            else:
                todo += [c for c in e.children if isinstance(c, Element) and c.size]
        if found:
            return found
    at = root
    while heavy := next((c for c in at.children if isinstance(c, Element) and 2 * c.size > root.size and c.tag not in _DROPPED and any(isinstance(d, Element) and d.tag in _BLOCK for d in c.children)), None):
        at = heavy
    return [at]


def hash_subtrees(root: Element) -> tuple[set[int], list[Element]]:
    """Fills in digests, shapes and sizes; returns the hashes that the page counts for its host, and its core."""
    import xxhash

    order, todo = [], [(root, 0)]
    path: dict[int, int] = {}
    while todo:
        e, above = todo.pop()
        order.append(e)
        path[id(e)] = own = xxhash.xxh64_intdigest(f"{above:x}<{e.tag} {e.marks}")
        todo += [(c, own) for c in e.children if isinstance(c, Element)]
    below: dict[int, int] = {}
    for e in reversed(order):
        full, plain = xxhash.xxh64(e.tag), xxhash.xxh64(f"{e.tag} {e.marks}")
        size, last = 0, -1
        for c in e.children:
            if isinstance(c, Element):
                full.update(c.digest.to_bytes(8, "little"))
                size += c.size
                kind = below[id(c)] if c.size else -1
            elif text := " ".join(c.split()):
                full.update(text)
                size += len(text) if e.tag not in _RAW else 0
                kind = 1
            else:
                continue
            if kind != last and kind != -1:  # a run of equal children counts once
                plain.update(kind.to_bytes(8, "little"))
                last = kind
        e.size, e.digest, below[id(e)] = size, full.intdigest(), plain.intdigest()
    core = core_of(root)
    inside, todo = set(), list(core)
    while todo:
        e = todo.pop()
        inside.add(id(e))
        todo += [c for c in e.children if isinstance(c, Element)]
    around: set[int] = set()  # what holds a part of the core
    for e in reversed(order):
        if any(id(c) in around or id(c) in inside for c in e.children) and id(e) not in inside:
            around.add(id(e))
    out = set()
    for e in order:
        if not e.size or e.tag not in _BLOCK or e.tag in _NOT_COUNTED or id(e) in around:
            continue
        out.add(e.digest)
        if id(e) not in inside and e.tag not in _HEADINGS:
            e.shape = xxhash.xxh64_intdigest(f"{path[id(e)]:x}>{below[id(e)]:x}") | 1
            out.add(e.shape)
    out.discard(0)
    return out, core


def _set_aside(e: Element, of_page: bool = False) -> bool:
    """Whether an element is no part of the text; ``of_page``: outside an article, where headers are the site's."""
    if e.tag in _DROPPED or e.hidden or of_page and e.tag == "header":
        return True
    if not e.marks:
        return False
    if of_page:
        return bool(_ASIDE.search(e.marks) or _HEADER.search(e.marks))
    return not _ASIDE_NAMES.isdisjoint(e.marks.lower().split())


def main_elements(root: Element) -> list[Element]:
    """The page's articles, else its main part, else its body, else all."""
    for wanted in ("article", "main", "body"):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.tag == wanted:
                if not _set_aside(e):
                    found.append(e)
                continue
            if wanted == "body" or not _set_aside(e, True):
                todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        if found:
            return found
    return [root]


def text_blocks(element: Element, template: frozenset[int], roles: bool = True) -> list[str]:
    """Texts of the blocks below, in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            blocks.append(text)
        held.clear()

    of_page = element.tag in ("body", "#root")
    todo: list = [element]
    while todo:
        e = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            held.append(e)
        elif e is not element and (_set_aside(e, of_page) if roles else e.tag in _RAW or e.tag == "head") or e.digest in template or e.shape in template:
            if e.tag in _BLOCK:
                flush()
        elif e.tag in ("br", "hr", "wbr", "img"):
            if e.tag == "hr":
                flush()
            elif e.tag == "br":
                held.append(" ")
        else:
            block = e.tag in _BLOCK or e.tag == "#root"
            if block:
                flush()
                todo.append(None)
            todo += reversed(e.children)
    flush()
    return blocks


def _forget_shapes(root: Element) -> None:
    todo = [root]
    while todo:
        e = todo.pop()
        e.shape = 0
        todo += [c for c in e.children if isinstance(c, Element)]


def extract(page: str, template: frozenset[int] = frozenset(), roles: bool = True) -> str:
    """The main text: blocks joined by two line feeds; empty if there is none.

    Without ``roles`` only the template is deleted (and what is never text, as scripts): tags and class names
    say nothing then.
    """
    root = parse(page)
    if template:
        _, core = hash_subtrees(root)
        if all(e.digest in template for e in core):
            _forget_shapes(root)
    return "\n\n".join(b for e in (main_elements(root) if roles else [root]) for b in text_blocks(e, template, roles))


def host_of(url):
    """Host part of a url column, lower case; pages without one share the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``pages(host, html)`` -> ``(host, template array<long>)`` for hosts that have recurring subtrees."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        hosts, hashes, mains = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(page or "")
            found, _ = hash_subtrees(root)
            own = sum(e.digest for e in main_elements(root)) & _MASK
            hosts += [host] * (len(found) + 1)
            hashes += [0, *found]  # 0 counts the host's pages
            mains += [own] * (len(found) + 1)
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), signed(hashes), signed(mains)], names=["host", "hash", "main"])

    seen = map_arrow(pages.select("host", "html"), run, "host string, hash long, main long").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("pages"))
    often = materialize(counts.where((F.col("pages") >= min_pages)), "subtrees")
    totals = often.where("hash = 0").select("host", F.col("pages").alias("total"))
    found = often.where("hash <> 0").join(totals, "host").where(F.col("pages") >= F.col("total") * share)
    return found.groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("template"))


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, roles: bool = True) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_chars)``, a row for each input row.

    Null or empty html gives an empty text; a null url belongs to host ''. Pages of the same host share
    its template, which is empty for hosts with fewer than ``min_pages`` different pages. Repeated rows and
    null ids are kept; other columns are ignored; an empty table gives no rows; a page may be of any length
    and depth.
    """
    text_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    found = templates(rows, min_pages, share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int"))
    joined = dealt.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "template")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(p or "", frozenset(h & _MASK for h in t or ()), roles) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return map_arrow(joined, run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
