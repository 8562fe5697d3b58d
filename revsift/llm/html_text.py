"""Operator 6: main text of web pages by tag-path ratios.

A page is read into text blocks, each under its root-to-leaf tag path. For
every path the method adds up the text length and the punctuation of its
blocks, divides both by the number of blocks and links, smooths the two
ratios over the paths in page order, fuses them (their product) and keeps
the paths above a threshold: those name the content nodes. The article or main
element that holds most of their text, if there is one, with other such elements
that hold at least a quarter as much, else the lowest
container of all of them and of the headings over text, is the article, and all of its blocks are
returned in page order, short ones too, but for those in elements that are
never the article (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments). Tag, role and a few plain names say so at once. Names
that consist of such words (a cookie banner, a related box) say it unless the
element outweighs the rest of the page; other
words of class and id only hint at it, and hold where the element is mostly
links, has no sentence, or lies outside the article. Headings have no hints.

Every step is linear in the page: paths are numbers of (parent path, step),
open elements are found by tag, and sums go once from children to parents.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_batches

# Elements by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead tr ul""".split())
# An open p does not end beyond one of these.
P_SCOPE = ("td", "th", "button", "object", "caption", "table")
# An open p ends where one of these starts.
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
# Start tag -> open elements that it ends, up to the nearest of the scope.
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
             "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
             "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
             "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
# Elements that are never part of the article.
NEVER = frozenset("nav footer aside form button select menu dialog head search fieldset label svg annotation annotation-xml canvas object audio video".split())
# Class and id words of elements that an article element can itself be.
NOT_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored".split())
# ARIA roles and words of class and id that mark such elements.
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar pagination pager
    cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login
    comment comments commentlist discussion disqus replies reply respond share sharing social related recommended
    widget widgets form search copyright skip""".split())
# Those that say it alone, as a whole name or with words of layout; the others are hints.
NAMED = frozenset("""ad ads adsbygoogle advert adverts advertisement sponsored sidebar comment comments commentlist disqus navbar
    breadcrumb breadcrumbs masthead topbar pagination cookie cookies gdpr""".split())
# Those that say it in a class of such words (in an id, in a name of two or more), unless the element outweighs the rest.
STRONG = frozenset("""consent notice popup modal overlay newsletter subscribe subscription signup promo promotion banner sponsor related
    recommended widget widgets share sharing social replies respond""".split())
LAYOUT = frozenset("""area bar bottom box block container content inner item items left list main page right section site slot
    top unit wrapper article post story entry articles posts stories links reading sticky fixed grid cards card wrap""".split())
# An article element stands beside the heaviest one where it holds at least this share of its text.
BESIDE = 0.25
# A block with a sentence has at least so many characters outside links.
SENTENCE = 40
# Elements that name the article themselves.
ARTICLE = frozenset(("article", "main"))

CONTAINER = frozenset("#root html body article main section div center td".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(?=[^A-Za-z/!?])|<\Z|</[^A-Za-z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/\"']+)")
HEADING = re.compile(r"h[1-6]")
_WORDS = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?…。！？]")
_PUNCT = re.compile(r"[.,;:!?…。、，！？；]")


class _Element:
    """An open element: ``path`` numbers its root-to-leaf tag path; ``block``,
    ``named`` and ``hinted`` are the nearest block element, article element and
    hinted block element around it (itself included)."""
    __slots__ = ("tag", "path", "never", "article", "parent", "order", "header", "hint", "strong", "block", "named", "hinted")

    def __init__(self, tag: str, parent, never: bool, article: bool, order: int, path: int, header: bool, hint: bool = False,
                 strong: bool = False):
        self.tag, self.parent, self.never, self.article, self.order, self.header = tag, parent, never, article, order, header
        self.path, self.hint, self.strong = path, hint, strong
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.named = self if article else parent.named if parent else None
        self.hinted = self if hint and tag in BLOCK else parent.hinted if parent else None


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool, bool, str]:
    """(never content, a hint of that, a strong hint, names the article, path step) of a start tag."""
    never, hint, strong, article, step = tag in NEVER, False, False, tag in ARTICLE, tag
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name = (m[1] or m[3]).lower()
            value = (m[2] or "").strip("\"'").lower()
            if name == "role":
                never |= value in NEVER_ROLE
                article |= value in ("main", "article")
            elif name == "itemprop":
                article |= value == "articlebody"
            elif name in ("class", "id"):
                words = set(_WORDS.findall(value))
                if tag not in ("html", "body", "article", "main") and not HEADING.fullmatch(tag) and (
                        words & NEVER_WORDS and not words & {"article", "post", "story", "entry"}
                        or words & {"comment", "comments", "sidebar", "sponsored", "related", "share"}):
                    names = [set(_WORDS.findall(x)) for x in value.split()]
                    never |= any(x & NAMED and x <= NEVER_WORDS | LAYOUT for x in names)
                    strong |= any(x & STRONG and x <= NEVER_WORDS | LAYOUT and (name == "class" or len(x) > 1) for x in names)
                    hint = True
                elif tag == "article" and words & NOT_ARTICLE:
                    never |= any(x & NOT_ARTICLE and x <= NEVER_WORDS | LAYOUT for x in (set(_WORDS.findall(x)) for x in value.split()))
                if name == "class":
                    step += "." + ".".join(sorted(words))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or \
                    name == "style" and re.search(r"display\s*:\s*none", value):
                never = True
    return never, hint, strong, article, step


def is_sentence(text: str, linked: int) -> bool:
    """Whether a block has a sentence that is not mostly links."""
    return linked < 0.5 * len(text) and len(text) - linked >= SENTENCE and _STOP.search(text) is not None


def read_blocks(page: str) -> list[tuple[str, _Element, int]]:
    """(text, innermost block element, characters in links) of every text
    block of a page in page order, white space as single spaces. Unclosed,
    misnested and cut-off markup is read as browsers do in the common cases."""
    root = _Element("#root", None, False, False, 0, 0, False)
    stack: list[_Element] = [root]
    paths: dict[tuple[int, str], int] = {}
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    open_blocks = [0]
    blocks: list[tuple[str, _Element, int]] = []
    buffer: list[str] = []
    links = [0]
    open_links = 0
    order = 0
    holder = root
    hidden = 0
    hinted, hints = 0, [0]  # open inline elements with a hint, characters in them

    def flush() -> None:
        nonlocal holder
        if buffer:
            text = " ".join("".join(buffer).split())
            # a block that is mostly in hinted inline elements, without a sentence, is a button or label
            if text and (2 * hints[0] < len(text) or is_sentence(text, links[0])):
                blocks.append((text, holder, links[0]))
            buffer.clear()
        links[0] = hints[0] = 0

    def last(tags) -> int:
        """Place of the innermost open element of these tags (0: none)."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def pop_to(k: int) -> None:
        nonlocal open_links, hidden, hinted
        for e in stack[k:]:
            open_links -= e.tag == "a"
            hidden -= e.never and e.tag not in BLOCK
            hinted -= e.hint and e.tag not in BLOCK
        if open_blocks[-1] >= k:
            flush()
        while len(stack) > k:
            tag = stack.pop().tag
            open_at[tag].pop()
            if tag in BLOCK:
                open_blocks.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if hidden > 0:
                continue
            if not buffer:
                holder = stack[-1].block
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if open_links > 0:
                links[0] += len(text.strip())
            if hinted > 0:
                hints[0] += len(text.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                buffer.append(" ")
                continue
            k = last((tag,))
            if k and (tag in BLOCK or k > open_blocks[-1]):  # an inline end tag does not close blocks
                pop_to(k)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        never, hint, strong, article, step = _marks(tag, m[3])
        if tag in ENDS_P:
            k = last(("p",))
            if k > last(P_SCOPE):
                pop_to(k)
        if tag in ENDS_SAME:
            same, scope = ENDS_SAME[tag]
            edge = last(scope)
            low = min((at_tag[j] for at_tag in map(open_at.get, same) if at_tag and (j := bisect_right(at_tag, edge)) < len(at_tag)), default=0)
            if low:
                pop_to(low)
        if tag in BLOCK:
            flush()
        parent = stack[-1]
        order += 1
        # the header of a page goes, that of an article keeps its headings
        header = parent.header or tag == "header"
        if tag == "header" and parent.named is None:
            never = True
        path = paths.setdefault((parent.path, step), len(paths) + 1)
        e = _Element(tag, parent, never or parent.never, article, order, path, header, hint, strong)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append(e)
        open_links += tag == "a"
        hinted += hint and tag not in BLOCK
        hidden += e.never and tag not in BLOCK
    flush()
    return blocks


def path_scores(blocks: list[tuple[str, _Element, int]]) -> dict[int, float]:
    """Fused and smoothed text and punctuation ratios of every tag path."""
    stats: dict[int, list[float]] = {}
    for text, e, linked in blocks:
        s = stats.setdefault(e.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += max(0, len(text) - linked)
        s[2] += len(_PUNCT.findall(text))
        s[3] += linked > 0
    paths = list(stats)
    ratio = [s[1] / (s[0] + s[3]) for s in stats.values()]
    punct = [s[2] / (s[0] + s[3]) for s in stats.values()]

    def smooth(v: list[float]) -> list[float]:
        return [(0.25 * v[i - 1] if i else 0) + 0.5 * v[i] + (0.25 * v[i + 1] if i + 1 < len(v) else 0) for i in range(len(v))]

    return {p: t * (1 + q) for p, t, q in zip(paths, smooth(ratio), smooth(punct))}


def text_headings(blocks: list[tuple[str, _Element, int]]) -> list[_Element]:
    """Elements of the headings that stand over text: before the next heading
    comes a block that is not mostly links (further headings between them count
    as one with it). Headings of a page's header or mostly of links do not count."""
    out, over_text, after_heading = [], False, False
    for text, e, linked in reversed(blocks):
        prose = linked < 0.5 * len(text)
        if HEADING.fullmatch(e.tag):
            after_heading = True
            if over_text and prose and not e.header:
                out.append(e)
        else:
            over_text = prose or over_text and not after_heading
            after_heading = False
    return out


def _around(inner) -> list[_Element]:
    """The given elements and all around them, parents first."""
    seen: dict[int, _Element] = {}
    for e in inner:
        while e is not None and e.order not in seen:
            seen[e.order] = e
            e = e.parent
    return [seen[k] for k in sorted(seen)]


def _sums(own: list[tuple[_Element, int]]) -> tuple[dict[int, int], list[_Element]]:
    """Sums under every element by its order, and the elements, parents first."""
    sums: dict[int, int] = {}
    for e, n in own:
        sums[e.order] = sums.get(e.order, 0) + n
    elements = _around(e for e, _ in own)
    for e in reversed(elements):
        if e.parent is not None:
            sums[e.parent.order] = sums.get(e.parent.order, 0) + sums.get(e.order, 0)
    return sums, elements


def without_furniture(blocks: list[tuple[str, _Element, int]]) -> list[tuple[str, _Element, int]]:
    """Blocks outside the elements whose hint their ratios confirm: mostly
    links, no sentence, or a strong hint on an element that is not most of the page:
    it stands in or beside an article element with text of its own, or holds at most half of all text."""
    hinted: dict[int, _Element] = {}
    stats: dict[int, list[int]] = {}
    total = in_article = 0
    for text, e, linked in blocks:
        total += len(text)
        in_article += len(text) if e.named else 0
        if e.hinted is not None:
            s = stats.setdefault(e.hinted.order, [0, 0, 0, 0])
            for i, n in enumerate((len(text), linked, is_sentence(text, linked), len(text) if e.named else 0)):
                s[i] += n
            x = e.hinted
            while x is not None and x.order not in hinted:
                hinted[x.order] = x
                x = x.parent.hinted
    for k in sorted(hinted, reverse=True):
        up = hinted[k].parent.hinted
        if up is not None:
            s = stats.setdefault(up.order, [0, 0, 0, 0])
            for i, n in enumerate(stats[k]):
                s[i] += n

    def outweighs(x: _Element, n: int, named: int) -> bool:
        if x.parent.named is not None:
            return named == in_article
        return 2 * n > total and 2 * named >= in_article

    drop = set()
    for k in sorted(hinted):
        x, (n, linked, sentences, named) = hinted[k], stats[k]
        up = x.parent.hinted
        if up is not None and up.order in drop or 2 * linked >= n or not sentences or x.strong and not outweighs(x, n, named):
            drop.add(k)
    return [b for b in blocks if b[1].hinted is None or b[1].hinted.order not in drop] if drop else blocks


def main_text(page: str) -> tuple[str, int, int]:
    """(main text, blocks taken, blocks of the page)."""
    blocks = read_blocks(page)
    usable = without_furniture([b for b in blocks if not b[1].never])
    if not usable:
        return "", 0, len(blocks)
    scores = path_scores(usable)
    floor = pstdev(scores.values()) * 0.5 if len(scores) > 1 else 0.0
    content = [b for b in usable if scores[b[1].path] >= floor and b[2] < 0.5 * len(b[0])] or usable
    # hinted text is part of the article only where the rest of the text puts it, unless it outweighs the rest
    plain = [b for b in content if b[1].hinted is None]
    if 2 * sum(len(b[0]) for b in plain) >= sum(len(b[0]) for b in content):
        content, voters = plain, [b for b in usable if b[1].hinted is None]
    else:
        voters = usable
    total = sum(len(b[0]) for b in content)

    # text of content under every element
    weight, elements = _sums([(e, len(text)) for text, e, _ in content])
    named = [e for e in elements if e.article and not e.never]
    heaviest = max((weight[e.order] for e in named), default=0)
    regions = {e.order for e in named if weight[e.order] >= BESIDE * heaviest}
    outer: dict[int, _Element | None] = {}
    for e in elements:  # the outermost of them around every element
        outer[e.order] = (outer[e.parent.order] if e.parent else None) or (e if e.order in regions else None)
    if 3 * sum(len(text) for text, e, _ in content if outer[e.order]) < total or not regions:
        # no article element, or teasers in such elements; the lowest container that holds all of the content and its headings
        inner = [e for _, e, _ in content if not HEADING.fullmatch(e.tag)] + text_headings(voters) or [e for _, e, _ in content]
        held, elements = _sums([(e, 1) for e in inner])
        regions = {max(e.order for e in elements if held[e.order] == len(inner) and e.tag in CONTAINER)}
    # a main element's text outside of its article elements, where these hold most of it, is held to its ratios
    articles: dict[int, int] = {}
    for text, e, _ in content:
        if (x := outer[e.order]) is not None and e.named is not x:
            articles[x.order] = articles.get(x.order, 0) + len(text)
    loose = {e.order for e in named if e.order in regions and e.tag == "main" and 2 * articles.get(e.order, 0) >= weight[e.order]}
    taken = []
    region: dict[int, _Element | None] = {}
    for e in _around(e for _, e, _ in usable):
        region[e.order] = (region[e.parent.order] if e.parent else None) or (e if e.order in regions else None)
    for text, e, linked in usable:
        x = region[e.order]
        if x is None:
            continue
        if e.header and not x.header and not HEADING.fullmatch(e.tag):
            continue
        if (not x.article or x.order in loose and e.named is x) and scores[e.path] < floor and linked >= 0.5 * len(text):
            continue  # link lists beside the text
        taken.append(text)
    return " ".join(taken), len(taken), len(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html: ``page_id``, ``url``,
    ``text`` (blocks joined by one space, empty if none), ``n_chars`` (code
    points), ``n_blocks`` and ``page_blocks`` (blocks taken, blocks of the page).

    Null or empty html has no text. Repeated rows give repeated results; other
    columns are not read. One pass, no shuffle; a page is one row.
    """
    src = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"),
                       F.coalesce(pages[html_col], F.lit("")).alias("html"))
    fields = [StructField("page_id", pages.schema[id_col].dataType), StructField("url", pages.schema[url_col].dataType),
              StructField("text", StringType()), StructField("n_chars", LongType()),
              StructField("n_blocks", LongType()), StructField("page_blocks", LongType())]

    def run(batches):
        for batch in batches:
            rows = [main_text(h.as_py()) for h in batch.column("html")]
            texts = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())], names=[f.name for f in fields])

    return map_batches(src, run, StructType(fields), rows=500)
