"""Main text of web pages by site template removal.

1. Every page is parsed into elements; each element's subtree (tag, text and children)
   is hashed.  A page becomes its blocks of text, each with the hashes of the elements
   that it lies in.  Outside the article of a page, and where links make up most of an
   element, its shape (tags and classes, repeated children once, no text) is hashed as
   well: menus and notices say something else on each page, but look alike.
2. Spark counts on how many pages of a host with different articles each subtree and each
   shape occurs.
3. Blocks in a subtree that recurs on most of them are the host's template and are cut
   out, inside an article too.  There, recurring prose stays if it makes up half of the
   article or more: such a page is a copy of others, not an article with additions.

Elements that say themselves that they are not content (navigation, footers, adverts,
forms, scripts ...) go without counting, unless only by their class and they hold the main
text.  In an article headings and prose are content whatever they are called, unless a class
says that they are advertising.  Reader comments go by their structure: entries that have
an author and a date, or a list or count under a heading that announces them.  Inline
elements are part of their block.  What lies outside ``<article>`` or ``<main>`` goes by the
same rules; there, mere links and copyright lines go as well.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: A block is template if it is on at least so many different pages of its host, and on this share of them.
MIN_PAGES = 8
MIN_SHARE = 0.5
#: Elements nested deeper than this are counted as part of the one at this depth.
DEEP = 64
#: Hits of so many pages, and so many template blocks, are broadcast; more are left to the planner.
BROADCAST_PAGES, BROADCAST_BLOCKS = 200_000, 100_000
SLICE = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object textarea title noembed noframes xmp".split())
DROP = RAW | frozenset("head nav footer aside form button select dialog fieldset option audio video map".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd article section main blockquote pre table thead tbody tfoot tr caption figure "
    "figcaption header footer nav aside form address fieldset hr body html details summary head hgroup search".split()
)
#: Go outside an article only: there they belong to menus and forms.
DROP_OUTSIDE = frozenset("header menu label".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr table ul ol dl b i em strong a span code q cite figcaption".split())
CLOSES_P = BLOCK
#: Words of class, id and role that mark what isn't content.
MARKS = frozenset(
    "nav navbar navigation menu submenu footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner "
    "promo promotion sponsor sponsored notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "signup login social share sharing related recommended breadcrumb breadcrumbs comment comments disqus reply replies respond widget "
    "toolbar alert pagination pager skip tracking complementary contentinfo search commentlist".split()
)
#: Classes that take prose in an article: advertising and what is asked of readers.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies newsletter breadcrumb breadcrumbs".split())
OUTSIDE_MARKS = frozenset("header masthead topbar".split())
#: Words that make a class name tell of a state (has-sidebar, comments-open), not of what the element is.
STATES = frozenset("has no not with without is open opened closed enabled disabled on off left right".split())

HEADINGS = ("h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol", "dl")
#: A heading that counts comments or asks for one needs no further sign of them.
ASKS = re.compile(r"\d|\b(?:reader|user|recent|latest|leave|post|add)\b", re.I)
AUTHOR = frozenset("author byline commenter user username vcard fn nickname avatar poster".split())
DATED = frozenset("date time timestamp datetime published ago when posted".split())
SAYS = re.compile(r"^\W*\S+(?: \S+){0,3} (?:says|said|wrote|replied|schreibt|sagt|dit|dice)\b", re.I)
DATE = re.compile(r"\b\d{4}-\d\d?-\d\d?\b|\b\d\d?[./]\d\d?[./](?:\d\d){1,2}\b|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|\b(?:[A-Z][a-z]{2,8} \d\d?,? \d{4}|\d\d? [A-Z][a-z]{2,8} \d{4})\b")
COPYRIGHT = re.compile(r"(?:\u00a9|\(c\)|copyright\b).{0,160}|.{0,80}\ball rights reserved\W*", re.I)
COMMENTS = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:reader|user|recent|latest|all)\s+)?(?:comments?|replies|responses|kommentare?|comentarios?|commentaires?)\W*\d*\W*"
    r"|\W*(?:leave|post|add) a (?:comment|reply)\W*",
    re.I,
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[^a-z0-9]+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url) if isinstance(url, str) else None
    return m[1].lower() if m else ""


@dataclass
class Node:
    tag: str
    parent: int
    main: bool
    why: int
    names: tuple[str, ...] = ()
    drop: bool = False
    content: list = field(default_factory=list)  # text, or the index of a child
    digest: int = 0


#: Why an element may be unwanted: for its tag or because it is hidden; for a class, id or role; for a part of one.
TAG, NAME, PART = 3, 2, 1


def _unwanted(tag: str, attrs: str, in_main: bool) -> int:
    if tag in DROP or (tag in DROP_OUTSIDE and not in_main):
        return TAG
    if not attrs or tag in ("html", "body"):
        return 0
    why = 0
    main = tag in ("article", "main")
    heading, prose = tag in ("h1", *HEADINGS), in_main and tag in PROSE and tag not in LISTS
    marks = STRONG if prose else MARKS if in_main else MARKS | OUTSIDE_MARKS
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            if heading or (name == "id" and (main or prose)):
                continue  # ids of headings and prose are made from their words
            for whole in value.split():
                words = set(_WORDS.split(whole))
                if whole in marks:
                    why = max(why, NAME)
                elif words & marks and not words & STATES and not main and not prose:
                    why = max(why, PART)
        elif name.startswith("data-ad") and name[7:8] in ("", "-", "s"):
            why = max(why, NAME)
        elif name == "hidden" or (name == "aria-hidden" and value == "true" and not in_main):
            return TAG
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return TAG
    return why


def _names(attrs: str) -> tuple[str, ...]:
    """Classes in order, without numbers: part of an element's shape."""
    m = re.search(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", attrs, re.I) if attrs else None
    return tuple(w for w in re.sub(r"\d+", "", (m[1] or m[2] or m[3] or "").lower()).split()) if m else ()


def drop_unwanted(nodes: list[Node]) -> None:
    """Mark what goes by its own account; a class name alone does not take the page's main text.

    That is most of the text in ``<article>`` and ``<main>``, or of all text where there are
    none; a mere part of a name does not take most of all text either.
    """
    wraps = set()  # a form or header around an article is its frame
    for i, x in enumerate(nodes):
        if x.tag in ("article", "main"):
            up = x.parent
            while up > 0 and up not in wraps:
                wraps.add(up)
                up = nodes[up].parent
    for i in wraps:
        if nodes[i].tag in ("form", "header", "fieldset", "label") and nodes[i].why == TAG:
            nodes[i].why = 0
    gone = [False] * len(nodes)
    size, inner = [0] * len(nodes), [0] * len(nodes)  # text in an element, and what of it is in article or main
    some = False
    for i, x in enumerate(nodes):
        gone[i] = x.why == TAG or (i > 0 and gone[x.parent])
        some |= x.main and not gone[i]
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if gone[i]:
            continue
        own = sum(len("".join(c.split())) for c in x.content if isinstance(c, str))
        size[i] += own
        inner[i] += own if x.main else 0
        if i:
            size[x.parent] += size[i]
            inner[x.parent] += inner[i]
    for i, x in enumerate(nodes):
        most = 2 * size[i] > size[0]
        holds = 2 * inner[i] > inner[0] if some else most
        named = (x.why == NAME and not holds) or (x.why == PART and not holds and not most)
        x.drop = x.drop or gone[i] or named or (i > 0 and nodes[x.parent].drop)


def drop_comments(nodes: list[Node]) -> None:
    """Mark reader comments: lists of entries that have an author and a date, and sections under a heading over comments.

    A heading that only says "Comments" or "Responses" may be one of the article's own; it
    counts if comments follow it at once, as a list or as entries.
    """
    entries = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        kids = [c for c in x.content if isinstance(c, int)]
        if len(kids) >= 2 and x.tag in BLOCK and x.tag not in ("table", "tr", "tbody", "p", "article", "main", "body", "html"):
            like = sum(_is_entry(nodes, c) for c in kids)
            entries[i] = like >= 2 and 5 * like >= 4 * len(kids)
    for i, x in enumerate(nodes):
        if entries[i]:
            x.drop = True
    for x in nodes:
        rank = ""
        kids = [c for c in x.content if isinstance(c, int)]
        for k, c in enumerate(kids):
            y = nodes[c]
            if rank and y.tag in ("h1", *HEADINGS) and y.tag <= rank:
                rank = ""
            if y.tag in HEADINGS and not rank:
                said = " ".join(_inner(nodes, c, 80).split())
                if COMMENTS.fullmatch(said) and (ASKS.search(said) or (k + 1 < len(kids) and _starts_comments(nodes, kids[k + 1], entries))):
                    rank = y.tag
            y.drop |= bool(rank)


def _starts_comments(nodes: list[Node], c: int, entries: list[bool]) -> bool:
    return nodes[c].tag in LISTS or entries[c] or _is_entry(nodes, c) or any(isinstance(k, int) and (entries[k] or _is_entry(nodes, k)) for k in nodes[c].content)


def _is_entry(nodes: list[Node], i: int) -> bool:
    """Whether an element is a comment: it has an author and a date among its first elements or words."""
    if nodes[i].tag not in BLOCK or nodes[i].tag == "p":
        return False
    author = date = False
    head, todo, seen = "", [i], 0
    while todo and seen < 24 and len(head) < 160:
        c = todo.pop()
        if isinstance(c, str):
            head += c
            continue
        seen += 1
        y, words = nodes[c], {w for n in nodes[c].names for w in _WORDS.split(n)}
        author |= y.tag == "cite" or bool(words & AUTHOR)
        date |= y.tag == "time" or bool(words & DATED)
        todo += reversed(y.content)
    head = " ".join(head.split())[:160]
    return (author or bool(SAYS.search(head))) and (date or bool(DATE.search(head)) or bool(SAYS.search(head)))


def _inner(nodes: list[Node], i: int, most: int) -> str:
    """Text of a small element; an empty one where it is longer."""
    out, todo = "", [i]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out += c
        else:
            todo += reversed(nodes[c].content)
        if len(out) + len(todo) > most:
            return ""
    return out


def parse(page: str) -> list[Node]:
    """Elements in page order; node 0 is the root. Unclosed and misnested markup is mended."""
    nodes = [Node("", -1, False, 0)]
    stack = [0]
    open_tags: Counter = Counter()
    at, n = 0, len(page)

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = nodes[stack.pop()]
            open_tags[node.tag] -= 1
            h = xxhash.xxh64(node.tag)
            for c in node.content:
                if isinstance(c, int):
                    h.update(nodes[c].digest.to_bytes(8, "little"))
                else:
                    h.update(" ".join(c.split()).encode("utf-8", "surrogatepass"))
                    h.update(b"\0")
            node.digest = h.intdigest()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        m = _TOKEN.match(page, lt) if lt < n else None
        while lt < n and m is None:  # a lone "<" is text
            lt = page.find("<", lt + 1)
            lt = n if lt < 0 else lt
            m = _TOKEN.match(page, lt) if lt < n else None
        if lt > at:
            nodes[stack[-1]].content.append(_html.unescape(page[at:lt]))
        if m is None:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            k = len(stack) - 1
            while open_tags[tag] > 0 and nodes[stack[k]].tag != tag:
                k -= 1
            if open_tags[tag] > 0:
                close(k)
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        if not page.endswith(">", 0, at):
            break  # cut off inside a tag
        if (tag in CLOSES_P and open_tags["p"] > 0) or (tag in ("li", "dd", "dt", "tr", "td", "th", "option") and open_tags[tag] > 0):
            for k in range(len(stack) - 1, 0, -1):
                open_ = nodes[stack[k]].tag
                if (open_ == "p" and tag in CLOSES_P) or (open_ == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
                    close(k)
                    break
                if open_ in BLOCK:
                    break
        up = nodes[stack[-1]]
        attrs = m[3] or ""
        main = up.main or tag in ("article", "main") or ("main" in attrs and bool(re.search(r"role\s*=\s*[\"']?main", attrs)))
        nodes.append(Node(tag, stack[-1], main, _unwanted(tag, attrs, up.main), _names(attrs)))
        up.content.append(len(nodes) - 1)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
    close(0)
    drop_comments(nodes)
    drop_unwanted(nodes)
    drop_trimmings(nodes)
    return nodes


def _measured(nodes: list[Node]) -> tuple[list[int], list[int], list[int]]:
    """Of each element the text that stays, how much of it is in links, and how much is in an article."""
    size, links, inner = ([0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.drop:
            size[i] = links[i] = inner[i] = 0
            continue
        own = sum(len("".join(c.split())) for c in x.content if isinstance(c, str))
        size[i] += own
        inner[i] += own if x.main else 0
        links[i] = size[i] if x.tag == "a" else links[i]
        if i:
            size[x.parent] += size[i]
            links[x.parent] += links[i]
            inner[x.parent] += inner[i]
    return size, links, inner


def drop_trimmings(nodes: list[Node]) -> None:
    """Outside an article that holds most of the text, mark what is nothing but links, and copyright lines."""
    size, links, inner = _measured(nodes)
    if 2 * inner[0] <= size[0]:
        return
    for i, x in enumerate(nodes[1:], 1):
        if x.drop or nodes[x.parent].drop:
            x.drop = True
        elif not x.main and not inner[i] and size[i] and (x.tag in BLOCK or x.tag == "a"):
            x.drop = links[i] == size[i] or (size[i] <= 200 and bool(COPYRIGHT.fullmatch(" ".join(_inner(nodes, i, 400).split()))))


def shapes(nodes: list[Node]) -> list[int]:
    """Of each element whose shape may tell that it is template, the hash of that; 0 for others."""
    size, links, inner = _measured(nodes)
    framed = 2 * inner[0] > size[0]
    out, digest = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        h = xxhash.xxh64(" ".join(("shape", x.tag, *x.names)))
        kids = [digest[c] if isinstance(c, int) else 1 for c in x.content if not isinstance(c, str) or c.strip()]
        for k, d in enumerate(kids):
            if not k or d != kids[k - 1]:  # so many alike
                h.update(d.to_bytes(8, "little"))
        digest[i] = h.intdigest()
        if size[i] and not inner[i] and ((framed and not x.main) or 2 * links[i] > size[i]):
            out[i] = digest[i]
    return out


def removable(x: Node) -> bool:
    """Blocks that may be template: those with content, but the outermost frame."""
    return x.tag in BLOCK and bool(x.content) and x.tag not in ("html", "body", "head", "article", "main")


@dataclass
class Block:
    """A block of text, the hashes of the removable elements it lies in (prose of an article apart), and whether it is in one."""

    text: str
    cut: list[int]
    prose: list[int]
    main: bool


def text_blocks(nodes: list[Node]) -> list[Block]:
    """Blocks in page order, without what goes by its own account."""
    blocks: list[Block] = []
    pend: list[str] = []
    path: list[tuple[int, int, bool]] = []  # of the elements a block lies in: subtree, shape or 0, prose of an article
    shape = shapes(nodes)

    def flush(main: bool) -> None:
        text = " ".join("".join(pend).split())
        if text:
            cut = [x for h, s, prose in path if not prose for x in (h, s) if x]
            blocks.append(Block(text, cut, [h for h, _, prose in path if prose], main))
        pend.clear()

    todo: list = [(0, 0, False)]
    while todo:
        i, k, named = todo.pop()
        x = nodes[i]
        if k < len(x.content):
            todo.append((i, k + 1, named))
            c = x.content[k]
            if isinstance(c, str):
                pend.append(c)
                continue
            y = nodes[c]
            if y.tag in ("br", "td", "th", "img"):
                pend.append(" ")
            if y.tag in BLOCK:
                flush(x.main)
            if y.drop:
                continue
            counts = removable(y) and len(path) < DEEP
            if counts:
                path.append((_signed(y.digest), _signed(shape[c]), y.main and y.tag in PROSE))
            todo.append((c, 0, counts))
        else:
            if x.tag in BLOCK or i == 0:
                flush(x.main)
            if named:
                path.pop()
    flush(False)
    return blocks


def article_key(nodes: list[Node]) -> int:
    """Hash of the page's articles, or of all of it where there are none: copies of an article share it."""
    h = xxhash.xxh64()
    some = False
    for x in nodes[1:]:
        if x.main and not nodes[x.parent].main and not x.drop:
            h.update(x.digest.to_bytes(8, "little"))
            some = True
    return _signed(h.intdigest() if some else nodes[0].digest)


def main_text(nodes: list[Node]) -> str:
    """The text of a page whose host has no template: its blocks joined by an empty line."""
    return "\n\n".join(b.text for b in text_blocks(nodes))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_LONGS = pa.list_(pa.int64())
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("cut", _LONGS), ("prose", _LONGS), ("main", pa.bool_())]))
PAGES = "rid long, page_id long, url string, host string, article long, subtrees array<long>, blocks array<struct<text:string,cut:array<long>,prose:array<long>,main:boolean>>"


def _pages(batches):
    """Each page's host, article, blocks, and the hashes of all elements they lie in."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            hosts = [host_of(u) for u in part.column("url").to_pylist()]
            articles, subtrees, blocks = [], [], []
            for page in part.column("html").to_pylist():
                nodes = parse(page or "")
                found = text_blocks(nodes)
                articles.append(article_key(nodes))
                subtrees.append(sorted({h for b in found for h in (*b.cut, *b.prose)}))
                blocks.append([vars(b) for b in found])
            columns = [part.column("rid"), part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(subtrees, _LONGS), pa.array(blocks, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "page_id", "url", "host", "article", "subtrees", "blocks"])


def extract(
    spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Null or empty pages have an empty text.  Pages without a host share one unnamed host.
    Repeated rows are each returned; other columns are ignored.
    """
    scratch = Scratch(spark, "html")
    src = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = scratch.save(src.mapInArrow(_pages, PAGES), "pages")

    once = found.groupBy("host", "article").agg(F.first("subtrees").alias("subtrees"))
    sizes = once.groupBy("host").agg(F.count("*").alias("pages"))
    counts = once.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    template = scratch.save(counts.join(sizes, "host").filter(F.col("n") >= min_share * F.col("pages")).select("host", "subtree"), "template")
    if template.count() <= BROADCAST_BLOCKS:
        template = F.broadcast(template)
    hits = found.select("rid", "host", F.explode("subtrees").alias("subtree")).join(template, ["host", "subtree"])
    hits = scratch.save(hits.groupBy("rid").agg(F.collect_list("subtree").alias("hits")), "hits")
    if hits.count() <= BROADCAST_PAGES:
        hits = F.broadcast(hits)

    size = lambda blocks, keep: F.aggregate(F.filter(blocks, keep), F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    rest = F.when(F.col("hits").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(b["cut"], "hits")))
    out = found.join(hits, "rid", "left").select("page_id", "url", "hits", rest.alias("rest"))
    recurs = lambda b: F.arrays_overlap(b["prose"], "hits")
    added = 2 * size(F.col("rest"), lambda b: b["main"] & recurs(b)) < size(F.col("rest"), lambda b: b["main"])
    kept = F.when(F.col("hits").isNotNull() & added, F.filter("rest", lambda b: ~recurs(b))).otherwise(F.col("rest"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
