"""Main text of web pages by the templates of their hosts.

Tokens of a page are its tags by path and its text runs. Over the distinct pages of a host each
token has a vector of occurrence counts; tokens with one vector are an equivalence class. Large,
frequent classes whose tags (or texts, without tags) hang below one other class, besides those that hang
below themselves, are valid and, so nested, make up the host's template. What the template leaves over are slots; those of the article give the text.

Vectors are never held: sums of hashes of (page, count) tell them apart and add up in any
order, so a host with a third of all pages is one key of partial sums like any other.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices

#: A class is frequent from so many distinct pages and that share of its host's, and large from so many tokens.
FREQUENT, LARGE = 3, 3
TAG_SHARE, TEXT_SHARE = 0.2, 0.5
#: Without a named content element: the share of the slots' characters that the article's container holds.
HELD_SHARE = 0.7

# Elements and attributes of HTML.
RAW = "script style textarea title noscript template iframe xmp noembed noframes".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSE_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "thead": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "option": ("option", ("select",)), "optgroup": ("option optgroup", ("select",))}
P_BOUNDS = set("html table td th caption object button".split())
HEAD_TAGS = set("meta link base title style script noscript template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NO_TEXT = set("nav footer aside form button select dialog menu svg math canvas object audio video map head datalist".split())
CONTAINERS = set("div section body td center main root".split())
NO_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names whose elements hold no article text.
NO_WORDS = re.compile(r"(ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|aside|widgets?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|pagination|pager|skip|toolbar|search|copyright)\Z")
CONTENT_WORDS = re.compile(r"(articlebody|articlecontent|articletext|postcontent|postbody|entrycontent|entrybody|storybody|maincontent)\Z")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'>]+)""")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in RAW}
_NAME_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def spaced(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return " ".join(_html.unescape(text).split())


@dataclass
class Element:
    """One element; flags hold for all that lies in it."""

    tag: str
    parent: int
    path: int
    outside: bool = False  # in an element that never holds the article
    named_out: bool = False  # in one whose class or id says so
    content: int = -1  # the nearest named content element
    inner_out: bool = False  # left out within that
    head: bool = False  # in a header within that
    link: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element that holds the block, [(piece of text, its element)])
    blocks: list[tuple[int, list[tuple[str, int]]]] = field(default_factory=list)

    def text(self, block: int, keep=lambda e: True) -> str:
        return spaced("".join(t for t, e in self.blocks[block][1] if keep(self.elements[e])))


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c, bare in _ATTR.findall(raw):
        found.setdefault((name or bare).lower(), _html.unescape(a or b or c))
    return found


def _opened(page: Page, tag: str, raw: str, parent: int) -> Element:
    up = page.elements[parent]
    attrs = _attributes(raw) if raw.strip(" /") else {}
    names = [n for a in ("class", "id") for n in attrs.get(a, "").split()]
    words = [w.lower() for n in names for w in _NAME_WORDS.findall(n)]
    joined = ["".join(_NAME_WORDS.findall(n)).lower() for n in names]
    role = attrs.get("role", "").lower()
    label = " ".join([tag, *sorted({w for n in names for w in [re.sub(r"\d+", "", n)]})])
    e = Element(tag, parent, _hash(up.path, label), up.outside, up.named_out, up.content, up.inner_out, up.head, up.link or tag == "a")
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None
    strong = tag in NO_TEXT or role in NO_ROLES or hidden
    named = tag not in ("html", "body", "main") and any(NO_WORDS.match(w) for w in words)
    content = (tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody" or any(CONTENT_WORDS.match(j) for j in joined)) and not strong and not named
    if tag == "header" or any(w in ("header", "masthead") for w in words) and tag not in ("html", "body", "article", "main"):
        if up.content >= 0:
            e.head = True
        else:
            e.outside |= tag == "header"
            e.named_out |= tag != "header"
    if tag in HEADINGS:
        e.head = False
    holder = page.elements[up.content] if up.content >= 0 else None
    if content and (holder is None or holder.tag == "main" and not e.inner_out):
        e.content, e.inner_out, e.head = len(page.elements), False, False
    else:  # an article in an article is a reader's
        e.inner_out |= strong or named or tag == "article" and holder is not None
    e.outside |= strong
    e.named_out |= named
    return e


def parse(source: str) -> Page:
    """Elements in order of their start tags and blocks in page order, in one pass.

    Ends that HTML lets out are found; ends without a start, comments, scripts, styles and an
    unfinished tag at the end of the page are left out.
    """
    page = Page([Element("root", -1, _hash("root"))])
    stack, counts = [0], Counter()
    pieces: list[tuple[str, int]] = []

    def flush() -> None:
        nonlocal pieces
        if any(t and not t.isspace() for t, _ in pieces):
            holder = stack[-1]
            while page.elements[holder].tag in INLINE:
                holder = page.elements[holder].parent
            page.blocks.append((holder, pieces))
        pieces = []

    def pop() -> str:
        tag = page.elements[stack.pop()].tag
        counts[tag] -= 1
        return tag

    def close(tags: list[str], bounds) -> None:
        """Pop the innermost of these elements, if one is open inside the bounds, and what lies in it."""
        if not any(counts[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[depth]].tag
            if tag in tags:
                while len(stack) > depth:
                    pop()
                return
            if tag in bounds:
                return

    at, size = 0, source.rfind(">") + 1
    while at < len(source):
        m = _TAG.search(source, at, max(size, at))
        rest = source[at : m.start() if m else len(source)]
        if not m:
            cut = re.search(r"<(?:[a-zA-Z/!?])", rest[max(size - at, 0) :])
            rest = rest[: max(size - at, 0) + cut.start()] if cut else rest
        if rest:
            pieces.append((rest, stack[-1]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<!") or m[0].startswith("<?"):
                continue
            found = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", m[0])  # quotes that don't end
            end, name, raw = found[1], found[2], ""
        else:
            end, raw = m[1], m[3]
        tag = name.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            pieces.append((" ", stack[-1]))
        if end:
            if counts[tag]:
                if tag in INLINE:
                    depth = len(stack) - 1
                    while depth and page.elements[stack[depth]].tag in INLINE and page.elements[stack[depth]].tag != tag:
                        depth -= 1
                    if page.elements[stack[depth]].tag == tag:
                        while len(stack) > depth:
                            pop()
                else:
                    while pop() != tag:
                        pass
            continue
        if counts["head"] and tag not in HEAD_TAGS:
            close(["head"], ())
        if tag in CLOSE_P:
            close(["p"], P_BOUNDS)
        if tag in CLOSES:
            own, bounds = CLOSES[tag]
            for _ in range(3):
                close(own.split(), bounds)
        page.elements.append(_opened(page, tag, raw, stack[-1]))
        if tag in RAW:
            done = _RAW_END[tag].search(source, at)
            at = done.end() if done else len(source)
        elif tag not in VOID and not (raw.endswith("/") and tag in ("svg", "path")):
            stack.append(len(page.elements) - 1)
            counts[tag] += 1
    flush()
    return page


def page_key(page: Page) -> int:
    """Names a page by its longest text run, so that copies of an article are one page."""
    return _hash("key", max((page.text(b) for b in range(len(page.blocks))), key=lambda t: (len(t), t), default=""))


def text_token(path: int, text: str) -> int:
    return _hash("text", path, text)


def tokens(page: Page) -> dict[int, tuple[int, bool, int]]:
    """By token: (path of what holds it, is a text run, occurrences). The root's holder is 0."""
    out: dict[int, tuple[int, bool, int]] = {}
    for e in page.elements:
        holder = page.elements[e.parent].path if e.parent >= 0 else 0
        out[e.path] = (holder, False, out.get(e.path, (0, False, 0))[2] + 1)
    for b, (holder, _) in enumerate(page.blocks):
        path = page.elements[holder].path
        t = text_token(path, page.text(b))
        out[t] = (path, True, out.get(t, (0, True, 0))[2] + 1)
    return out


def main_text(page: Page, template: set[int]) -> str:
    """The article's blocks, two line ends between them.

    A named content element (article, or else main or such) holds the article whole, but for parts that
    a tag, role or name marks as none, and articles in articles; what the host's template repeats in it
    stays, for articles may quote what others quote. Without one, template texts go and the article's container is the
    innermost that the template knows (any, if it knows none) with HELD_SHARE of what is left, links apart;
    headings of the first level before it stay.
    """
    e = page.elements
    for weak in (False, True):
        mains = {e[h].content for h, _ in page.blocks if e[h].content >= 0}
        mains = {m for m in mains if not e[m].outside and (weak or not e[m].named_out)}
        mains = {m for m in mains if e[m].tag != "main"} or mains
        if mains:
            inside, first = _inside(e, mains), min(mains)
            parts = [page.text(b, lambda x: not x.inner_out and not x.head) for b, (h, _) in enumerate(page.blocks) if inside[h] or e[h].tag == "h1" and h < first and e[h].content >= 0]
            return "\n\n".join(p for p in parts if p)
    fits = lambda x: not x.outside and not x.named_out
    left = [(h, page.text(b, fits), b) for b, (h, _) in enumerate(page.blocks)]
    left = [(h, t, b) for h, t, b in left if t and text_token(e[h].path, page.text(b)) not in template]
    sums = [0] * len(e)
    for h, _, b in left:
        sums[h] += sum(len(t) for t, x in page.blocks[b][1] if not e[x].link and fits(e[x]))
    for i in range(len(e) - 1, 0, -1):
        sums[e[i].parent] += sums[i]
    known = [i for i, x in enumerate(e) if x.tag in CONTAINERS and (x.path in template or not template)]
    main = max((i for i in known if sums[i] >= HELD_SHARE * sums[0]), default=0)
    inside = _inside(e, {main})
    return "\n\n".join(t for h, t, _ in left if inside[h] or e[h].tag == "h1" and h < main)


def _inside(e: list[Element], mains: set[int]) -> list[bool]:
    """Whether each element is one of these or lies in one."""
    out: list[bool] = []
    for i, x in enumerate(e):
        out.append(i in mains or x.parent >= 0 and out[x.parent])
    return out


def host_of(url: str = "url") -> Column:
    """The lower-cased host of an address; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, holder, is_text, pages, s1, s2): each token's vector over the host's distinct pages, as sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                rows: dict[tuple, int] = {}
                for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    page = parse(source or "")
                    key = page_key(page)
                    for token, (holder, is_text, n) in tokens(page).items():
                        at = (host, key, token, holder, is_text)
                        rows[at] = max(rows.get(at, 0), n)
                columns = [*(list(c) for c in zip(*rows, strict=True)), list(rows.values())] if rows else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["host", "page", "token", "holder", "is_text", "n"])

    found = pages.select(host_of().alias("host"), "html").mapInArrow(run, "host string, page long, token long, holder long, is_text boolean, n long")
    once = found.groupBy("host", "page", "token", "holder", "is_text").agg(F.max("n").alias("n"))
    mark = F.xxhash64("page", "n")
    return once.groupBy("host", "token", "holder", "is_text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(mark.bitwiseAND(0x7FFFFFFF)).alias("s1"), F.sum(F.shiftrightunsigned(mark, 33)).alias("s2")
    )


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, holder, is_text, pages, s1, s2, size, above): tokens of the valid classes.

    A class is (pages, s1, s2) of a host; ``above`` is the class that holds it, as an array of those. Two
    classes may hold parts of each other (a part of the frame inside one of many like elements).
    """
    vector = F.array("pages", "s1", "s2")
    found = materialize(occurrences(pages), "occurrences")
    hosts = found.where("holder = 0 and not is_text").select("host", F.col("pages").alias("all"))
    share = F.when(F.col("is_text"), TEXT_SHARE).otherwise(TAG_SHARE)
    often = found.join(hosts, "host").where((F.col("pages") >= F.least(F.lit(FREQUENT), F.col("all"))) & (F.col("pages") >= share * F.col("all")) & (~F.col("is_text") | (F.col("all") >= FREQUENT)))
    often = materialize(often.withColumn("class", vector).drop("all"), "frequent")
    holders = often.where("not is_text").select("host", F.col("token").alias("holder"), F.col("class").alias("above"))
    sizes = often.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"), F.bool_and("is_text").alias("texts"))
    placed = often.join(sizes, ["host", "class"]).join(holders, ["host", "holder"], "left").where(~F.col("is_text") | F.col("texts"))
    edges = placed.select("host", "class", "size", F.coalesce("above", F.array(F.lit(-1).cast("long"))).alias("above")).where(F.col("above") != F.col("class")).distinct()
    back = edges.select("host", F.col("above").alias("class"), F.col("class").alias("above"), F.lit(1).alias("back"))
    outer = edges.join(back, ["host", "class", "above"], "left").groupBy("host", "class", "size").agg(F.count_if(F.col("back").isNull()).alias("outer"), F.min_by("above", F.struct("back", "above")).alias("above"))
    valid = outer.where(F.col("outer") <= 1).drop("outer")
    return often.join(valid, ["host", "class"]).where(~F.col("is_text") | (F.col("size") >= LARGE)).select("host", "token", "holder", "is_text", "pages", "s1", "s2", "size", "above")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of a host's template.

    Their number is bounded by the shares: at most 1 / TAG_SHARE times the tags, and 1 / TEXT_SHARE times the
    text runs, of the host's average page.
    """
    return classes(pages).groupBy("host").agg(F.collect_set("token").alias("template"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, or one without article text, gives an empty text. Pages without a host share one.
    Repeated rows each give their row, ids and addresses may be null, other columns are not read.
    """
    own = materialize(templates(pages), "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 4_000_000):
                known: dict[str, set[int]] = {}
                texts = []
                for host, source, template in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                    if host not in known:
                        known[host] = set(template.as_py() or ())
                    texts.append(main_text(parse(source or ""), known[host]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    asked = pages.select("page_id", "url", "html", host_of().alias("host")).join(own, "host", "left").select("page_id", "url", "html", "host", "template")
    return asked.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
