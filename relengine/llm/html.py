"""Main text of web pages by consensus host paths: score containers, vote per host, extract again by the winners."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from .common import Scratch

TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<=]*)([^>"'<]*(?:"[^"<>]*"[^>"'<]*)*)>""")  # no sign in a value can be mistaken
DELIMITER = re.compile(r"""[>"']""")
TELLING = re.compile("class|id|role|hidden", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
#: Fixed values of HTML: elements without content, with raw text, and those that stand as blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes open elements of these names, up to the nearest of those after the bar.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
CLOSE_P = BLOCK - {"br", "body", "html", "head", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"}
#: Elements whose text is never the article's, and words of class, id and role that mark such parts.
NEVER = frozenset("script style noscript template iframe nav aside footer button select textarea input option label svg canvas object menu dialog title head fieldset".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|masthead|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|comment\w*|replies|reply|disqus|discussion|widget|toolbar|pagination|pager|search\w*|copyright|skip)(?:$|[\s_-])", re.I
)
#: Of these, words that hardly ever name a page's layout; class words like has-sidebar and no-sidebar tell of the layout only and mark nothing.
PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|breadcrumbs?|footer|cookie\w*|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|"
    r"comment\w*|replies|reply|disqus|discussion|pagination|pager|copyright|skip)(?:$|[\s_-])", re.I
)
LAYOUT = re.compile(r"(?:^|\s)(?:has|no|not|with|without|hide)[_-]\S*", re.I)
#: Within an article, a name marks a part only if the rest of it tells of nothing, as in share-buttons but not in share-price ...
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content count feed form foot footer group head header holder icon icons inner item items left link links "
    "list main media message module more outer page panel post posts reader region right row section site slot stories text thread title tool tools top unit user widget wrap wrapper".split()
)
#: ... and a paragraph is only marked by names that no text of an article has.
NEVER_TEXT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|newsletter|subscri\w*|signup|copyright)(?:$|[\s_-])", re.I)
#: Elements that may stand in a head; any other start tag, and text, ends an open one.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


def _rules() -> tuple[list[tuple[frozenset, frozenset, bool]], dict[str, int]]:
    """What start tags close: (names, names that end the search, whether all or the nearest), and the place of each tag's rule."""
    rules: list[tuple[frozenset, frozenset, bool]] = []
    of = {}
    for name in (*CLOSES, *sorted(CLOSE_P - CLOSES.keys())):
        shut, within = CLOSES.get(name, ((), ("button", "table", "td", "th", "object")))
        rule = (frozenset((*shut, "p") if name in CLOSE_P else shut), frozenset(within), name in CLOSES)
        if rule not in rules:
            rules.append(rule)
        of[name] = rules.index(rule)
    return rules, of


RULES, RULE_OF = _rules()
TOUCHED = frozenset().union(*(shut | within for shut, within, _ in RULES))


class Element:
    """An open or closed element: what is known of it by its own tag and its ancestors', so that nobody climbs."""

    __slots__ = ("article", "block", "chars", "depth", "heading", "lifted", "link", "mark", "name", "off", "order", "part", "path", "scopes", "up")

    def __init__(self, name: str, path: str, up: Element | None, order: int, off: bool, marked: bool = False, part: bool = False):
        self.name, self.path, self.up, self.order, self.off, self.chars = name, path, up, order, off, 0
        self.part, self.lifted = part, False
        if up is None:
            self.depth, self.article, self.mark, self.link, self.heading, self.block, self.scopes = 0, None, None, False, False, self, (0,) * len(RULES)
            return
        inline = name not in BLOCK
        self.depth = up.depth + 1
        self.article = self if name in ("article", "main") else up.article
        self.mark = self if marked else up.mark  # the nearest marked element
        self.link = name == "a" or inline and up.link  # inside a link, or an h1, with no block between
        self.heading = name == "h1" or inline and up.heading
        self.block = up.block if inline else self

    def opened(self, place: int) -> None:
        """Note, for each of RULES, the place on the stack of what such a tag would close; 0 is nothing."""
        held = self.up.scopes
        if self.name in TOUCHED:
            held = tuple(
                0 if self.name in within else x if self.name not in shut or every and x else place
                for x, (shut, within, every) in zip(held, RULES)
            )
        self.scopes = held


def step(name: str, attributes: dict[str, str]) -> str:
    """An element's part of a generalised path: its tag and classes, numbers made one."""
    if "class" not in attributes:
        return name
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
    return ".".join([name, *classes])


def below(path: str, part: str) -> str:
    """A generalised path is the digest of its parent's and its own step, so that deep ones aren't longer."""
    return xxh3_128_hexdigest(f"{path}>{part}".encode("utf-8", "surrogatepass"))


def path_of(steps: str) -> str:
    """The path of steps from the outermost on, as ``html>body>div.post``."""
    path = ""
    for part in steps.split(">"):
        path = below(path, part)
    return path


class Tags:
    """Comments, declarations and tags of a page, from left to right; each character is read a fixed number of times."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def end(self, at: int) -> int:
        """The ``>`` that ends a tag whose name ends at ``at``; those in quoted values don't.  -1: there is none.

        Where a quote is never closed, quotes mean nothing from there on.
        """
        html, i = self.html, at
        while self.quotes:
            m = DELIMITER.search(html, i)
            if m is not None and m[0] == ">":
                return m.start()
            if m is not None:
                before = m.start() - 1
                while before > at and html[before].isspace():
                    before -= 1
                i = m.end()
                if html[before] == "=":
                    i = html.find(m[0], i) + 1
            if m is None or not i:
                self.quotes = False
        return html.find(">", at)

    def next(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next one from ``pos``; comments and declarations have no name."""
        html = self.html
        while (m := TAG.search(html, pos)) is not None:
            start = m.start()
            if m[0] == "<!--":
                end = html.find("-->", start + 2)
                return start, len(html) if end < 0 else end + 3, "", False, ""
            if start > self.last:
                return None
            if m[0] in ("<!", "<?"):
                return start, html.find(">", start) + 1, "", False, ""
            if (plain := PLAIN_TAG.match(html, start)) is not None:
                return start, plain.end(), plain[2].lower(), bool(plain[1]), plain[3]
            name = NAME.match(html, m.end() - 1)
            end = self.end(name.end())
            if end < 0:
                return None
            return start, end + 1, name[0].lower(), m[0][1] == "/", html[name.end() : end]
        return None


def is_marked(name: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether class, id or role mark an element as boilerplate, and whether as a part that may hold articles of its own."""
    words = LAYOUT.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    part = bool(PARTS.search(words))
    if name in ("body", "html", "main", "article"):
        return False, part
    if attributes.get("role", "").lower() in ROLES:
        return True, part
    if not MARKS.search(words):
        return False, part
    if not in_article:
        return True, part
    if name == "p":
        return bool(NEVER_TEXT.search(words)), part
    for word in words.split():
        if MARKS.search(word):
            rest = [x for x in re.split(r"[\W_\d]+", word.lower()) if len(x) > 1 and x not in PLAIN_WORDS and not MARKS.search(x)]
            if not rest:
                return True, part
    return False, part


def parsed(html: str) -> list[list[tuple[Element, str]]]:
    """The decoded text nodes of each block in page order, with the elements they stand in; not those of NEVER and hidden elements."""
    root = Element("", "", None, 0, False)
    stack, opened, made = [root], Counter(), 0
    found: list[list[tuple[Element, str]]] = [[]]
    tags, pos, n = Tags(html), 0, len(html)

    def shut(place: int) -> None:
        for e in stack[place:]:
            opened[e.name] -= 1
        del stack[place:]

    def text(raw: str) -> None:
        if stack[-1].name == "head" and not raw.isspace():
            shut(len(stack) - 1)
        if not stack[-1].off:
            found[-1].append((stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def ends() -> None:
        if found[-1]:
            found.append([])

    while pos < n:
        tag = tags.next(pos)
        if tag is None:
            text(html[pos:])
            break
        start, end, name, closes, attrs = tag
        if start > pos:
            text(html[pos:start])
        pos = end
        if not name:
            continue
        if closes:
            if opened[name]:
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                shut(place)
            if name in BLOCK:
                ends()
            continue
        if name not in IN_HEAD and stack[-1].name == "head":
            shut(len(stack) - 1)
        if name in BLOCK:
            ends()
        if name in VOID:
            continue
        if name in RULE_OF and (place := stack[-1].scopes[RULE_OF[name]]):
            shut(place)
        up = stack[-1]
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)} if TELLING.search(attrs) else {}
        off = up.off or name in NEVER or (name == "header" and not up.article)
        marked, part = name == "form", False
        if attributes and not off:
            off = "hidden" in attributes or attributes.get("aria-hidden") == "true"
            by_name, part = is_marked(name, attributes, up.article is not None)
            marked = marked or by_name
        made += 1
        e = Element(name, below(up.path, step(name, attributes)) if name in BLOCK else up.path, up, made, off, marked, part)
        if attrs.endswith("/") and name not in BLOCK:
            continue
        e.opened(len(stack))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
            pos = close.end() if close else n
            continue
        stack.append(e)
        opened[name] += 1
    return found


def lift_marks(pieces: list[tuple[Element, str]]) -> None:
    """Lift the marks of elements that hold what the page is about, as of a wrapper whose class tells of a sidebar.

    Marks are judged from the outermost on; one is judged when those around it are lifted.
    An element's mark is lifted if it holds the page's main element; if it holds an article and no text of an article is
    unmarked; if it holds two thirds of the page's text outside links, or the most while none is unmarked.  Marks of PARTS, which may
    hold comments or teasers, need an article or h1 within, more text than is unmarked, and no unmarked article.
    """
    marks: dict[Element, list] = {}  # characters outside links and in them, and whether a main element is there, of all below
    whole = free = linked = 0
    free_article = False
    direct: dict[Element, list] = {}  # the same, and whether an article and an h1 are there, of what has no other mark between
    for e, t in pieces:
        size = len(t.strip())
        if not size:
            continue
        home = e.article if e.article is not None and (e.article.name == "main" or not e.article.part) else None
        whole += 0 if e.link else size
        if e.mark is None:
            linked, free = linked + size * e.link, free + size * (not e.link)
            free_article = free_article or home is not None and not e.link
            continue
        m, d = e.mark, direct.setdefault(e.mark, [0, 0, False, False, False])
        d[0], d[1] = d[0] + size * (not e.link), d[1] + size * e.link
        if not e.link:
            inside = home is not None and home.depth > m.depth
            d[2] = d[2] or inside and home.name == "main"
            d[3], d[4] = d[3] or inside, d[4] or e.heading
    parents: dict[Element, list[Element]] = {}
    for m in sorted(direct, key=lambda m: m.order):  # with the marked elements around them
        while m is not None and m not in marks:
            marks[m] = [0, 0, False]
            m = m.up.mark
    for m in sorted(marks, key=lambda m: -m.order):
        d = direct.get(m, (0, 0, False, False, False))
        sums = marks[m]
        sums[0], sums[1], sums[2] = sums[0] + d[0], sums[1] + d[1], sums[2] or d[2]
        if (above := m.up.mark) is not None:
            up = marks[above]
            up[0], up[1] = up[0] + sums[0], up[1] + sums[1]
            up[2] = up[2] or sums[2]
            parents.setdefault(above, []).append(m)
    front = [m for m in marks if m.up.mark is None]
    while front:
        most = max(marks[m][0] for m in front)
        now = [m for m in front if to_lift(m, marks[m], direct.get(m), whole, free, linked, free_article, most)]
        for m in now:
            m.lifted = True
            d = direct.get(m, (0, 0, False, False, False))
            free, linked = free + d[0], linked + d[1]
            free_article = free_article or d[3]
        front = [x for m in now for x in parents.get(m, ())]


def to_lift(m: Element, sums: list, own: list | None, whole: int, free: int, linked: int, free_article: bool, most: int) -> bool:
    chars, _, main = sums
    home, title = (own[3], own[4]) if own else (False, False)
    if m.part:
        return main or (home or title) and chars > free and not free_article
    return bool(main or home and not free_article or chars > linked and (3 * chars >= 2 * whole or not free and chars == most))


def page_blocks(html: str) -> list[tuple[Element, str, int]]:
    """(block element, text, score) of each block that isn't boilerplate by its own marks.

    The score is the number of characters outside links; none if most are in links, all of an h1."""
    every = parsed(html)
    pieces = [x for held in every for x in held]
    if any(e.mark is not None for e, _ in pieces):
        lift_marks(pieces)
    switched: dict[Element, bool] = {}  # marked elements: whether one that isn't lifted is here or above
    for m in sorted({m for e, _ in pieces for m in [e.mark] if m is not None}, key=lambda m: m.order):
        chain = []
        while m is not None and m not in switched:
            chain.append(m)
            m = m.up.mark
        for x in reversed(chain):
            switched[x] = not x.lifted or x.up.mark is not None and switched[x.up.mark]
    found = []
    for held in every:
        kept = [(e, t) for e, t in held if e.mark is None or not switched[e.mark]]
        text = " ".join("".join(t for _, t in kept).split())
        if not text:
            continue
        whole = sum(len(t) for _, t in kept)
        e = kept[0][0].block
        linked = 0 if e.name == "h1" else sum(len(t) for e, t in kept if e.link)  # titles often link to their page
        found.append((e, text, 0 if 2 * linked > whole else max(1, len(text) * (whole - linked) // whole)))
    return found


CONTAINERS = frozenset("article main section div td body blockquote center dd html".split())


def ancestry(found: list[tuple[Element, str, int]]) -> list[Element]:
    """The blocks' elements and all above them, outermost first."""
    seen: dict[int, Element] = {}
    for e, _, _ in found:
        while e is not None and e.order not in seen:
            seen[e.order] = e
            e = e.up
    return [seen[i] for i in sorted(seen)]


def best_path(found: list[tuple[Element, str, int]]) -> tuple[str, int] | None:
    """The generalised path of the deepest container that holds all that scores on the page, and its score."""
    above = ancestry(found)
    for e in above:
        e.chars = 0
    for e, _, n in found:
        e.chars += n
    for e in reversed(above):
        if e.up is not None:
            e.up.chars += e.chars
    total = sum(n for _, _, n in found)
    best = next((e for e in reversed(above) if total and e.chars == total and e.name in CONTAINERS), None)
    return None if best is None else (best.path, total)


def within(found: list[tuple[Element, str, int]], path: str) -> list[bool]:
    """Whether each block is inside a container of that path."""
    inside: dict[int, bool] = {}
    for e in ancestry(found):
        inside[e.order] = e.path == path and e.name in CONTAINERS or e.up is not None and inside[e.up.order]
    return [inside[e.order] for e, _, _ in found]


def article(found: list[tuple[Element, str, int]], winners: list[tuple[str, bool]]) -> str:
    """Text of the page's container by the winning paths (path, whether most of the host's pages voted for it).

    The first path counts that holds all that scores on the page; or, if most pages voted for it, at least half of that, with no title (h1)
    outside.  Else it is the page's own best container, else all blocks.
    """
    total = sum(n for _, _, n in found)
    for path, by_most in winners if total else ():
        chosen = within(found, path)
        score = sum(n for (_, _, n), c in zip(found, chosen) if c)
        titled = any(e.name == "h1" for (e, _, _), c in zip(found, chosen) if not c)
        if score == total or by_most and 2 * score >= total and not titled:
            return " ".join(t for (_, t, _), c in zip(found, chosen) if c)
    own = best_path(found)
    chosen = within(found, own[0]) if own else [True] * len(found)
    return " ".join(t for (_, t, _), c in zip(found, chosen) if c)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Main text of ``pages`` (page_id, url, html).

    Each page's containers are scored by the characters they hold outside links and outside parts that tag, class, id or role
    mark as menus, headers, footers, sidebars, notices, adverts, forms or comments; blocks of mostly links don't score.  The path of
    tags and classes, with numbers made one, of the smallest container that holds all that scores is the page's vote.  Votes are counted
    per host; paths that at least two pages and a twentieth of the host's voted for win, so a host has at most twenty, and each page is
    extracted again by the first of them that fits it (:func:`article`).  Pages without one are extracted by their own smallest
    container.  So, besides marked parts and blocks of links, what lies outside the container that most pages of a host agree on is left
    out; unmarked boilerplate within it stays.

    Returns a row per page: page_id, url, text, n_chars (code points).  Character references are decoded within each text node.  A null or
    empty html has an empty text; pages of null or unreadable url share one host; repeated rows count each; an empty table gives
    no rows; further columns are ignored.  Reading a page takes time in proportion to its length, however malformed it is.
    """
    scratch = Scratch(spark, "html")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    p = pages.select("page_id", "url", F.col("html").cast("string"), host.alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text in zip(b.column("host").to_pylist(), b.column("html")):
                if (best := best_path(page_blocks(text.as_py() or ""))) is not None:
                    out.append((h, *best))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "path", "score"])

    votes = p.select("host", "html").mapInArrow(vote, "host string, path string, score long").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    votes = scratch.table(votes, "votes")
    everyone = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    won = votes.join(everyone, "host").where((F.col("votes") >= 2) & (F.col("votes") * 20 >= F.col("all")))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path", (F.col("votes") * 2 > F.col("all")).alias("by_most"))))
    winners = scratch.table(won.groupBy("host").agg(ranked.alias("w")).select("host", F.transform("w", lambda x: F.struct(x["path"].alias("path"), x["by_most"].alias("by_most"))).alias("paths")), "winners")
    p = p.join(winners, "host", "left").select("page_id", "url", "html", "paths")  # broadcast if Spark finds the winners small enough

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = ([(w["path"], w["by_most"]) for w in ws or []] for ws in b.column("paths").to_pylist())
            texts = [article(page_blocks(h), w) if (h := x.as_py()) else "" for x, w in zip(b.column("html"), paths)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(again, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
