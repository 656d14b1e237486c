"""Main text of web pages from flat text blocks.

A page becomes a list of text blocks, each with its word count, its link
density, and whether the markup around it names an article or page furniture.
A decision tree over these and the neighbours' counts, trained on the labelled
blocks below, picks the blocks that stay.  Splitting into blocks is Python in
Arrow batches; the tree becomes a Spark expression over the list.
"""

import bisect
import functools
import html as references
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SILENT = ("script style title noscript template svg iframe select textarea button object canvas math audio video "
          "datalist").split()
BREAKS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table "
    "tbody td tfoot th thead tr ul").split())
#: Elements that are tracked as surroundings of a block.
HOLDERS = BREAKS - frozenset("p tr hr h1 h2 h3 h4 h5 h6 body html head caption legend".split())
#: Elements that end where another of their kind begins, up to the list or table that holds them.
ITEMS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "table"), "th": ("td th", "table")}
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus "
    "nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus "
    "respond reply replies related recommended widget widgets toolbar pagination pager search copyright legal disclaimer "
    "feedback discussion discussions reactions testimonial testimonials trackback trackbacks pingback teaser teasers").split())
#: Of these, names that layouts of whole pages carry too, as in content-sidebar.
LAYOUT = frozenset("banner sidebar sidebars menu menus nav navbar navigation footer masthead topbar toolbar widget widgets modal overlay".split())
#: Words that add nothing to the one before, written apart or together with it.
FILLERS = frozenset((
    "list area box section sections wrap wrapper container inner outer body text item items block bar holder row col column panel "
    "link links info form thread title meta author avatar count unit slot zone group content main entry post posts").split())
#: Words for an element that holds all that its name lists, as in content-sidebar-wrap.
AROUND = frozenset("wrap wrapper container layout page".split())
PHRASES = frozenset((("site", "info"), ("tag", "cloud"), ("skip", "link"), ("back", "top")))
ARTICLE_NAMES = frozenset("article post entry content story main".split())
#: Words of a name that say what is absent or allowed for, as in no-comments or has-sidebar.
STATES = frozenset("no not non has have with without hide hides is".split())
#: Silent elements whose content is no markup, up to their end tag.
RAW = frozenset("script style title iframe textarea".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*>))*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S | re.I)
SILENT_TAG = re.compile(rf"<(/?)({'|'.join(SILENT)})(?=[\s/>])", re.I)
BREAK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BREAKS))})(?=[\s/>])", re.I)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CLOSED_ITSELF = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/\s*$")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Words of a wrapper that outweigh its mark.
MUCH = 120

BLOCK = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("words", "links", "main", "aside", "heading"))])
FEATURES = ("words", "links", "main", "aside", "heading", "words_before", "links_before", "words_after", "links_after")

#: Labelled blocks: the nine features, then 1 for main text.  Counts and
#: densities as they are met in articles, lists of links, notices and forms.
LABELLED: tuple[tuple[float, ...], ...] = (
    # inside an article: headings, paragraphs, one-word paragraphs, lists, quotes
    (6, 0, 1, 0, 1, 8, 0, 40, 0, 1), (1, 0, 1, 0, 1, 1, 1, 12, 0, 1), (14, 0, 1, 0, 1, 0, 0, 95, 0, 1), (9, 0, 1, 0, 1, 30, 0, 3, 0, 1),
    (55, 0, 1, 0, 0, 6, 0, 80, 0, 1), (120, .05, 1, 0, 0, 55, 0, 61, 0, 1), (1, 0, 1, 0, 0, 44, 0, 70, 0, 1), (2, 0, 1, 0, 0, 1, 0, 2, 0, 1),
    (3, 0, 1, 0, 0, 90, 0, 0, 0, 1), (22, .2, 1, 0, 0, 15, 0, 33, .1, 1), (5, 0, 1, 0, 0, 0, 0, 9, 0, 1), (300, .01, 1, 0, 0, 4, 0, 18, 0, 1),
    (8, .5, 1, 0, 0, 35, 0, 60, 0, 1), (4, 1, 1, 0, 0, 60, 0, 50, 0, 1), (12, 0, 1, 0, 0, 12, 0, 7, .3, 1), (1, 0, 1, 0, 0, 0, 0, 0, 0, 1),
    (17, 0, 1, 0, 0, 3, 1, 20, 0, 1), (41, .1, 1, 0, 0, 1, 1, 1, 1, 1), (70, 0, 1, 0, 0, 2, 0, 9, 0, 1), (33, 0, 1, 0, 0, 33, 0, 33, 0, 1),
    # page furniture: menus, adverts, notices, forms, footers, sidebars, comments
    (1, 1, 0, 1, 0, 0, 0, 1, 1, 0), (1, 1, 0, 1, 0, 1, 1, 1, 1, 0), (2, 1, 0, 1, 0, 1, 1, 8, 0, 0), (8, 0, 0, 1, 0, 1, 1, 6, 0, 0),
    (30, 0, 0, 1, 0, 2, 1, 11, 0, 0), (12, .4, 0, 1, 0, 45, 0, 0, 0, 0), (7, 0, 0, 1, 0, 80, 0, 0, 0, 0), (60, 0, 0, 1, 0, 3, 0, 70, 0, 0),
    (45, .02, 1, 1, 0, 100, 0, 20, 0, 0), (90, 0, 1, 1, 0, 5, 0, 60, 0, 0), (3, 0, 1, 1, 1, 50, 0, 25, 0, 0), (5, 1, 1, 1, 0, 40, 0, 4, 1, 0),
    (10, 0, 0, 1, 1, 70, 0, 30, .5, 0), (150, .1, 0, 1, 0, 20, 0, 10, 0, 0), (4, 0, 0, 1, 1, 0, 0, 3, 1, 0), (1, 0, 1, 1, 0, 90, 0, 2, 0, 0),
    (25, 0, 0, 1, 0, 25, 0, 25, 0, 0), (16, .9, 1, 1, 0, 66, 0, 40, 0, 0), (200, 0, 0, 1, 0, 1, 1, 2, 1, 0), (2, .5, 0, 1, 0, 12, 0, 0, 0, 0),
    # inside an article, short text before or between linked text
    (1, 0, 1, 0, 0, 2, 0, 1, 1, 1), (2, 0, 1, 0, 0, 30, 0, 4, 1, 1), (4, 0, 1, 0, 0, 0, 0, 6, 1, 1), (6, 0, 1, 0, 1, 0, 0, 3, 1, 1),
    (3, 0, 1, 0, 0, 5, 1, 5, 1, 1), (8, 0, 1, 0, 0, 40, 0, 2, .9, 1), (5, .2, 1, 0, 0, 3, .5, 7, .8, 1), (2, 0, 1, 0, 1, 1, 1, 1, 1, 1),
    (10, 0, 1, 0, 0, 4, 0, 9, 1, 1), (3, 1, 1, 0, 0, 4, 1, 5, 1, 1), (1, 1, 1, 0, 0, 1, 1, 0, 0, 1), (6, .9, 1, 0, 0, 2, 0, 3, .7, 1),
    (14, 0, 1, 0, 0, 60, 0, 24, 1, 1), (30, .3, 1, 0, 0, 90, .3, 5, 1, 1), (90, 0, 1, 0, 0, 400, 1, 60, 1, 1), (5, 1, 1, 0, 1, 90, .3, 1, 1, 1),
    # in a wrapper of doubtful mark: long unlinked text stays
    (40, 0, 0, .5, 0, 6, 0, 60, 0, 1), (80, .05, 0, .5, 0, 40, 0, 30, 0, 1), (25, 0, 0, .5, 0, 50, 0, 90, 0, 1), (150, .02, 0, .5, 0, 1, 1, 2, 1, 1),
    (35, 0, 1, .5, 0, 40, 0, 55, 0, 1), (60, .1, 1, .5, 0, 9, 0, 70, 0, 1), (210, 0, 1, .5, 0, 0, 0, 3, 1, 1), (20, 0, 0, .5, 0, 33, 0, 4, 0, 1),
    (6, 0, 0, .5, 0, 45, 0, 51, 0, 1), (3, 0, 0, .5, 1, 60, 0, 38, 0, 1), (7, 0, 0, .5, 1, 0, 0, 48, 0, 1), (9, 0, 0, .5, 0, 31, 0, 55, 0, 1),
    (2, 1, 0, .5, 0, 1, 1, 2, 1, 0), (4, 0, 0, .5, 0, 2, 1, 3, 1, 0), (30, .8, 0, .5, 0, 12, .6, 9, .8, 0), (5, 0, 0, .5, 0, 3, 0, 4, 0, 0),
    (1, 1, 1, .5, 0, 50, 0, 1, 1, 0), (3, 0, 1, .5, 0, 70, 0, 2, 1, 0), (2, 0, 1, .5, 0, 1, 1, 60, 0, 0), (45, .9, 0, .5, 0, 3, 1, 20, .8, 0),
    (12, 1, 0, .5, 0, 30, 0, 50, 0, 0), (3, .8, 0, .5, 0, 6, 1, 90, 0, 0), (8, 0, 1, .5, 0, 30, 0, 40, 0, 0), (6, 0, 1, .5, 1, 3, 1, 25, 0, 0),
    (12, .8, 1, .5, 0, 30, 0, 20, 0, 0), (40, 1, 1, .5, 0, 10, 1, 50, .2, 0), (60, .9, 1, .5, 0, 80, 0, 3, 1, 0), (24, 0, 1, .5, 0, 3, 1, 1, 1, 1),
    # neither: long plain text stays, short or linked text goes
    (40, 0, 0, 0, 0, 6, 0, 60, 0, 1), (75, .05, 0, 0, 0, 40, 0, 30, 0, 1), (28, .1, 0, 0, 0, 50, 0, 90, 0, 1), (110, 0, 0, 0, 0, 1, 1, 2, 1, 1),
    (20, 0, 0, 0, 0, 35, 0, 44, 0, 1), (52, .2, 0, 0, 0, 18, 0, 5, 0, 1), (33, 0, 0, 0, 0, 0, 0, 0, 0, 1), (18, 0, 0, 0, 0, 64, 0, 3, 0, 1),
    (7, 0, 0, 0, 0, 45, 0, 51, 0, 1), (3, 0, 0, 0, 0, 38, 0, 80, 0, 1), (5, 0, 0, 0, 1, 3, 1, 48, 0, 1), (8, 0, 0, 0, 1, 60, 0, 37, 0, 1),
    (2, 0, 0, 0, 0, 70, 0, 29, .1, 1), (9, 0, 0, 0, 0, 31, 0, 55, 0, 1), (6, 0, 0, 0, 1, 0, 0, 88, 0, 1), (12, 0, 0, 0, 0, 26, 0, 41, 0, 1),
    (3, 1, 0, 0, 0, 2, 1, 4, 1, 0), (1, 1, 0, 0, 0, 0, 0, 2, 1, 0), (5, .8, 0, 0, 0, 3, 1, 1, 1, 0), (30, .7, 0, 0, 0, 12, .6, 9, .8, 0),
    (4, 0, 0, 0, 0, 2, 1, 3, 1, 0), (6, 0, 0, 0, 0, 0, 0, 3, 1, 0), (7, 0, 0, 0, 0, 5, .4, 4, .9, 0), (2, 0, 0, 0, 0, 1, 1, 0, 0, 0),
    (45, .9, 0, 0, 0, 3, 1, 20, .8, 0), (8, .6, 0, 0, 0, 70, 0, 6, 1, 0), (3, 0, 0, 0, 1, 4, 1, 5, .9, 0), (2, 0, 0, 0, 1, 2, 0, 3, 1, 0),
    (5, 0, 0, 0, 0, 3, 0, 4, 0, 0), (4, 0, 0, 0, 0, 6, 0, 2, 0, 0), (9, .1, 0, 0, 0, 4, .5, 7, .5, 0), (1, 0, 0, 0, 0, 3, 0, 2, 0, 0),
    (5, .9, 0, 0, 0, 40, 0, 60, 0, 0), (1, 1, 0, 0, 0, 80, 0, 45, 0, 0), (30, .9, 0, 0, 0, 5, 1, 70, 0, 0), (60, 1, 0, 0, 0, 30, 0, 30, 0, 0),
)


def attributes(attrs: str) -> dict[str, str | None]:
    """Values by whole name, as written first; None for a bare name."""
    out: dict[str, str | None] = {}
    for m in ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), None))
    return out


@functools.lru_cache(1 << 14)
def compound(word: str) -> tuple[str, ...]:
    """A known word and a filler written as one, apart."""
    if word in FURNITURE_NAMES or word in ARTICLE_NAMES:
        return (word,)
    for k in range(len(word) - 1, 1, -1):
        if word[:k] in FURNITURE_NAMES and word[k:] in FILLERS:
            return word[:k], word[k:]
    return (word,)


def names(tag: str, attrs: str) -> tuple[float, bool, bool]:
    """Mark of page furniture (0 none, 0.5 doubtful, 1), article, hidden.

    A class or id counts by its words, fillers at its end left out: one that begins
    or ends in a word for reactions, adverts or notices is furniture, and so is one
    that ends in a word of layouts and names no article; one that only holds such a
    word is doubtful, one with a word of STATES says nothing.  Names of articles
    outweigh as many names of furniture."""
    got = attributes(attrs) if attrs else {}
    strong, weak, article = 0, 0, {"article": 1, "main": 2}.get(tag, 0)
    role = (got.get("role") or "").strip().lower()
    article += {"article": 1, "main": 2}.get(role, 0)
    header = False
    for name in f"{got.get('class') or ''} {got.get('id') or ''}".split():
        words = [w for x in NAME.findall(HUMP.sub("-", name).lower()) for w in compound(x)]
        if not words or STATES.intersection(words):
            continue
        core = list(words)
        while len(core) > 1 and core[-1] in FILLERS:
            core.pop()
        aside, main = FURNITURE_NAMES.intersection(words), bool(ARTICLE_NAMES.intersection(words))
        if aside & {core[0], core[-1]} - LAYOUT or tuple(words[:2]) in PHRASES:
            strong += 1
        elif main and aside:
            if core[0] in ARTICLE_NAMES and words[-1] in AROUND:
                article += 1
            else:
                weak += 1
        elif main:
            article += 1
        elif aside:
            strong, weak = (strong + 1, weak) if core[-1] in aside else (strong, weak + 1)
        elif "header" in words:
            header = True
    strong += header and not article
    if role in FURNITURE_ROLES or tag in FURNITURE_TAGS:
        mark = 1.0
    elif strong:
        mark = 1.0 if article < strong else 0.5 if article == strong else 0.0
    else:
        mark = 0.5 if weak and not article else 0.0
    hidden = "hidden" in got and (got["hidden"] or "").strip().lower() in ("", "hidden")
    return (1.0 if hidden else mark), bool(article) and mark == 0 and not hidden, hidden


class Silent:
    """Where the silent elements of a page end."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.tags: dict[tuple[bool, str], list[int]] = {}
        for m in SILENT_TAG.finditer(page):
            self.tags.setdefault((bool(m[1]), m[2].lower()), []).append(m.start())

    def after(self, end: bool, tag: str, at: int) -> int:
        found = self.tags.get((end, tag), ())
        k = bisect.bisect_left(found, at)
        return found[k] if k < len(found) else len(self.page)

    def end(self, tag: str, at: int) -> int:
        """End of an element whose content begins at ``at``: its end tag; if that is
        missing or belongs to a later element, the next tag of a block if sooner."""
        page, close = self.page, self.after(True, tag, at)
        if close == len(page) or (tag not in RAW and self.after(False, tag, at) < close):
            m = BREAK_TAG.search(page, at, close)
            if m:
                return m.start()
        return (page.find(">", close) + 1 or len(page)) if close < len(page) else close


def blocks(page: str) -> list[tuple]:
    """(text, words, link density, main, aside, heading) of each block with text."""
    out: list[tuple] = []
    # surroundings: (parent, tag, mark, article, hidden), the page itself first
    around: list[tuple[int, str, float, bool, bool]] = [(-1, "", 0.0, False, False)]
    held = [0]
    text: list[str] = []
    linked, in_link, own, heading, dropped = 0, False, 0.0, False, False
    silent: Silent | None = None
    at = 0

    def close() -> None:
        nonlocal text, linked
        joined = SPACE.sub(" ", "".join(text)).strip()
        if joined:
            n = joined.count(" ") + 1
            out.append((joined, float(n), min(1.0, linked / n), held[-1], own, float(heading)))
        text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            plain = references.unescape(raw)
            text.append(plain)
            if in_link:
                linked += len(plain.split())

    while m := TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in SILENT:
            if not m["end"] and not CLOSED_ITSELF.search(m["attrs"]):
                silent = silent or Silent(page)
                at = silent.end(tag, at)
            continue
        if tag == "a":
            in_link = not m["end"] and "href" in attributes(m["attrs"])
        elif tag in ("br", "img", "wbr"):
            text.append(" ")
        if tag not in BREAKS:
            continue
        close()
        in_link, own, heading = False, 0.0, False
        if tag != "html":  # any block ends the head
            dropped = tag == "head" and not m["end"]
        if m["end"]:
            if tag in HOLDERS:
                for k in range(len(held) - 1, 0, -1):
                    if around[held[k]][1] == tag:
                        del held[k:]
                        break
            continue
        mark, article, hidden = names(tag, m["attrs"])
        if tag in ITEMS:
            same, within = (x.split() for x in ITEMS[tag])
            for k in range(len(held) - 1, 0, -1):
                if around[held[k]][1] in same:
                    del held[k:]
                    break
                if around[held[k]][1] in within:
                    break
        if tag in HOLDERS:
            around.append((held[-1], tag, mark, article, hidden))
            held.append(len(around) - 1)
        else:
            own = mark if tag not in ("body", "html") else 0.0
            heading = tag[0] == "h" and tag[1:].isdigit()
    add(page[at:])
    close()
    where = settled(around, out)
    return [(t, n, links, float(where[k][0]), max(own, where[k][1]), h) for t, n, links, k, own, h in out]


def settled(around: Sequence[tuple], found: Sequence[tuple]) -> list[tuple[bool, float]]:
    """(main, aside) of all surroundings.

    A mark is in doubt if MUCH unlinked text, and most of the page's, is within;
    an article in doubtful surroundings is an article."""
    plain = [0.0] * len(around)
    for _, n, links, k, _, _ in found:
        plain[k] += n * (1 - links)
    for k in range(len(around) - 1, 0, -1):
        plain[around[k][0]] += plain[k]
    out: list[tuple[bool, float]] = [(False, 0.0)]
    for k, (up, tag, mark, article, hidden) in enumerate(around[1:], 1):
        main, aside = out[up]
        if tag == "header" and not main:
            mark = 1.0
        if mark == 1 and not hidden and plain[k] >= max(MUCH, 0.8 * plain[0]):
            mark = 0.5
        if article and mark < 1 and aside < 1:
            out.append((True, 0.0))
        else:
            out.append((main, max(aside, mark)))
    return out


def tree(spark: SparkSession, rows: Sequence[Sequence[float]] = LABELLED, depth: int = 6) -> Callable[[dict[str, Column]], Column]:
    """A decision tree trained on labelled blocks, as a function from the
    features' columns to the probability of main text."""
    table = spark.createDataFrame([tuple(map(float, r)) for r in rows], T.StructType(
        [T.StructField(n, T.DoubleType()) for n in (*FEATURES, "label")])).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))

    def walk(node) -> tuple | float:
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        return FEATURES[node.split().featureIndex()], float(node.split().threshold()), walk(node.leftChild()), walk(node.rightChild())

    grown = walk(model._java_obj.rootNode())

    def apply(node: tuple | float, x: dict[str, Column]) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, limit, low, high = node
        return F.when(x[name] <= limit, apply(low, x)).otherwise(apply(high, x))

    return lambda x: apply(grown, x)


def to_blocks(df: DataFrame, page: str, keep: Sequence[str]) -> DataFrame:
    """_0, _1, ... (``keep``) and _blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field(f.name, pa.string() if f.name == "text" else pa.float64()) for f in BLOCK.fields]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                found, ends = [], [0]
                for x in part.column(0):
                    found.extend(blocks(x.as_py() or ""))
                    ends.append(len(found))
                cols = list(zip(*found)) or [[] for _ in BLOCK.fields]
                flat = pa.StructArray.from_arrays([pa.array(c, kind.value_type.field(i).type) for i, c in enumerate(cols)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                                                 names=[*(f"_{i}" for i in range(len(keep))), "_blocks"])

    put = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    schema = T.StructType([*(T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("_blocks", T.ArrayType(BLOCK))])
    return df.select(F.col(f"`{page}`").alias("_page"), *put).mapInArrow(run, schema)


def extract(df: DataFrame, page: str = "html", keep: Sequence[str] = ("page_id", "url"),
            labelled: Sequence[Sequence[float]] = LABELLED) -> DataFrame:
    """``keep``, text and n_chars (code points), one row per row.

    A null or empty page has an empty text.  Of a page in which the tree finds no
    main text, the blocks without mark or link stay.  Pages that repeat are read each; an
    empty table gives an empty one; columns not in ``keep`` go.  Markup that is
    cut off or not closed ends with the page.
    """
    grown = tree(df.sparkSession, labelled)
    b = F.col("_blocks")

    def stays(x: Column, i: Column) -> Column:
        before, after = F.get(b, i - 1), F.get(b, i + 1)
        none = lambda c: F.coalesce(c, F.lit(0.0))
        f = {n: x[n] for n in FEATURES[:5]} | {
            "words_before": none(before["words"]), "links_before": none(before["links"]),
            "words_after": none(after["words"]), "links_after": none(after["links"])}
        return F.when(grown(f) > 0.5, x["text"])

    texts = F.array_compact(F.transform(b, stays))
    # a page too short for the tree to find anything: all that is neither marked nor linked
    plain = F.transform(F.filter(b, lambda x: (x["aside"] == 0) & (x["links"] < 0.5)), lambda x: x["text"])
    texts = F.when(F.size(texts) > 0, texts).otherwise(plain)
    out = to_blocks(df, page, keep).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.array_join(texts, "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
