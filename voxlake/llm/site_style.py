"""HTML main text by site style trees.

The element trees of a site's pages are merged: elements with the same path of tags, classes and ids are one node of the
site's style tree. A node keeps how its pages lay it out (the sequences of its children, its "styles") and what they say
in it. Importance is an entropy. A node whose pages all look the same is presentation of the site and scores low, one that
differs from page to page scores high; a text found on many pages scores low, one found on a single page high. The composite
importance of a node mixes its own with that of its children, the less the more styles it has. Branches of low importance
are removed from each page, together with elements that say themselves what they are (menus, footers, forms and so on).

All pages make the tree, and all are judged by it. A page that marks its article has the article, less what in it calls itself
a notice, an advert, a form and the like: what many articles say alike (a byline, a lead) is still theirs. The tree decides on
what stands outside of it, and on all of a page without such a mark. Where it would leave nothing,
because a site's pages agree in all, it says nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import batch_rows
from voxlake.session import materialize

#: Weight of the children per style, and the composite importance below which a branch goes.
DECAY, LEAST_IMPORTANCE = 0.9, 0.5
#: Levels of a tree; what lies deeper counts as lying directly below the deepest.
DEPTH = 32
#: Pages of a site from which on its statistics say anything.
LEAST_PAGES = 5
#: Sums of tree nodes that a task holds.
HELD_NODES = 1 << 16

RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<given>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)

# What HTML says about elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
#: An element that ends another of these, and the elements that shield what is outside.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SHIELD = set("body html table td th button li dd dt blockquote article section div main aside nav header footer form".split())
#: Inside an image or a formula elements may be self-closed, and these are not shown; an element of ENDS_P ends both.
FOREIGN, UNSEEN = {"svg", "math"}, set("title style script desc metadata annotation annotation-xml".split())
BOILERPLATE_TAGS = set("nav footer aside form button select input dialog menu head canvas audio video".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of what no article has in it, and of what only stands beside one.
NAMED_WORDS = set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner popup modal overlay newsletter "
    "comment comments commentlist respond disqus".split()
)
BESIDE_WORDS = NAMED_WORDS | set(
    "aside subscribe subscription signup login share sharing social related recommended recommendations widget toolbar "
    "pagination pager search skip masthead topbar copyright".split()
)
#: In a name, what follows the first says what goes with the element; a name with the second says its state.
WITH, STATES = set("has have no not non with without".split()), set("enabled disabled".split())
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}


def name_words(label: str) -> set[str]:
    """The words of class names and ids that say what the element itself is."""
    found = set()
    for name in label.split():
        words = re.split(r"[^a-z]+", name)
        if STATES.isdisjoint(words):
            found.update(words[: next((i for i, w in enumerate(words) if w in WITH), len(words))])
    return found


class Element:
    __slots__ = ("tag", "name", "path", "children", "words", "role", "hidden", "depth", "above")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        found = {}
        for m in ATTR.finditer(attrs) if attrs else ():
            found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        label = re.sub(r"\d+", "#", f"{found.get('class', '')} {found.get('id', '')}".strip().lower())
        self.tag, self.children = tag, []
        self.role = found.get("role", "").lower()
        # The id of an article names its subject.
        self.words = name_words(found.get("class", "").lower() if tag in MAIN_TAGS or self.role in MAIN_ROLES else label) if label else set()
        self.hidden = "hidden" in found or found.get("aria-hidden") == "true"
        self.name = f"{tag} {' '.join(sorted(label.split()))}"
        self.depth = 0 if parent is None else min(parent.depth + 1, DEPTH)
        # Where the tree begins anew: the path of the node above, that of the deepest level for all that lies below.
        self.above = 0 if parent is None else parent.above if parent.depth == DEPTH else parent.path
        self.path = xxhash.xxh64_intdigest(self.name.encode("utf-8", "replace"), self.above) & ((1 << 63) - 1)


def parse(page: str) -> Element:
    """A tolerant element tree: unclosed and stray tags do not lose text."""
    root = Element("#root", "", None)
    stack, at = [root], 0

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part) if "&" in part else part)

    def close(tags: set, shield: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in shield:
                return

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag, attrs = m["tag"] or m["raw"], m["attrs"] or m["given"] or ""
        if tag is None:
            continue
        tag = tag.lower()
        unseen = tag in UNSEEN and any(x.tag in FOREIGN for x in stack)
        if m["raw"]:
            if not unseen:
                continue
            at = m.end("given") + 1
        if m["end"]:
            close({tag}, set() if tag not in INLINE else SHIELD - {tag})
            continue
        if tag in ENDS_P:
            close(FOREIGN, SHIELD | {"foreignobject"})
            close({"p"}, SHIELD)
        if tag in ENDS:
            close(*ENDS[tag])
        element = Element(tag, attrs, stack[-1])
        element.hidden |= unseen
        stack[-1].children.append(element)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(element)
    text(page[at:])
    return root


def is_main(e: Element) -> bool:
    return e.tag in MAIN_TAGS or e.role in MAIN_ROLES


def is_named(e: Element, in_main: bool = False) -> bool:
    """Whether its class or id calls it boilerplate; what holds the whole page is never called so."""
    return e.tag not in ("body", "html") and not e.words.isdisjoint(NAMED_WORDS if in_main else BESIDE_WORDS)


def says_boilerplate(e: Element) -> bool:
    return e.hidden or e.tag in BOILERPLATE_TAGS or e.role in BOILERPLATE_ROLES


def is_boilerplate(e: Element, in_main: bool, kept: set[Element] | None) -> bool:
    """``kept`` stay whatever their names say; without it no name counts."""
    if says_boilerplate(e) or (not in_main and e.tag == "header"):
        return True
    if kept is None or e in kept or e.tag in ("body", "html"):
        return False
    return is_named(e, in_main) or (not in_main and "header" in e.words)


def with_main(root: Element) -> set[Element]:
    """The main elements, or else the articles, and all they stand in. Articles that are named boilerplate, or stand in
    what is (comments, teasers), are among them only if the page has no others."""
    found, stack = [], [(root, (), False)]
    while stack:
        e, above, named = stack.pop()
        if e is not root and says_boilerplate(e):
            continue
        above, named = (*above, e), named or is_named(e) or "header" in e.words and e.tag not in ("body", "html")
        if is_main(e):
            found.append((e.tag == "main" or e.role == "main", named, above))
        else:
            stack += [(c, above, named) for c in e.children if isinstance(c, Element)]
    chosen = [x for x in found if x[0]] or [x for x in found if not x[1]] or found
    return {e for _, _, above in chosen for e in above}


def nodes(root: Element) -> Iterator[tuple[Element, str, list[str]]]:
    """Every element with its style and the texts that stand directly in it."""
    stack = [root]
    while stack:
        e = stack.pop()
        style, said = [], []
        for c in e.children:
            name = c.name if isinstance(c, Element) else "#text"
            if name != "#text":
                stack.append(c)
            elif c.strip():
                said.append(" ".join(c.split()))
            else:
                continue
            if not style or style[-1] != name:  # a run of equal children counts as one
                style.append(name)
        yield e, "|".join(style), said


def main_text(root: Element, low: set[int]) -> str:
    """The text of what is left: blocks in page order, joined by a space. Where the tree would leave nothing it does not count,
    and where names would, they do not."""

    def inner(e: Element, in_main: bool, kept: set[Element] | None, low: set[int], out: list[str]) -> None:
        stack = [(e, in_main)]
        while stack:
            x, within = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x is not e and (is_boilerplate(x, within, kept) or not within and x.path in low):
                continue
            if x.tag not in INLINE:
                out.append(" ")
                stack.append((" ", within))
            within = within or is_main(x)
            stack += [(c, within) for c in reversed(x.children)]

    main = with_main(root)
    for kept, low_ in ((main, low), (main, set()), (None, low), (None, set())):
        mains, stack = [], [root]
        while stack:
            x = stack.pop()
            if x is not root and (is_boilerplate(x, False, kept) or x.path in low_ and x not in main):
                continue
            if is_main(x):
                mains.append(x)
                continue
            stack += [c for c in reversed(x.children) if isinstance(c, Element)]
        for start in (mains, [root]):
            out: list[str] = []
            for x in start:
                inner(x, x is not root, kept, low_, out)
            found = " ".join("".join(out).split())
            if found:
                return found
    return ""


NODE_SCHEMA = "host string, path long, parent long, depth int, kind int, feature long, n double, parts double, pages long"


def page_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of all pages' trees, added up over what a task has read: rows of kind 0 for the nodes, of kind 1 for their
    styles, of kind 2 for their texts, with how often (``n``), the sum of n log n over the pages (``parts``) and the pages.
    ``pages``: ``html, host``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def h(x: str) -> int:
            return xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63)

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*key, *sums) for key, sums in held.items()], columns=names)

        names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
        held: dict[tuple, list] = {}
        for pdf in batches:
            for source, host in zip(pdf["html"], pdf["host"]):
                seen: dict[tuple, int] = {}
                for e, style, said in nodes(parse(source)):
                    at = host, e.path, e.above, e.depth
                    seen[*at, 0, 0] = 1
                    for key in [(*at, 1, h(style)), *((*at, 2, h(t)) for t in said)]:
                        seen[key] = seen.get(key, 0) + 1
                for key, n in seen.items():
                    sums = held.setdefault(key, [0, 0.0, 0])
                    sums[0] += n
                    sums[1] += n * math.log(n)
                    sums[2] += 1
            if len(held) > HELD_NODES:
                yield rows()
                held = {}
        if held:
            yield rows()

    return pages.select("html", "host").mapInPandas(run, NODE_SCHEMA)


def node_counts(found: DataFrame) -> DataFrame:
    """``host, path, parent, depth, pages`` and the entropies of every node of every site's style tree, a row a node."""
    by_feature = found.groupBy("host", "path", "parent", "depth", "kind", "feature").agg(
        F.sum("n").alias("total"), F.sum("parts").alias("parts"), F.sum("pages").alias("pages")
    )
    # Per text: its entropy over the pages. Per node: the entropy of its styles, the mean over its texts.
    spread = F.log("total") - F.col("parts") / F.col("total")
    style, text = F.col("kind") == 1, F.col("kind") == 2
    return by_feature.groupBy("host", "path", "parent", "depth").agg(
        F.max(F.when(F.col("kind") == 0, F.col("pages"))).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("total"))).alias("st"),
        F.sum(F.when(style, F.col("total") * F.log("total"))).alias("sp"),
        F.sum(F.when(text, F.col("total"))).alias("ct"),
        F.sum(F.when(text, F.col("total") * spread)).alias("ch"),
    )


def importance(found: DataFrame) -> DataFrame:
    """``host, path, importance, peak, pages``: the composite importance of every node of every site's style tree, and the
    highest in its branch.

    Trees are gone through from the deepest level up, one grouping by parent a level, so that no task has all of a tree.
    """
    tree = materialize(node_counts(found), "tree")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    scale, alone = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double")), F.col("pages") < 2
    own = F.when(alone, 1.0).otherwise(clip((F.log("st") - F.col("sp") / F.col("st")) / scale))
    said = F.when(alone, 1.0).when(F.col("ct") > 0, clip(1 - F.col("ch") / F.col("ct") / scale))
    tree = tree.select("host", "path", "parent", "depth", "pages", "styles", own.alias("own"), said.alias("said"))
    levels, below = [], None
    for depth in range(tree.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = tree.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"among": F.lit(0).cast("long"), "total": F.lit(0.0), "highest": F.lit(0.0)})
        else:
            level = level.join(below, ["host", "path"], "left").fillna(0, ["among", "total", "highest"])
        parts = F.col("among") + F.when(F.col("said").isNull(), 0).otherwise(1)
        mean = F.when(parts > 0, (F.col("total") + F.coalesce("said", F.lit(0.0))) / parts).otherwise(F.col("own"))
        keep = F.pow(F.lit(DECAY), F.col("styles"))
        level = level.withColumn("importance", F.when(F.col("among") > 0, (1 - keep) * F.col("own") + keep * mean).otherwise(mean))
        level = level.withColumn("peak", F.greatest("importance", "highest"))
        levels.append(materialize(level.select("host", "path", "parent", "importance", "peak", "pages"), "level"))
        below = levels[-1].groupBy("host", F.col("parent").alias("path")).agg(
            F.count(F.lit(1)).alias("among"), F.sum("importance").alias("total"), F.max("peak").alias("highest")
        )
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("parent")


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``page_id, url, text``: the main text of every page, empty if none.

    Pages of a host (``www.`` aside) are a site. A null html is empty; a null or odd url belongs to a site of its own name.
    Pages of sites with fewer than LEAST_PAGES pages are judged by what their elements say of themselves. Rows that repeat
    a page id are taken one by one. Rows with a null page id are extracted without site statistics. Other columns are ignored.
    """
    spark = pages.sparkSession
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://(?:[^/@]*@)?([^/:?#]*)", 1)), r"^www\.", "")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    with batch_rows(spark):
        tree = importance(page_nodes(base.filter("page_id is not null")))
    low = tree.filter((F.col("peak") < least) & (F.col("pages") >= LEAST_PAGES))
    low = materialize(low.groupBy("host").agg(F.collect_set("path").alias("low")), "low")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, url, source, low_ in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["low"]):
                rows.append((page, url, main_text(parse(source), set() if page is None or low_ is None else set(low_))))
            yield pd.DataFrame(rows, columns=["page_id", "url", "text"])

    # Ids pass through Python as text: numbers beside nulls would turn into floating point.
    judged = base.join(low, "host", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "low")
    with batch_rows(spark):
        texts = materialize(judged.mapInPandas(run, "page_id string, url string, text string"), "judged")
    return texts.withColumn("page_id", F.col("page_id").cast("long"))
