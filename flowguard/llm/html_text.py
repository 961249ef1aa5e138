"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. A block is described by its word count and link
density, those of the blocks before and after it, and by what encloses it. A decision tree, trained by MLlib on the
blocks of the small labelled pages in `LABELLED`, says which blocks belong to the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm.common import map_text
from flowguard.llm.html_samples import LABELLED

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*))(?:>|\Z)""", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# HTML element names by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe object select textarea button title head math audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: These are often left open, so they don't enclose anything here.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option b i h1 h2 h3 h4 h5 h6 html body center".split())
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside header form menu dialog fieldset".split())
_SIDE_NAME = re.compile(
    r"\b(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscri\w+|share|sharing|social|sidebar|widget|menu|nav\w*|breadcrumbs?|footer|header|masthead|topbar|toolbar|comments?|commentlist|respond|reply|replies|disqus|related|recommended|more|login|signup|search|pagination|pager|tags?|copyright|legal|skip)\b"
)
_MAIN_NAME = re.compile(r"\b(?:article|content|post|entry|story|body|main|text|prose)\b")
_SENTENCE = re.compile(r"[.!?…:;][\"'”’)\]]*$")


@dataclass
class Block:
    text: str
    words: int
    linked: float
    tag: str
    in_main: bool
    in_aside: bool
    side_name: bool
    main_name: bool


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name something beside the main text, or the main text."""
    names = re.sub(r"[_-]+", " ", " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))).lower()
    return bool(_SIDE_NAME.search(names)), bool(_MAIN_NAME.search(names))


@dataclass
class _Reader:
    """Builds the blocks of one page. Of the open elements only those inside the innermost article tell about a block,
    so something left open before the article doesn't matter in it."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, bool, bool]] = field(default_factory=list)  # element, names beside, names main
    parts: list[tuple[str, bool]] = field(default_factory=list)
    links: int = 0
    tag: str = ""

    def flush(self) -> None:
        if self.parts:
            text = html.unescape("".join(t for t, _ in self.parts)).split()
            if text:
                linked = sum(len(html.unescape(t).split()) for t, in_link in self.parts if in_link)
                at = max((i for i, (name, _, _) in enumerate(self.open) if name in MAIN), default=-1)
                around = self.open[max(at, 0) :]
                self.blocks.append(Block(
                    " ".join(text), len(text), min(1.0, linked / len(text)), self.tag, at >= 0, any(n in ASIDE and not (n == "header" and at >= 0) for n, _, _ in around),
                    any(s for _, s, _ in around), any(m for _, _, m in around),
                ))
            self.parts = []

    def opened(self, name: str, attributes: str) -> None:
        if name == "a":
            self.links += 1
        elif name not in INLINE:
            self.flush()
            self.links = 0
            if name != "br":
                self.tag = name
            if name not in OPEN_ENDED and name not in VOID and not attributes.endswith("/"):
                self.open.append((name, *(_hints(attributes) if attributes else (False, False))))

    def closed(self, name: str) -> None:
        if name == "a":
            self.links = 0
        elif name not in INLINE:
            self.flush()
            self.tag = ""
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == name:
                    del self.open[i:]
                    break


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a whole page, in order. Broken markup is read as far as it goes: an unended comment or tag
    takes the rest, stray end tags are ignored."""
    out, at, n = _Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            out.parts.append((page[at:lt], out.links > 0))
        if lt == n:
            break
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)  # the second where a quote in the tag never ends
        if not m:
            out.parts.append(("&lt;", out.links > 0))
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            out.closed(name)
        elif name in UNSEEN and name != "head":
            out.flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end or name in ("script", "style"):
                at = end.end() if end else n
        elif name != "head":
            out.opened(name, m[3])
    out.flush()
    return out.blocks


FEATURES = ["words", "linked", "words_before", "words_after", "linked_before", "linked_after", "in_main", "in_aside", "side_name", "main_name", "heading", "paragraph", "item", "sentence"]


def describe(blocks: list[Block]) -> list[list[float]]:
    """The values of `FEATURES` for each block; beyond the ends of the page there are 0 words and no links."""
    out = []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        out.append([float(x) for x in (
            b.words, b.linked, before.words if before else 0, after.words if after else 0, before.linked if before else 0, after.linked if after else 0,
            b.in_main, b.in_aside, b.side_name, b.main_name, b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("p", "pre", "blockquote"), b.tag in ("li", "dd", "dt"), bool(_SENTENCE.search(b.text)),
        )])
    return out


#: A tree is a leaf (True for main text) or (feature, threshold, tree up to the threshold, tree above it).
Tree = bool | tuple


def fit(spark: SparkSession, labelled: list[tuple[str, str]] = LABELLED, depth: int = 12) -> Tree:
    """The tree for pages and their labels, one sign for each block: + main text, - anything else."""
    rows = []
    for page, labels in labelled:
        found = describe(read_blocks(page))
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks: {page[:80]}")
        rows += [(x, float(y == "+")) for x, y in zip(found, labels, strict=True)]
    data = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=512, minInstancesPerNode=1, seed=1).fit(data)

    def read(node) -> Tree:
        if node.numDescendants() == 0:
            return node.prediction() == 1.0
        split = node.split()
        return (split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild()))

    return read(model._java_obj.rootNode())


def is_main(tree: Tree, x: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: Tree) -> str:
    blocks = read_blocks(page)
    return "\n".join(b.text for b, x in zip(blocks, describe(blocks), strict=True) if is_main(tree, x))


def extract(pages: DataFrame, tree: Tree | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per input row: the columns `keep`, text (blocks joined by newlines) and n_chars (its code points).

    Defined cases: null or empty html, and pages without main text, give an empty text; nulls in `keep` stay; repeated
    rows each keep their row and agree; an empty table gives an empty table; other columns are ignored. Whole pages are
    read, nothing is cut.
    """
    tree = fit(pages.sparkSession) if tree is None else tree

    def run(texts: list[str]) -> list[list]:
        found = [main_text(t, tree) for t in texts]
        return [found, [len(x) for x in found]]

    return map_text(pages, list(keep), html_col, run, [("text", pa.string(), "string"), ("n_chars", pa.int64(), "long")])


def show(tree: Tree, indent: str = "") -> Iterator[str]:
    """The tree as lines of text."""
    if isinstance(tree, bool):
        yield indent + ("main text" if tree else "other")
    else:
        yield f"{indent}{FEATURES[tree[0]]} <= {tree[1]:g}"
        yield from show(tree[2], indent + "  ")
        yield f"{indent}{FEATURES[tree[0]]} > {tree[1]:g}"
        yield from show(tree[3], indent + "  ")
