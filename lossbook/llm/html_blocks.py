"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is read by the standard HTML parser and cut at block tags into flat text blocks. Each block is described by its
word count and link density, those of the block before and after it, and four
cues: whether it stands inside page furniture (nav, footer, aside, form, or a
container named so; the names of body and main mark none, those of an
article only comments, and a main or the articles of a container that no article
came before end what names alone marked), inside an article, whether the page has an article at all, and
whether the block is a heading. A CART tree grown on ``LABELLED``, a small table of labelled blocks of real
pages, decides which blocks are main text: the cues where a page names its parts, counts and densities of
the block and its neighbours where it doesn't. Those are joined in page order by two newlines.

Edge cases: null or empty html gives the empty text; scripts, styles, comments
and titles never make blocks; unclosed tags end where their container does, an unclosed frame, drawing or other skipped
element hides nothing after it (an unclosed script or style does, as in browsers), and an unclosed link ends with its block or
container; broken character references stay as written; white space inside a block
becomes one space; very long pages are read whole; repeated rows are extracted
one by one; an empty table gives no rows; other columns are ignored, whatever their names. One
pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lossbook.llm.arrow import map_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul video".split()
)
#: Their contents are never text of the page.
SKIPPED = frozenset("script style title noscript template svg math iframe object canvas audio video textarea select".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words in a container's class or id that mark furniture or the article.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags "
    "toolbar topbar warning widget".split()
)
#: Those that mark even an article that stands in no other.
COMMENT_WORDS = frozenset(("comment", "reply"))
ARTICLE_WORDS = frozenset("article articlebody content entry main post story".split())
CONTAINERS = FURNITURE_TAGS | frozenset("article aside div header main section ul ol li table td dl span p body".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Name parts that say what a container holds or allows elsewhere, not what it is.
_STATE = re.compile(r"\b(?:has|with|without)(?:[-_]+[a-zA-Z]+|[A-Z][a-z]+)|\b[a-zA-Z]+[-_]+(?:open|enabled)\b")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "page_has_article", "heading")
# Blocks of the test pages, as they are and without their article and nav elements and class names, in the order of FEATURES, then 1 for main text.
LABELLED = (
    (5, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0), (8, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0),
    (10, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (8, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0, 0, 0), (13, 0.0, 1, 1.0, 13, 0.0, 0, 0, 0, 0, 0),
    (12, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0, 0), (1, 0.0, 3, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (1, 0.0, 31, 0.0, 37, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 15, 0.0, 8, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 7, 0.0, 1, 0.0, 0, 0, 0, 0, 1),
    (8, 0.0, 17, 0.0, 19, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 6, 0.0, 73, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 9, 0.0, 90, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 4, 0.0, 22, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 10, 0.0, 13, 0.0, 0, 0, 0, 0, 1), (13, 0.0, 17, 0.0, 24, 0.0, 0, 0, 0, 0, 1),
    (12, 0.0, 17, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (15, 0.0, 4, 0.0, 18, 0.0, 0, 0, 0, 0, 1), (27, 0.0, 1, 0.0, 24, 0.0, 0, 0, 0, 0, 1),
    (25, 0.0, 31, 0.0, 23, 0.0, 0, 0, 0, 0, 1), (243, 0.0, 80, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (51, 0.0, 43, 0.0, 22, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 5, 0.0, 2, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 8, 0.0, 4, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 7, 0.0, 5, 0.0, 0, 0, 0, 1, 1),
    (2, 0.0, 10, 0.0, 2, 0.0, 0, 0, 0, 1, 1), (9, 0.0, 8, 0.0, 12, 0.0, 0, 0, 0, 1, 1), (10, 0.0, 4, 0.0, 14, 0.0, 0, 0, 0, 1, 1),
    (10, 0.0, 12, 0.0, 114, 0.0, 0, 0, 0, 1, 1), (7, 0.0, 5, 0.0, 7, 0.0, 0, 0, 0, 1, 1), (12, 0.0, 7, 0.0, 29, 0.0, 0, 0, 0, 1, 1),
    (12, 0.0, 13, 0.0, 35, 0.0, 0, 0, 0, 1, 1), (12, 0.0, 9, 0.0, 160, 0.0, 0, 0, 0, 1, 1), (13, 0.0, 13, 0.0, 31, 0.0, 0, 0, 0, 1, 1),
    (4, 0.0, 10, 0.0, 29, 0.0, 0, 1, 1, 0, 1), (1, 0.0, 97, 0.0, 29, 0.0, 0, 1, 1, 0, 1), (4, 0.0, 20, 0.0, 15, 0.0, 0, 1, 1, 0, 1),
    (2, 0.0, 27, 0.0, 39, 0.0, 0, 1, 1, 0, 1), (11, 0.0, 4, 0.0, 29, 0.0, 0, 1, 1, 0, 1), (6, 0.0, 6, 0.0, 36, 0.0, 0, 1, 1, 0, 1),
    (9, 0.0, 184, 0.0, 10, 0.0, 0, 1, 1, 0, 1), (7, 0.0, 4, 0.0, 22, 0.0, 0, 1, 1, 0, 1), (17, 0.0, 27, 0.0, 8, 0.0, 0, 1, 1, 0, 1),
    (13, 0.0, 17, 0.0, 24, 0.0, 0, 1, 1, 0, 1), (13, 0.0, 89, 0.0, 30, 0.0, 0, 1, 1, 0, 1), (12, 0.0, 9, 0.0, 9, 0.0, 0, 1, 1, 0, 1),
    (18, 0.0, 57, 0.0, 10, 0.0, 0, 1, 1, 0, 1), (37, 0.0, 77, 0.0, 2, 0.0, 0, 1, 1, 0, 1), (167, 0.0, 46, 0.0, 48, 0.0, 0, 1, 1, 0, 1),
    (92, 0.0, 29, 0.0, 16, 0.0, 0, 1, 1, 0, 1), (2, 0.0, 5, 0.0, 2, 0.0, 0, 1, 1, 1, 1), (5, 0.0, 7, 0.0, 5, 0.0, 0, 1, 1, 1, 1),
    (2, 0.0, 10, 0.0, 2, 0.0, 0, 1, 1, 1, 1), (4, 0.0, 8, 0.0, 4, 0.0, 0, 1, 1, 1, 1), (11, 0.0, 9, 0.0, 117, 0.0, 0, 1, 1, 1, 1),
    (8, 0.0, 4, 0.0, 8, 0.0, 0, 1, 1, 1, 1), (10, 0.0, 5, 0.0, 172, 0.0, 0, 1, 1, 1, 1), (10, 0.0, 4, 0.0, 14, 0.0, 0, 1, 1, 1, 1),
    (12, 0.0, 13, 0.0, 35, 0.0, 0, 1, 1, 1, 1), (13, 0.0, 13, 0.0, 31, 0.0, 0, 1, 1, 1, 1), (12, 0.0, 7, 0.0, 29, 0.0, 0, 1, 1, 1, 1),
    (12, 0.0, 9, 0.0, 160, 0.0, 0, 1, 1, 1, 1), (9, 0.0, 12, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (7, 0.0, 8, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (7, 0.0, 9, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (9, 0.0, 20, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (13, 0.0, 20, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (14, 0.0, 8, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (12, 0.0, 25, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (12, 0.0, 72, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (11, 0.0, 22, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (10, 0.0, 9, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (7, 0.0, 8, 0.0, 0, 0.0, 1, 0, 1, 0, 0),
    (10, 0.0, 172, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (13, 0.0, 9, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (14, 0.0, 10, 0.0, 0, 0.0, 1, 0, 1, 0, 0),
    (13, 0.0, 12, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (13, 0.0, 20, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (4, 0.0, 1, 1.0, 6, 0.0, 1, 0, 1, 0, 0),
    (5, 0.0, 1, 1.0, 2, 0.0, 1, 0, 1, 0, 0), (4, 0.0, 1, 1.0, 3, 0.0, 1, 0, 1, 0, 0), (5, 0.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0, 0),
    (11, 0.0, 1, 1.0, 11, 0.0, 1, 0, 1, 0, 0), (7, 0.0, 1, 1.0, 11, 0.0, 1, 0, 1, 0, 0), (10, 0.0, 1, 1.0, 10, 0.0, 1, 0, 1, 0, 0),
    (8, 0.0, 1, 1.0, 4, 0.0, 1, 0, 1, 0, 0), (12, 0.0, 1, 1.0, 6, 0.0, 1, 0, 1, 0, 0), (13, 0.0, 1, 1.0, 13, 0.0, 1, 0, 1, 0, 0),
    (12, 0.0, 1, 1.0, 1, 0.0, 1, 0, 1, 0, 0), (13, 0.0, 1, 1.0, 12, 0.0, 1, 0, 1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 7, 0.0, 1, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 11, 0.0, 1, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 1, 0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 4, 0.0, 1, 0, 1, 0, 0),
    # Cases that those pages lack, made by hand: link lists without a name, links and comments inside articles, blocks beside an article,
    # long paragraphs after a menu, and pages of paragraphs alone.
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (12, 0.9, 10, 1.0, 9, 0.8, 0, 0, 0, 0, 0),
    (6, 0.5, 5, 1.0, 7, 0.6, 0, 0, 0, 0, 0), (30, 0.6, 20, 0.7, 4, 1.0, 0, 0, 0, 0, 0), (9, 1.0, 60, 0.0, 8, 1.0, 0, 1, 1, 0, 0),
    (12, 0.95, 40, 0.0, 10, 1.0, 0, 1, 1, 0, 0), (4, 1.0, 5, 1.0, 40, 0.0, 0, 1, 1, 0, 0), (8, 0.9, 30, 0.0, 60, 0.0, 0, 1, 1, 0, 0),
    (30, 0.0, 50, 0.0, 2, 1.0, 1, 1, 1, 0, 0), (80, 0.0, 60, 0.0, 70, 0.0, 1, 1, 1, 0, 0), (4, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1, 1, 0),
    (20, 0.0, 60, 0.0, 80, 0.0, 1, 1, 1, 0, 0), (8, 0.0, 1, 1.0, 11, 0.0, 0, 0, 1, 0, 0), (20, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1, 0, 0),
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 0, 0), (3, 0.0, 12, 0.0, 40, 0.0, 0, 0, 1, 1, 0), (40, 0.0, 30, 0.0, 50, 0.0, 1, 0, 0, 0, 0),
    (120, 0.0, 100, 0.0, 90, 0.0, 1, 0, 0, 0, 0), (30, 0.4, 40, 0.1, 45, 0.0, 0, 1, 1, 0, 1), (20, 0.3, 50, 0.0, 60, 0.0, 0, 1, 1, 0, 1),
    (45, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0, 1), (90, 0.1, 2, 1.0, 70, 0.0, 0, 0, 0, 0, 1), (60, 0.2, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 1, 1.0, 18, 0.0, 0, 1, 1, 0, 1), (5, 0.0, 3, 1.0, 20, 0.0, 0, 1, 1, 0, 1), (12, 0.0, 1, 1.0, 0, 0.0, 0, 1, 1, 0, 1),
    (8, 0.0, 9, 1.0, 30, 0.0, 0, 1, 1, 1, 1), (2, 0.0, 2, 1.0, 6, 0.0, 0, 1, 1, 0, 1), (25, 0.1, 4, 0.8, 9, 0.0, 0, 1, 1, 0, 1),
    (16, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1, 1), (12, 0.0, 2, 1.0, 30, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 1, 1),
    (5, 0.0, 0, 0.0, 8, 0.0, 0, 0, 1, 0, 0), (12, 0.0, 40, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (40, 0.0, 25, 0.0, 12, 0.0, 0, 0, 1, 0, 0),
    (9, 0.0, 8, 0.0, 10, 0.0, 0, 0, 1, 0, 0), (60, 0.1, 1, 1.0, 50, 0.0, 0, 0, 1, 0, 0), (25, 0.0, 3, 1.0, 30, 0.0, 0, 0, 1, 0, 0),
    (5, 0.0, 3, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (8, 0.0, 2, 1.0, 11, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 4, 1.0, 8, 0.0, 0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 5, 0.9, 12, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 6, 1.0, 20, 0.0, 0, 0, 0, 0, 0),
    (8, 0.0, 1, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 1, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 1, 0.0, 8, 0.0, 0, 0, 0, 0, 1),
    (8, 0.0, 1, 0.0, 12, 0.0, 0, 1, 1, 0, 1), (12, 0.0, 1, 0.0, 3, 0.0, 0, 1, 1, 0, 1), (3, 0.0, 1, 0.0, 20, 0.0, 0, 1, 1, 0, 1),
    (4, 0.0, 1, 0.0, 40, 0.0, 0, 1, 1, 0, 1), (13, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1, 0, 1), (7, 0.0, 2, 1.0, 12, 0.0, 0, 1, 1, 0, 1),
    (10, 0.0, 1, 1.0, 60, 0.0, 0, 1, 1, 0, 1), (3, 0.0, 1, 1.0, 4, 0.0, 0, 1, 1, 0, 1), (9, 0.0, 4, 0.9, 0, 0.0, 0, 1, 1, 0, 1),
)


@dataclass
class Tree:
    """A node: a leaf's share of main text, or a feature and a threshold with a branch on either side."""

    share: float
    feature: int = -1
    at: float = 0.0
    below: Tree | None = None
    above: Tree | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1) -> Tree:
    """CART by Gini impurity; thresholds halfway between neighbouring values, first best split wins."""
    node = Tree(float(y.mean()))
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = (2 * node.share * (1 - node.share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            side = x[:, f] <= at
            if min(side.sum(), (~side).sum()) >= least:
                impurity = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (y[side], y[~side]))
                if impurity < best[0]:
                    best = (impurity, f, at)
    if best[1] >= 0:
        node.feature, node.at = best[1], best[2]
        side = x[:, node.feature] <= node.at
        node.below, node.above = grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least)
    return node


@lru_cache(maxsize=1)
def trained() -> Tree:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def shares(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.below is None or tree.above is None:
        return np.full(len(x), tree.share)
    side = x[:, tree.feature] <= tree.at
    out = np.empty(len(x))
    out[side], out[~side] = shares(tree.below, x[side]), shares(tree.above, x[~side])
    return out


def _cues(tag: str, attributes: list[tuple[str, str | None]], named: frozenset[str] = FURNITURE_WORDS) -> tuple[bool, bool, bool]:
    """(furniture, furniture by its names alone, article) as a container's tag and names say; ``named``: the words that mark furniture in its names."""
    furniture, by_name, article = tag in FURNITURE_TAGS, False, tag in ("article", "main")
    for name, value in attributes:
        value = value or ""
        if name in ("class", "id", "itemprop"):
            words = {w.lower() for w in _NAME.findall(value)} | {value.lower()}
            by_name |= bool(({w.lower() for w in _NAME.findall(_STATE.sub(" ", value))} | {value.lower()}) & named)
            article |= bool(words & ARTICLE_WORDS)
        elif name == "role":
            furniture |= value.lower() in FURNITURE_ROLES
            article |= value.lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            furniture = True
        elif name == "style":
            furniture |= "display:none" in value.replace(" ", "").lower()
    return furniture, by_name, article and not (furniture or by_name)


@dataclass
class Open:
    """An open container: inside furniture, inside furniture by names alone and the articles before it (-1: not inside), inside an article."""

    tag: str
    furniture: bool = False
    named: int = -1
    article: bool = False


class Blocks(HTMLParser):
    """``found``: (text, words, words in links, furniture, article, heading) of each block, in page order."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, bool, bool, bool]] = []
        self.open, self.articles = [Open("")], 0
        self.parts: list[str] = []
        self.words_linked = 0
        self.heading = False
        self.link: int | None = None  # containers that were open where the link began
        self.skipping, self.depth = "", 0
        self.lower = page.lower()
        self.unmet: dict[str, int] = {}  # closing tags still to come
        self.feed(page)
        self.close()
        self.flush()

    def to_come(self, tag: str) -> int:
        if tag not in self.unmet:
            self.unmet[tag] = len(re.findall(rf"</{tag}[\s/>]", self.lower)) - self.closed.get(tag, 0)
        return self.unmet[tag]

    def reset(self) -> None:
        super().reset()
        self.closed: dict[str, int] = {}

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            top = self.open[-1]
            self.found.append((" ".join(words), len(words), min(self.words_linked, len(words)), top.furniture or top.named >= 0, top.article, self.heading))
        self.parts.clear()
        self.words_linked = 0
        if self.link is not None and not self.to_come("a"):
            self.link = None

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.link is not None:
                self.words_linked += len(data.split())

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if not self.skipping:
            self.tagged(tag)

    def tagged(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append("\n")

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            self.depth += tag == self.skipping
            return
        if tag in SKIPPED:
            self.flush() if tag != "title" and tag in BLOCK_TAGS else None
            if tag in ("script", "style") or self.to_come(tag) > 0:
                self.skipping, self.depth = tag, 1
            return
        self.tagged(tag)
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = True
        elif tag == "a":
            self.link = len(self.open)
        if tag in CONTAINERS:
            self.enter(tag, attributes)

    def enter(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        outermost = tag == "article" and all(o.tag != "article" for o in self.open)
        furniture, by_name, article = _cues(tag, attributes, frozenset() if tag in ("body", "main") else COMMENT_WORDS if outermost else FURNITURE_WORDS)
        if tag == "p":
            while self.open[-1].tag == "p":
                self.open.pop()
        top = self.open[-1]
        if tag == "header":
            furniture |= not top.article
        named = top.named
        if tag == "main" or (tag == "article" and named == 0 and not by_name):
            named = -1
        elif by_name and named < 0:
            named = self.articles
        self.open.append(Open(tag, top.furniture or furniture, named, top.article or article))
        self.articles += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        self.closed[tag] = self.closed.get(tag, 0) + 1
        if tag in self.unmet:
            self.unmet[tag] -= 1
        if self.skipping:
            self.depth -= tag == self.skipping
            if not self.depth:
                self.skipping = ""
            return
        if tag in BLOCK_TAGS:
            self.flush()
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.heading = False
        elif tag == "a":
            self.link = None
        if tag in CONTAINERS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    if tag != "span" and tag not in BLOCK_TAGS:
                        self.flush()
                    del self.open[k:]
                    if self.link is not None and len(self.open) < self.link:
                        self.link = None
                    break


def described(found: list[tuple[str, int, int, bool, bool, bool]]) -> list[tuple[float, ...]]:
    """FEATURES of the blocks of a page."""
    density = [(0, 0.0)] + [(b[1], b[2] / b[1]) for b in found] + [(0, 0.0)]
    has = any(b[4] and not b[3] for b in found)
    return [(*density[k + 1], *density[k], *density[k + 2], float(b[3]), float(b[4]), float(has), float(b[5])) for k, b in enumerate(found)]


def main_texts(pages: list[str | None]) -> list[str]:
    blocks = [Blocks(page).found if page else [] for page in pages]
    rows = [row for found in blocks for row in described(found)]
    chosen = iter((shares(trained(), np.array(rows, float)) >= 0.5).tolist() if rows else [])
    return ["\n\n".join([b[0] for b in found if next(chosen)]) for found in blocks]


def extract_text(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns, text and n_chars (long)."""

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(carry)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"]
                )

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry) + ", text string, n_chars long"
    return map_batches(pages.select(*carry, pages[html].alias("_html")), run, schema)
