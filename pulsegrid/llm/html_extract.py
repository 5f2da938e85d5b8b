"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every element and text run is a node with features of its subtree (density, links, punctuation), attributes, depth and
siblings.  The trees are fitted on a bounded sample of pages (``SAMPLE`` pages in order of a checksum) whose markup names its parts
(article, nav, aside, class names); each sampled page is learned twice, once as it is and once with its names blanked, so
that pages without telling names are judged by structure.  Decoding gives every node in or out so that the summed log
probabilities are largest under one rule: nothing inside a node that is out is in.  The kept text runs, in page order, make the text.

A null or empty page has an empty text.  If the sample has no page with named parts, nodes are judged by their names alone.
Repeated rows give repeated results; nulls in page_id and url pass through.
Pages of any length are parsed whole.  Other columns, whatever their names, are not read.  An empty table gives an empty table.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage

from .dom import AGAINST, BLOCKS, FOR, Page
from .text import slices

#: Pages that the trees are fitted on, number and depth of the trees.
SAMPLE, TREES, DEPTH = 400, 12, 4
_OUT_TAGS = frozenset("nav aside footer form header menu button dialog".split())


def named_out(page: Page, k: int, within: bool) -> bool:
    """Whether a node's own name says that it isn't main text; a header inside the article holds its title."""
    tag, words = page.tag[k], page.tokens[k]
    return (tag in _OUT_TAGS and not (within and tag == "header")) or any(w in AGAINST for w in words) and not any(w in FOR for w in words)


def weak_labels(page: Page) -> np.ndarray | None:
    """In and out by the names in the markup; None when no node is named as the main text."""
    n = len(page.tag)
    marked = [k for k in range(n) if page.tag[k] == "article"] or [k for k in range(n) if page.tag[k] == "main" or "main" in page.tokens[k]] \
        or [k for k in range(n) if any(w in FOR for w in page.tokens[k])]
    if not marked:
        return None
    inside, out, marks = np.zeros(n, bool), np.zeros(n, bool), set(marked)
    for k in range(1, n):
        p = page.parent[k]
        inside[k] = inside[p] or k in marks
        out[k] = out[p] or named_out(page, k, bool(inside[p]))
    label = inside & ~out
    for k in np.flatnonzero(label)[::-1]:
        p = page.parent[k]
        while p >= 0 and not label[p]:
            label[p] = True
            p = page.parent[p]
    return label if label.any() else None


def _blank(page: Page) -> Page:
    """The page with telling tags and attributes taken away."""
    page.tokens = [()] * len(page.tag)
    page.tag = ["div" if t in _OUT_TAGS or t in ("article", "main", "section") else t for t in page.tag]
    return page


def _examples(batches):
    for batch in batches:
        rows, labels = [], []
        for source in batch.column("html").to_pylist():
            page = Page(source)
            label = weak_labels(page)
            if label is not None:
                rows += [page.features(), _blank(page).features()]
                labels += [label, label]
        if rows:
            x = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(float)), pa.list_(pa.float64())), pa.array(np.concatenate(labels).astype(float))], ["x", "label"])


def _walk(node, out: list) -> int:
    """Copy a fitted tree into rows (feature, threshold, left, right, value)."""
    k = len(out)
    out.append(None)
    if node.subtreeDepth() == 0:
        out[k] = (0, np.inf, k, k, node.prediction())
    else:
        split = node.split()
        out[k] = (split.featureIndex(), split.threshold(), _walk(node.leftChild(), out), _walk(node.rightChild(), out), 0.0)
    return k


class Trees:
    """Fitted trees as arrays."""

    def __init__(self, model):
        self.weights, self.trees = list(model.treeWeights), []
        for tree in model.trees:
            rows: list = []
            _walk(tree._call_java("rootNode"), rows)
            f, t, left, right, v = zip(*rows)
            self.trees.append((np.array(f), np.array(t), np.array(left), np.array(right), np.array(v)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, (f, t, left, right, v) in zip(self.weights, self.trees):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = np.where(x[rows, f[at]] <= t[at], left[at], right[at])
            total += weight * v[at]
        return 2 * total


def fit(pages: DataFrame) -> Trees | None:
    """Trees from a bounded sample of pages; None without usable examples."""
    sample = pages.where("html is not null").select("html").orderBy(F.xxhash64("html")).limit(SAMPLE)
    rows = sample.mapInArrow(_examples, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    rows = cut_lineage(rows.coalesce(4))
    if rows.select("label").distinct().count() < 2:
        return None
    return Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, stepSize=0.3, cacheNodeIds=False).fit(rows))


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The best assignment of in (True) and out in which nothing inside an out node is in; the root is in."""
    log_in, log_out = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    best_in, all_out = log_in[:], log_out[:]
    for k in range(len(parent) - 1, 0, -1):
        p = parent[k]
        best_in[p] += max(best_in[k], all_out[k])
        all_out[p] += all_out[k]
    kept = np.zeros(len(parent), bool)
    kept[0] = True
    for k in range(1, len(parent)):
        kept[k] = kept[parent[k]] and best_in[k] > all_out[k]
    return kept


def blocks(page: Page, kept: np.ndarray) -> list[str]:
    """Kept text runs joined into blocks: a block element ends the block before it and the one inside it."""
    out: list[list[str]] = [[]]
    line: list[int] = []                                              # open block elements around the last node
    for k in range(1, len(page.tag)):
        tag = page.tag[k]
        while line and line[-1] != page.parent[k] and not _within(page, k, line[-1]):
            line.pop()
            out.append([])
        if tag in BLOCKS:
            out.append([])
            line.append(k)
        elif tag == "br":
            out[-1].append(" ")
        elif tag == "#" and kept[k]:
            out[-1].append(page.text[k])
    return [b for b in (" ".join("".join(parts).split()) for parts in out) if b]


def _within(page: Page, k: int, top: int) -> bool:
    while k > top:
        k = page.parent[k]
    return k == top


def _extract(shared):
    def run(batches):
        trees = shared.value
        for batch in batches:
            for piece in slices(batch, "html"):
                texts, pages = [], [Page(s or "") for s in piece.column("html").to_pylist()]
                if trees is not None:
                    size = np.cumsum([0, *(len(p.tag) for p in pages)])
                    odds = trees.log_odds(np.concatenate([p.features() for p in pages]))
                for k, page in enumerate(pages):
                    if trees is None:
                        mine = np.array([-4.0 if named_out(page, j, False) else 1.0 for j in range(len(page.tag))])
                    else:
                        mine = odds[size[k]:size[k + 1]]
                    texts.append("\n".join(blocks(page, decode(page.parent, mine))))
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages))
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shared), f"{kinds}, text string, n_chars long")
