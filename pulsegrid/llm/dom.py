"""A small, forgiving tree of an HTML page: elements and text runs in page order, with features for each."""
from __future__ import annotations

import html
import re
import zlib

import numpy as np

#: Elements without content, with raw content, and those that begin a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body html aside nav footer header form".split())
#: Words of class, id and role that speak for and against main text.
AGAINST = frozenset("ad ads adv advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus dock footer form "
                    "header hidden legal login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup privacy promo recommend recommended "
                    "related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar trending widget".split())
FOR = frozenset("article articlebody content entry main post story".split())
TAGS = "article aside div footer form h1 header li main nav p section table ul a b".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Nodes in page order; node 0 is the root.  A text run has tag '#' and its decoded text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.text, self.depth = ["#root"], [-1], [()], [""], [0]
        self._read(source)

    def _add(self, tag: str, parent: int, tokens=(), text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append(text)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tag) - 1

    def _words(self, top: int, text: str) -> None:
        if text:
            self._add("#", top, (), html.unescape(text) if "&" in text else text)

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                self._words(stack[-1], source[at:])
                return
            self._words(stack[-1], source[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in SCOPE and tag not in SCOPE:
                        break
                continue
            if tag in RAW:
                if not m[3].endswith("/>"):
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            closes = {"p"} if tag in CLOSES_P else CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1) if closes else ():
                name = self.tag[stack[k]]
                if name in closes:
                    del stack[k:]
                    break
                if name in SCOPE:
                    break
            node = self._add(tag, stack[-1], tokens(m[3]) if "=" in m[3] else ())
            if tag not in VOID and not m[3].endswith("/>"):
                stack.append(node)

    def features(self) -> np.ndarray:
        """One row for each node; see NAMES."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.array([len(t) for t in self.text], float)
        words = np.array([len(t.split()) for t in self.text], float)
        marks = np.array([len(_PUNCTUATION.findall(t)) for t in self.text], float)
        element = np.array([t != "#" for t in self.tag], float)
        linked, inside = np.zeros(n), np.zeros(n, bool)
        against, favour = (np.array([sum(w in s for w in t) for t in self.tokens], float) for s in (AGAINST, FOR))
        above_against, above_for = against.copy(), favour.copy()
        for k in range(1, n):
            p = self.parent[k]
            inside[k] = inside[p] or self.tag[k] == "a"
            above_against[k] += above_against[p]
            above_for[k] += above_for[p]
        linked[inside] = own[inside]
        total = np.stack([own, words, marks, linked, element, (np.array(self.tag) == "p").astype(float)])
        for k in range(n - 1, 0, -1):
            total[:, self.parent[k]] += total[:, k]
        chars, n_words, n_marks, n_linked, n_tags, n_p = total
        up = np.maximum(parent, 0)
        siblings, place, gathered = np.zeros(n), np.zeros(n), np.zeros(n)
        for k in range(1, n):
            place[k] = siblings[self.parent[k]]
            siblings[self.parent[k]] += 1
            gathered[self.parent[k]] += chars[k]
        seen = np.cumsum(own) - own
        around = np.maximum(siblings[up], 1)
        hashed = np.zeros((8, n))
        for k, t in enumerate(self.tokens):
            for w in t:
                hashed[zlib.crc32(w.encode()) % 8, k] += 1
        named = np.array(self.tag)
        columns = [np.array(self.depth, float), np.log1p(chars), np.log1p(n_words), n_marks / (n_words + 1), n_linked / (chars + 1), chars / (n_tags + 1), np.log1p(n_tags), np.log1p(n_p),
                   chars / (chars[0] + 1), chars / (gathered[up] + 1), np.log1p(gathered[up] / around), np.log1p(around), place / around, seen / (chars[0] + 1), n_linked[up] / (chars[up] + 1),
                   np.log1p(chars[up]), np.log1p(n_p[up]), against, favour, above_against - against, above_for - favour, element]
        return np.stack([*columns, *hashed, *[named == t for t in TAGS], *[named[up] == t for t in TAGS]], axis=1).astype(np.float32)


def tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and itemprop."""
    found = [a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)]
    return tuple(w.lower() for value in found for w in _PART.findall(value))
