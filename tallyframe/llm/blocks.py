"""HTML pages as sequences of leaf blocks with tag paths, and their feature vectors. Parsing costs
time and memory in proportion to the page, however broken or deep it is."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub "
                   "sup time tt u var wbr img".split())
#: Opening one of these closes an open one of the same group, up to the nearest container.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
          "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CONTAINERS = frozenset("html body div section article main aside nav header footer form ul ol dl table blockquote "
                       "figure fieldset".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]+)|(<)",
                    re.DOTALL)
# The same, but a quote in a tag is any other character.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>|([^<]+)|(<)", re.DOTALL)
#: Tags without an end, each looked for up to the end of the page, after which quotes are ignored.
BROKEN_TAGS = 16
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s ]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.IGNORECASE) for t in RAW}


# Markup that states that its content is not main text, and that it may be; further elements of HTML.
ASIDE = frozenset("<nav <header <footer <aside <form <button <select <option <dialog <menu <fieldset <figcaption "
                  "ad ads advert advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb "
                  "breadcrumbs sidebar widget related footer header masthead cookie cookies consent notice notices gdpr "
                  "comment comments reply replies respond disqus share social newsletter subscribe signup login search "
                  "popup modal pagination pager copyright toolbar skip".split())
MAIN = frozenset("content entry post story body".split())
ELEMENTS = (VOID | RAW | INLINE | CONTAINERS | frozenset(CLOSES) | frozenset(
    "h1 h2 h3 h4 h5 h6 pre thead tbody tfoot caption details summary address center label".split()))
#: Place of each known token in a path vector. Other words, which a site is free to choose, have none, so
#: that they can't pass for one that says something.
KNOWN = {t: k for k, t in enumerate(sorted(ASIDE | MAIN | {"<" + e for e in ELEMENTS}))}
PATH_DIM, WORD_DIM, EXTRA = -(-len(KNOWN) // 8) * 8, 32, 6
DIM = PATH_DIM + WORD_DIM + EXTRA


class Node:
    """An open element; its ancestors by reference, so that a path costs the same at any depth."""

    __slots__ = ("tag", "parent", "tokens", "bits", "depth", "stated")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...]):
        self.tag, self.parent, self.tokens, self.stated = tag, parent, tokens, None
        self.bits, self.depth = (parent.bits, parent.depth + 1) if parent else (0, 0)
        for t in tokens:
            if t in KNOWN:
                self.bits |= 1 << KNOWN[t]


@dataclass(slots=True)
class Block:
    node: Node                  # the innermost open element
    text: str
    linked: int                 # code points of the text inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Tokens of the open elements, outermost first."""
        nodes, at = [], self.node
        while at:
            nodes.append(at.tokens)
            at = at.parent
        return tuple(t for ts in reversed(nodes) for t in ts)


# First parts of class names that tell a state of the element, not what it holds.
STATES = frozenset("no not has have is with without hide hidden show".split())


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the names in class, id and role: each name by its words, but none
    of a name whose first word tells a state (``no-sidebar``). Those of the page as
    a whole (``html``, ``body``) say nothing of a block."""
    out = ["<" + tag]
    if "=" in attributes and tag not in ("html", "body"):
        for a, b, c in _NAMES.findall(attributes):
            for name in (a or b or c).lower().split():
                words = _WORD.findall(name)
                if len(words) == 1 or words and words[0] not in STATES:
                    out += words
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page with visible text, in page order: text between two boundaries
    of block elements (``br`` counts as one), references decoded, white space made one space.
    Scripts, styles, comments and markup give none."""
    out: list[Block] = []
    root = Node("", None, ())
    stack: list[Node] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    node = root
    linked = broken = 0
    page, at, token = page or "", 0, _TOKEN

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(node, text, linked))
            parts.clear()
        linked = 0

    def drop(k: int) -> None:
        """Closes the open elements from the ``k``-th on."""
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    while (m := token.match(page, at)) is not None:
        at = m.end()
        ends, tag, attributes, text, stray = m.groups()
        if stray and page[at:at + 1].isalpha():
            broken += 1
            token = _PLAIN if broken >= BROKEN_TAGS else token
            if page.find(">", at) < 0:                  # no tag ends any more: the rest is text
                text, at = page[at - 1:], len(page)
        if text or stray:
            text = html.unescape(text) if text else "<"
            if not parts:
                if not text.strip():
                    continue
                node = stack[-1] if stack else root
            parts.append(text)
            if open_["a"]:
                linked += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not ends:
            close()
            at = _RAW_END[tag].search(page, at).end()
            continue
        if tag not in INLINE:
            close()
        if ends:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                drop(k)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS:
            continue
        ended = CLOSES.get(tag, ("p",)) if tag in CLOSES or tag in CONTAINERS else ()
        if any(open_[t] for t in ended):
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k].tag
                if t in ended:
                    drop(k)
                    break
                if t in CONTAINERS:
                    break
        stack.append(Node(tag, stack[-1] if stack else root, _tokens(tag, attributes)))
        open_[tag] += 1
    close()
    return out


class Vectors:
    """Blocks of a page -> float32 matrix of tag paths, hashed words and layout."""

    def __init__(self, limit: int = 100_000):
        self.paths: dict[int, np.ndarray] = {}
        self.words: dict[str, int] = {}
        self.limit = limit

    def path(self, bits: int) -> np.ndarray:
        got = self.paths.get(bits)
        if got is None:
            if len(self.paths) >= self.limit:
                self.paths.clear()
            raw = np.frombuffer(bits.to_bytes(PATH_DIM // 8, "little"), np.uint8)
            got = self.paths[bits] = np.unpackbits(raw, bitorder="little").astype(np.float32)
        return got

    def word_ids(self, text: str) -> list[int]:
        ids, known = [], self.words
        for w in text.lower().split():
            i = known.get(w)
            if i is None:
                if len(known) >= self.limit:
                    known.clear()
                i = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM
            ids.append(i)
        return ids

    def page(self, found: list[Block]) -> np.ndarray:
        x = np.zeros((len(found), DIM), np.float32)
        for k, b in enumerate(found):
            x[k, :PATH_DIM] = self.path(b.node.bits)
            ids, n = self.word_ids(b.text), len(b.text)
            w = np.bincount(ids, minlength=WORD_DIM)
            x[k, PATH_DIM:PATH_DIM + WORD_DIM] = np.sqrt(w / max(len(ids), 1))
            x[k, -EXTRA:] = (np.log1p(n) / 8, min(b.linked / n, 1), k / len(found), len(ids) < 6,
                             b.text[-1] in ".!?…\"”»", min(b.node.depth, 40) / 20)
        return x
