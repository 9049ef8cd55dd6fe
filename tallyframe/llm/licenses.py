"""Operator 7: licence scan with an Aho-Corasick automaton and a shunting-yard parser.

Words are lower-cased runs of a-z, 0-9 and non-ASCII characters. One automaton over the
normalised words finds notice phrases and identifier tags in a single pass, however many
there are. Behind an identifier tag the licence expression of the raw line (``MIT OR
(Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)``) is read by a shunting-yard
parser: ``WITH`` binds tighter than ``AND``, that tighter than ``OR``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases, further notice phrases, identifier tags.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {"gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
           "mozilla public license": "mpl", "bsd license": "bsd", "eclipse public license": "epl",
           "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
           "creative commons attribution": "cc-by", "public domain": "public-domain", "the unlicense": "unlicense",
           "all rights reserved": "proprietary"}
TAGS = ("spdx license identifier",)

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_NORMAL = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[tuple[str, ...]] | None:
    """Postfix form of a licence expression, as ("id", name) and ("op", name) tuples. Reading
    stops at the first token that can't continue it; None if what was read is no
    expression (no operand, an operator without its right side, an open parenthesis)."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if operand:
            if token == "(":
                stack.append(token)
                continue
            if token == ")" or low in PRECEDENCE:
                return None
            out.append(("id", low))
            operand = False
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(("op", stack.pop()))
            if not stack:
                break
            stack.pop()
        elif low in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(("op", stack.pop()))
            stack.append(low)
            operand = True
        else:
            break
    if operand or "(" in stack:
        return None
    return out + [("op", s) for s in reversed(stack)]


def evaluate(postfix: list[tuple[str, ...]]) -> list[frozenset[str]]:
    """The choices that an expression leaves, each a set of licences that apply together:
    ``or`` joins the choices of both sides, ``and`` combines them, ``with`` attaches an
    exception to its licence. There can be exponentially many; ``normal_form`` has as many
    names as the expression."""
    stack: list[list[frozenset[str]]] = []
    for kind, name in postfix:
        if kind == "id":
            stack.append([frozenset([name])])
            continue
        right, left = stack.pop(), stack.pop()
        if name == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif name == "and":
            stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
        else:
            stack.append([frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right])
    return stack[0]


def normal_form(postfix: list[tuple[str, ...]]) -> str:
    """The value of an expression as text: choices joined by ``|``, licences that apply together
    by ``+``, one within the other in brackets; operands are distinct and sorted."""
    marks = {"or": "|", "and": "+", "with": " with "}
    stack: list[tuple[str, set[str]]] = []

    def text(mark: str, parts: set[str], inside: bool) -> str:
        joined = mark.join(sorted(parts))
        return f"({joined})" if inside and len(parts) > 1 else joined

    for kind, name in postfix:
        if kind == "id":
            stack.append(("", {name}))
            continue
        mark, right, left = marks[name], stack.pop(), stack.pop()
        if name == "with":
            stack.append(("", {text(*left, True) + mark + text(*right, True)}))
            continue
        parts = left[1] if left[0] == mark else {text(*left, True)}
        parts.update(right[1] if right[0] == mark else [text(*right, True)])
        stack.append((mark, parts))
    return text(*stack[0], False)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, *TAGS):
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str, automaton: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, score)."""
    words = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
    padded = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else "  "
    base, labels, places, tagged, seen, count = set(), set(), [], False, 0, 0
    for end, phrase in automaton.iter(padded):
        start = end + 1 - len(phrase) - 2          # place of the space before the phrase
        if phrase in BASE:
            count += padded.count(" ", seen, start) if start >= seen else -padded.count(" ", start, seen)
            seen = start
            base.add(BASE[phrase])
            places.append(count)
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
        else:
            tagged = True
    expressions = []
    for m in _TAG.finditer(text) if tagged else ():
        postfix = parse_expression(m[1])
        if postfix:
            expressions.append(normal_form(postfix))
            labels.update(name for kind, name in postfix if kind == "id")
    labels |= base
    # A tag is a statement; a notice a strong sign; further places add little.
    score = 1.0 if expressions else round(1 - 0.3 / len(places), 6) if places else 0.5 if labels else 0.0
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), expressions, score)


SCHEMA = ("id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, expressions array<string>, score double")


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.float64()]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score"]
    for batch in batches:
        rows = [scan_text(t.as_py() or "", automaton) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score): one
    row per row of ``docs``. Labels are distinct, sorted and joined by commas; ``expressions``
    has the ``normal_form`` of each tag's expression.

    Null texts count as empty: no words, no labels, score 0. Overlapping places all count.
    Repeated rows are scanned alike; an empty table gives no rows."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_task, SCHEMA.format(id=d.schema["id"].dataType.simpleString()))
