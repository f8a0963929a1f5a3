"""License scans: an Aho-Corasick automaton finds phrases and identifier tags, a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all characters beyond ASCII; the
automaton runs over the words joined with single spaces, so a phrase matches wherever its words stand
consecutively, whatever stands between them. A second automaton finds the tags (SPDX-License-Identifier,
license-expression, license) in the text as it stands; where a colon or an equals sign and a licence expression (and / or /
with, parentheses) follow, the expression is parsed and its identifiers of the known families become labels; others
give none. What follows a plain `license:` counts only if it names a known family.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from gleaner.llm.common import as_bytes

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notice phrases of further licences and the labels that this operator adds for them.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-text",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by-text",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "artistic license": "artistic",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "open database license": "odbl",
    "zlib license": "zlib",
    "do what the fuck you want to public license": "wtfpl",
}
# Families of identifiers that an expression may name: start of the lower-cased identifier, up to a hyphen -> (label, permissive).
IDENTIFIERS = {
    "agpl": ("agpl", False), "lgpl": ("lgpl", False), "gpl": ("gpl", False), "mpl": ("mpl", False), "epl": ("epl", False),
    "eupl": ("eupl", False), "cddl": ("cddl", False), "osl": ("osl", False), "cecill": ("cecill", False), "odbl": ("odbl", False),
    "apache": ("apache", True), "bsd": ("bsd", True), "0bsd": ("bsd", True), "mit": ("mit", True), "isc": ("isc", True), "zlib": ("zlib", True),
    "cc0": ("cc0", True), "cc-by-nc-sa": ("cc-by-nc-sa", False), "cc-by-nc-nd": ("cc-by-nc-nd", False), "cc-by-nc": ("cc-by-nc", False),
    "cc-by-sa": ("cc-by-sa", False), "cc-by-nd": ("cc-by-nd", False), "cc-by": ("cc-by", True), "unlicense": ("unlicense", True),
    "bsl": ("bsl", True), "python": ("psf", True), "psf": ("psf", True), "artistic": ("artistic", True), "ofl": ("ofl", True), "wtfpl": ("wtfpl", True),
    "postgresql": ("postgresql", True), "ncsa": ("ncsa", True), "x11": ("x11", True), "ms-pl": ("ms-pl", True), "blueoak": ("blueoak", True), "odc-by": ("odc-by", True),
}
FIELD = b"license"
TAGS = (b"spdx-license-identifier", b"license-expression", b"license expression", FIELD)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
# An expression ends where a character stands that none has, the next tag's colon for one, so that no text is read often.
_AFTER = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9.+() \t-]*)")
_PART = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")


def family(identifier: str) -> tuple[str, bool] | None:
    name = identifier.lower()
    while name:
        if name in IDENTIFIERS:
            return IDENTIFIERS[name]
        name = name.rpartition("-")[0]
    return None


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's parts in postfix order; None if it isn't one. Text after a complete expression ends it."""
    out, ops, operand = [], [], True
    for part in _PART.findall(expression):
        low = part.lower()
        if operand:
            if part == "(":
                ops.append("(")
                continue
            if part == ")" or low in PRECEDENCE:
                return None
            out.append(part)
            operand = False
        elif low in PRECEDENCE:
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif part == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        else:
            break
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


@lru_cache(maxsize=10_000)
def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """(labels of the known identifiers, whether the expression as a whole can be met by permissive licences), or None.

    `or` leaves the choice, `and` needs both, `with` adds an exception to the licence on its left and keeps its label.
    """
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for part in postfix:
        if part in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if part == "with":
                stack.append(left)
            else:
                stack.append((left[0] | right[0], left[1] or right[1] if part == "or" else left[1] and right[1]))
        else:
            known = family(part)
            stack.append(({known[0]}, known[1]) if known else (set(), False))
    return stack[0]


def automaton():
    """(the automaton of phrases, over joined words; that of tags, over raw text)."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, "license": None, **BASE}.items():
        phrases.add_word(f" {phrase} ", (phrase, label))
    for tag in TAGS:
        tags.add_word(tag.decode(), tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def expressions(text: bytes, tags) -> list[str]:
    """The licence expressions that follow tags."""
    out, low = [], text.lower()
    for end, tag in tags.iter(low.decode("latin-1")):
        begin = end + 1 - len(tag)
        if begin and low[begin - 1 : begin].isalnum():
            continue
        if (found := _AFTER.match(text, end + 1)) and (value := evaluate(source := found[1].decode().strip())):
            if value[0] or tag != FIELD:
                out.append(source)
    return out


def scan(text: bytes | None, machine) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expression, permissive) of one text."""
    phrases, tags = machine
    words = text.translate(_TABLE).split() if text else []
    # the automaton's matches overlap by the space between neighbours, so every space stands once and is shared
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    begins, starts, base, labels, tagged, notices = None, [], set(), set(), False, 0
    for end, (phrase, label) in phrases.iter(joined) if words else ():
        if label is None:
            tagged = True
            continue
        labels.add(label)
        notices += 1
        if phrase in BASE:
            begins = begins or list(accumulate((len(w) + 1 for w in words), initial=1))
            base.add(label)
            starts.append(bisect_left(begins, end - len(phrase)))
    found = expressions(text, tags) if tagged else []
    values = [evaluate(x) for x in found]
    labels.update(*(v[0] for v in values))
    permissive = all(v[1] for v in values) if values else None
    score = 1 - 0.5**notices * (0.1 if values else 1)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found[0] if found else None, permissive


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permissive boolean"


def _scanned(batches):
    import pyarrow as pa

    machine = automaton()
    kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        columns = list(zip(*(scan(t, machine) for t in as_bytes(batch.column(1))))) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document (columns: SCHEMA); a single pass without a shuffle.

    docs: doc_id and text; others are ignored. A null or empty text has no words, no labels, a score of 0 and null
    word places; repeated rows are scanned each by itself. n_base counts all places of base phrases, first_word and
    last_word are the smallest and largest start among them. score grows with every notice found (1 - 2^-notices)
    and with a licence expression that parses. expression is the first such, permissive whether all can be met by
    permissive licences; null without one.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scanned, SCHEMA)
