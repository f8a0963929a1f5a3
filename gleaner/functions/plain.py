"""Tokenizers as plain functions over lower-cased texts, for work that reads whole texts in Arrow batches.

Each gives what the column expression of the same name gives (tests hold them together); stems are remembered by word,
as a vocabulary is far smaller than its texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from gleaner.functions import stemmer, text

_TOKEN = re.compile(text.TOKEN.removeprefix("(?U)"))  # here classes are Unicode's anyway
_CYRILLIC = re.compile(text.CYRILLIC)
_STOPWORDS = frozenset(text.STOPWORDS)
#: What a byte of a text without Cyrillic letters is to tokens: itself, or a blank.
_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


class Stems(dict):
    LIMIT = 1_000_000

    def __missing__(self, word: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = stemmer.stem(word)
        return value


_STEMS = Stems()


def cyrillic(lowered: str) -> bool:
    return not lowered.isascii() and _CYRILLIC.search(lowered) is not None


def numbered(lowered: str) -> bool:
    """Whether a hyphen stands between a letter and a digit, as in all numbers of acts."""
    i = lowered.find("-")
    while i >= 0:
        a, b = lowered[i - 1 : i], lowered[i + 1 : i + 2]
        if (a.isdecimal() and b.isalpha()) or (a.isalpha() and b.isdecimal()):
            return True
        i = lowered.find("-", i + 1)
    return False


def split_tokens(lowered: str) -> list[str]:
    if cyrillic(lowered):
        return [t for t in (t.replace("ё", "е") for t in _TOKEN.findall(lowered)) if t not in _STOPWORDS]
    if numbered(lowered):
        return _TOKEN.findall(lowered)
    # only runs of a-z and 0-9 are left to be found
    return lowered.encode("utf-8", "replace").translate(_BYTES).decode("ascii").split()


def tokenize(lowered: str) -> list[str]:
    found = split_tokens(lowered)
    return [_STEMS[t] for t in found] if cyrillic(lowered) else found


def truncate_tokens(lowered: str, n: int = 6) -> list[str]:
    return [t[:n] for t in split_tokens(lowered)]


class Words(dict):
    """The tokens of each word between white space, remembered by word."""

    LIMIT = 500_000

    def __init__(self, tokens: Callable[[str], list[str]]):
        self.tokens = tokens

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.tokens(word)
        return value


def counted(lowered: str, tokens: Callable[[str], list[str]], words: Words) -> dict[str, int]:
    """How often a lower-cased text holds each token. No token reaches over white space, so words with a hyphen, of which numbers of acts are made, are taken apart once each.

    In texts with Cyrillic letters what becomes of a word depends on the text, so those are taken whole.
    """
    if cyrillic(lowered) or not numbered(lowered):
        return Counter(tokens(lowered))
    parts = lowered.split()
    counts = Counter(tokens(" ".join(w for w in parts if "-" not in w)))
    for word in parts:
        if "-" in word:
            counts.update(words[word])
    return counts


#: The plain version of a tokenizer that is a column expression.
PLAIN: dict[Callable, Callable[[str], list[str]]] = {stemmer.tokenize: tokenize, text.split_tokens: split_tokens, text.truncate_tokens: truncate_tokens}


def blanked(lowered: str, words: Words) -> tuple[bytes, bool]:
    """The tokens of `split_tokens` in order, with white space between them, for many texts to be split at once; whether the text has Cyrillic letters."""
    if cyrillic(lowered):
        return " ".join(split_tokens(lowered)).encode(), True
    if numbered(lowered):
        return " ".join(t for w in lowered.split() for t in words[w]).encode(), False
    return lowered.encode("utf-8", "replace").translate(_BYTES), False


def _stem(tokens):
    import pyarrow as pa

    return pa.array([_STEMS[t] for t in tokens.to_pylist()], pa.string())


def _head(tokens):
    import pyarrow.compute as pc

    return pc.utf8_slice_codeunits(tokens, 0, 6)


#: What a tokenizer makes of tokens of `split_tokens` (Arrow arrays of strings), in texts without Cyrillic letters and in those with them; None: the tokens themselves.
FORMS: dict[Callable, tuple[Callable | None, Callable | None]] = {stemmer.tokenize: (None, _stem), text.split_tokens: (None, None), text.truncate_tokens: (_head, _head)}
