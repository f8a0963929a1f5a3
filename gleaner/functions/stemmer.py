"""The published Snowball stemmer for Russian as a column expression; `stem` is the plain version that tests hold it against."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import CYRILLIC, let, split_tokens

VOWELS = "аеиоуыэюя"
# Endings of the published algorithm. A group (after) only counts behind а or я.
GERUND_AFTER, GERUND = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE_AFTER, PARTICIPLE = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
VERB_AFTER = "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split()
VERB = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split()
NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()


def _regions(word: str) -> tuple[int, int]:
    m = re.search(f"[{VOWELS}]", word)
    rv = m.end() if m else len(word)
    at = 0
    for _ in range(2):
        m = re.search(f"[{VOWELS}][^{VOWELS}]", word[at:])
        at = at + m.end() if m else len(word)
    return rv, at


def _cut(word: str, rv: int, plain, after=()) -> str | None:
    """The word without the longest ending of either group that lies in the region; None without one."""
    best = None
    for ending in plain:
        if word.endswith(ending) and len(word) - len(ending) >= rv and (best is None or len(ending) > best):
            best = len(ending)
    for ending in after:
        at = len(word) - len(ending)
        if word.endswith(ending) and at - 1 >= rv and word[at - 1] in "ая" and (best is None or len(ending) > best):
            best = len(ending)
    return None if best is None else word[: len(word) - best]


def stem(word: str) -> str:
    """The stem of a word of а-я; any other token as it is."""
    if not re.fullmatch("[а-я]+", word):
        return word
    rv, r2 = _regions(word)
    out = _cut(word, rv, GERUND, GERUND_AFTER)
    if out is None:
        word = next((w for w in (_cut(word, rv, ("ся", "сь")),) if w is not None), word)
        out = _cut(word, rv, ADJECTIVE)
        if out is not None:
            cut = _cut(out, rv, PARTICIPLE, PARTICIPLE_AFTER)
            out = out if cut is None else cut
        else:
            out = next((w for w in (_cut(word, rv, VERB, VERB_AFTER), _cut(word, rv, NOUN)) if w is not None), word)
    word = out
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    for ending in ("ость", "ост"):
        if word.endswith(ending) and len(word) - len(ending) >= r2:
            word = word[: -len(ending)]
            break
    if word.endswith("ейше") and len(word) - 4 >= rv:
        word = word[:-4]
    elif word.endswith("ейш") and len(word) - 3 >= rv:
        word = word[:-3]
    if word.endswith("нн") and len(word) - 1 > rv:
        return word[:-1]
    if word.endswith("ь") and len(word) > rv:
        return word[:-1]
    return word


def _ending(plain, after=()) -> str:
    """A pattern of the longest ending of either group; those of `after` count behind а or я."""
    return f"(?:{'|'.join(plain)}{'|(?<=[ая])(?:' + '|'.join(after) + ')' if after else ''})$"


def stem_column(word: Column) -> Column:
    """The stem of a word of а-я; any other word as it is.

    Endings are cut from what follows the first vowel; a region that begins later is checked by length.
    """

    def cut(part: Column, pattern: str) -> Column:
        return F.regexp_replace(part, F.lit(pattern), F.lit(""))

    def verb_or_noun(rest: Column) -> Column:
        return let(cut(rest, _ending(VERB, VERB_AFTER)), lambda v: F.when(v != rest, v).otherwise(cut(rest, _ending(NOUN))))

    def inflected(rest: Column) -> Column:
        adjective = let(cut(rest, _ending(ADJECTIVE)), lambda a: F.when(a != rest, cut(a, _ending(PARTICIPLE, PARTICIPLE_AFTER))).otherwise(verb_or_noun(rest)))
        return adjective

    def first(part: Column) -> Column:
        return let(cut(part, _ending(GERUND, GERUND_AFTER)), lambda g: F.when(g != part, g).otherwise(let(cut(part, "(?:ся|сь)$"), inflected)))

    def rest(w: Column, part: Column) -> Column:
        head = F.char_length(w) - F.char_length(part)
        late = F.regexp_extract(w, f"^.*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]", 0)
        begin = F.when(late == "", F.char_length(w)).otherwise(F.char_length(late))
        out = let(cut(first(part), "и$"), lambda x: let(cut(x, "ость?$"), lambda y: F.when(head + F.char_length(y) >= begin, y).otherwise(x)))
        last = let(cut(out, "ейше?$"), lambda x: F.when(x.endswith("нн"), cut(x, "н$")).otherwise(cut(x, "ь$")))
        return F.concat(F.left(w, head), last)

    return let(word, lambda w: F.when(w.rlike("^[а-я]+$"), let(cut(w, f"^[^{VOWELS}]*[{VOWELS}]?"), lambda part: rest(w, part))).otherwise(w))


def tokenize(text: Column) -> Column:
    """The stems of a text's tokens; without a Cyrillic letter these are the tokens."""
    return F.when(text.rlike(CYRILLIC), F.transform(split_tokens(text), stem_column)).otherwise(split_tokens(text))


def stemmed(tokens: DataFrame, column: str = "token") -> DataFrame:
    """The rows with column replaced by its stem."""
    return tokens.withColumn(column, stem_column(F.col(column)))
