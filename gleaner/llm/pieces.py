"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All words of a batch that aren't known yet lie end to end in one flat array of symbols. A round finds the best rank of any
adjacent pair in each word (a segmented minimum), merges all places of that rank at once, leftmost first where they
overlap, and closes the gaps; words without a pair left are taken out. That is the order in which a queue by (score, place)
would merge, but for symbols whose merged result can at once be part of a pair of the same or a better rank: of those a
round merges the leftmost alone. Decoding gathers the pieces' bytes by id.

A word ends where no piece of the vocabulary goes on, so no merge is lost at its end (`Pieces` checks that of every piece).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes

BLANK = "▁"
#: Where a text may be cut into words, the finest first; blanks lead the word that follows.
CUTS = (rb" *[A-Za-z\xc3-\xdf\x80-\xbf]+| *(?:[^A-Za-z\x80-\xff \n\t]+|[\xc2\xe0-\xff][\x80-\xbf]+)+|[\n\t]+| +", rb" *[^ \n\t]+|[\n\t]+| +", rb" *[^ ]+| +")
NONE = np.int32(2**31 - 1)


class Pieces:
    """A byte-fallback BPE model without normalisation beyond the leading blank; words met are remembered up to a bound."""

    def __init__(self, path: str, most_words: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.byte = np.full(n, -1, np.int16)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[i] = int(self.names[i][3:5], 16)
        if sp.normalize(" x  Ａ\n ") != f"{BLANK}{BLANK}x{BLANK}{BLANK}Ａ\n{BLANK}" or (self.byte >= 0).sum() != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: only models of byte fallback and a leading blank, without other normalisation, are encoded here")
        self.byte_ids = np.empty(256, np.int32)
        self.byte_ids[self.byte[self.byte >= 0]] = np.flatnonzero(self.byte >= 0)
        normal = [i for i in range(n) if i != self.unknown and not self.control[i] and self.byte[i] < 0]
        self._pairs({self.names[i]: i for i in normal}, {self.names[i]: -sp.get_score(i) for i in normal})
        spelt = [self.names[i].replace(BLANK, " ").encode() for i in normal]
        # for each cut, a piece that it would break rules it out
        self.cut = next(c for c in map(re.compile, CUTS) if all(len(c.findall(s)) == 1 for s in spelt))
        self._surfaces(sp)
        self.most_words, self.words = most_words, {}

    def _pairs(self, ids: dict[str, int], costs: dict[str, float]) -> None:
        """Symbols are ids, or numbers from n on for single characters that only occur inside of pieces. For each pair that can be merged, by its key: the result, its rank, and whether the leftmost alone may be merged in a round."""
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - set(ids)):
            symbols[c] = self.n + len(symbols)
        self.base = np.int64(max(symbols.values(), default=0) + 1)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        self.of_char[ord(" ")] = self.of_char[ord(BLANK)]
        # neighbours inside of any piece; between all others a word may be cut further
        self.near = np.unique([self._key(self.of_char[ord(a)], self.of_char[ord(b)]) for p in ids for a, b in zip(p, p[1:])])
        ranks = {c: r for r, c in enumerate(sorted(set(costs.values())))}
        rows = [(symbols[p[:k]] * int(self.base) + symbols[p[k:]], i, ranks[costs[p]]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, made, rank = (np.array(c, np.int64) for c in zip(*sorted(rows)))
        # the best rank of a pair that a piece is part of, against the piece's own
        best, own = np.full(self.base, NONE, np.int64), np.full(self.base, -1, np.int64)
        for side in np.divmod(keys, self.base):
            np.minimum.at(best, side, rank)
        own[made] = rank
        self.keys, self.made, self.rank = keys, made.astype(np.int32), rank.astype(np.int32)
        self.alone = best[made] <= own[made]
        # runs of blanks: how far they can be cut off in whole pieces
        self.blanks = max((len(p) for p in ids if set(p) == {BLANK}), default=0)
        self.blank_run = ids.get(BLANK * self.blanks)

    def _surfaces(self, sp) -> None:
        """The bytes that each id stands for, end to end."""
        said = []
        for i, name in enumerate(self.names):
            said.append(b"" if self.control[i] else sp.decode([i]).encode() if i == self.unknown else bytes([self.byte[i]]) if self.byte[i] >= 0 else name.replace(BLANK, " ").encode())
        self.said_length = np.array([len(s) for s in said], np.int64)
        self.said_start = np.cumsum(self.said_length) - self.said_length
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def _key(self, left, right):
        return np.int64(1) * left * self.base + right

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows of the pair table, -1 for pairs that nothing is made of."""
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1).astype(np.int32)

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, lengths of words) once no pair is left; starts: where each word starts, none of them empty."""
        key = self._key(symbols[:-1], symbols[1:])
        apart = (self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] != key) | (symbols[:-1] < 0) | (symbols[1:] < 0)
        cut = np.append(True, apart)
        cut[starts] = True
        word = np.cumsum(cut) - 1  # of the parts between cuts
        n = int(word[-1]) + 1
        own = word[starts]
        pair = np.full(len(symbols), -1, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        pair[inside] = self.look_up(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(heads, len(word)))
            best = np.minimum.reduceat(rank, heads)
            live = np.repeat(best < NONE, sizes)
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, pair, rank = symbols[live], word[live], pair[live], rank[live]
                sizes, best = sizes[best < NONE], best[best < NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # of places next to each other every other one, from the left
            first = np.append(True, np.diff(at) > 1)
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            lead = np.append(True, word[at][1:] != word[at][:-1])
            at = at[lead | ~np.repeat(np.logical_or.reduceat(self.alone[pair[at]], np.flatnonzero(lead)), np.diff(np.append(np.flatnonzero(lead), len(at))))]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            at = at - np.arange(len(at))  # one gap before each place that follows
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(symbols)]
                pair[i] = np.where(word[i] == word[i + 1], self.look_up(symbols[i], symbols[i + 1]), -1)
            if len(symbols) and at[-1] == len(symbols) - 1:
                pair[-1] = -1
        symbols, word = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.add.reduceat(np.bincount(word, minlength=n), own)

    def learn(self, words: list[bytes]) -> None:
        """Encode words (blanks as they stand in the text) and remember their ids, as little-endian 32-bit numbers."""
        texts, front, most = words, {}, 4 * self.blanks
        if self.blanks and (long := [i for i, w in enumerate(words) if w[:most] == b" " * most]):
            # a long run of blanks gives its longest piece again and again from the left; its end is left to the rounds
            texts = list(words)
            for i in long:
                front[i] = (len(words[i]) - len(words[i].lstrip(b" "))) // self.blanks - 3
                texts[i] = words[i][front[i] * self.blanks :]
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        lengths = np.add.reduceat((raw & 0xC0 != 0x80).astype(np.int64), np.cumsum(sizes) - sizes)
        points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -points.astype(np.int32) - 1, symbols)
        symbols, sizes = self.merged(symbols, np.cumsum(lengths) - lengths)
        flat, ends = symbols.astype("<i4").tobytes(), np.cumsum(sizes)
        starts = ends - sizes
        bounds = (4 * np.append(starts, ends[-1])).tolist()
        self.words.update(zip(words, map(flat.__getitem__, map(slice, bounds[:-1], bounds[1:]))))
        for i in np.flatnonzero(np.logical_or.reduceat((symbols < 0) | (symbols >= self.n), starts)).tolist():
            self.words[words[i]] = self._fallback(symbols[starts[i] : ends[i]])
        for i, cut in front.items():
            self.words[words[i]] = np.full(cut, self.blank_run, "<i4").tobytes() + self.words[words[i]]

    def _fallback(self, symbols: np.ndarray) -> bytes:
        """Characters without a piece become the ids of their bytes."""
        if not hasattr(self, "chars"):
            self.chars = {int(self.of_char[c]): chr(c) for c in np.flatnonzero(self.of_char >= self.n)}
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if 0 <= s < self.n else self.byte_ids[list((chr(-s - 1) if s < 0 else self.chars[s]).encode())].tolist()
        return np.array(out, "<i4").tobytes()

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty ones."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in self._slices(texts):
            all_ = set().union(*(words for _, words in group))
            fresh = all_ - self.words.keys()
            if len(self.words) + len(fresh) > self.most_words:
                self.words.clear()
                fresh = all_
            if fresh:
                self.learn(list(fresh))
            for i, words in group:
                out[i].append(b"".join(map(self.words.__getitem__, words)))
        return [np.frombuffer(b"".join(x), "<i4") for x in out]

    def _slices(self, texts: list[bytes | None], size: int = 1_000_000):
        """Lists of (text's number, words) of about `size` bytes; long texts are cut before a blank that begins a word."""
        group, total = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            text, at = b" " + _valid(text).replace(_BLANK, b" "), 0  # the mark itself is a blank, too
            while at < len(text):
                end = len(text)
                if end - at > size and (found := _WORD_STARTS.search(text, at + size)):
                    end = found.end() - 1
                group.append((i, self.cut.findall(text, at, end)))
                total, at = total + end - at, end
                if total >= size:
                    yield group
                    group, total = [], 0
        if group:
            yield group

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are joined to characters (U+FFFD for each that belongs to none), the leading blank goes."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id that the model doesn't have")
        ids = ids[~self.control[ids]]
        if not len(ids):
            return ""
        lengths = self.said_length[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.said_start[ids] - (ends - lengths), lengths)
        raw = self.said[at].tobytes()
        head = 1 if self.byte[ids[0]] < 0 and ids[0] != self.unknown and self.names[ids[0]][0] == BLANK else 0
        try:
            return raw[head:].decode()
        except UnicodeDecodeError:
            pass
        single = self.byte[ids] >= 0
        edges = np.flatnonzero(np.append(True, single[1:] != single[:-1]))
        bounds = [*(ends[edges] - lengths[edges]).tolist(), len(raw)]
        return "".join(_characters(raw[a:b]) if single[k] else raw[a:b].decode() for k, a, b in zip(edges, bounds, bounds[1:]))[head:]


_BLANK = BLANK.encode()
_WORD_STARTS = re.compile(rb"[^ ] ")


def _valid(text: bytes) -> bytes:
    try:
        text.decode()
    except UnicodeDecodeError:
        return _characters(text).encode()
    return text


def _characters(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each single byte that no character can be made of."""
    out, i = [], 0
    while i < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, part: int = 64) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no ids. Equal rows are encoded each by itself. path: the model's file, on every machine.
    Texts of any length are encoded whole; what a worker holds is one batch of texts, their ids and a bounded table of words.
    """

    def run(batches):
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            for i in range(0, batch.num_rows, part):
                some = batch.slice(i, part)
                found = model.encode_all(as_bytes(some.column(1)))
                offsets = np.cumsum([0, *map(len, found)])
                values = pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text", part: int = 64) -> DataFrame:
    """The other columns of rows and, in place of the ids, the text that they stand for. Null ids give null, an id that the model lacks an error."""
    others = [c for c in rows.columns if c != ids]
    names = [*others, text]

    def run(batches):
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            for i in range(0, batch.num_rows, part):
                some = batch.slice(i, part)
                lists = some.column(len(others))
                said = [model.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(others)], pa.array(said, pa.string())], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{text}` string"])
    return rows.select(*others, ids).mapInArrow(run, schema)
