"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows. A document's whole windows go out at once; its rest
goes to the window that it fits best. When none fits, the fullest window is filled up with the head of the
rest (if that head is long enough to be worth a cut) and emitted, and what remains opens a window. At its
end a partition fills its open windows up from each other; the one that then isn't full is merged with those of
other partitions as far as they fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEPARATOR, SPECIAL = 0, "<|endoftext|>"


def encoder(ranks_path: str, json_path: str):
    """text -> ids of the byte-level BPE vocabulary, with the document separator appended.

    json_path is the vocabulary of the tokenizers library, whose ids are the right ones. The rank file holds the same
    vocabulary and merges and gives the same ids (tests/llm compares them) four times as fast, but can fail: its pattern
    matcher runs out of stack on very long runs of blanks. Such texts go through the JSON file, which is only opened for them.
    The special token's string in a text becomes its id.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    code = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    slow: list[Tokenizer] = []

    def encode(text: str | None) -> np.ndarray:
        try:
            ids = code.encode(text, allowed_special={SPECIAL}, disallowed_special=()) if text else []
        except ValueError:
            slow[:] = slow or [Tokenizer.from_file(json_path)]
            ids = slow[0].encode(text, add_special_tokens=False).ids
        return np.array([*ids, SEPARATOR], "<u4")

    return encode


def pieces(parts: list[tuple]) -> list[tuple]:
    """(doc_id, start, length, crc32, doc_tokens, offset) of a window's parts (ids, doc_id, start, doc_tokens), in their order."""
    out, offset = [], 0
    for ids, doc, start, total in parts:
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, offset))
        offset += len(ids)
    return out


class Windows:
    """Open windows of one partition, found by the room they have left; they hold their ids until they close."""

    def __init__(self, size: int, open_windows: int, least_cut: int):
        self.size, self.most, self.least_cut = size, open_windows, least_cut
        self.rooms: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, ids: np.ndarray, doc):
        """Yields (number, pieces) of every window that this document closes."""
        total, at = len(ids), 0
        while total - at >= self.size:
            yield self.new(), pieces([(ids[at : at + self.size], doc, at, total)])
            at += self.size
        while at < total:
            rest = total - at
            k = bisect_left(self.rooms, (rest, -1))
            if k < len(self.rooms):
                yield from self.put(k, ids[at:], doc, at, total)
                return
            if len(self.rooms) < self.most:
                number = self.new()
                self.held[number] = [(ids[at:].copy(), doc, at, total)]
                insort(self.rooms, (self.size - rest, number))
                return
            room = self.rooms[0][0]
            if room >= self.least_cut:
                yield from self.put(0, ids[at : at + room], doc, at, total)
                at += room
            else:
                _, number = self.rooms.pop(0)
                yield number, pieces(self.held.pop(number))

    def put(self, k, ids, doc, start, total):
        room, number = self.rooms.pop(k)
        self.held[number].append((ids.copy(), doc, start, total))
        if room == len(ids):
            yield number, pieces(self.held.pop(number))
        else:
            insort(self.rooms, (room - len(ids), number))

    def leftovers(self):
        """(number, fill, pieces) of the windows that the open ones make when each is filled up from the next; only the last can have room."""
        parts, room = [], self.size
        for _, number in self.rooms:
            for ids, doc, start, total in self.held[number]:
                while len(ids):
                    parts.append((ids[:room], doc, start, total))
                    start, ids, room = start + len(parts[-1][0]), ids[room:], room - len(parts[-1][0])
                    if not room:
                        yield self.new(), self.size, pieces(parts)
                        parts, room = [], self.size
        if parts:
            yield self.new(), self.size - room, pieces(parts)


def merged(windows: list[tuple], size: int) -> list[tuple]:
    """Best-fit decreasing of (number, fill, pieces); a joined window keeps the number of its first part."""
    rooms: list[tuple[int, int]] = []
    out: list[list] = []
    for number, fill, pieces in sorted(windows, key=lambda w: (-w[1], w[0])):
        k = bisect_left(rooms, (fill, -1))
        if k == len(rooms):
            insort(rooms, (size - fill, len(out)))
            out.append([number, fill, list(pieces)])
            continue
        room, at = rooms.pop(k)
        base = size - room
        out[at][2] += [(*p[:5], p[5] + base) for p in pieces]
        out[at][1] += fill
        if room > fill:
            insort(rooms, (room - fill, at))
    return [tuple(w) for w in out]


def _packed(ranks_path: str, json_path: str, size: int, open_windows: int, least_cut: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, windows, base = encoder(ranks_path, json_path), Windows(size, open_windows, least_cut), TaskContext.get().partitionId() << 32

        def rows(closed, rest):
            flat = [(d, s, n, c, t, base + number, o) for number, pieces in closed for d, s, n, c, t, o in pieces]
            kinds = (pa.int64(),) * 7
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*flat) if flat else [[]] * 7, kinds)] + [pa.array([rest] * len(flat), pa.bool_())], names)

        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["open"]
        for batch in batches:
            closed = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                closed += windows.add(encode(text.as_py()), doc)
            yield rows(closed, False)
        last = list(windows.leftovers())
        yield rows([(n, p) for n, fill, p in last if fill == size], False)
        yield rows([(n, p) for n, fill, p in last if fill < size], True)

    return run


def _joined(size: int):
    def run(pdf):
        import pandas as pd

        windows = []
        for number, part in pdf.sort_values(["sequence_id", "offset"], kind="stable").groupby("sequence_id"):
            rows = part[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]].astype(object).itertuples(index=False, name=None)
            windows.append((number, int(part.length.sum()), list(rows)))
        flat = [(d, s, n, c, t, number, o) for number, _, pieces in merged(windows, size) for d, s, n, c, t, o in pieces]
        return pd.DataFrame(flat, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, ranks_path: str, json_path: str, size: int = 1024, open_windows: int = 64, least_cut: int = 16, group: int = 4096) -> DataFrame:
    """One row per piece of a document (columns: COLUMNS).

    ranks_path and json_path: the vocabulary as a rank file and as the JSON file of the tokenizers library (`encoder`).
    docs: doc_id and text; others are ignored. A null text counts as empty, so every row has at least the
    separator; rows with the same doc_id are packed each by itself, a null doc_id stays null. A sequence has at
    most `size` ids, offsets in it run gapless from 0, and the sequence ids are unique, not dense.
    Only the last window of each partition meets others in a second step: one task for each `group` partitions, with
    a few rows from each, so that step stays bounded however many partitions there are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = checkpoint(docs.mapInArrow(_packed(ranks_path, json_path, size, open_windows, least_cut), COLUMNS + ", open boolean"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    partition = F.shiftright("sequence_id", 32)
    last = pieces.where("open").withColumn("g", F.floor(partition / group)).groupBy("g").applyInPandas(_joined(size), COLUMNS)
    return pieces.where("not open").select(names).union(last.select(names))
