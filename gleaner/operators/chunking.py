"""Cutting documents into chunks by length or by structure, and spans of chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 3  # characters of a pseudo-token where offsets are needed
TRIM = 3  # pseudo-tokens that a chunk too long loses beyond its cap: it is trimmed up to four times, each time to one less
RATIO = 3.2  # characters of a token where lengths are counted; the two differ, as in the data this must match


@dataclass(frozen=True)
class Config:
    name: str
    strategy: str = "length"
    size: int = 512
    overlap: float = 0.15
    heading: bool = True
    section: bool = True


# The named chunkings.
CONFIGS = (
    Config("base", "structure"), Config("size-256", "structure", 256), Config("size-1024", "structure", 1024), Config("overlap-0", "structure", overlap=0.0),
    Config("overlap-30", "structure", overlap=0.30), Config("no-heading", "structure", heading=False), Config("no-section", "structure", section=False), Config("by-length"),
)


def count_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / RATIO)).cast("int")


def windows(docs: DataFrame, size: int = 512, overlap: float = 0.15, step: int = STEP) -> DataFrame:
    """doc_id, position, char_start, char_end, text: windows of size tokens; the last one ends with the text.

    The rows of a text come from its length alone, so texts aren't copied before they are cut. Blank windows drop
    out and positions close up.
    """
    return _placed(_cut(docs, F.lit(size), F.lit(max(1, size - int(size * overlap))), step))


def _cut(docs: DataFrame, size: Column, hop: Column, step: int = STEP) -> DataFrame:
    """A row for each window of `size` tokens, one every `hop`: i, char_start, char_end, text, and the other columns of docs."""
    n = F.ceil(F.length("text") / step).cast("int")
    last = F.greatest(F.lit(0), F.ceil((n - size) / hop)).cast("int")
    at = docs.where(F.length("text") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("i") * hop * step
    at = at.withColumns({"char_start": start.cast("int"), "char_end": F.least(start + size * step, F.length("text")).cast("int")})
    return at.withColumn("text", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))


def _placed(cut: DataFrame) -> DataFrame:
    """Stripped windows that aren't blank, with their places in the document."""
    cut = cut.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return cut.select("doc_id", place.alias("position"), "char_start", "char_end", "text")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.format_string("%d#%04d", "doc_id", "position"))


def act_of_chunk(chunk: Column) -> Column:
    return F.substring_index(chunk, "#", 1)


# Only \n ends a line (flag d). Numbers are taken possessively: the same matches, and no stack for numbers of many parts.
_TOC, _UNIT = r"\.\s*\.\s*\.|\.{4,}", r"(?U)^(\d+(?:\.\d+)*+)\.\s+(?=\S)"
_CHAPTER, _ANNEX = r"(?Ud)^Глава\s+(\d+)\.?\s*(.*)$", r"(?Ud)^(Приложение(?:\s+\d+)?)\b\s*(.*)$"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _section(line: Column) -> Column:
    name = F.concat(F.lit("Глава "), F.regexp_extract(line, _CHAPTER, 1), F.lit(". "), F.regexp_extract(line, _CHAPTER, 2))
    rest = F.regexp_extract(line, _ANNEX, 2)
    annex = F.concat(F.regexp_extract(line, _ANNEX, 1), F.when(rest != "", F.concat(F.lit(". "), rest)).otherwise(""))
    return F.when(line.rlike(_CHAPTER), F.rtrim(F.rtrim(name, F.lit(_SPACES)), F.lit("."))).when(line.rlike(_ANNEX), annex)


@dataclass(frozen=True)
class Lines:
    """How lines are told apart: the patterns of a line of a table of contents, of one that opens a unit (group 1: its
    number) and of a text that isn't blank, and the section that a heading sets (null: the line is no heading)."""

    toc: str = _TOC
    unit: str = _UNIT
    solid: str = r"\S"
    section: Callable[[Column], Column] = _section


def parse_units(docs: DataFrame, lines: Lines = Lines()) -> DataFrame:
    """doc_id, unit, number, section, start, end, text: clauses and preambles of a text, line by line.

    Lines carry their offset; headings set the section, numbered lines open a unit, other lines join the open one
    (a running count of openings numbers the units). Lines of a table of contents join an open unit or drop out.
    """
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))
    toc = F.col("line").rlike(lines.toc)
    line = line.withColumn("head", F.when(~toc, lines.section(F.col("line"))))
    kind = F.when(F.col("head").isNotNull(), "h").when(toc, "t").when(F.col("line").rlike(lines.unit), "u").otherwise("p")
    line = line.withColumn("kind", kind)
    line = line.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    # what stood last among headings, units and plain lines: a plain line opens a unit after a heading or at the start
    previous = F.coalesce(F.last(F.when(F.col("kind") != "t", F.col("kind")), ignorenulls=True).over(before), F.lit("h"))
    line = line.withColumn("previous", previous)
    opens = (F.col("kind") == "u") | ((F.col("kind") == "p") & (F.col("previous") == "h"))
    line = line.withColumn("unit", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = line.where(~((F.col("kind") == "h") | ((F.col("kind") == "t") & (F.col("previous") == "h"))))
    found = body.groupBy("doc_id", "unit").agg(
        F.sort_array(F.collect_list(F.struct("n", "line", "kind", "section", "start"))).alias("rows")
    )
    first, last = F.col("rows")[0], F.element_at("rows", -1)
    text = F.array_join(F.col("rows.line"), "\n")
    out = found.select(
        "doc_id", "unit", F.when(first["kind"] == "u", F.regexp_extract(first["line"], lines.unit, 1)).otherwise("").alias("number"),
        first["section"].alias("section"), first["start"].alias("start"), (last["start"] + F.length(last["line"])).cast("int").alias("end"), text.alias("text"),
    )
    return out.where(F.col("text").rlike(lines.solid))


def header(kind: Column, number: Column, date: Column, title: Column, section: Column, most: Column) -> Column:
    """The heading line of a chunk; the title is cut to the room that is left in `most` tokens, or left out."""
    stem = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1000)), F.lit(" Банка России № "), number, F.lit(" от "), date)
    prefix = r"(?iU)^(Указание|Положение|Инструкция|Методические\s+рекомендации|Официальное\s+разъяснение)(\s+Банка\s+России)?\s*"
    name = F.btrim(F.regexp_replace(F.trim(title), prefix, ""), F.lit(' "«»'))
    tail = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(". "), section)).otherwise("")
    room = most - count_tokens(F.concat(stem, tail)) - 2
    cut = F.concat(F.regexp_replace(F.substring(name, F.lit(1), room * STEP), r"[ ,.;\-]+$", ""), F.lit("…"))
    name = F.when(F.ceil(F.length(name) / STEP) > room, cut).otherwise(name)
    return F.when(room <= 4, F.concat(stem, tail)).otherwise(F.concat(stem, F.lit(". "), name, tail))


def _heading(act: Column, section: Column, size: int) -> Column:
    """The heading of an act's chunks: two fifths of a chunk at most, so that the text gets the rest."""
    return header(*(act[c] for c in ("kind", "number", "date", "title")), section, F.lit(max(16, int(size * 0.4))))


def headed_windows(acts: DataFrame, size: int = 512, overlap: float = 0.15) -> DataFrame:
    """Like windows, each under its act's heading, whose tokens are taken off the budget. acts: doc_id, text, kind, number, date, title."""
    acts = acts.withColumn("head", F.concat(_heading(F.struct(*acts.columns), F.lit(""), size), F.lit("\n\n")))
    left = F.lit(size) - count_tokens(F.col("head"))
    acts = acts.select("doc_id", "text", "head", F.greatest(F.lit(32), left).alias("budget"), F.greatest(F.lit(1), left).alias("most"))
    cut = _cut(acts, F.col("budget"), F.greatest(F.lit(1), F.col("budget") - int(size * overlap)))
    over = F.ceil(F.length("text") / STEP) > F.col("most")
    kept = F.when(over, F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(0), F.col("most") - TRIM) * STEP)).otherwise(F.col("text"))
    cut = cut.withColumn("text", kept).withColumn("char_end", F.col("char_start") + F.length("text"))
    return _placed(cut.withColumn("text", F.concat("head", "text")))


def headed(units: DataFrame, acts: DataFrame, size: int = 512, section: bool = True) -> DataFrame:
    """The units with `head`, the heading of their act and section, and `base`, that of the act alone, for pack_units.

    acts: doc_id, kind, number, date, title. section: whether the heading names the section.
    """
    acts = acts.select("doc_id", F.struct("kind", "number", "date", "title").alias("act"))
    act, none = F.col("act"), F.lit("")
    both = units.join(acts, "doc_id")
    return both.withColumns({"head": _heading(act, F.col("section") if section else none, size), "base": _heading(act, none, size)}).drop("act")


def pack_units(units: DataFrame, size: int = 512, overlap: float = 0.15) -> DataFrame:
    """doc_id, position, section, units, char_start, char_end, text: clauses gathered into chunks within the budget.

    Units that carry headings (see headed) get them in front of every chunk, and the budget is what the heading of
    the act leaves of `size`, 32 at least. A chunk of more pseudo-tokens than its own heading leaves room for is cut TRIM below that.

    A chunk closes before the clause that doesn't fit or changes the section; its last clauses, as far as they fit
    into the overlap, open the next one (unless they are all of it). A clause beyond the budget is cut by windows.
    The choice depends on all clauses before, so each document is walked in order: its units are gathered into one row, where
    they lie already by document, and many documents go to Python at once.
    """
    has_head = "head" in units.columns
    each = F.struct("unit", "number", "section", "start", "end", "text", *(["head"] if has_head else []))
    base = F.first("base") if has_head else F.lit(None).cast("string")
    docs = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("units"), base.alias("base"))
    walk = _packed(size, int(size * overlap), has_head)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "base", "units").mapInArrow(walk, "doc_id long, position int, section string, units string, char_start int, char_end int, text string")


def _packed(size: int, keep: int, has_head: bool, part: int = 256):
    """The walk of pack_units over rows of doc_id, base, units, a few documents at a time."""

    def tokens(text: str) -> int:
        return max(1, int(len(text) / RATIO))

    def chunks(doc, base, units):
        out, buf, load = [], [], 0
        budget = max(32, size - tokens(base + "\n\n")) if has_head else size

        def emit(text, unit, label, start, end):
            prefix = unit["head"] + "\n\n" if has_head else ""
            most = max(1, size - tokens(prefix)) if prefix else size
            if -(-len(text) // STEP) > most:
                text = text[: max(0, most - TRIM) * STEP]
                end = start + len(text)
            if (full := (prefix + text).strip()):
                out.append((doc, len(out), unit["section"], label, start, end, full))

        def flush():
            nonlocal buf, load
            if not buf:
                return
            named = [u["number"] for u in buf if u["number"]]
            label = f"{named[0]}–{named[-1]}" if len(named) > 1 else "".join(named)
            emit("\n".join(u["text"] for u in buf), buf[0], label, buf[0]["start"], buf[-1]["end"])
            k, acc = len(buf), 0
            while k and acc + tokens(buf[k - 1]["text"]) <= keep:
                k -= 1
                acc += tokens(buf[k]["text"])
            buf, load = (buf[k:], acc) if k else ([], 0)

        for u in units:
            n = tokens(u["text"])
            if n > budget:
                flush()
                hop, pieces = max(1, budget - keep), -(-len(u["text"]) // STEP)
                for i in range(0, pieces, hop):
                    s, e = i * STEP, min((i + budget) * STEP, len(u["text"]))
                    emit(u["text"][s:e], u, u["number"], u["start"] + s, u["start"] + e)
                    if i + budget >= pieces:
                        break
                continue
            if buf and (load + n > budget or buf[0]["section"] != u["section"]):
                flush()
            buf.append(u)
            load += n
        flush()
        return out

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "position", "section", "units", "char_start", "char_end", "text"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for i in range(0, batch.num_rows, part):
                out = [row for doc in zip(*(c.to_pylist() for c in batch.slice(i, part).columns)) for row in chunks(*doc)]
                columns = zip(*out) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def chunk_stats(chunks: DataFrame, by: str, size: Column) -> DataFrame:
    n = count_tokens(F.col("text"))
    return chunks.groupBy(by).agg(F.count("*").alias("n_chunks"), F.percentile(n, 0.5).alias("median_tokens"), F.max(n).alias("max_tokens"), F.count_if(n > size).alias("over_size"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of the same document that share characters: a_id, b_id and the shared length.

    a, b: id, doc_id, char_start, char_end. The document is the equality key, so intervals only meet within one.
    """
    x = a.select(F.col("id").alias("a_id"), "doc_id", F.col("char_start").alias("s1"), F.col("char_end").alias("e1"))
    y = b.select(F.col("id").alias("b_id"), "doc_id", F.col("char_start").alias("s2"), F.col("char_end").alias("e2"))
    shared = F.least("e1", "e2") - F.greatest("s1", "s2")
    return x.join(y, "doc_id").where("s1 < e2 and s2 < e1").select("a_id", "b_id", "doc_id", "s1", "e1", "s2", "e2", shared.alias("shared"))


def parents(fine: DataFrame, base: DataFrame) -> DataFrame:
    """id, parent: for each fine span the base span with most shared characters (ties: first start, end), else the one that starts nearest."""
    w = Window.partitionBy("a_id").orderBy(F.desc("shared"), "s2", "e2", "b_id")
    best = overlapping(fine, base).withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("a_id").alias("id"), F.col("b_id").alias("parent"))
    rest = fine.join(best, "id", "left_anti").select("id", "doc_id", F.col("char_start").alias("s1"))
    w = Window.partitionBy("id").orderBy(F.abs(F.col("s2") - F.col("s1")), "s2", "e2", "b_id")
    near = rest.join(base.select(F.col("id").alias("b_id"), "doc_id", F.col("char_start").alias("s2"), F.col("char_end").alias("e2")), "doc_id")
    near = near.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", F.col("b_id").alias("parent"))
    return best.union(near)


def span_is_solid(chunks: DataFrame, docs: DataFrame, head: int = 60) -> DataFrame:
    """chunk_id, solid: whether the chunk's first characters stand in its span of the document."""
    text = docs.select("doc_id", F.col("text").alias("whole"))
    inside = F.contains(F.substring(F.col("whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")), F.substring("text", 1, head))
    return chunks.join(text, "doc_id").select("chunk_id", inside.alias("solid"))
