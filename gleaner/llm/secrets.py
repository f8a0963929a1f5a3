"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find candidates and their places. Candidate values of any shape are hashed and counted by the distinct
repositories (sources) and owners (what stands before a source's first slash; the whole source without one) that hold
them: a value with many owners or in many repositories is a copied example, one that stays with fewer is a live-looking
credential. `docs` counts the documents that hold a value, each once; it is reported, but as copies of a document say
nothing about who else has a value, it doesn't enter the verdict, nor does a value's randomness. The base spans are reported
whatever their verdict; the counts decide about the spans that the method adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, join_frequent, let, marked, running, unused

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"
# Candidates of the method: long runs of key characters that mix letters and digits, whatever stands before them.
LONG = r"[A-Za-z0-9_\-]{32,}"
KINDS = ("assign", "access", "hex", "owned")


def _places(text: str, pattern: str, part: int) -> str:
    """Array of (s, e, v) of all matches: start, end (code points) and the match. A few regex passes over texts that match."""
    gaps = f"slice(split({text}, {pattern}, -1), 1, size(h))"
    ends = running(f"zip_with({gaps}, h, (x, y) -> char_length(x) + char_length(y))")
    values = "h" if part == 0 else f"regexp_extract_all({text}, {pattern}, {part})"
    places = f"zip_with(zip_with(h, {values}, (x, y) -> named_struct('h', x, 'v', y)), {ends}, (x, e) -> named_struct('s', cast(e - char_length(x.h) as int), 'e', e, 'v', x.v))"
    return let(f"regexp_extract_all({text}, {pattern}, 0)", "h", places)


def _uncovered(spans: str, others: str) -> str:
    """SQL: those of the spans that overlap none of the others, by one sort of all ends of spans and starts of others."""
    events = f"array_sort(concat(transform({spans}, x -> named_struct('p', x.e, 't', 0, 's', x.s, 'e', x.e, 'v', x.v)), transform({others}, x -> named_struct('p', x.s, 't', 1, 's', x.s, 'e', x.e, 'v', x.v))))"
    reach = running("transform(t, x -> if(x.t = 1, x.e, 0))", "greatest({}, {})")
    kept = f"filter(zip_with(t, {reach}, (x, r) -> if(x.t = 0 and r <= x.s, named_struct('s', x.s, 'e', x.e, 'v', x.v), null)), x -> x is not null)"
    return let(events, "t", f"array_sort({kept})")


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, source and the candidate places of every document: assign, access, hex, long, and those of long that overlap none of the others, lone."""
    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "coalesce(text, '') text", "xxhash64(text) text_hash")
    for name, pattern, part in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("long", LONG, 0)):
        p = _lit(pattern)
        none = "cast(array() as array<struct<s: int, e: int, v: string>>)"
        out = out.withColumn(name, F.when(F.expr(f"text rlike {p}"), F.expr(_places("text", p, part))).otherwise(F.expr(none)))
    out = out.withColumn("assign", F.expr("filter(assign, x -> char_length(x.v) >= 6)"))
    out = checkpoint(out.withColumn("long", F.expr(r"filter(long, x -> x.v rlike '[0-9]' and x.v rlike '[A-Za-z]')")).drop("text").withColumn("row", F.monotonically_increasing_id()))
    return out.withColumn("lone", F.expr(f"if(size(long) > 0, {_uncovered('long', 'concat(assign, access, hex)')}, long)"))


def scan_secrets(docs: DataFrame, copied_owners: int = 3, copied_repositories: int = 6) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found array<struct<s, e, kind, owners, repositories, docs, verdict>>, text_hash.

    docs: doc_id, text, source; others are ignored. A null text is empty, a null source is an owner of its own.
    Every base span stays. A further candidate becomes an `owned` span if its value is live and no base span overlaps it.
    verdict: `copied` from copied_owners distinct owners or copied_repositories distinct repositories on, else `live`.
    Repeated rows of one doc_id are told apart, and each counts in docs. A value may be as frequent as it likes: its counts are
    aggregated before the shuffle, and those of very frequent values are broadcast to the rows.
    """
    found = find(docs)
    any_ = found.where("size(assign) + size(access) + size(hex) + size(long) > 0")
    repository = F.coalesce("source", F.lit("\x00"))
    values = F.expr("array_distinct(transform(concat(assign, access, hex, long), x -> xxhash64(x.v)))")
    holds = any_.select(repository.alias("repository"), F.explode(values).alias("h")).groupBy("h", "repository").agg(F.count("*").alias("c"))
    counts = holds.groupBy("h").agg(F.count_distinct(F.regexp_extract("repository", "^[^/]*", 0)).alias("owners"), F.count("*").alias("repositories"), F.sum("c").alias("docs"))
    counts = checkpoint(counts.withColumn("count", F.col("docs")))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    kinds = [F.expr(f"transform({name}, x -> named_struct('s', x.s, 'e', x.e, 'k', {k}, 'v', x.v))") for k, name in enumerate(("assign", "access", "hex", "lone"))]
    spans = any_.select("row", F.explode(F.concat(*kinds)).alias("x")).select("row", "x.s", "x.e", "x.k", F.xxhash64("x.v").alias("h"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    rated = join_frequent(spans, counts, "h", "count", total).withColumn("verdict", F.when(copied, "copied").otherwise("live")).where("k < 3 or verdict = 'live'")
    lists = rated.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", "owners", "repositories", "docs", "verdict"))).alias("every"))
    out = found.select("row", "doc_id", "text_hash").join(lists, "row", "left")
    none = "filter(cast(array() as array<struct<s: int, k: int, e: int, owners: bigint, repositories: bigint, docs: bigint, verdict: string>>), x -> false)"
    out = out.withColumn("every", F.coalesce("every", F.expr(none))).withColumn("base", F.expr("filter(every, x -> x.k < 3)"))
    names = "element_at(array({}), x.k + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    joined = "array_join(transform({}, x -> concat(" + names + ", ':', x.s, ':', x.e)), ',')"
    return out.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))),
        F.sha2(F.expr(joined.format("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format("every")).alias("spans"),
        F.expr(f"transform(every, x -> named_struct('s', x.s, 'e', x.e, 'kind', {names}, 'owners', x.owners, 'repositories', x.repositories, 'docs', x.docs, 'verdict', x.verdict))").alias("found"),
        "text_hash",
    )


def redacted(text: str, spans: str, mark: str) -> str:
    """SQL: the text with each of the spans (s, e; sorted) replaced by mark, overlapping ones together.

    The text is cut before every 64th span first, as reaching a place in a string takes time in proportion to it.
    """
    reach = running(f"transform({spans}, x -> x.e)", "greatest({}, {})")
    steps = f"zip_with(zip_with({spans}, r, (x, m) -> named_struct('s', x.s, 'm', m)), concat(array(0), slice(r, 1, size(r) - 1)), (x, p) -> named_struct('s', x.s, 'm', x.m, 'p', p))"
    groups = "transform(sequence(0, (size(t) - 1) div 64), k -> slice(t, 64 * k + 1, 64))"
    pieces = f"array_join(transform(g, x -> if(x.s >= x.p, concat(substring(c, x.p - g[0].p + 1, x.s - x.p), {mark}), '')), '')"
    part = let(f"substring({text}, g[0].p + 1, if(k = size(gs) - 1, 2147483647, element_at(g, -1).m - g[0].p))", "c", f"concat({pieces}, substring(c, element_at(g, -1).m - g[0].p + 1))")
    return let(reach, "r", let(steps, "t", let(groups, "gs", f"array_join(transform(gs, (g, k) -> {part}), '')")))


def redact(docs: DataFrame, mark: str, **options) -> DataFrame:
    """The rows of docs, every span of their text that scan_secrets reports replaced by mark.

    Spans that overlap are replaced together. Rows without spans, null texts included, stay as they are, and are not shuffled.
    """
    id_, hash_, found, maybe, sign = unused(docs, "id", "hash", "found", "maybe", "sign")
    spans = scan_secrets(docs, **options).where("size(found) > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.expr("array_sort(transform(found, x -> struct(x.s, x.e)))").alias(found))
    spans = checkpoint(spans.dropDuplicates([id_, hash_]))
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64("text"))
    seen = marked(keyed, spans, maybe, f"{id_}, {hash_}")
    few = seen.where(F.col(maybe)).withColumn(sign, F.lit(mark))
    i2, h2 = unused(few, "i2", "h2")
    spans = spans.withColumnsRenamed({id_: i2, hash_: h2})
    few = few.join(spans, F.col(id_).eqNullSafe(F.col(i2)) & (F.col(hash_) == F.col(h2)), "left")
    cut = F.when(F.col(found).isNotNull(), F.expr(redacted("text", found, sign))).otherwise(F.col("text"))
    return seen.where(~F.col(maybe)).select(docs.columns).union(few.withColumn("text", cut).select(docs.columns))
