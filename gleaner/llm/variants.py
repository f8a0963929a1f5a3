"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters, so all anagrams share it, and two words that differ by one
letter more, less or exchanged have keys that differ by a value of one letter or the difference of two. That is joined
as an equality: each word gives its key, and the keys with the value of each of its letters taken off. A key less a
letter that equals another word's whole key is an addition or removal, two that equal each other an exchange. The join
verifies the order of letters with a bounded edit distance. Where very many words share a key, the words without the
letter at each of its places are joined too, so that only words that match elsewhere meet.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are sums modulo this prime, so no length of word makes them overflow.
MODULUS = 2**61 - 1


def spelt_words(docs: DataFrame, least: int = 7, one_in: int = 31) -> DataFrame:
    """word, n: how often each word of `least` code points or more stands in the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered. Where one_in divides the crc32 of `doc_id:word`,
    the code point crc32 % length is left out. A null doc_id counts as an empty one; null texts have no words.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select(F.translate("run", UPPER, LOWER).alias("run"), "id")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    rows = rows.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def power(letter):
    """The value of a letter."""
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def near_words(words: DataFrame, crowd: int = 48) -> DataFrame:
    """word, n, word2, n2 for words (word, n; each word once) of edit distance 1, in both orders.

    crowd: keys that more rows share are joined by place as well (`placed`); either way gives the same rows.
    """
    letters = F.split("word", "")
    keyed = words.select("word", "n", letters.alias("l")).withColumn("key", F.aggregate("l", F.lit(0).cast("long"), lambda a, c: (a + power(c)) % MODULUS)).withColumn("size", F.size("l"))
    whole = keyed.select("key", "size", F.lit(None).cast("string").alias("less"), "word", "n")
    less = keyed.select("key", "size", F.explode(F.array_distinct("l")).alias("less"), "word", "n")
    less = less.select(F.pmod(F.col("key") - power(F.col("less")), F.lit(MODULUS)).alias("key"), (F.col("size") - 1).alias("size"), "less", "word", "n")
    rows = checkpoint(whole.union(less))
    crowded = rows.groupBy("key", "size").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("key", "size", F.lit(True).alias("crowded"))
    rows = checkpoint(rows.join(crowded, ["key", "size"], "left"))
    verified = (F.col("word") != F.col("word2")) & (F.levenshtein("word", "word2", 1) == 1)

    def other(t: DataFrame, *names: str) -> DataFrame:
        return t.select(*names, F.col("less").alias("less2"), F.col("word").alias("word2"), F.col("n").alias("n2"))

    few = rows.where("crowded is null")
    # two whole keys are anagrams of each other, which are not near
    found = few.join(other(few, "key", "size"), ["key", "size"]).where("less is not null or less2 is not null").where(verified)
    pair = ("word", "n", "word2", "n2")
    many = rows.where("crowded")
    exchanged, longer = placed(many.where("less is not null"))
    by = ["key", "size", "place", "rest"]
    same_place = exchanged.join(other(exchanged, *by), by).where(verified)
    by = ["key", "size", "rest"]
    grown = longer.join(other(many.where("less is null").withColumn("rest", F.xxhash64("word")), *by), by).where(verified)
    return found.select(*pair).union(same_place.select(*pair)).union(grown.select(*pair)).union(grown.select("word2", "n2", "word", "n"))


def placed(less: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of words with a letter taken off, by each place of that letter: (with place and hash of the rest, with the hash alone, each rest once)."""
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("less"))
    out = less.withColumn("place", F.explode(places)).withColumn("rest", F.xxhash64(F.concat(F.expr("substring(word, 1, place - 1)"), F.expr("substring(word, place + 1)"))))
    return out, out.dropDuplicates(["key", "size", "less", "word", "rest"])


def group_variants(docs: DataFrame, least: int = 7, least_n: int = 2, times: int = 10, crowd: int = 48) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `least` code points that occurs `least_n` times or more.

    docs: doc_id, text; others are ignored. Two words are near if they differ by one inserted, deleted or replaced code
    point. form: the near word that occurs most often (ties: the first in code-point order), where it does at least
    `times` as often as the word; root: where the forms end that lead on from it. Null and empty texts have no words,
    repeated rows count each time, no rows give none.
    """
    words = checkpoint(spelt_words(docs, least).where(F.col("n") >= least_n))
    best = F.min(F.struct((-F.col("n2")).alias("n"), F.col("word2").alias("word"))).alias("best")
    per = near_words(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.col("best.n") <= -times * F.col("n")
    rows = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    rows = checkpoint(rows)
    # each form occurs `times` as often as what leads to it, which bounds the length of a chain; jumps double
    steps = math.log(max(rows.agg(F.max("n")).first()[0] or 1, times), times)
    links = rows.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        on = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        links = checkpoint(links.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to")))
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
