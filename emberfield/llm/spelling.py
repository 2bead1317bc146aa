"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is the multiset of its letters, a binary vector over (letter, how many of them before). One inserted, deleted or
replaced letter moves that vector by at most two places. The places are dealt to PARTS parts, so at most two parts
differ and the rest agree: a signature for each choice of PARTS - 2 parts is shared by every such pair for at
least one choice. As words have six or more letters, one edit also leaves their first or their last three as they are, so each signature is keyed
twice with these; anagrams, which share all signatures, seldom meet then. Pairs with a key in common are joined and
verified by their edit distance. All of it is DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii

PARTS, APART = 5, 2
LEAST_LENGTH, LEAST_COUNT, EDGE = 6, 5, 3
# A form is at least so many times as frequent as its variant.
TIMES = 5
# One in so many (document, word) pairs has a letter dropped.
DROP = 199
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH letters or more that occur LEAST_COUNT times or more in all texts.

    A-Z is lower-cased. A null text has no words and a null id is an empty one. Counts are summed by task before the shuffle.
    """
    runs = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.pmod(h, F.lit(DROP)) == 0, short).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def signatures(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``key``, a row for each choice of PARTS - APART parts of the letters with the first and with the last letters."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    rows = words.select("word", "n", F.array_sort(letters).alias("letters"))
    places = F.transform("letters", lambda c, i: F.xxhash64(c, i - F.array_position("letters", c)))
    rows = rows.select("word", "n", places.alias("places"))
    # The places of a part are distinct, so their exclusive or names the set.
    part = lambda p: F.aggregate("places", F.lit(0).cast("long"), lambda acc, v: F.when(F.pmod(v, F.lit(PARTS)) == p, acc.bitwiseXOR(v)).otherwise(acc))
    rows = rows.select("word", "n", *[part(p).alias(f"p{p}") for p in range(PARTS)])
    edges = [F.concat(F.lit("^"), F.left("word", F.lit(EDGE))), F.concat(F.lit("$"), F.right("word", F.lit(EDGE)))]
    keys = [F.xxhash64(e, *[x for p in c for x in (F.lit(p), F.col(f"p{p}"))]) for e in edges for c in combinations(range(PARTS), PARTS - APART)]
    return rows.select("word", "n", F.explode(F.array(*keys)).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: words of ``words`` (word, n) that differ by exactly one inserted, deleted or replaced letter.

    Words are distinct and have LEAST_LENGTH letters or more. The join is an equi-join that adaptive execution can split; only
    verified pairs leave it, and a pair that shares several keys is reduced to one row.
    """
    keyed = signatures(words)
    one, two = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    apart = F.abs(F.char_length("a") - F.char_length("b")) <= 1
    pairs = one.join(two, "key").filter((F.col("a") < F.col("b")) & apart & (F.levenshtein("a", "b", 1) == 1))
    return pairs.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def follow(links: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, root): from each word along ``form`` to the last. Each round doubles the steps; chains must end.

    A form is TIMES as frequent as its word, so a chain has at most log(n) / log(TIMES) steps and few rounds are needed.
    """
    now = durable(links.select(F.col(word).alias("word"), F.col(form).alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("by"), F.col("root").alias("further"))
        moved = durable(now.join(ahead, now["root"] == ahead["by"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        now = moved.drop("went")
        if moved.filter("went").isEmpty():
            return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word of :func:`word_counts`: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest n (ties: the smallest), if that n is TIMES the word's or more, else null; ``root``
    is the last of the chain of forms, the word itself without one; ``n_near`` counts near words. An empty table, or one without
    such words, gives no rows; repeated rows count as often as they occur; other columns are not read.
    """
    words = durable(word_counts(docs, id_col, text_col))
    pairs = near_pairs(words)
    sides = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(sides).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    formed = F.col("best_n") >= TIMES * F.col("n")
    found = durable(found.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")))
    roots = follow(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
