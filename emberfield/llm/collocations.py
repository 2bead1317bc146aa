"""Phrases of two to four words that belong together, by best-first branch and bound.

Phrases grow from their prefixes. A phrase that begins with P, of first word w, occurs at most f(P) times, so it scores at
most floor(SCALE f(P) / (f(w) + f(P))): the bound of P. All single words have the highest bound and are grown at
once; then prefixes are grown in the order of their bounds, the best of each language first, in rounds that each take
ROUND_GROWTH times as many as before. All phrases that score at least the round's least bound are then known; a language
is settled when as many of them as are asked for survive, or when no prefix is left.

Each counting step is a pass over the texts of the languages not settled. Which n-grams a pass counts is told by bitmaps of
hashes, of a bounded size: a wrong hit costs a row that the join with exact counts drops again. Every count that enters a result is
of the words themselves; hashes alone count only the first, admissible guess at pairs (never too low).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.session import broadcast_if_small

from .common import durable
from .tokens import U64, Words, mix, split_words

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE, HELD_PERCENT = 2_000_000, 80
NO_LANGUAGE = "und"
# Prefixes of each language grown in the first round, as multiples of what is asked for, and how many times more in each further one.
FIRST_ROUND, ROUND_GROWTH = 8, 8
# Bitmaps have 16 bits for each hash up to this size (32 MB), from where wrong hits become more frequent.
LEAST_BITS, MOST_BITS = 16, 28
# Bytes of text and hashes that a task holds at once.
PIECE, HELD = 2 << 20, 1 << 20
SLICES = 64

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _BREAKS.copy()
_GAPS[[32, 9]] = True


@dataclass(frozen=True)
class Bitmap:
    """A set of hashes by their leading bits: everything in it is found, and a few other hashes."""

    bits: int
    data: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> U64(64 - self.bits)
        return (self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, key: str = "key") -> Bitmap:
    """Bitmap of a column of 64-bit hashes, built by Spark in blocks of 4 KB; at most 2^MOST_BITS bits reach the driver."""
    bits = int(np.clip(np.ceil(np.log2(max(keys.count(), 1) * 16)), LEAST_BITS, MOST_BITS))
    at = F.shiftrightunsigned(F.col(key), 64 - bits) + 1
    blocks = keys.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    data = np.zeros(max(4096, 1 << (bits - 3)), dtype=np.uint8)
    for r in blocks:
        start = (r["b"] - 1) * 4096
        data[start: start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(bits, data)


def _language_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray]:
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = next(split_words(pa.array([x.encode().hex() or "-" for x in names]))).hashes if names else np.zeros(0, U64)
    return coded.indices.to_numpy(), names, seeds


def _phrases(w: Words, at: np.ndarray, n: int) -> pa.Array:
    """Words of the n-grams at ``at``, one blank between them."""
    data = w.data.tobytes()
    cut = [data[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at + n - 1].tolist())]
    return pa.array([(b" ".join(x.split()) if n > 1 else x).decode("utf-8", "replace") for x in cut], pa.string())


def _flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    key, n = (np.concatenate(c) for c in zip(*held))
    key, to = np.unique(key, return_inverse=True)
    n = np.bincount(to, n, minlength=len(key)).astype(np.int64)
    for i in range(0, len(key), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(key[i: i + 100_000].view(np.int64)), pa.array(n[i: i + 100_000])], names=["key", "n"])


# A pass counts n-grams of ``size`` words for which each clause has a hit: (offset, words, name of a bitmap).
Clauses = Sequence[Sequence[tuple[int, int, str]]]


def _counter(size: int, clauses: Clauses, shared, named: bool, tail: bool):
    """Task that counts n-grams of ``size`` words by hash, or with their words; ``tail`` adds the hash of what follows the first word."""

    def found(w: Words, own: np.ndarray, maps: Mapping[str, Bitmap]) -> tuple[np.ndarray, np.ndarray, dict]:
        breaks = np.append(0, np.cumsum(_BREAKS[w.data]))
        doc = w.doc_of()
        apart = np.ones(len(doc), dtype=np.int64)
        apart[:-1] = (doc[1:] != doc[:-1]) | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
        later = np.append(0, np.cumsum(apart))
        at = np.arange(max(len(doc) - size + 1, 0))
        at = at[later[at + size - 1] == later[at]]  # no break between the first word and the last
        hashes: dict[tuple[int, int], np.ndarray] = {}

        def of(at: np.ndarray, offset: int, n: int) -> np.ndarray:
            return mix(w.grams(at + offset, n) ^ own[doc[at]], 31)

        for clause in clauses:
            hit = reduce(np.logical_or, [maps[name].has(of(at, offset, n)) for offset, n, name in clause])
            at = at[hit]
        hashes["key"] = of(at, 0, size)
        if tail:
            hashes["tail"] = of(at, 1, size - 1)
        return at, doc, hashes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        held, waiting = [], 0
        for batch in batches:
            own, names, seeds = _language_hashes(batch)
            for w in split_words(batch.column("text"), lower=True, gaps=_GAPS, size=PIECE):
                if not len(w.hashes):
                    continue
                lang = own[w.first: w.first + len(w.counts)]
                at, doc, hashes = found(w, seeds[lang], maps)
                key, first, n = np.unique(hashes["key"], return_index=True, return_counts=True)
                if not named:
                    held.append((key, n))
                    waiting += len(key)
                    if waiting > HELD:
                        yield from _flush(held)
                        held, waiting = [], 0
                    continue
                for i in range(0, len(key), 100_000):
                    some = first[i: i + 100_000]
                    columns = [
                        pa.array(names, pa.string()).take(pa.array(lang[doc[at[some]]])), _phrases(w, at[some], size),
                        pa.array(key[i: i + 100_000].view(np.int64)), pa.array(n[i: i + 100_000]),
                    ]
                    if tail:
                        columns.append(pa.array(hashes["tail"][some].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "key", "n", "tail"][: len(columns)])
        if held:
            yield from _flush(held)

    return work


def count_grams(docs: DataFrame, size: int, clauses: Clauses = (), maps: Mapping[str, Bitmap] | None = None, named: bool = True, tail: bool = False) -> DataFrame:
    """Of the n-grams of ``size`` words in ``docs`` (lang, text) that the clauses let through: (lang, phrase, key, f), with ``tail`` also
    the hash of what follows the first word; or, not ``named``, (key, f). Counts are summed by task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(maps or {}))
    schema = ("lang string, phrase string, key long, n long" if named else "key long, n long") + ", tail long" * tail
    rows = docs.mapInArrow(_counter(size, clauses, shared, named, tail), schema)
    more = [F.first("key").alias("key")] * named + [F.first("tail").alias("tail")] * tail
    return rows.groupBy(*(["lang", "phrase"] if named else ["key"])).agg(F.sum("n").alias("f"), *more)


def _ratio(a: Column, total: Column) -> Column:
    """floor(SCALE a / total), exactly: products of 64-bit counts need more than 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(total))


def _scored(grams: DataFrame, size: int, known: Mapping[int, DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each row of ``grams`` (lang, phrase, f): the cut of the lowest score, ties to the first."""
    words = F.split("phrase", " ")
    cuts, out = [], grams.select("lang", "phrase", F.col("f").alias("a"))
    for k in range(1, size):
        first, rest = known[k].select("lang", F.col("phrase").alias("first"), F.col("f").alias(f"l{k}")), known[size - k].select("lang", F.col("phrase").alias("rest"), F.col("f").alias(f"r{k}"))
        out = out.withColumn("first", F.array_join(F.slice(words, 1, k), " ")).withColumn("rest", F.array_join(F.slice(words, k + 1, size - k), " "))
        out = out.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).drop("first", "rest")
        cuts.append(F.struct(_ratio(F.col("a"), F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return out.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _bounded(grams: DataFrame, words: DataFrame) -> DataFrame:
    """``grams`` with ``bound``: no phrase that begins with one scores more."""
    first = words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("first_f"))
    rows = grams.withColumn("first", F.substring_index("phrase", " ", 1)).join(first, ["lang", "first"])
    return rows.withColumn("bound", _ratio(F.col("f"), F.col("first_f") + F.col("f"))).drop("first", "first_f")


def _unheld(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """``scored`` without phrases that lie in one a word longer with 100 f >= HELD_PERCENT a. That is enough: a phrase that
    is held by a longer one is held by each between them, which occurs at least as often."""
    words = F.split("phrase", " ")
    n = F.size(words) - 1
    parts = longer.filter(F.col("f") >= LEAST).select("lang", F.col("f"), F.explode(F.array(F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, F.lit(2), n), " "))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: c.cast("decimal(19,0)")
    held = wide(F.col("longer")) * F.lit(100) >= wide(F.col("a")) * F.lit(HELD_PERCENT)
    return scored.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~held).drop("longer")


def _next_floor(bounds: DataFrame, most: int) -> DataFrame:
    """(lang, least): the bound down to which about ``most`` prefixes of each language are grown, 0 where there are fewer.

    Bounds are counted in steps of a 32nd of an octave, so a language has a few hundred rows."""
    step = F.floor(F.log2(F.col("bound") + 1) * 32)
    steps = bounds.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), F.min("bound").alias("least"))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return steps.withColumn("so_far", so_far).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("so_far") >= most, F.col("least"))), F.lit(0)).alias("least"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends, these into words at blanks and tabs. f counts a phrase's
    occurrences within pieces, n the words of a language. Candidates have two to LONGEST words and f = a >= LEAST; their score is the
    least of floor(SCALE a / (l + r)) over the cuts into two parts that occur l and r times. A candidate that lies in a longer one with 100 f >= HELD_PERCENT a
    is dropped. Order: score and a descending, phrase ascending by bytes.

    A null text is empty, a null language is ``und``; repeated rows count as often as they occur; an empty table gives no rows;
    other columns are not read. Texts are counted whole, whatever their length.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = durable(count_grams(docs, 1))
    totals = durable(every.groupBy("lang").agg(F.sum("f").alias("n")))
    words = durable(every.filter(F.col("f") >= LEAST))
    maps = {"word": bitmap(words)}
    guesses = count_grams(docs, 2, [[(0, 1, "word")], [(1, 1, "word")]], maps, named=False).filter(F.col("f") >= LEAST)
    maps["pair"] = bitmap(durable(guesses))
    pairs = durable(count_grams(docs, 2, [[(0, 2, "pair")]], maps).filter(F.col("f") >= LEAST))
    known = {1: words, 2: pairs}
    scored2, bound2 = durable(_scored(pairs, 2, known)), durable(_bounded(pairs, words))
    open_ = docs.select("lang").distinct()
    results, most = [], FIRST_ROUND * top
    while True:
        least = broadcast_if_small(durable(_next_floor(bound2.join(open_, "lang", "left_semi"), most)))
        todo = docs.join(least, "lang", "left_semi")
        alive = lambda rows, by: rows.join(least, "lang").filter(F.col(by) >= F.col("least")).drop("least")  # noqa: B023, E731
        best2 = alive(scored2, "score")
        # Three words: what grows from prefixes, and what a good pair may lie in.
        now = {**maps, "grow": bitmap(alive(bound2, "bound")), "good": bitmap(best2.join(pairs.select("lang", "phrase", "key"), ["lang", "phrase"]))}
        triples = durable(count_grams(todo, 3, [[(0, 2, "grow"), (1, 2, "good")], [(0, 2, "pair")], [(1, 2, "pair")]], now).filter(F.col("f") >= LEAST))
        scored3 = durable(_scored(triples, 3, known))
        best3, grow3 = alive(scored3, "score"), alive(_bounded(triples, words), "bound")
        now |= {"grow": bitmap(grow3), "good": bitmap(best3.join(triples.select("lang", "phrase", "key"), ["lang", "phrase"]))}
        fours = durable(count_grams(todo, 4, [[(0, 3, "grow"), (1, 3, "good")], [(0, 2, "pair")], [(1, 2, "pair")], [(2, 2, "pair")]], now, tail=True).filter(F.col("f") >= LEAST))
        # Counts of the last three words of each; the first three were counted, or lie in no result.
        now["tail"] = bitmap(fours, "tail")
        tails = durable(count_grams(todo, 3, [[(0, 3, "tail")]], now).filter(F.col("f") >= LEAST))
        best4 = alive(_scored(fours, 4, {**known, 3: triples.unionByName(tails).dropDuplicates(["lang", "phrase"])}), "score")
        kept = durable(_unheld(best2, triples).unionByName(_unheld(best3, fours)).unionByName(best4))
        found = kept.groupBy("lang").agg(F.count("*").alias("found"))
        state = durable(least.join(found, "lang", "left").select("lang", ((F.col("least") == 0) | (F.coalesce("found", F.lit(0)) >= top)).alias("settled")))
        results.append(kept.join(broadcast_if_small(state.filter("settled")), "lang", "left_semi"))
        open_, most = state.filter("NOT settled").select("lang"), most * ROUND_GROWTH
        if open_.isEmpty():
            break
    # First the best of each slice of a language, so that no task sorts all that survived.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    slices = reduce(DataFrame.unionByName, results).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    best = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
