"""Language of a text by multinomial naive Bayes over hashed character n-grams.

One pass sums, for each known language, how often its texts use each of BUCKETS hashed n-grams of 1 to 3 characters. The
logarithms of their shares form a matrix of BUCKETS x languages that is broadcast; a text's score for a language is
the log share of its documents plus the sum of the matrix over the n-grams of the whole text, in numpy per batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import pieces, text_bytes

LENGTHS, BITS = (1, 2, 3), 14
BUCKETS = 1 << BITS
SMOOTHING = 0.5
# BUCKETS x languages numbers are broadcast and held by each task; more languages are an error, as no such table of them exists.
MAX_LANGUAGES = 1 << 9
UNKNOWN = "und"
# Tasks' sums are added in so many groups before they go to the driver.
GROUPS = 16

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_SMALL = 0x600  # code points below have tables
_LETTER = np.array([chr(c).isalpha() for c in range(_SMALL)])
# Letters in lower case where that is one character; whatever is no letter becomes a space.
_FOLD = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else c if chr(c).isalpha() else 32 for c in range(_SMALL)], dtype=np.uint32)


def _letters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and which are letters."""
    low = np.minimum(points, _SMALL - 1)
    folded, letter = _FOLD[low], _LETTER[low]
    big = np.flatnonzero(points >= _SMALL)
    if len(big):
        kinds, at = np.unique(points[big], return_inverse=True)
        alpha = np.array([chr(int(c)).isalpha() for c in kinds])[at]
        folded[big], letter[big] = np.where(alpha, points[big], np.uint32(32)), alpha
    return folded, letter


def characters(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of pieces of a string column: number of the first text, bounds of the texts in characters, folded characters, letters."""
    offsets, data = text_bytes(texts)
    for i, j in pieces(offsets):
        part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        try:
            points = np.frombuffer(part.tobytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32)
            bounds = np.append(0, np.cumsum((part & 0xC0) != 0x80))[at]
        except UnicodeDecodeError:  # bytes that are no UTF-8 count one by one
            points, bounds = part.astype(np.uint32), at
        yield i, bounds, *_letters(points)


def grams(bounds: np.ndarray, folded: np.ndarray, letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams that hold a letter, and where each text's begin, for each length."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    for n in LENGTHS:
        if len(folded) < n:
            continue
        size = len(folded) - n + 1
        code, some = np.full(size, n, dtype=np.uint32) * _FACTORS[3], np.zeros(size, dtype=bool)
        for k in range(n):
            code += (folded[k: k + size] + np.uint32(1)) * _FACTORS[k]
            some |= letter[k: k + size]
        code ^= code >> np.uint32(15)
        code *= _FACTORS[1]
        some &= np.arange(n, n + size) <= end[:size]
        at = np.flatnonzero(some)
        yield (code[at] >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(at, bounds)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


SUMS = "lang string, docs long, counts binary"


def _sums(vectors: Iterator[tuple[str, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums by language, one row each; what a task holds is BUCKETS numbers for each language."""
    docs: dict[str, int] = {}
    counts: dict[str, np.ndarray] = {}
    for lang, n, v in vectors:
        docs[lang] = docs.get(lang, 0) + n
        counts[lang] = counts[lang] + v if lang in counts else v
        _check(len(docs))
    if docs:
        names = sorted(docs)
        yield pa.RecordBatch.from_arrays([
            pa.array(names), pa.array([docs[x] for x in names], pa.int64()), pa.array([zlib.compress(counts[x].tobytes(), 1) for x in names], pa.binary()),
        ], names=["lang", "docs", "counts"])


def _check(languages: int) -> None:
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is that column a language?")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def vectors():
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            names, own = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            _check(len(names))
            total = np.zeros((len(names), BUCKETS), dtype=np.int64)
            for first, bounds, folded, letter in characters(batch.column("text")):
                lang = own[first: first + len(bounds) - 1].astype(np.int64)
                for bucket, at in grams(bounds, folded, letter):
                    code = np.repeat(lang << BITS, np.diff(at)) + bucket
                    total += np.bincount(code, minlength=total.size).reshape(total.shape)
            docs = np.bincount(own, minlength=len(names))
            yield from ((names[k], int(docs[k]), total[k]) for k in range(len(names)))

    yield from _sums(vectors())


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sums((r["lang"], r["docs"], np.frombuffer(zlib.decompress(r["counts"]), np.int64)) for b in batches for r in b.to_pylist())


@dataclass
class Languages:
    names: list[str]
    prior: np.ndarray
    weights: np.ndarray  # BUCKETS x languages

    def judge(self, texts: pa.Array) -> pa.Array:
        """(lang_pred, score) of each text; score is the posterior of the language told."""
        told, score = np.full(len(texts), len(self.names)), np.zeros(len(texts))
        for first, bounds, folded, letter in characters(texts):
            n = len(bounds) - 1
            total = np.tile(self.prior, (n, 1))
            some = np.diff(np.append(0, np.cumsum(letter))[bounds]) > 0
            for bucket, at in grams(bounds, folded, letter):
                full = np.flatnonzero(np.diff(at) > 0)
                if len(full) and self.names:
                    total[full] += np.add.reduceat(self.weights[bucket], at[full], axis=0)
            if self.names and n:
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                told[first: first + n] = np.where(some, best, len(self.names))
                score[first: first + n] = np.where(some, sure, 0.0)
        return pa.StructArray.from_arrays([pa.array([*self.names, UNKNOWN]).take(pa.array(told)), pa.array(score)], names=["lang_pred", "score"])


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Sums over all documents that are not held out and have a language; a null text counts as an empty one of its language.

    Repeated rows count as often as they occur, an empty table gives a model that knows no language, and other columns are not read.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = rows.mapInArrow(_count, SUMS).repartition(GROUPS).mapInArrow(_add, SUMS).collect()  # GROUPS rows a language
    names = sorted({r["lang"] for r in sums})
    _check(len(names))
    docs_of, counts = np.zeros(len(names)), np.zeros((len(names), BUCKETS))
    for r in sums:
        k = names.index(r["lang"])
        docs_of[k] += r["docs"]
        counts[k] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    shares = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return Languages(names, np.log(docs_of / max(docs_of.sum(), 1.0)), np.ascontiguousarray(shares.T))


def tell_languages(docs: DataFrame, model: Languages, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language told and its posterior; own columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, as is any text where no language was learned. Of equal
    posteriors the first name counts. Texts are read whole, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x MAX_LANGUAGES numbers

    @F.arrow_udf("lang_pred string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        return shared.value.judge(texts)

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    rows = docs.select(*rest, judge(F.coalesce(F.col(text_col), F.lit(""))).alias("told language"))
    return rows.select(*rest, F.col("`told language`.lang_pred").alias(lang_out), F.col("`told language`.score").alias(score_out))
