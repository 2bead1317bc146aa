"""Word windows that occur more than once in a corpus, found from candidate keys and verified in full.

Two passes over the text. The first emits keys of candidate spans; spans whose key occurs once in the corpus are
out. The second hashes (96 bits) every window of the spans left; a window is covered if the same words also start
earlier. Before each shuffle a task keeps one row per key, so a key has at most one row per task whatever its
frequency, and rows travel packed as columns of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import OTHER, PLAIN, U64, Words, mix, split_words

# Rows a task gathers before it sums them up and passes them on.
FLUSH = 1 << 20
# Spans and starts on the way to their documents.
SPAN, START = [np.int64, np.int64, np.int32, np.int32], [np.int64, np.int64, np.int32]
# Stands for a missing id, so that missing ids come last.
NO_ID = (1 << 63) - 1
PACKED = "bucket int, blob binary"
SPANS = "id long, k long, spans binary"


def document_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """id and k: rows with equal id and text are one document; ``k``, 32 bits of a hash of the text, tells rows apart that share an id only."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.hash(text).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, text) of :func:`document_key`; a null text is empty."""
    id_, k = document_key(docs, id_col, text_col)
    return docs.select(id_.alias("id"), k.alias("k"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def _planes(column: np.ndarray) -> bytes:
    """Byte after byte of all values, so that the shuffle's compression finds what is alike."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket as one blob, in the order given: their number, then column after column."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=int)
    blobs = [b"".join([np.int64(b - a).tobytes(), *(_planes(c[a:b]) for c in columns)]) for a, b in zip(edges[:-1], edges[1:])]
    for i in range(0, len(blobs), 500):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]][i: i + 500], pa.int32()), pa.array(blobs[i: i + 500], pa.binary())], names=["bucket", "blob"])


def unpack(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for part, kind in zip(parts, kinds):
            size = n * np.dtype(kind).itemsize
            part.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, size, at).reshape(-1, n).T).view(kind).ravel())
            at += size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def slots(spark: SparkSession) -> list[int]:
    """A number for each shuffle partition that ``repartition`` sends there, so that each gets one bucket of blobs."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(40 * parts).select(F.col("id").cast("int").alias("n"))
    found = dict(numbers.groupBy(F.pmod(F.hash("n"), F.lit(parts)).alias("p")).agg(F.min("n").alias("n")).collect())
    return [found.get(p, p) for p in range(parts)]


def dealt(df: DataFrame, places: list[int]) -> DataFrame:
    """Blobs to the partitions of their buckets."""
    return df.repartition(len(places), F.get(F.array(*map(F.lit, places)), "bucket"))


def blobs_of(batches: Iterator[pa.RecordBatch]) -> list[bytes]:
    return [b for batch in batches for b in batch.column("blob").to_pylist()]


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def to_documents(ids: np.ndarray, ks: np.ndarray, values: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, k, values) packed by a bucket of documents."""
    bucket = mix(ids.view(U64) ^ (ks.view(U64) << U64(20)), 8) % U64(buckets)
    yield from pack(bucket.astype(np.int32), [ids, ks, *values])


def by_document(kinds: list):
    """Task that brings the rows of each document of its bucket together: (id, k, values packed)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ks, *values = unpack(blobs_of(batches), kinds)
        order = np.lexsort((ks, ids))
        ids, ks, values = ids[order], ks[order], [v[order] for v in values]
        edges = np.append(np.flatnonzero(changes(ids, ks)), len(ids)) if len(ids) else np.zeros(1, dtype=int)
        flat = np.stack(values, axis=1) if len(values) > 1 else values[0]
        for i in range(0, len(edges) - 1, 5000):
            e = edges[i: i + 5001]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[e[:-1]]), pa.array(ks[e[:-1]]), pa.array([flat[a:b].tobytes() for a, b in zip(e[:-1], e[1:])], pa.binary()),
            ], names=["id", "k", "spans"])

    return work


def documents(batches, n_list: bool) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list | None]]:
    for batch in batches:
        ids, ks = batch.column("id").to_numpy(), batch.column("k").to_numpy()
        lists = batch.column("spans").to_pylist() if n_list else None
        for w in split_words(batch.column("text")):
            part = slice(w.first, w.first + len(w.bounds) - 1)
            yield w, ids[part], ks[part], lists and lists[part]


CANDIDATE = [U64, np.int64, np.int64, np.int32, np.int32, np.uint8]


def emit_keys(keys: Callable[[Words], tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int):
    """Task of the first pass. ``keys`` gives for a piece of text spans of windows: first window, number of windows, key."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, ids, ks, start, count = (np.concatenate(c) for c in zip(*held))
        # Least hashes are small; mixed anew they spread evenly. 48 bits do: a key shared by chance only adds windows to verify.
        key = mix(key, 9) >> U64(16)
        order = np.argsort(key, kind="stable")
        first = changes(key[order])
        many = np.append(~first[1:], False)
        # One row per key asks whether others have it; the rest are known to be repeated and go anywhere.
        state = np.empty(len(key), dtype=np.uint8)
        state[order] = np.where(first, np.where(many, 1, 0), 2)
        # A bucket is a range of keys; keys are hashes, so equal ranges are evenly filled.
        spread = np.where(state < 2, key, mix(np.arange(len(key)).astype(U64), 1) >> U64(16))
        bucket = (spread >> U64(16)) * U64(buckets) >> U64(32)
        yield from pack(bucket.astype(np.int32), [key, ids, ks, start, count, state])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w, ids, ks, _ in documents(batches, False):
            start, count, key = keys(w)
            if not len(start):
                continue
            doc = np.searchsorted(w.bounds, start, side="right") - 1
            held.append((key, ids[doc], ks[doc], (start - w.bounds[doc]).astype(np.int32), count.astype(np.int32)))
            n += len(start)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return work


def repeated_keys(buckets: int):
    """Task that keeps the spans whose key has another row: keys are sorted and neighbours compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, ks, start, count, state = unpack(blobs_of(batches), CANDIDATE)
        asks = np.flatnonzero(state < 2)
        asks = asks[np.argsort(key[asks], kind="stable")]
        first = changes(key[asks])
        hit = state > 0
        hit[asks] |= ~first | np.append(~first[1:], False)[: len(first)]
        yield from to_documents(ids[hit], ks[hit], [start[hit], count[hit]], buckets)

    return work


WINDOWS = [U64, np.uint32, np.int64, np.int64, np.int32, np.uint8]


def emit_windows(window: int, buckets: int):
    """Task of the second pass: hashes of all windows of the candidate spans."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h1, h2, ids, ks, start = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((start, ks, ids, h2, h1))
        first = changes(h1[order], h2[order])
        lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        asks, later = np.empty(len(h1), dtype=bool), np.empty(len(h1), dtype=bool)
        asks[order] = first
        later[order] = (ids[order] != ids[lead]) | (ks[order] != ks[lead]) | (start[order] != start[lead])
        spread = np.where(asks, h1, mix(np.arange(len(h1)).astype(U64), 1)) % U64(buckets)
        use = asks | later
        yield from pack(spread[use].astype(np.int32), [h1[use], h2[use], ids[use], ks[use], start[use], later[use].astype(np.uint8)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w, ids, ks, lists in documents(batches, True):
            spans = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in lists]
            doc = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            flat = np.concatenate(spans).astype(np.int64)
            count = flat[:, 1]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.unique(np.repeat(w.bounds[doc] + flat[:, 0], count) + inner)
            doc = np.searchsorted(w.bounds, at, side="right") - 1
            held.append((w.grams(at, window, PLAIN), (w.grams(at, window, OTHER) >> U64(32)).astype(np.uint32), ids[doc], ks[doc], (at - w.bounds[doc]).astype(np.int32)))
            n += len(at)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return work


def covered_windows(buckets: int):
    """Task that keeps the first words of windows that also start earlier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, ids, ks, start, later = unpack(blobs_of(batches), WINDOWS)
        asks = np.flatnonzero(later == 0)
        asks = asks[np.lexsort((start[asks], ks[asks], ids[asks], h2[asks], h1[asks]))]
        first = changes(h1[asks], h2[asks])
        lead = asks[np.flatnonzero(first)[np.cumsum(first) - 1]]
        hit = later == 1
        hit[asks] = (ids[asks] != ids[lead]) | (ks[asks] != ks[lead]) | (start[asks] != start[lead])
        yield from to_documents(ids[hit], ks[hit], [start[hit]], buckets)

    return work


def covered(texts: DataFrame, window: int, keys: Callable) -> DataFrame:
    """Rows (id, k, spans): first words of the covered windows of each document that has any. ``texts`` is from :func:`identified`."""
    places = slots(texts.sparkSession)
    n = len(places)
    asked = dealt(texts.mapInArrow(emit_keys(keys, n), PACKED), places).mapInArrow(repeated_keys(n), PACKED)
    spans = dealt(asked, places).mapInArrow(by_document(SPAN), SPANS)
    windows = texts.join(spans, ["id", "k"]).select("id", "k", "text", "spans").mapInArrow(emit_windows(window, n), PACKED)
    late = dealt(windows, places).mapInArrow(covered_windows(n), PACKED)
    return dealt(late, places).mapInArrow(by_document(START), SPANS)
