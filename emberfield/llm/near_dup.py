"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A table key is a pair (left, right) from two small collections of bands, so TABLES x TABLES tables cost
2 x BAND x TABLES minhashes instead of 2 x BAND x TABLES^2. Two texts are candidates if they agree on a left band, on
a right band, and on enough of all minhashes. At similarity 0.75 a pair misses all tables with probability 1.3e-7, and
falls below the required agreement with about 1e-6.

Texts with equal sets are one class. Rows that share a left band meet in a task, which matches the right bands and
emits a few edges per row, never all pairs. Candidates' components then bring full sets together, in blocks where
a component is large, and exact links give the final components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh
from .components import components
from .repeats import NO_ID, changes, document_key, identified
from .tokens import PLAIN, U64, Words, mix, range_sums, split_words

SHINGLE, PERCENT = 5, 75
BAND, TABLES, MINHASHES = 2, 20, 128
AGREE = 72  # of MINHASHES; a pair at similarity 0.75 agrees on 96 on average, with a deviation of 4.9
PAIRS_UP_TO = 8
BUCKET_BLOCK, SET_BLOCK = 1024, 128

_rng = np.random.default_rng(20_240_607)
FACTORS = (_rng.integers(0, 1 << 31, MINHASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint32)


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, and where each text's begin; a shorter text is one shingle."""
    at = w.windows(SHINGLE)
    doc = np.searchsorted(w.bounds, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    whole = mix(mix(range_sums(w.hashes, w.bounds[short], w.bounds[short + 1], PLAIN)) + w.counts[short].astype(U64), 3)
    h, doc = np.concatenate([w.grams(at, SHINGLE), whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = changes(doc, h)
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(w.bounds)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MINHASHES minima per set; sets are not empty."""
    x = (h >> U64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, MINHASHES), dtype=np.uint32)
    for i in range(MINHASHES):
        out[:, i] = np.minimum.reduceat(x * FACTORS[i] + SHIFTS[i], bounds[:-1])
    return out


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: set size, a 128-bit name of the set, keys of the left bands, and a byte of each minhash."""
    for batch in batches:
        ids, ks = batch.column("id").to_numpy(), batch.column("k").to_numpy()
        for w in split_words(batch.column("text"), lower=True):
            h, bounds = shingle_sets(w)
            size = np.diff(bounds)
            some = np.flatnonzero(size > 0)
            one, two = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            lefts, bytes_ = [[] for _ in size], [b"" for _ in size]
            if len(some):
                begin = bounds[:-1][some]
                one[some] = np.add.reduceat(mix(h, 11), begin).view(np.int64)
                two[some] = np.add.reduceat(mix(h, 12), begin).view(np.int64)
                sig = signatures(h, np.append(begin, len(h)))
                bands = sig[:, : BAND * TABLES].astype(U64).reshape(-1, TABLES, BAND)
                left = mix((bands[:, :, 0] << U64(32) | bands[:, :, 1]) + np.arange(TABLES, dtype=U64) * U64(0x9E3779B97F4A7C15), 21).view(np.int64)
                small = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                for k, d in enumerate(some.tolist()):
                    lefts[d], bytes_[d] = left[k], small[k].tobytes()
            part = slice(w.first, w.first + len(size))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[part]), pa.array(ks[part]), pa.array(size.astype(np.int64)), pa.array(one), pa.array(two),
                pa.array(lefts, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()),
            ], names=["id", "k", "n", "one", "two", "lefts", "sig"])


DESCRIBED = "id long, k long, n long, one long, two long, lefts array<long>, sig binary"
EDGES = "a_id long, a_k long, b_id long, b_k long"


def _edges(ids, ks, a, b) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ks[a]), pa.array(ids[b]), pa.array(ks[b])], names=["a_id", "a_k", "b_id", "b_k"])


def _alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Do rows share a right band, and agree on enough minhashes?"""
    same = one == two
    right = same[:, BAND * TABLES: 2 * BAND * TABLES].reshape(len(same), TABLES, BAND).all(axis=2).any(axis=1)
    return right & (same.sum(axis=1) >= AGREE)


def candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within left buckets: all candidates are connected, with about one edge per row in a large bucket."""
    held = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
    if held is None or not held.num_rows:
        return
    key, side, ids, ks = (held.column(c).to_numpy() for c in ("key", "side", "id", "k"))
    sig = np.frombuffer(b"".join(held.column("sig").to_pylist()), np.uint8).reshape(-1, MINHASHES)
    order = np.lexsort((ks, ids, side, key))
    key, ids, ks, sig = key[order], ids[order], ks[order], sig[order]
    edges = np.append(np.flatnonzero(changes(key)), len(key))
    size = np.repeat(np.diff(edges), np.diff(edges))
    for step in range(1, PAIRS_UP_TO):
        a = np.flatnonzero((size[:-step] <= PAIRS_UP_TO) & (key[:-step] == key[step:])) if step < len(key) else []
        for i in range(0, len(a), 20_000):
            some = a[i: i + 20_000]
            hit = some[_alike(sig[some], sig[some + step])]
            yield from _edges(ids, ks, hit, hit + step)
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi - lo > PAIRS_UP_TO:
            a, b = connect(sig[lo:hi])
            yield from _edges(ids, ks, a + lo, b + lo)


def connect(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is alike: a star around the most typical row, then each row outside against all."""
    n = len(sig)
    typical = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], dtype=np.uint8)
    hub = int((sig == typical).sum(axis=1).argmax())
    star = np.flatnonzero(_alike(sig, sig[hub][None, :]))
    star = star[star != hub]
    label = np.arange(n)
    label[star] = hub
    a, b = [np.full(len(star), hub)], [star]
    inside = label == hub
    for o in np.flatnonzero(~inside):
        near = np.flatnonzero(_alike(sig, sig[o][None, :]))
        groups, first = np.unique(label[near], return_index=True)
        other = near[first[groups != label[o]]]
        if len(other):
            a.append(np.full(len(other), o))
            b.append(other)
            label[np.isin(label, groups)] = label[o]
    return np.concatenate(a), np.concatenate(b)


def blocks(rows: DataFrame, group: str, size: int, total: str) -> DataFrame:
    """``rows`` with ``key`` and ``side``: groups of more than ``size`` rows become pairs of blocks, so that every two rows of a
    group meet under some key and no key has more than about two blocks."""
    n = F.ceil(F.col(total) / size).cast("int")
    mine = F.pmod(F.xxhash64("id", "k"), n).cast("int")
    rows = rows.withColumn("parts", n).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    pair = F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select("*", F.when(F.col("parts") == 1, F.xxhash64(group, F.lit(0), F.lit(0))).otherwise(pair).alias("key"), (F.col("mine") > F.col("other")).cast("int").alias("side")).drop("parts", "mine", "other")


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ks, root, total = (batch.column(c).to_numpy() for c in ("id", "k", "root", "total"))
        for w in split_words(batch.column("text"), lower=True):
            h, bounds = shingle_sets(w)
            part = slice(w.first, w.first + len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[part]), pa.array(ks[part]), pa.array(root[part]), pa.array(total[part]),
                pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
            ], names=["id", "k", "root", "total", "shingles"])


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the exact links among a few sets: 100 x intersection >= PERCENT x union."""
    size = np.array([len(s) for s in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(column, minlength=len(value)) > 1
    to = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], to[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    link = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    label, a, b = np.full(len(sets), -1), [], []
    for i in range(len(sets)):
        todo = [i] if label[i] < 0 else []
        label[todo] = i
        while todo:
            at = todo.pop()
            more = np.flatnonzero(link[at] & (label < 0))
            label[more] = i
            a.extend([at] * len(more))
            b.extend(more.tolist())
            todo.extend(more.tolist())
    return np.array(a, dtype=int), np.array(b, dtype=int)


def exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
    if held is None or not held.num_rows:
        return
    key, ids, ks = (held.column(c).to_numpy() for c in ("key", "id", "k"))
    sets = held.column("shingles")
    order = np.argsort(key, kind="stable")
    edges = np.append(np.flatnonzero(changes(key[order])), len(key))
    a, b = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi - lo > 1:
            rows = order[lo:hi]
            x, y = linked([np.frombuffer(sets[int(r)].as_py(), U64) for r in rows])
            a.append(rows[x])
            b.append(rows[y])
    yield from _edges(ids, ks, np.concatenate(a), np.concatenate(b))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``id``, ``k``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 x intersection >= 75 x union of their sets of five-word shingles (A-Z lower-cased);
    ``component_id`` is the smallest id reachable by links. A shorter text is one shingle; a null, empty or blank one has
    none and is linked with nothing. A missing id comes last. Rows repeated with one id and text get the same
    result; ``k``, a hash of the text, tells rows apart that share an id only. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = identified(docs, id_col, text_col)
    every = durable(texts.mapInArrow(describe, DESCRIBED))
    classes = durable(
        every.filter("n > 0").groupBy("n", "one", "two")
        .agg(F.min(F.struct("id", "k")).alias("rep"), F.any_value("lefts").alias("lefts"), F.any_value("sig").alias("sig"))
    )
    # Left buckets with more than one class; only their rows carry the minhashes on.
    keys = classes.select("rep.*", F.explode("lefts").alias("left"))
    full = keys.groupBy("left").agg(F.count("*").alias("total")).filter("total > 1")
    rows = keys.join(full, "left").join(classes.select("rep.*", "sig"), ["id", "k"])
    rows = blocks(rows, "left", BUCKET_BLOCK, "total").select("key", "side", "id", "k", "sig").repartition(parts, "key")
    near = components(rows.mapInArrow(candidate_edges, EDGES))
    totals = near.groupBy("root").agg(F.count("*").alias("total"))
    sets = near.join(totals, "root").select("node.*", F.xxhash64("root").alias("root"), "total")
    # Only the texts of candidates travel; rows repeated with one id and text count once.
    sets = texts.join(sets, ["id", "k"]).dropDuplicates(["id", "k"]).mapInArrow(full_sets, "id long, k long, root long, total long, shingles binary")
    sets = blocks(sets, "root", SET_BLOCK, "total").select("key", "id", "k", "shingles").repartition(parts, "key")
    final = components(sets.mapInArrow(exact_links, EDGES))
    roots = classes.select("n", "one", "two", "rep").join(final, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("root.id", "rep.id").alias("component"))
    out = every.select("id", "k", "n", "one", "two").join(roots, ["n", "one", "two"], "left").select("id", "k", "n", F.coalesce("component", "id").alias("component"))
    missing = lambda c: F.expr(f"nullif({c}, {NO_ID})")
    return out.select(missing("id").alias("id"), "k", F.col("n").alias("n_shingles"), missing("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, same columns."""
    gone = near_groups(docs, id_col, text_col).filter("NOT kept").select(F.coalesce("id", F.lit(NO_ID)).alias("gone_id"), F.col("k").alias("gone_k")).distinct()
    one, two = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_k")
    gone = gone.withColumnsRenamed({"gone_id": one, "gone_k": two})
    id_, k = document_key(docs, id_col, text_col)
    return docs.join(gone, (id_ == gone[one]) & (k == gone[two]), "left_anti")
