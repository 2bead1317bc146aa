"""Quality of a text by a factorisation machine over hashed words, structure statistics and length.

The score is w0 + sum w_j x_j + the sum of <v_i, v_j> x_i x_j over all pairs, which the identity
1/2 sum_f ((sum v_jf x_j)^2 - sum v_jf^2 x_j^2) gives in time linear in the features. The machine is fitted on
a bounded sample of labelled rows; scoring passes once over all texts with the weights broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .repeats import changes
from .tokens import U64, Words, _hash_words, split_words

# At most so many labelled rows are used, those with the least hashes of their ids: the bound of what the driver holds.
MAX_LABELLED = 6_000
WORD_BITS, RANK, BINS, STATISTICS = 13, 8, 16, 11
FEATURES = (1 << WORD_BITS) + STATISTICS * BINS
WORD_WEIGHT = 3.0

_CLASS = {
    "upper": list(range(65, 91)), "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "digit": list(range(48, 58)),
    "symbol": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-"], "line": [10],
}
_TABLES = {name: np.isin(np.arange(256), codes) for name, codes in _CLASS.items()}


def statistics(w: Words) -> np.ndarray:
    """STATISTICS numbers from 0 to 1 for each text of a piece; all 0 for an empty one."""
    n, size = w.counts, np.diff(w.offsets)
    total = {k: np.diff(np.append(0, np.cumsum(t[w.data]))[w.offsets]) for k, t in _TABLES.items()}
    doc = w.doc_of()

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[w.bounds])

    def distinct(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, owner))
        return np.bincount(owner[order][changes(owner[order], value[order])], minlength=len(n))

    again = ~changes(w.hashes, doc)
    marked = _TABLES["symbol"][w.data[w.ends - 1]] if len(doc) else np.zeros(0, dtype=bool)
    shout = per_text(_TABLES["upper"][w.data[w.starts]] & _TABLES["upper"][w.data[np.minimum(w.starts + 1, len(w.data) - 1)]]) if len(doc) else n * 0
    # Lines, without those that hold no byte.
    stop = np.flatnonzero(_TABLES["line"][w.data])
    edge = np.unique(np.concatenate([w.offsets, stop, stop + 1]))
    start, end = edge[:-1], edge[1:]
    text = ~_TABLES["line"][w.data[start]] if len(start) else np.zeros(0, dtype=bool)
    start, end = start[text], end[text]
    owner = np.searchsorted(w.offsets, start, side="right") - 1
    lines = np.bincount(owner, minlength=len(n))
    one = np.maximum(n, 1)
    parts = [
        total["symbol"] / np.maximum(size, 1), total["upper"] / np.maximum(total["letter"], 1), total["digit"] / np.maximum(size, 1),
        1 - distinct(doc, w.hashes) / one, per_text(again) / one, per_text(marked) / one, shout / one,
        1 - distinct(owner, _hash_words(w.data, start, end)) / np.maximum(lines, 1), np.minimum(size / one / 32, 1),
        np.log2(n + 1.0) / 24, np.log2(lines + 1.0) / 20,
    ]
    return np.clip(np.where(n > 0, np.stack(parts), 0.0), 0, 1).T


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values, text after text, and where each text's begin."""
    doc, n = w.doc_of(), w.counts
    code = doc.astype(np.int64) << WORD_BITS | (w.hashes >> U64(64 - WORD_BITS)).astype(np.int64)
    code, tf = np.unique(code, return_counts=True)
    word_doc = code >> WORD_BITS
    stats = statistics(w)
    at = np.sqrt(stats) * (BINS - 1)
    low = np.minimum(at.astype(np.int64), BINS - 2)
    base = (1 << WORD_BITS) + np.arange(STATISTICS) * BINS + low
    rest = at - low
    docs = np.repeat(np.arange(len(n)), STATISTICS)
    owner = np.concatenate([word_doc, docs, docs])
    number = np.concatenate([code & ((1 << WORD_BITS) - 1), base.ravel(), base.ravel() + 1])
    value = np.concatenate([WORD_WEIGHT * tf / n[word_doc], (1 - rest).ravel(), rest.ravel()])
    order = np.argsort(owner, kind="stable")
    return number[order], value[order].astype(np.float32), np.searchsorted(owner[order], np.arange(len(n) + 1))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, number: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        begin = bounds[:-1]
        spread = self.factors[number] * value[:, None]
        pairs = (np.add.reduceat(spread, begin) ** 2 - np.add.reduceat(spread**2, begin)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.linear[number] * value, begin) + pairs

    def scores(self, *found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*found).astype(np.float64), -30, 30)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Logistic loss by Adam over mini-batches in a seeded order; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32))
    state = [np.zeros_like(x) for x in (m.linear, m.factors)] + [np.zeros_like(x) for x in (m.linear, m.factors)]
    steps = np.zeros(FEATURES, np.float32)
    for epoch in range(epochs if len(labels) else 0):
        order, pace = rng.permutation(len(labels)), rate * (1 - epoch / epochs) + rate / 50
        for i in range(0, len(order), batch):
            some = order[i: i + batch]
            number, value = (np.concatenate([rows[r][k] for r in some]) for k in (0, 1))
            size = np.array([len(rows[r][0]) for r in some])
            bounds = np.append(0, np.cumsum(size))
            error = (m.scores(number, value, bounds) - labels[some]).astype(np.float32)
            own = np.repeat(error, size) / len(some)
            spread = m.factors[number] * value[:, None]
            total = np.repeat(np.add.reduceat(spread, bounds[:-1]), size, axis=0)
            used, to = np.unique(number, return_inverse=True)
            steps[used] += 1
            m.bias -= pace * float(error.mean())
            for k, (weights, slope) in enumerate(((m.linear, (own * value)[:, None]), (m.factors, (own * value)[:, None] * (total - spread)))):
                got = np.stack([np.bincount(to, slope[:, f], minlength=len(used)) for f in range(slope.shape[1])], axis=1).astype(np.float32).reshape(weights[used].shape)
                got += decay * weights[used]
                first, second = state[k], state[k + 2]
                first[used] = 0.9 * first[used] + 0.1 * got
                second[used] = 0.99 * second[used] + 0.01 * got**2
                t = steps[used].reshape(-1, *[1] * (weights.ndim - 1))
                weights[used] -= pace * (first[used] / (1 - 0.9**t)) / (np.sqrt(second[used] / (1 - 0.99**t)) + 1e-6)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in split_words(batch.column("text")):
            number, value, bounds = features(w)
            cut = list(zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(w.first, len(cut)), batch.column("label").slice(w.first, len(cut)),
                pa.array([zlib.compress(number[a:b].astype(np.int32).tobytes() + value[a:b].tobytes(), 1) for a, b in cut], pa.binary()),
            ], names=["id", "label", "found"])


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Machine:
    """Fit on at most ``most`` labelled rows that are not held out. Rows with a null id or label are passed over; of several
    labels of one id the mean counts. Without labels all scores are a half."""
    ids = F.col(id_col).cast("long").alias("id")
    known = labels.select(ids, F.col(label_col).cast("double").alias("label")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(ids, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    got = rows.mapInArrow(_rows, "id long, label double, found binary").orderBy("id", "found").limit(most).collect()
    found = []
    for r in got:
        raw = zlib.decompress(r["found"])
        found.append((np.frombuffer(raw, np.int32, len(raw) // 8), np.frombuffer(raw, np.float32, len(raw) // 8, len(raw) // 2)))
    return fit_machine(found, np.array([r["label"] for r in got]))


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` from 0 to 1. Null and empty texts score by having no words; an own column of that name is replaced."""
    weights = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES x (RANK + 1) numbers
    if score_col in docs.columns:
        docs = docs.drop(score_col)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(weights.value.scores(*features(w)) for w in split_words(texts))]))

    return docs.withColumn(score_col, score(F.coalesce(F.col(text_col), F.lit(""))))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` that score at least ``least``, same columns."""
    name = fresh(docs.columns, "quality_score")
    return score_quality(docs, learn_quality(docs, labels, id_col, text_col), text_col, name).filter(F.col(name) >= least).drop(name)
