"""Long repeats by hash buckets of minimisers, in place of a suffix order.

Of all suffixes of the texts only those are kept that begin at a minimiser: the least of the hashes of HEAD words in
a row within some window of WINDOW words. Two places that share WINDOW words share such a suffix at the same distance. The kept
suffixes meet by a hash of their first HEAD words alone; they are not sorted by the words that follow, and no common
prefix is extended. Where two meet, every window of WINDOW words that the minimiser rules is hashed anew, in 96 bits, and
compared with all such windows elsewhere; windows that also start earlier are merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import NO_ID, changes, covered, identified
from .tokens import U64, Words

WINDOW, HEAD = 50, 10


def leftmost_least(values: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Where the least of ``values[start:start + width]`` is, the first of equals."""
    at, span = np.arange(len(values)), 1
    while 2 * span <= width:
        other = at[np.minimum(np.arange(len(values)) + span, len(values) - 1)]
        at, span = np.where(values[at] <= values[other], at, other), 2 * span
    one, two = at[start], at[start + width - span]
    return np.where(values[one] <= values[two], one, two)


def suffix_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept suffixes as (first window ruled, number of windows, hash of the head)."""
    at = w.windows(WINDOW)
    if not len(at):
        return at, at, np.zeros(0, dtype=U64)
    heads = w.grams(np.arange(len(w.hashes) - HEAD + 1), HEAD)  # heads across texts are in no window
    place = leftmost_least(heads, at, WINDOW - HEAD + 1)
    first = changes(place)
    first[1:] |= at[1:] != at[:-1] + 1
    begin = np.flatnonzero(first)
    return at[begin], np.diff(np.append(begin, len(at))), heads[place[begin]]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in a row as one span."""
    for batch in batches:
        ids, lists = batch.column("id").to_numpy(), batch.column("spans").to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        for doc, starts in zip(ids, lists):
            at = np.unique(np.frombuffer(starts, np.int32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(at) > WINDOW)  # spans that touch or overlap are one
            start, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + WINDOW
            out.append((np.full(len(start), doc), start, end))
        if out:
            doc, start, end = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(start), pa.array(end), pa.array(end - start)], names=["id", "start", "end", "n_words"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to remove, a row each: ``id``, ``start`` and ``end`` in words (end exclusive), ``n_words``.

    A span is the union of windows of 50 words of one document that also start earlier, in a document with a smaller id
    or before in the same one; the first occurrence stays. Documents without such a window have no row: so null and empty
    texts, and all of fewer than 50 words. A missing id comes last. Rows repeated with one id and text are one
    document; with one id and other texts they are ordered by a hash of the text. Other columns are not read.
    """
    return covered(identified(docs, id_col, text_col), WINDOW, suffix_spans).mapInArrow(_merge, "id long, start long, end long, n_words long")
