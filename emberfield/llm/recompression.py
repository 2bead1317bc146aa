"""Long repeats by recompression: rounds that name runs and pairs of symbols the same way everywhere.

Names are 64-bit hashes of what they stand for, so they are global without an exchange. Runs of one word
are named once, before the rounds; each of ROUNDS rounds then splits the symbols into left and right ones by a bit of
their name and names the pairs (left, right). Whether two neighbours join depends on them alone, so two equal windows
agree on all symbols but those at their ends. A window is keyed by the least hash of the phrases (a few symbols in a row) that lie inside for sure;
equal windows have equal keys, and windows with repeated keys are verified by hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NO_ID, documents, changes, covered, identified
from .tokens import PLAIN, U64, Words, mix, range_sums

WINDOW, ROUNDS, PHRASE = 20, 2, 4
GOLDEN = U64(0x9E3779B97F4A7C15)


def window_keys(w: Words, window: int = WINDOW, rounds: int = ROUNDS, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows of a piece of text, a key for each, and where its phrase lies.

    Equal windows have equal keys, and their phrases lie at the same distance from their first words.
    """
    at = w.windows(window)
    if not len(at):
        return at, np.zeros(0, dtype=U64), at
    doc = w.doc_of()
    new = changes(w.hashes, doc)
    run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    length = np.diff(np.append(begin, len(new)))
    s = np.where(length > 1, mix(w.hashes[begin] + length.astype(U64) * GOLDEN, 77), w.hashes[begin])
    doc = doc[begin]
    # The first and the last run may go on outside the window.
    low, high = run[at] + 1, run[at + window - 1] - 1
    for r in range(rounds):
        right = (mix(s, r + 1) >> U64(40)) & U64(1) == 1
        # A right symbol at the window's start, or a left one at its end, may be joined with one outside.
        low = low + right[np.minimum(low, len(s) - 1)]
        high = high - ~right[high]
        pair = np.zeros(len(s), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = ~pair[:-1]
        to = np.cumsum(keep) - 1
        joined, p = s.copy(), np.flatnonzero(pair)
        joined[p] = mix(s[p] * GOLDEN + s[p + 1], 999)
        s, doc = joined[keep], doc[keep]
        none = low > high
        low, high = to[np.minimum(low, len(to) - 1)], to[np.maximum(high, 0)]
        high[none] = low[none] - 1
    key, place, count = np.empty(len(at), dtype=U64), at.copy(), high - low + 1
    full, few, none = count >= phrase, (count > 0) & (count < phrase), count <= 0
    if full.any():
        here = np.arange(len(s) - phrase + 1)
        phrases = mix(range_sums(s, here, here + phrase, PLAIN), 5)
        least = [here]
        while (1 << len(least)) <= window:  # where the least of 2, 4, 8, ... phrases is, the first one of equals
            half, last = 1 << (len(least) - 1), least[-1]
            other = last[np.minimum(here + half, len(here) - 1)]
            least.append(np.where(phrases[last] <= phrases[other], last, other))
        a, n = low[full], count[full] - phrase + 1
        level = np.frexp(n.astype(np.float64))[1] - 1
        least = np.stack(least)
        one, two = least[level, a], least[level, a + n - (1 << level)]
        place[full] = np.where(phrases[one] <= phrases[two], one, two)
        key[full] = phrases[place[full]]
    if few.any():
        key[few], place[few] = mix(range_sums(s, low[few], high[few] + 1, PLAIN), 6), low[few]
    if none.any():
        key[none] = mix(w.grams(at[none], window), 7)
    return at, key, place


def key_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row that share one phrase, as (first window, number, key)."""
    at, key, place = window_keys(w)
    if not len(at):
        return at, at, key
    first = changes(key, place)
    first[1:] |= at[1:] != at[:-1] + 1
    begin = np.flatnonzero(first)
    return at[begin], np.diff(np.append(begin, len(at))), key[begin]


def kept_texts(w: Words, removed: np.ndarray) -> Iterator[bytes]:
    """Words not removed, one space between them, text by text."""
    out, keep = w.data.copy(), ~removed
    depth = np.zeros(len(out) + 1, dtype=np.int8)
    depth[w.starts[keep]] += 1
    depth[w.ends[keep]] -= 1
    mask = np.cumsum(depth[:-1], dtype=np.int8) > 0
    # The byte after a word becomes its space, but for a word that ends with its text.
    gap = w.ends[keep & (w.ends < np.repeat(w.offsets[1:], w.counts))]
    out[gap], mask[gap] = 32, True
    at = np.append(0, np.cumsum(mask))[w.offsets]
    joined = out[mask].tobytes()
    for a, b in zip(at[:-1], at[1:]):
        yield joined[a:b].rstrip(b" ")


def remove_covered(window: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, ids, _, lists in documents(batches, True):
            removed = np.zeros(len(w.hashes) + 1, dtype=np.int32)
            for d, starts in enumerate(lists):
                if starts:
                    start = w.bounds[d] + np.unique(np.frombuffer(starts, np.int32))
                    removed[start] += 1
                    removed[start + window] -= 1
            removed = np.cumsum(removed[:-1]) > 0
            texts = list(kept_texts(w, removed))
            gone = np.append(0, np.cumsum(removed))[w.bounds]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(w.counts.astype(np.int64)), pa.array(np.diff(gone).astype(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), *([pa.array([t.decode() for t in texts])] if with_text else []),
            ], names=["id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])])

    return work, "id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """A row per document: ``id``, ``n_words``, ``n_removed``, ``kept_sha256``, and with ``with_text`` the text that is left.

    Each word goes that is covered by a window of 20 words of one document whose words also start earlier: in a
    document with a smaller id, or earlier in the same one. Null and empty texts have no words and keep an empty
    text; a document of fewer than 20 words loses none. A missing id comes last. Rows repeated with one id and text are
    one document and get the same result; with one id and other texts they are ordered by a hash of the text. Other
    columns are not read. An empty table gives an empty one.
    """
    texts = identified(docs, id_col, text_col)
    hits = covered(texts, WINDOW, key_spans)
    work, schema = remove_covered(WINDOW, with_text)
    return texts.join(hits, ["id", "k"], "left").select("id", "k", "text", "spans").mapInArrow(work, schema)
