"""Spelling variants, collocations and languages against plain versions."""

import os
import random
import zlib
from collections import Counter

import pytest

from emberfield.llm import collocations as col
from emberfield.llm import spelling
from emberfield.llm.language_id import held_out, learn_languages, tell_languages

from . import brute

FOLDER = "/root/testdata/sf0.01"


def plain_words(rows):
    import re

    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower_ascii(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def edits(w, alphabet):
    for i in range(len(w) + 1):
        for c in alphabet:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1:]
        yield w[:i] + w[i + 1:]


def plain_groups(rows):
    n = plain_words(rows)
    alphabet = set("".join(n))
    near = {w: {v for v in edits(w, alphabet) if v in n and v != w} for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def typed_words(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéÀ") for _ in range(rng.choice([6, 6, 7, 8, 12]))) for _ in range(40)] + ["banana", "Thereof", "aaaaaa"]
    rows = [(None, "Thereof " * 6), (1, None), (2, ""), (3, "x" * 5000 + " " + "longer " * 300), (3, "Banana,banana" * 9), (3, "Banana,banana" * 9)]
    for doc in range(10, 400):
        words = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            if rng.random() < 0.25:
                w = rng.choice(list(edits(w, "abé")))
            words.append(w if rng.random() < 0.8 else w.upper())
        rows.append((doc, rng.choice([" ", "-", "1"]).join(words)))
    return rows


def test_spelling(spark):
    rows = typed_words()
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, word string, n int, key int")
    got = {tuple(r) for r in spelling.spelling_groups(docs).collect()}
    assert got == plain_groups(rows) and sum(f is not None for _, f, *_ in got) > 20
    assert len({r for _, _, r, *_ in got}) < len(got)


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(none).collect() == []


def test_signatures_meet(spark):
    """Each pair one edit apart shares a key; anagrams seldom do."""
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6, 15)))
        b = rng.choice([b for b in edits(a, "abz") if len(b) >= 6 and b != a])
        pairs.append((a, b))
    words = spark.createDataFrame(sorted({(w, 1) for p in pairs for w in p}), "word string, n long")
    keys = {}
    for r in spelling.signatures(words).collect():
        keys.setdefault(r["word"], set()).add(r["key"])
    assert all(keys[a] & keys[b] for a, b in pairs) and all(len(k) == 20 for k in keys.values())


def plain_collocations(rows, top):
    import re

    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[(lang or "und", tuple(w[i: i + k]))] += 1
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    held = {}
    for (lang, w), a in some.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                held[(lang, w[i: i + n])] = max(a, held.get((lang, w[i: i + n]), 0))
    out = {}
    for (lang, w), a in some.items():
        if 100 * held.get((lang, w), 0) < 80 * a:
            cuts = [(2_000_000 * a // (f[(lang, w[:k])] + f[(lang, w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, w[:k])], f[(lang, w[k:])]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, best in out.items() for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])}


def phrased(seed=2, n=600):
    rng = random.Random(seed)
    fixed = ["new york city hall", "of the", "due  to", "à la carte", "one two three", "ha ha ha ha ha", "x\ty"]
    words = [f"w{i}" for i in range(40)] + ["of", "the", "New", "city", "one", "à"]
    rows = [(None, "en"), ("", None), ("z " * 5000, "en")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words[: rng.choice([5, 46])]) for _ in range(rng.choice([3, 30]))]
        rows.append(("".join(p + rng.choice([" ", " ", "  ", ", ", ".\n", "\t"]) for p in parts), rng.choice(["en", "en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("top", [3, 2000])
def test_collocations(spark, top):
    """With few phrases asked for, languages settle after rounds of few prefixes."""
    rows = phrased()
    docs = spark.createDataFrame([(t, x, "p", 1, 2.0) for t, x in rows], "text string, lang string, phrase string, f int, key double")
    assert {tuple(r) for r in col.collocations(docs, top=top).collect()} == plain_collocations(rows, top)


def test_rounds(spark, monkeypatch):
    monkeypatch.setattr(col, "FIRST_ROUND", 1)
    monkeypatch.setattr(col, "ROUND_GROWTH", 2)
    rows = phrased(5, 400)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert {tuple(r) for r in col.collocations(docs, top=5).collect()} == plain_collocations(rows, 5)


def test_crowded_bitmaps(spark, monkeypatch):
    """Wrong hits cost rows, not results."""
    monkeypatch.setattr(col, "LEAST_BITS", 3)
    monkeypatch.setattr(col, "MOST_BITS", 3)
    rows = phrased(6, 300)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert {tuple(r) for r in col.collocations(docs, top=20).collect()} == plain_collocations(rows, 20)


def test_no_collocations(spark):
    assert col.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert col.collocations(spark.createDataFrame([("a b", None)], "text string, lang string")).collect() == []


def test_large_counts(spark):
    """Products beyond 64 bits."""
    big = 3 * 10**17
    got = spark.createDataFrame([(big, 2 * big + 1)], "a long, t long").select(col._ratio(col.F.col("a"), col.F.col("t"))).first()[0]
    assert got == 2_000_000 * big // (2 * big + 1)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_languages(spark):
    """Accuracy on documents that were not learned from; the query's columns."""
    from emberfield.llm.queries import QUERIES

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op13_language_id"](spark, FOLDER).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    tested = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(tested) > 150 and sum(tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark):
    rows = [(i, t, x, "s", 0.5) for i, (t, x) in enumerate([
        ("the cat and the dog", "en"), ("el gato y el perro", "es"), ("the dog", "en"), ("y el gato", "es"), (None, "en"), ("", None), ("12 -- 3", "en"),
        ("кот и собака " * 2000, "ru"), ("и", None), ("x" * 300_000, None), ("A", None), ("the cat and the dog", "en"),
    ])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = learn_languages(docs)
    got = {r["doc_id"]: r for r in tell_languages(docs, model).collect()}
    assert len(got) == len(rows) and set(model.names) <= {"en", "es", "ru"}
    assert [got[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and got[5]["score"] == 0
    assert got[0]["lang_pred"] == got[11]["lang_pred"] and got[0]["score"] == got[11]["score"]
    kept = {r[0] for r in docs.filter(~held_out(col.F.col("doc_id"))).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in (0, 1, 7) if i in kept)
    none = docs.filter("false")
    assert tell_languages(none, model).collect() == [] and learn_languages(none).names == []
    assert {r["lang_pred"] for r in tell_languages(docs, learn_languages(none)).collect()} == {"und"}


def test_posterior_is_plain_bayes(spark):
    """Scores equal a dictionary-based naive Bayes over the same buckets."""
    import math

    import pyarrow as pa

    from emberfield.llm import language_id as li

    def buckets(text):
        out = Counter()
        for _, bounds, folded, letter in li.characters(pa.array([text])):
            for b, _ in li.grams(bounds, folded, letter):
                out.update(b.tolist())
        return out

    texts = [("ab ba, ab", "x"), ("aab", "x"), ("bcc b", "y"), ("c", "y"), ("abc", "y")]
    docs = spark.createDataFrame([(2 * i + 100, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    used = [(t, x) for (t, x), r in zip(texts, docs.select(held_out(col.F.col("doc_id")).alias("h")).collect()) if not r["h"]]
    counts = {x: sum((buckets(t) for t, y in used if y == x), Counter()) for x in {x for _, x in used}}
    model = learn_languages(docs)
    assert model.names == sorted(counts)
    for text in ("ab", "cab c", "zz"):
        logs = {x: math.log(sum(y == x for _, y in used) / len(used)) + sum(n * math.log((c[b] + 0.5) / (c.total() + 0.5 * li.BUCKETS)) for b, n in buckets(text).items()) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        got = model.judge(pa.array([text]))[0].as_py()
        assert got["lang_pred"] == best and got["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))
