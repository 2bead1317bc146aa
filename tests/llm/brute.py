"""Plain versions of the operators, for small tables."""

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, row int, norm string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    return WORD.findall(lower_ascii(text or "") if lower else text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=0, n=120, vocabulary=60):
    """Rows with copies, near copies, shared passages, runs of one word, empty and odd texts, nulls in every column."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["É", "ça", "A", "The", "the", "x,", "日本", "-"]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = [None, "", " \t\n", "a", "a b c d", "ha " * 90, "A b C d e", "a b c d e", " a\x0bb\x0cc  d\re\n"]
    while len(texts) < n:
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 5, 19, 20, 21, 60, 60, 150]))]
        kind = rng.random()
        if kind < 0.25:
            cut = rng.randrange(0, 40)
            w[len(w) // 2: len(w) // 2] = passage[cut: cut + rng.choice([15, 20, 25, 30, 55, 70])]
        elif kind < 0.5 and len(texts) > 12:
            w = words(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.6:
            w = (w[: rng.choice([1, 2, 3, 7])] or ["z"]) * rng.choice([3, 25])
        texts.append("".join(x + rng.choice([" ", " ", "  ", "\n", "\t "]) for x in w).rstrip(rng.choice([" ", "\n", ""])))
    rows = [(i * 3 % n if n % 3 else i, t, "en", f"s{rng.randrange(4)}" if rng.random() < 0.9 else None, 1, -i, "k", 0, "n") for i, t in enumerate(texts)]
    rows.append((n + 5, "word " * 5000 + "end", None, "s0", None, None, None, None, None))
    return rows


def covered(rows, window):
    """Per row: which words lie in a window that also starts earlier."""
    seen, out = set(), {}
    for doc, text in sorted((r[0], r[1]) for r in [(r[0], r[1] or "") for r in rows]):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i: i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        out[doc] = (w, gone)
    return out


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """doc -> (set size, component) from all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1
