"""Exact, near and substring duplicates against plain versions on small tables with odd rows."""

import pytest
from pyspark.sql import functions as F

from emberfield.llm import components as llm_components
from emberfield.llm.components import components
from emberfield.llm.content_sort import drop_exact_copies, exact_groups
from emberfield.llm.near_dup import connect, drop_near_copies, linked, near_groups
from emberfield.llm.recompression import drop_repeated_passages
from emberfield.llm.suffix_dedup import repeated_spans

from . import brute


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(parts)


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return brute.corpus(request.param)


def test_exact(spark, rows):
    norm = {r[0]: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    same = {}
    for d in sorted(norm):
        same.setdefault(norm[d], []).append(d)
    got = {r["id"]: r for r in exact_groups(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t in norm.items():
        r = got[d]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (same[t][0], len(same[t]), d == same[t][0], brute.sha(t))


def test_exact_hot_text_and_odd_ids(spark):
    rows = [(i, "one  text", *[None] * 7) for i in range(3000)] + [(None, "one text", *[None] * 7), (5, "one\ntext", *[None] * 7), (None, "other", *[None] * 7), (None, "other", *[None] * 7)]
    got = exact_groups(frame(spark, rows, 7)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 2
    assert {r["group_size"] for r in got} == {3002, 2} and {r["keep_id"] for r in got} == {0, None}
    kept = drop_exact_copies(frame(spark, rows, 7))
    assert kept.columns == frame(spark, rows).columns and sorted((r["doc_id"] or 0, r["id"]) for r in kept.collect()) == [(0, None), (0, None)]


def test_recompression(spark, rows):
    want = brute.covered(rows, 20)
    got = {r["id"]: r for r in drop_repeated_passages(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, (w, gone) in want.items():
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["text"], got[d]["kept_sha256"]) == (len(w), len(gone), text, brute.sha(text)), d


def test_suffixes(spark, rows):
    want = set()
    for d, (w, gone) in brute.covered(rows, 50).items():
        for i in gone:
            if i - 1 not in gone:
                end = i
                while end in gone:
                    end += 1
                want.add((d, i, end, end - i))
    assert want and {tuple(r) for r in repeated_spans(frame(spark, rows)).collect()} == want


def test_near(spark, rows):
    want = brute.near(rows)
    got = {r["id"]: r for r in near_groups(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, (n, root) in want.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, root, d == root), d
    kept = drop_near_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, root) in want.items() if d == root}


def test_near_large_group(spark):
    """A group larger than a block, whose members mostly link to the first text only."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = [base]
    for _ in range(400):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        texts.append(w)
    rows = [(i, " ".join(w), *[None] * 7) for i, w in enumerate(texts)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(frame(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_repeated_rows_and_missing_ids(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, long, *[None] * 7), (1, long, *[None] * 7), (None, long, *[None] * 7), (2, None, *[None] * 7)]
    got = sorted(((r["id"] or 0), r["n_words"], r["n_removed"]) for r in drop_repeated_passages(frame(spark, rows)).collect())
    assert got == [(0, 60, 60), (1, 60, 0), (1, 60, 0), (2, 0, 0)]
    assert [tuple(r) for r in repeated_spans(frame(spark, rows)).collect()] == [(None, 0, 60, 60)]
    near = sorted((r["id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(frame(spark, rows)).collect())
    assert near == [(0, 56, 1, False), (1, 56, 1, True), (1, 56, 1, True), (2, 0, 2, True)]


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (exact_groups, drop_repeated_passages, repeated_spans, near_groups, drop_exact_copies, drop_near_copies):
        assert f(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (7, 7), *[(i, i + 1) for i in range(20, 60)], *[(100, i) for i in range(101, 160)]]
    want = {(i, 1) for i in (1, 2, 3)} | {(8, 8), (9, 8)} | {(i, 20) for i in range(20, 61)} | {(i, 100) for i in range(100, 160)}
    for parts in (1, 7):
        rows = spark.createDataFrame([(a, 0, b, 0) for a, b in edges], "a_id long, a_k long, b_id long, b_k long").repartition(parts)
        assert {(r["node"]["id"], r["root"]["id"]) for r in components(rows).collect()} == want
    assert components(rows.filter("false")).collect() == []


def test_components_of_a_hub(spark, monkeypatch):
    """A node of 100,000 edges and a long chain, in tasks that see a few edges at a time."""
    monkeypatch.setattr(llm_components, "CONTRACTED", 500)
    n = 100_000
    hub = spark.range(1, n + 1).selectExpr("id + 10 AS a_id", "0L AS a_k", f"{5 * n} AS b_id", "0L AS b_k")
    chain = spark.range(1, 300).selectExpr(f"{9 * n} + id AS a_id", "1L AS a_k", f"{9 * n} + id + 1 AS b_id", "1L AS b_k")
    got = components(hub.unionByName(chain).repartition(13)).selectExpr("node.id AS node", "root.id AS root", "root.k AS k")
    seen = {(r["root"], r["k"]): r["n"] for r in got.groupBy("root", "k").agg(F.count("*").alias("n")).collect()}
    assert seen == {(11, 0): n + 1, (9 * n + 1, 1): 300} and got.select("node").distinct().count() == n + 301


def test_linked_and_connect():
    import numpy as np

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    a, b = linked(sets)  # 0-1 and 1-2 share 90 of 110, 0-2 80 of 120
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist())} == {frozenset((0, 1)), frozenset((1, 2))}
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, 256, (2, 128), dtype=np.uint8)
    x, y = connect(np.stack([one, two, one, two, one]))
    assert {frozenset(e) for e in zip(x.tolist(), y.tolist())} == {frozenset((0, 2)), frozenset((0, 4)), frozenset((1, 3))}
