"""Registered queries against their SQL, the pipeline against plain stages, and the plans of the native operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from emberfield.llm import queries  # noqa: E402

from . import brute  # noqa: E402
from .test_filters import base_listed, plain_contamination  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_registered():
    names = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in contract.queries()
    assert set(queries.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    left, right = check.rows_of(df.columns, df.collect()), check.rows_of(rel.columns, rel.fetchall())
    assert len(left) > 0 and left == right


def rows_of(spark, name="documents", folder=FOLDER):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def test_secrets_query(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    got, rows = {r["doc_id"]: r for r in queries.QUERIES["op4_secrets"](spark, folder).collect()}, rows_of(spark, folder=folder)
    for doc, text, *_ in rows:
        assert got[doc]["base_sha256"] == brute.sha(base_listed(text)[1])
    assert len(got) == len(rows) and sum(r["n_live"] + r["n_example"] for r in got.values()) > 10


def test_quality_query(spark):
    labels = {d: q for d, q, *_ in rows_of(spark, "labels")}
    got = queries.QUERIES["op3_quality"](spark, FOLDER).collect()
    assert len(got) == len(rows_of(spark)) and all(r["held_out"] == brute.held_out(r["doc_id"]) for r in got)
    judged = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(judged) >= 0.95 * len(judged)


def test_pages_query(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op10_html_text"](spark, FOLDER).collect()}
    for page, _, text in rows_of(spark, "pages"):
        inner = re.search(r"<article>(.*)</article>", text, re.S)[1]
        assert got[page] == " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_mixing_query(spark):
    got = queries.QUERIES["op7_mixing"](spark, FOLDER).collect()
    source = {d: s for d, _, _, s, _ in rows_of(spark)}
    taken, target, size = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s], size[s], target[s] = taken.get(s, 0) + r["taken"], r["source_size"], r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values())) and all(abs(taken[s] - target[s]) <= 40 for s in taken)  # a block, and the short last block up to three times


def test_pipeline(spark):
    """Each stage on its own input, against a plain version of it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    bench = rows_of(spark, "benchmark")
    labels = {d: q for d, q, *_ in rows_of(spark, "labels")}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, FOLDER)
        after = [tuple(r) for r in docs.collect()]
        ids = {r[0] for r in after}
        if name == "quality":
            wrong = [d for d, *_ in before if d in labels and (d in ids) != bool(labels[d])]
            assert len(wrong) <= 0.02 * len(labels)
        elif name == "exact_dedup":
            first = {}
            for d, t, *_ in sorted(before):
                first.setdefault(" ".join(brute.words(t)), d)
            assert ids == set(first.values())
        elif name == "near_dedup":
            assert ids == {d for d, (_, root) in brute.near(before).items() if d == root}
        elif name == "decontamination":
            assert ids == {w[0] for w in plain_contamination(before, bench) if not w[5]}
        else:
            assert len(after) == len(before) and docs.columns == ["doc_id", "size", "source_size", "target", "taken"]
        if k < 4:
            assert docs.columns == columns and set(after) <= set(before)
        docs = spark.createDataFrame(after, docs.schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(after)


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_decontamination"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop"))


def test_sort_needs_one_exchange(spark):
    """Ranges of content serve the window: no second shuffle of the texts."""
    plan = queries.QUERIES["op6_exact_dedup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(lead" not in plan
