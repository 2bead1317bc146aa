"""Url filter, secrets, decontamination, mixing, quality and page text against plain versions."""

import math
import random
import re
import time

import numpy as np
import pytest

from emberfield.llm import decontaminate, mixing
from emberfield.llm.decontaminate import contamination, drop_contaminated, remove_passages
from emberfield.llm.html_text import extract_text, main_text
from emberfield.llm.mixing import capped_targets, mix_sources, sainte_lague
from emberfield.llm.quality import Machine, keep_good, learn_quality, score_quality
from emberfield.llm import secret_scan
from emberfield.llm.secret_scan import COPIED_REPOS, digest, scan_secrets
from emberfield.llm.url_filter import judge_urls, split_url

from . import brute


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(parts)


URLS = [
    "http://a.example.com/en/x?q#f", "https://WWW.Example.com/en/", "https://www.example.com/de/en/", "http://example.com", "http://x.net/fr/1", "http://net/es/",
    "http://notexample.com/en/1", "ftp://b.org/x", "no scheme", "", None, "http://", "x://COM/?", "http://é.com/", "http://a.com?x=/", "http://.com/x", "a://b://c.com/", "http://a.com/en#/",
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
         ("com", "/", "block"), ("example.com", "/de", "block"), (None, "/", "block")]


def best_rule(url, rules):
    host, path = split_url(url)
    fit = [(len(h), len(p), v, h + p) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("most", [100, 2])
def test_urls(spark, most):
    rows = [(i, u, "h", "r", None) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, n long")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in judge_urls(pages, rules, max_rules=most).collect()), key=repr)
    assert got == sorted(((i, *best_rule(u, RULES)) for i, u, *_ in rows), key=repr)
    none = judge_urls(pages.limit(0), rules, max_rules=most)
    assert none.count() == 0 and judge_urls(pages, rules.limit(0)).filter("verdict != 'allow'").count() == 0


PATTERNS = [("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 2),
            ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def base_listed(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return spans, ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(spans))


def test_secrets(spark):
    key, token = "0123456789abcdef01234567", "aB3dE5fG7hJ9kL1mN3pQ"
    texts = [
        f'é Token = "{key}" x', f"API_KEY:{key}", "password: abc", "password=secret: token=abcdefgh", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "xAKIAAKIA" + "Z" * 20, key[:23],
        key + "g" + key, "ſecret=abcdefgh", "apikey'='a.b=c_d/e", f"see {token} and {token}", None, "", "secret=" + "x" * 100_000, token + "=", "toKen:" + token, "日本 passwd  :  'abc-def+1'",
    ]
    rows = [(i, t, "en", f"s{i}" if i != 3 else None, None, 1, "k", 2, "n") for i, t in enumerate(texts)]
    rows += [(100 + i, f"key {token}1 end", "en", f"s{i}", *[None] * 5) for i in range(4)]  # held by four owners: an example
    rows += [(200, f"mine {token}2 end", *[None] * 7), (200, f"mine {token}2 end", *[None] * 7)]
    got = [r for r in digest(scan_secrets(frame(spark, rows))).collect()]
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i, t, *_ in rows:
        spans, listed = base_listed(t)
        assert (by[i]["n_assign"], by[i]["n_access"], by[i]["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3)), i
        assert by[i]["base_sha256"] == brute.sha(listed), (i, by[i]["spans"], listed)
        assert set(filter(None, listed.split(","))) <= set(by[i]["spans"].split(","))
    assert by[100]["n_owned"] == 0 and by[200]["spans"] == "owned:5:26" and by[11]["n_owned"] == 0  # two owners hold the token of 11
    assert (by[1]["n_example"], by[1]["n_live"]) == (2, 0)  # three owners hold it
    assert digest(scan_secrets(frame(spark, []))).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1000, 10**9])
def test_secrets_hot_or_not(spark, monkeypatch, hot):
    """The verdicts do not depend on which values are broadcast: none, some or all; one value is in every document."""
    token = "Qw7eRt9yUi3oPa5sDf1g"
    rows = [(i, f"secret=everywhere token=value-{i % 5} {token}{i % 30:02d}", "en", f"s{i % 4}", *[None] * 5) for i in range(60)] + [(99, None, "en", "s1", *[None] * 5)]
    plain = {r["id"]: r for r in digest(scan_secrets(frame(spark, rows))).collect()}
    monkeypatch.setattr(secret_scan, "HOT", hot)
    found = scan_secrets(frame(spark, rows))
    assert {r["id"]: r for r in digest(found).collect()} == plain
    assert plain[0]["n_assign"] == 2 and plain[0]["n_example"] == 2 and plain[99]["spans"] == ""
    if hot == 1000:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_secrets_of_many_repositories(spark):
    token = "aB3dE5fG7hJ9kL1mN3pQ"
    hot = [(i, f"see {token}1 and secret=copied-word", "en", "hot", *[None] * 5) for i in range(COPIED_REPOS)]
    few = [(100 + i, f"see {token}2 and secret=other-word", "en", "hot", *[None] * 5) for i in range(COPIED_REPOS - 1)]
    same = [(200, f"see {token}3", "en", "hot", *[None] * 5)] * COPIED_REPOS  # one repository
    two = [(300 + i, "secret=third-word", "en", f"s{i % 2}", *[None] * 5) for i in range(COPIED_REPOS)]
    by = {r["id"]: r for r in digest(scan_secrets(frame(spark, hot + few + same + two))).collect()}
    for i in range(COPIED_REPOS):
        assert (by[i]["n_assign"], by[i]["n_owned"], by[i]["n_live"], by[i]["n_example"]) == (1, 0, 0, 1)
        assert (by[300 + i]["n_live"], by[300 + i]["n_example"]) == (0, 1)
    for i in range(COPIED_REPOS - 1):
        assert (by[100 + i]["n_assign"], by[100 + i]["n_owned"], by[100 + i]["n_live"], by[100 + i]["n_example"]) == (1, 1, 2, 0)
    assert by[200]["n_owned"] == 1
    # Repositories of a column of their own: 40 documents of one are one.
    rows = frame(spark, [(i, f"see {token}4", "one", "hot", *[None] * 5) for i in range(40)])
    assert {r["n_owned"] for r in digest(scan_secrets(rows, repo_col=rows.columns[2])).collect()} == {1}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower_ascii(text or ""))


def plain_contamination(rows, items, n=10):
    grams = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(0, len(w) - n) + 1 if w else 0):
            grams.setdefault(tuple(w[i: i + n]), set()).add(item)
    out = []
    for doc, text, *_ in rows:
        w, hit, found = plain_words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i: i + k]) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[tuple(w[i: i + k])]
        out.append((doc, len(w), len(hit), len(found), brute.sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_contamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", bound)
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, ", ".join(rng.choice(vocab) for _ in range(rng.choice([10, 15, 30])))) for i in range(12)] + [(12, "Short one É"), (13, ""), (14, None), (3, "again; the same id with more than ten words in it so there"), (15, "v1-v2")]
    rows = brute.corpus(3, 60)
    for d in range(500, 530):
        w = [rng.choice(vocab) for _ in range(60)]
        own = plain_words(rng.choice(items)[1]) or ["x"]
        at = rng.randrange(len(own))
        w[20:20] = own[at: at + rng.choice([9, 10, 12])]
        rows.append((d, " ".join(w).upper() if d % 2 else "(" + ")(".join(w), *[None] * 7))
    rows += [rows[-1], (None, items[0][1], *[None] * 7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, rows), bench).drop("spans").collect()
    want = plain_contamination(rows, items)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(w[5] for w in want) and any(not w[5] for w in want)
    clean = drop_contaminated(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    left = {r["id"]: r["text"] for r in remove_passages(frame(spark, rows), bench).collect()}
    for doc, text, *_ in rows:
        hits = next(w for w in want if w[0] == doc)
        assert len(plain_words(left[doc])) == hits[1] - hits[2] and (hits[5] or left[doc] == text)
    windows = decontaminate.benchmark_windows(bench, "item_id", "text", 10)
    plan = decontaminate.find_hits(frame(spark, rows), windows, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint" in plan or "strategy=broadcast" in plan) == (bound > 0)
    if not bound:  # keys and places are shuffled, never the words of a text
        sides = [n for n in re.findall(r"Project \[([^\n]*)\]", plan) if "key#" in n and "at#" in n]
        assert sides and not any(re.search(r"\bw#", n) for n in sides)
    assert contamination(frame(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert contamination(frame(spark, []), bench).count() == 0 and drop_contaminated(frame(spark, []), bench).count() == 0


def test_sainte_lague():
    for seed in range(30):
        rng = random.Random(seed)
        votes = [rng.choice([0, 10, 10, rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 12))]
        limits = [rng.choice([2, 50, 10**6]) for _ in votes]
        seats, want = rng.randrange(0, 300), [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i, v in enumerate(votes) if v and want[i] < limits[i]]
            if open_:
                want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert sainte_lague(votes, seats, limits) == want, (votes, limits, seats)


def test_targets():
    assert capped_targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    got = capped_targets([10, 1000, 1000], [5, 2, 1], 3)
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 400])), "en", rng.choice(["a", "b", "é", "c", None]), *[None] * 5) for i in range(300)]
    rows += [(7, "one two", *[None] * 7), (None, "x " * 30_000, "en", "tiny", *[None] * 5), (301, None, "en", "zero", *[None] * 5)]
    got = mix_sources(frame(spark, rows), shard_words=5000).collect()
    again = mix_sources(frame(spark, rows, 5), shard_words=5000).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, capped_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    source = {r[0]: r[3] for r in rows if r[0] != 7}
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["id"] != 7:
            s = source[r["id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
            taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - target[s]) <= 10 * (2 + math.ceil(sizes[s] / 5000)) + (1200 if s in (source[0], None) else 0), (s, t, target[s])
    assert mix_sources(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mix_sources(frame(spark, [(1, None, *[None] * 7)])).collect()] == [0]


def test_mixing_many_sources(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"s{i}" for i in range(150)] + ["é", None]
    # Many sources of equal size tie at the last quotient; some are small enough to be capped, some empty.
    size = {n: rng.choice([0, 3, 40, 40, 40, 900]) for n in names}
    rows = [(i, " ".join(["w"] * size[n]), "en", n, *[None] * 5) for i, n in enumerate(names * 2)]
    for weights, cap in [((5, 2, 1), 3), ((1000, 1), 1)]:
        few = mix_sources(frame(spark, rows), weights, cap, shard_words=500).collect()
        monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
        many = mix_sources(frame(spark, rows), weights, cap, shard_words=500).collect()
        monkeypatch.undo()
        assert sorted(map(tuple, many)) == sorted(map(tuple, few)) and len(many) == len(rows)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    none = mix_sources(frame(spark, [(i, None, "en", n, *[None] * 5) for i, n in enumerate(names)])).collect()
    assert len(none) == len(names) and {(r["target"], r["taken"]) for r in none} == {(0.0, 0)}


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: ". ".join(" ".join(f"w{rng.randrange(300)}" for _ in range(9)) for _ in range(rng.randrange(1, 12)))
    bad = lambda: " ".join(f"w{rng.randrange(300)}$$$" for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "s", 1, i, "k", 0, "n") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    # What is held out never teaches: wrong labels there change nothing.
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, 1 - quality, quality) AS quality", "toxic")
    docs = frame(spark, rows + [(1000, None, *[None] * 7), (1001, "", *[None] * 7), (1002, "x" * 300_000, *[None] * 7)])
    m = learn_quality(docs, labels)
    assert np.array_equal(m.linear, learn_quality(docs, flipped).linear)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, m).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert all((got[i] >= 0.5) == (i % 4 != 0) for i in range(600) if brute.held_out(i))
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in got.items() if s >= 0.5}
    assert {r["score"] for r in score_quality(docs, learn_quality(docs, labels.limit(0))).collect()} and keep_good(frame(spark, []), labels).count() == 0


def test_pair_identity():
    rng = np.random.default_rng(1)
    m = Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    number, value = np.array([1, 5, 7, 2, 9]), np.array([1, 0.5, 2, 1, 3], dtype=np.float32)
    want = [0.3 + sum(m.linear[number[i]] * value[i] for i in part) + sum(m.factors[number[i]] @ m.factors[number[j]] * value[i] * value[j] for i in part for j in part if i < j) for part in ([0, 1, 2], [3, 4])]
    assert m.logits(number, value, np.array([0, 3, 5])) == pytest.approx(want, rel=1e-4)


PARAGRAPH = "Sentences of some length, with commas and full stops. " * 12
PAGES = {
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p><b>{PARAGRAPH}<br><p>Short.</article><footer>&copy; x</footer></body>":
        f"Head & more {PARAGRAPH}Short.",
    f"<div class='sidebar'>Links</div><div id=content><div><p>{PARAGRAPH}</p></div><div><p>Two<i>sy</i>llables {PARAGRAPH}</p></div></div><div class='comment-list'><p>{PARAGRAPH}</p></div>":
        f"{PARAGRAPH}Twosyllables {PARAGRAPH}".strip(),
    "": "", None: "", "<p>a<p>b": "a b", "no markup &lt;x&gt;": "no markup <x>", "<script>var a='<p>no</p>';</script><p>yes</p><!-- <p>no</p> -->": "yes",
    f"<body><div><form>Mail <input></form><p>{PARAGRAPH}</p><div class='ad'>Buy</div><p>End</p></div><div id='cookie-notice'>We use cookies</div></body>": f"{PARAGRAPH}End",
    f"<body class='no-sidebar'><main><header>Top</header><p>{PARAGRAPH}</p><aside>By the way</aside><table><tr><td>1<td>2</table></main></body>": f"{PARAGRAPH}1 2",
}


def test_pages(spark):
    for page, text in PAGES.items():
        assert main_text(page) == text.strip(), page
    rows = [(i, None, p, "t", 1) for i, p in enumerate(PAGES)] + [(None, "u", "<p>" + "long " * 100_000 + "</p>", None, None)] * 2
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["id"] is not None} == {t.strip() for t in PAGES.values()}
    assert max(r["n_chars"] for r in got) == 499_999
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BLOCK_PAGES = {
    # No block of the three holds more than a third; the parent's sum is less than a part's.
    "<body><div id=story>{}</div></body>".format("".join(f"<div class=story-part>{f'<p>{k} {PARAGRAPH}</p>' * 5}</div>" for k in "abc")): " ".join(f"{k} {PARAGRAPH.strip()}" for k in "abc" for _ in range(5)),
    f"<body><ul class=links><li><a href=x>One</a><li><a href=y>Two</a></ul><div class=post-intro><p>What it is about.</p></div><div class=post-body>{f'<p>{PARAGRAPH}</p>' * 5}</div></body>":
        "What it is about. " + PARAGRAPH * 5,
    f"<body><div class=row><div class=post-intro><span>Lead.</span></div></div><div class=row><div class=post-body>{f'<p>{PARAGRAPH}</p>' * 5}</div></div></body>": "Lead. " + PARAGRAPH * 5,
    f"<body><div id=content><div class=left><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class=entry>{f'<p>{PARAGRAPH}</p>' * 5}</div><div class=data><table><tr><td>1<td>2</table></div></div>Made by us</body>":
        PARAGRAPH * 5 + "1 2",
    f"<body><article>{f'<p>a {PARAGRAPH}</p>' * 5}</article><div>Between</div><article>{f'<p>b {PARAGRAPH}</p>' * 5}</article></body>": f"a {PARAGRAPH}" * 5 + f"b {PARAGRAPH}" * 5,
}


@pytest.mark.parametrize("page", BLOCK_PAGES)
def test_articles_in_several_blocks(page):
    assert main_text(page) == BLOCK_PAGES[page].strip()


CUT_PAGES = {
    f"<article><p>{PARAGRAPH}<svg viewBox='0 0 1 1'/> after <math/> math</p><p>End</p></article>": f"{PARAGRAPH}after math End",
    f"<article><svg><title/><text>Axis</text></svg><p>{PARAGRAPH}</p><svg><path d=x><p>Next</p></article>": f"{PARAGRAPH}Next",
    f"<article><p>{PARAGRAPH}<svg><foreignObject><div>Label</div></foreignObject></svg> end</p></article>": f"{PARAGRAPH}end",
    **{f"<article><div><{x} data=a>Fallback</div><p>{PARAGRAPH}</p><{x}><p>Next</p><p>And <{x} src=b />so on</p></article>": f"{PARAGRAPH}Next And so on" for x in ("object", "video", "audio", "canvas")},
    f"<article><p>One <video><p>Fallback</p></video>two <object><object>In</object>out</object>three {PARAGRAPH}</p></article>": f"One two three {PARAGRAPH}",
    f"<article><p>{PARAGRAPH}So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>": f"{PARAGRAPH}So a=1 holds.",
    f"<body><div class='post comments-open'><p>{PARAGRAPH}</p></div><div class='post-comments'><p>Me too</p></div></body>": PARAGRAPH,
    f"<body><section id=story class='category-advertising'><p>{PARAGRAPH}</p></section><div class=content role=navigation>Menu</div></body>": PARAGRAPH,
}


@pytest.mark.parametrize("page", CUT_PAGES)
def test_no_article_text_cut(page):
    assert main_text(page) == CUT_PAGES[page].strip()


# Names made from titles, stray quotes, odd comments and tags cut off.
NAMED_PAGES = {
    **{f"<body><article><p>{PARAGRAPH}</p>{part}<p>{PARAGRAPH}</p></article></body>": f"{PARAGRAPH}{told} {PARAGRAPH}" for part, told in [
        (f"<section id='related-work'><h2>Related work</h2><p>{PARAGRAPH}</p></section>", f"Related work {PARAGRAPH.strip()}"),
        (f"<section id='social-effects'><p>{PARAGRAPH}</p></section>", PARAGRAPH.strip()),
        ("<h2 id='search'>Search</h2>", "Search"), ("<h1 id='comment-on-the-law'>On the law</h1>", "On the law"),
        (f"<p id='notice-period'>{PARAGRAPH}</p>", PARAGRAPH.strip()),
        ("<p class=it's>It is</p>", "It is"), ("<p><a href=\"x>stray</a> and <a href=\"y\">fine</a></p>", "stray and fine"),
        ("<p title='a > b'>Shown</p>", "Shown"), ("<!-->In<!-- x --!>between<!---> here<!-- > -->", "Inbetween here"),
    ]},
    **{f"<body><article><p>{PARAGRAPH}</p>{part}</article></body>": PARAGRAPH for part in [
        "<div id=comments><p>Me too, and at length.</p></div>", "<div class='comment-list'><p>Me too</p></div>", "<p class=share>Share</p>",
        "<section id='related-posts'><a href=x>One more</a> <a href=y>Another</a></section>", "<div id=site-search>Find</div>",
    ]},
    f"<body><article><p>{PARAGRAPH}<a <b <c": PARAGRAPH,
    f"<body><article><p>{PARAGRAPH}<a href=\"x": PARAGRAPH,
    f"<body><div id=main-content><div class=links><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class=text>{f'<p>{PARAGRAPH}</p>' * 5}</div></div></body>": PARAGRAPH * 5,
}


@pytest.mark.parametrize("page", NAMED_PAGES)
def test_names_quotes_and_comments(page):
    assert main_text(page) == NAMED_PAGES[page].strip()


@pytest.mark.parametrize("part", ["<a ", "<div>", "<object>", "<a b=\"x>", "<li><div>", "<div></x>", "<div><td>", "<svg><div>", "<!--", "<div class=post>"])
def test_time_is_linear(part):
    """A megabyte takes seconds, where a square would take hours."""
    began = time.monotonic()
    main_text(part * (1_000_000 // len(part)) + PARAGRAPH)
    assert time.monotonic() - began < 60
