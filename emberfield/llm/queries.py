"""The operators over the given tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .content_sort import exact_groups
from .decontaminate import contamination
from .html_text import extract_text
from .language_id import held_out as language_held_out
from .language_id import learn_languages, tell_languages
from .mixing import mix_sources
from .near_dup import near_groups
from .quality import held_out, learn_quality, score_quality
from .recompression import drop_repeated_passages
from .secret_scan import digest, scan_secrets
from .spelling import spelling_groups
from .suffix_dedup import repeated_spans
from .url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_url_filter", r"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC NULLS LAST, length(p) DESC) AS k
    FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1""")
def op2(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules).withColumnRenamed("id", "page_id")


@query("op6_exact_dedup", r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)""")
def op6(spark, folder):
    return exact_groups(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_mixing")
def op7(spark, folder):
    return mix_sources(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op8_decontamination", f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS gram FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) x(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(gram) AS k FROM g),
win AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS gram FROM d, lens, unnest(range(1, len(w) - k + 2)) x(i) WHERE len(w) >= k),
hit AS (SELECT win.*, item_id FROM win JOIN g USING (gram)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) x(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8(spark, folder):
    out = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.withColumnRenamed("id", "doc_id").drop("spans")


def _covered_sql(window: int) -> str:
    """Words covered by a window that also starts earlier, from scratch."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {window - 1}) AS g FROM d, unnest(range(1, len(w) - {window - 2})) x(i) WHERE len(w) >= {window}),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM late, unnest(range(i, i + {window})) x(p)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.x, ' ' ORDER BY e.p) AS t FROM (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) y(p)) e
    ANTI JOIN gone USING (doc_id, p) GROUP BY e.doc_id)"""


@query("op5_substring_dedup", _covered_sql(20) + """
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op5(spark, folder):
    return drop_repeated_passages(table(spark, folder, "documents"), with_text=False).withColumnRenamed("id", "doc_id")


@query("op9_near_dedup", r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) x(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""")
def op9(spark, folder):
    return near_groups(table(spark, folder, "documents")).drop("k").withColumnRenamed("id", "doc_id")


@query("op3_quality")
def op3(spark, folder):
    docs = table(spark, folder, "documents")
    scored = score_quality(docs.select("doc_id", "text"), learn_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_secrets")
def op4(spark, folder):
    return digest(scan_secrets(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


@query("op10_html_text")
def op10(spark, folder):
    return extract_text(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query("op1_suffix_dedup", _covered_sql(50).split("\nkept AS")[0].rstrip(",") + """,
m AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM gone)
SELECT doc_id, min(p) - 1 AS start, max(p) AS "end", count(*) AS n_words FROM m GROUP BY doc_id, grp""")
def op1(spark, folder):
    return repeated_spans(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


# CRC32 bit by bit; words one edit apart share what is left when a letter is dropped at the same place, or one is the other less a letter.
@query("op11_spelling", r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
e AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM d GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [192 | (unicode(c) >> 6), 0, 0, 0, 0, 0, 0, 0, 128 | (unicode(c) & 63), 0, 0, 0, 0, 0, 0, 0] END)),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS h FROM e WHERE length(run) >= 6),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS MATERIALIZED (SELECT *, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM i),
p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
r AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN r USING (word)),
t AS (WITH RECURSIVE s AS (SELECT word, word AS here, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next) SELECT word, here AS root FROM s WHERE next IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t USING (word)""")
def op11(spark, folder):
    return spelling_groups(table(spark, folder, "documents"))


@query("op12_collocations", r"""WITH d AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS MATERIALIZED (SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM w),
q AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY piece ORDER BY pos)),
g AS MATERIALIZED (SELECT lang, 1 AS k, w1 AS phrase FROM q UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM q WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM q WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM q WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS MATERIALIZED (SELECT lang, k, phrase, a, unnest(range(1, k)) AS j, w FROM c),
s AS MATERIALIZED (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score FROM cut c
  JOIN f x ON x.lang || ' ' || x.phrase = c.lang || ' ' || array_to_string(w[1:j], ' ') JOIN f y ON y.lang || ' ' || y.phrase = c.lang || ' ' || array_to_string(w[j+1:], ' ')),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS MATERIALIZED (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, unnest(list_transform(range(1, k), lambda i: array_to_string(w[i:i + 1], ' '))) AS phrase FROM c WHERE k > 2
  UNION ALL SELECT lang, a, unnest(list_transform(range(1, k - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM c WHERE k > 3) GROUP BY ALL),
kept AS MATERIALIZED (SELECT b.* FROM b LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM rk JOIN n USING (lang) WHERE rank <= 2000""")
def op12(spark, folder):
    return collocations(table(spark, folder, "documents"))


@query("op13_language_id")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    told = tell_languages(docs.select("doc_id", "text"), learn_languages(docs))
    return told.select("doc_id", language_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
