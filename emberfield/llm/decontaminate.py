"""Benchmark passages in training text.

The benchmark's windows of ``n`` words form a hash set that is broadcast; each document's windows are scanned
against it inside the JVM, every hit is verified word by word, and the words hit (or the whole document) are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before A-Z is lower-cased, as an expression and inside a SQL text.
ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
ANY_CASE_SQL = ANY_CASE.replace("\\", "\\\\")
# The set is broadcast up to this many windows of about 100 bytes; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
# Keys of contaminated texts, of 16 bytes, are broadcast up to this many.
BROADCAST_TEXTS = 1_000_000
# A window, or a text, that a third of all rows share meets its matches in so many tasks.
SALTS = 16


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _gram(array: str, start: str, length: str) -> str:
    return f"array_join(slice({array}, {start}, {length}), ' ')"


def _key(hashes: str, start: str, length: str) -> str:
    return f"xxhash64(slice({hashes}, {start}, {length}))"


def _windows(length: str) -> str:
    """Hashes of all windows of ``length`` words; ``h`` holds the words' hashes."""
    return f"if(size(h) >= {length}, transform(sequence(1, size(h) - {length} + 1), i -> {_key('h', 'i', length)}), array())"


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows (key, len, gram, item): an item of fewer than ``n`` words, but not none, is one window."""
    rows = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(n))).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    rows = rows.select("item", "len", "w", F.expr(f"posexplode({_windows('len')}) AS (at, key)"))
    return rows.select("key", "len", F.expr(_gram("w", "at + 1", "len")).alias("gram"), "item").distinct()


def _text_key(text: Column, one: str = "one", two: str = "two") -> list[Column]:
    """128 bits of a text: what is found in a text holds for all rows that have it."""
    return [F.xxhash64(text).alias(one), F.xxhash64(F.lit(1), text).alias(two)]


def _scans(lengths: list[int]) -> list[Column]:
    return [F.expr(f"transform({_windows(str(k))}, (x, p) -> struct(x AS key, p AS at, {k} AS len))") for k in lengths]


def _back(rows: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """``rows`` with what was found in their texts, if anything; a text of a third of all rows is dealt to SALTS tasks."""
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(found, [*key, "salt"], "left").drop(*key, "salt")


def find_hits(rows: DataFrame, windows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """For each row of ``rows`` one mark (``at`` null) and one row per verified window in it.

    Columns: ``keep``, ``n_words``, ``at`` (first word, from 0), ``len``, ``gram``. Up to BROADCAST_WINDOWS one pass over the text gives both.
    Beyond, keys and places alone meet the windows; what they find returns to the texts, which verify it word by word and give the marks.
    """
    grams = durable(windows.select("key", "len", "gram").distinct())
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most n values
    hashed = F.expr("transform(w, x -> xxhash64(x))")
    if grams.count() > BROADCAST_WINDOWS:
        key = "text_one", "text_two"
        keyed = rows.select(*_text_key(F.col(text), *key), words(F.col(text)).alias("w")).withColumn("h", hashed)
        sent = keyed.select(*key, F.inline(F.concat(*_scans(lengths)))).withColumn("salt", F.pmod(key[0], F.lit(SALTS)).cast("int"))
        dealt = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = sent.join(dealt, ["key", "len", "salt"]).groupBy(*key).agg(F.collect_set(F.struct("at", "len", "gram")).alias("found"))
        rows = _back(rows.select(*keep, F.col(text).alias("scanned"), *_text_key(F.col(text), *key)), found, *key).withColumn("w", words(F.col("scanned")))
        hits = F.expr(f"filter(coalesce(found, array()), x -> {_gram('w', 'x.at + 1', 'x.len')} = x.gram)")
        mark = F.expr("array(struct(CAST(NULL AS INT) AS at, 0 AS len, '' AS gram))")
        return rows.select(*keep, F.size("w").alias("n_words"), F.inline(F.concat(mark, hits)))
    mark = rows.sparkSession.range(1).select(F.xxhash64(F.lit("mark")).alias("key"), F.lit(0).alias("len"), F.lit("").alias("gram"))
    last = F.array(F.struct(F.xxhash64(F.lit("mark")).alias("key"), F.lit(-1).alias("at"), F.lit(0).alias("len")))
    rows = rows.select(*keep, words(F.col(text)).alias("w")).withColumn("h", hashed)
    rows = rows.select(*keep, "w", F.explode(F.concat(*_scans(lengths), last)).alias("x"))
    rows = rows.select(*keep, "w", F.col("x.key").alias("key"), F.col("x.at").alias("at"), F.col("x.len").alias("k"))
    hits = rows.join(F.broadcast(grams.unionByName(mark)), "key").filter(f"k = len AND (at < 0 OR {_gram('w', 'at + 1', 'k')} = gram)")
    return hits.select(*keep, F.size("w").alias("n_words"), F.expr("nullif(at, -1)").alias("at"), "len", "gram")


def _covered(spans: str) -> str:
    """Words in the union of spans (start, end), sorted."""
    return f"""aggregate({spans}, struct(0 AS n, 0 AS upto),
        (a, s) -> struct(a.n + greatest(0, s.end - greatest(s.start, a.upto)) AS n, greatest(a.upto, s.end) AS upto), a -> a.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``spans``.

    ``spans`` lists the windows found as (start, end) in words. Null and empty texts have no words; items without words
    have no windows; a null item id counts as none. Repeated rows of either table each get their result, an empty benchmark
    contaminates nothing, and further columns are not read.
    """
    windows = durable(benchmark_windows(benchmark, item_col, item_text, n))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = durable(find_hits(rows, windows, ["row", "id"]))
    per_doc = hits.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.expr("if(at IS NULL, NULL, struct(at AS start, at + len AS end))"))).alias("spans"),
    )
    items = (
        hits.filter("at IS NOT NULL").select("row", "gram", "len").distinct()
        .join(windows.select("gram", "len", "item").filter("item IS NOT NULL"), ["gram", "len"])
        .groupBy("row", "item").agg(F.lit(1)).groupBy("row").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    )
    out = per_doc.join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("n_hit", F.expr(_covered("spans")).cast("long"))
    return out.select(
        "id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, same columns."""
    windows = benchmark_windows(benchmark, item_col, item_text, n)
    texts = docs.select(F.col(text_col).alias("text")).select("text", *_text_key(F.col("text")))
    hit = durable(find_hits(texts, windows, ["one", "two"]).filter("at IS NOT NULL").select("one", "two").distinct())
    one, two = fresh(docs.columns, "text_one"), fresh(docs.columns, "text_two")
    hit, small = hit.withColumnsRenamed({"one": one, "two": two}), hit.count() <= BROADCAST_TEXTS
    key = _text_key(docs[text_col])
    return docs.join(F.broadcast(hit) if small else hit, (key[0] == hit[one]) & (key[1] == hit[two]), "left_anti")


def remove_passages(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id`` and ``text``: the text from which the words hit are cut, other characters kept as they are."""
    windows = benchmark_windows(benchmark, item_col, item_text, n)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text", *_text_key(F.col("text")))
    hits = find_hits(rows, windows, ["one", "two"]).filter("at IS NOT NULL").select("one", "two", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("p"))
    rows = _back(rows, hits.groupBy("one", "two").agg(F.collect_set("p").alias("hit")), "one", "two")
    gaps = F.split("text", ANY_CASE)
    cut = F.expr(f"""concat(gaps[0], array_join(transform(regexp_extract_all(text, '{ANY_CASE_SQL}', 0),
        (x, i) -> concat(if(array_contains(hit, i), '', x), gaps[i + 1])), ''))""")
    return rows.withColumn("gaps", gaps).select("id", F.when(F.col("hit").isNull(), F.col("text")).otherwise(cut).alias("text"))
