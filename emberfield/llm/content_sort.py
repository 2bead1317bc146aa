"""Exact duplicates by a distributed sort of the content.

Sampled splitters cut the order of (leading bytes, hash) into ranges, each range is sorted externally,
equal texts become neighbours, and the window compares each text in full with the one before it.
A text that holds more than 1/500 of all rows is cut into slices by identifier, so that no range is hot; there are
at most 500 such texts, and their totals come from one aggregation with map-side sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A text with more than one in so many rows is hot: at most as many can be.
HOT_SHARE = 500
SLICES = 512
LEAD = 24


def normalised(text: Column) -> Column:
    """``text`` with each run of white space as one space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row per document: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; with ``carry`` also ``row``, a struct of all its columns.

    Texts are equal when identical after white space is normalised; the smallest id stays. A null text is an
    empty one, and empty texts equal each other. A null id comes after all others. Of rows repeated with one id, one is
    kept. An empty table gives an empty one. Columns of ``docs`` never clash, as they travel inside ``row``.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    hot_rows = max(2, docs.count() // HOT_SHARE)
    hot = (
        rows.groupBy("sha").agg(F.count("*").alias("hot_n"), F.min("id").alias("hot_id"))
        .filter(F.col("hot_n") > hot_rows)
    )
    # At most HOT_SHARE rows by construction, or some of a few rows in a tiny table.
    rows = rows.join(F.broadcast(hot), "sha", "left")
    rows = rows.select(
        "*", F.substring("norm", 1, LEAD).alias("lead"), F.xxhash64("norm").alias("hash"),
        F.when(F.col("hot_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(SLICES))).cast("int").alias("slice"),
    )
    ranged = rows.repartitionByRange("lead", "hash", "slice")
    ordered = Window.partitionBy("lead", "hash", "slice", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ranged.select(
        "id", "sha", "hot_n", "hot_id", F.row_number().over(ordered).alias("rank"), F.first("id").over(whole).alias("first_id"),
        F.count(F.lit(1)).over(whole).alias("n"), *(["row"] if carry else []),
    )
    keep = F.when(F.col("hot_n").isNull(), F.col("first_id")).otherwise(F.col("hot_id"))
    return out.select(
        "id", keep.alias("keep_id"), F.coalesce("hot_n", "n").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("rank") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if carry else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the exact copies, same columns."""
    return exact_groups(docs, id_col, text_col, carry=True).filter("kept").select("row.*")
