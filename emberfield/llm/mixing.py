"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in blocks of equal size. The sources get integer quotas by highest quotients, each source's quota is
dealt among its shards the same way, and within a shard a seeded permutation picks the blocks. Everything the size of
the corpus stays in Spark; the driver sees a row per source, or sums only if there are more than MAX_SOURCES.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

# Sources up to which the driver deals the quotas.
MAX_SOURCES = 100_000
MAX_SHARDS = 4_096


def sainte_lague(votes: list[float], seats: int, limits: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), at most ``limits`` each; ties go to the earlier entry."""
    v, cap = np.asarray(votes, dtype=np.float64), np.asarray(limits, dtype=np.int64)
    seats = min(int(seats), int(cap[v > 0].sum()))
    if seats <= 0:
        return [0] * len(v)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(v / (2 * divisor) + 0.5).astype(np.int64), cap)

    low, high = 1e-9 * v.max() / (2 * seats + 1), v.max() * 2
    while at(low).sum() < seats:
        low /= 16
    for _ in range(200):  # the largest divisor that still deals at least so many seats
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    out, sure = at(low), at(high)
    for i in np.argsort(-np.arange(len(v)), kind="stable"):  # seats at the last, tied quotient
        back = min(int(out.sum()) - seats, int(out[i] - sure[i]))
        if back > 0:
            out[i] -= back
    return out.tolist()


def capped_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of all words by weight; what exceeds ``cap`` times a size is shared out again until none does."""
    left, held, targets = float(sum(sizes)), set(), [0.0] * len(sizes)
    while len(held) < len(sizes):
        unit = left / sum(w for i, w in enumerate(weights) if i not in held)
        over = [i for i in range(len(sizes)) if i not in held and unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in range(len(sizes)):
                if i not in held:
                    targets[i] = unit * weights[i]
            break
        for i in over:
            held.add(i)
            targets[i] = cap * sizes[i]
            left -= targets[i]
    return targets


def _before(df: DataFrame, value: str, last: bool = False) -> Column:
    """Sum of ``value`` over the parts before a row's own, or after it; the driver sees a row per part."""
    sums = dict(df.groupBy("part").agg(F.sum(value)).collect())
    parts = range(max(sums, default=0) + 1)
    return F.get(F.array(*(F.lit(sum(n for q, n in sums.items() if (q > p if last else q < p))).cast("long") for p in parts)), "part")


def many_quotas(totals: DataFrame, weights: tuple[float, ...], cap: int, block: int, shard_words: int) -> DataFrame:
    """What :func:`capped_targets` and :func:`sainte_lague` say, a row per source, for any number of sources.

    Each round of the caps and of the search for the divisor is one sum over the sources; they are numbered by a range sort.
    """
    by = F.col("source").asc_nulls_last()
    at = F.monotonically_increasing_id()  # the partition, and 33 bits of the row in it
    parts = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(totals.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("at", at))
    ranged = ranged.select("source", "size", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.lit(1).alias("one"))
    place = F.col("at") + _before(ranged, "one")
    kind = F.pmod(place, F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), "kind")
    sources = durable(ranged.select("source", "size", "part", place.alias("place"), kind.alias("kind")).withColumn("weight", weight))

    sums = {r["kind"]: (r["n"], r["size"]) for r in sources.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    total, held, unit = sum(s for _, s in sums.values()), {}, 0.0
    while total:
        open_ = sum(weights[k] * (n - held.get(k, (0, 0))[0]) for k, (n, _) in sums.items())
        if not open_:
            unit = math.inf
            break
        unit = (float(total) - cap * sum(s for _, s in held.values())) / open_
        over = sources.filter(F.col("weight") * F.lit(unit) > cap * F.col("size")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        now = {r["kind"]: (r["n"], r["size"]) for r in over.collect()}
        if now == held:
            break
        held = now
    share = F.col("weight") * F.lit(unit)
    target = F.when(share > cap * F.col("size"), (cap * F.col("size")).cast("double")).otherwise(share) if total else F.lit(0.0)
    sources = durable(sources.select("source", "size", "part", "place", target.alias("target"), (cap * F.ceil(F.col("size") / block)).cast("long").alias("most")))

    def deal(divisor: float) -> Column:
        return F.floor(F.least(F.col("target") / F.lit(2 * divisor) + 0.5, F.col("most").cast("double"))).cast("long")

    top, limit = sources.agg(F.max("target"), F.sum(F.when(F.col("target") > 0, F.col("most")))).first()
    seats = min(round(total / block), limit or 0)
    quota = F.lit(0).cast("long")
    if seats > 0:
        # Positive doubles are in the order of their bits: 64 parts a pass, until two neighbours deal at least so many seats, and fewer.
        low, high = 1, struct.unpack("<q", struct.pack("<d", top * 2))[0]
        divisor = lambda bits: struct.unpack("<d", struct.pack("<q", bits))[0]
        while high - low > 1:
            tries = sorted({low + (high - low) * i // 64 for i in range(1, 64)} - {low, high})
            got = sources.agg(*(F.sum(deal(divisor(b))).alias(f"n{i}") for i, b in enumerate(tries))).first()
            low = max([low, *(b for b, n in zip(tries, got) if n >= seats)])
            high = min([high, *(b for b, n in zip(tries, got) if n < seats)])
        # Seats at the last, tied quotient are taken back from the last sources.
        out = sources.withColumn("out", deal(divisor(low))).withColumn("tied", F.col("out") - deal(divisor(high)))
        excess = out.agg(F.sum("out")).first()[0] - seats
        after = Window.partitionBy("part").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
        left = F.lit(excess) - _before(out, "tied", last=True) - F.coalesce(F.sum("tied").over(after), F.lit(0))
        sources, quota = out, F.col("out") - F.greatest(F.lit(0), F.least(left, F.col("tied")))
    shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("size") / shard_words))).cast("int")
    return durable(sources.select(F.col("place").cast("int").alias("place"), "source", F.col("size").alias("source_size"), "target", shards.alias("shards"), quota.cast("long").alias("quota")))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block: int = 10, shard_words: int = 100_000,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """A row per document: ``id``, ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted).

    Sources in order of code points, null last, weigh ``weights`` in turn. A document is taken at most ``cap`` times.
    A null or empty text has size 0 and is never taken; an empty table gives an empty one; rows repeated with one id
    are separate documents. A source's taken words differ from its target by about a block per shard. Other columns
    are not read. The driver deals the quotas of up to ``MAX_SOURCES`` sources, Spark those of more, with equal results.
    """
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    base = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    sums = base.groupBy("source").agg(F.sum("size").alias("size"))
    totals = sums.limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        return _dealt(base, many_quotas(sums, weights, cap, block, shard_words), cap, block, seed)
    totals = sorted(((r["source"], r["size"]) for r in totals), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [s for _, s in totals]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap) if sum(sizes) else [0.0] * len(sizes)
    shards = [min(MAX_SHARDS, max(1, math.ceil(s / shard_words))) for s in sizes]
    quotas = sainte_lague(targets, round(sum(sizes) / block), [cap * math.ceil(s / block) for s in sizes]) if sizes else []
    named = docs.sparkSession.createDataFrame(
        [(i, s, n, float(t), k, int(q)) for i, ((s, n), t, k, q) in enumerate(zip(totals, targets, shards, quotas))],
        "place int, source string, source_size long, target double, shards int, quota long",
    )
    return _dealt(base, F.broadcast(named), cap, block, seed)


def _dealt(base: DataFrame, named: DataFrame, cap: int, block: int, seed: int) -> DataFrame:
    """Words taken of each document, from the quotas of the sources."""
    rows = base.join(named, base["source"].eqNullSafe(named["source"])).select(
        "id", "size", "place", "source_size", "target", "quota", F.xxhash64("id", F.lit(seed)).alias("order"),
        F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("shards")).cast("int").alias("shard"),
    )

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        """Quotas of a source's shards, at most MAX_SHARDS rows, and the permutation of each."""
        group = group.sort_values("shard")
        blocks = [-(-int(n) // block) for n in group["words"]]
        got = sainte_lague([float(n) for n in group["words"]], int(group["quota"].iloc[0]), [cap * n for n in blocks])
        step, first = [], []
        for shard, n in zip(group["shard"], blocks):
            a = max(1, int(n * 0.6180339887498949))
            while n and math.gcd(a, n) != 1:
                a += 1
            step.append(a)
            first.append((int(shard) * 2654435761 + seed * 40503) % max(n, 1))
        return pd.DataFrame({"place": group["place"], "shard": group["shard"], "blocks": blocks, "got": got, "step": step, "first": first})

    dealt = rows.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    dealt = dealt.groupBy("place").applyInPandas(deal, "place int, shard int, blocks long, got long, step long, first long")
    # Equal order and id: rows repeated, whose sizes decide; equal sizes are alike.
    stream = Window.partitionBy("place", "shard").orderBy("order", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(stream)).join(dealt, ["place", "shard"])
    taken = f"""if(size = 0 OR blocks = 0, 0L, size * (got div blocks) + aggregate(
        sequence((end - size) div {block}, (end - 1) div {block}), 0L, (a, b) -> a + if((b * step + first) % blocks < got % blocks,
            least(end, (b + 1) * {block}) - greatest(end - size, b * {block}), 0L)))"""
    return rows.select("id", "size", "source_size", "target", F.expr(taken).alias("taken"))
