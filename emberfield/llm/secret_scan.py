"""Secrets in text, with the corpus-wide ownership of each.

Patterns give candidates; their hashes are counted over the whole corpus by distinct repositories and owners. A
value that many owners hold, or one owner in many repositories, is a copied example; one that a single owner holds in few
looks live. High-entropy tokens that look live and that no pattern names are added as spans of kind ``owned``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .tokens import pieces, text_bytes

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "owned"]
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
TOKEN_LEAST, ENTROPY_LEAST = 20, 3.5
# A value with over 1/HOT of all occurrences is hot; there are fewer than HOT such values, so they are broadcast.
HOT = 1000
# Owners, and repositories, from which on a value counts as a widely copied example.
COPIED, COPIED_REPOS = 3, 10

_HEX = np.isin(np.arange(256), [*range(48, 58), *range(97, 103)])
_TOKEN = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), 43, 45, 47, 95])
_SETS = np.isin(np.arange(256), [58, 61])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the three fixed kinds, ends exclusive, in code points."""
    found = [(*m.span(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    found += [(*m.span(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(*m.span(), 2, m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens of letters and digits with high entropy outside the base spans."""
    out = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if len(v) >= TOKEN_LEAST and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= ENTROPY_LEAST:
            if not any(s < m.end() and m.start() < e for s, e, _, _ in base):
                out.append((*m.span(), 3, v))
    return out


def _long_runs(mask: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Does each text hold a run of at least so many bytes of a class? Runs do not cross texts."""
    inside = np.zeros(len(mask) + 1, dtype=bool)
    inside[:-1] = mask
    start = np.zeros(len(mask), dtype=bool)
    start[1:] = mask[1:] & ~mask[:-1]
    if len(mask):
        start[0] = mask[0]
    first = at[:-1][at[:-1] < len(mask)]
    start[first] = mask[first]
    begin = np.flatnonzero(start)
    stop = np.zeros(len(mask) + 1, dtype=bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    edge = at[1:][at[1:] > 0]
    stop[edge] |= inside[edge - 1]
    end = np.flatnonzero(stop)
    out = np.zeros(len(at) - 1, dtype=bool)
    out[np.searchsorted(at, begin[end - begin >= least], side="right") - 1] = True
    return out


FOUND = "row long, id long, owner string, repo string, spans array<struct<start:int,end:int,kind:int,hash:string>>"


def find_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, with their candidates. A scan of the bytes tells which texts the patterns need to see."""
    for batch in batches:
        texts = batch.column("text")
        offsets, data = text_bytes(texts)
        spans: list[list] = [[] for _ in range(len(texts))]
        for i, j in pieces(offsets):
            part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            sets = np.diff(np.append(0, np.cumsum(_SETS[part]))[at]) > 0
            look = sets | _long_runs(_HEX[part], at, LEAST["hex"]) | _long_runs(_TOKEN[part], at, TOKEN_LEAST)
            for k in np.flatnonzero(look):
                text = part[at[k]: at[k + 1]].tobytes().decode("utf-8", "replace")
                base = base_spans(text)
                spans[i + k] = [
                    {"start": s, "end": e, "kind": kind, "hash": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:32]}
                    for s, e, kind, v in base + tokens(text, base)
                ]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("hash", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "owner", "repo")), pa.array(spans, kind)], names=["row", "id", "owner", "repo", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """A row per document: ``id``, ``found``: an array of (start, end, kind, hash, owners, repos, verdict) in order.

    ``verdict`` is "example" for values of at least COPIED owners or COPIED_REPOS repositories, else "live" for those of one
    owner, else "shared". A repository is one of its owner's, and the document where ``repo_col`` is not given. A null or empty text has no secrets; a null owner is an owner of
    its own; rows repeated are scanned each, and count once as repositories. Other columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = durable(rows.mapInArrow(find_candidates, FOUND))
    each = rows.filter(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    # Summed before each shuffle: a value copied everywhere is one row per task, owner and repository.
    spread = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("times"))
    spread = spread.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    spread = spread.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"), F.sum("times").alias("times"))
    verdict = F.when((F.col("owners") >= COPIED) | (F.col("repos") >= COPIED_REPOS), "example").when(F.col("owners") == 1, "live").otherwise("shared")
    spread = durable(spread.select("hash", "owners", "repos", "times", verdict.alias("verdict")))
    # Occurrences of hot values stay where they are; of the others none can fill a task.
    total = spread.agg(F.sum("times")).first()[0] or 0
    hot, rest = spread.filter(F.col("times") * HOT > total).drop("times"), spread.filter(F.col("times") * HOT <= total).drop("times")
    told = each.join(F.broadcast(hot), "hash").unionByName(each.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(rest, "hash"))
    told = told.filter("kind < 3 OR verdict = 'live'")
    found = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "owners", "repos", "verdict"))).alias("found"))
    return rows.select("row", "id").join(found, "row", "left").select("id", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span lists of :func:`scan_secrets`."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = f"array_join(transform({{}}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"
    count = lambda test: F.expr(f"cast(size(filter(found, x -> {test})) as long)")
    return found.select(
        "id", count("x.kind = 0").alias("n_assign"), count("x.kind = 1").alias("n_access"), count("x.kind = 2").alias("n_hex"),
        F.sha2(F.expr(listed.format("filter(found, x -> x.kind < 3)")), 256).alias("base_sha256"), F.expr(listed.format("found")).alias("spans"),
        count("x.kind = 3").alias("n_owned"), count("x.verdict = 'live'").alias("n_live"), count("x.verdict = 'example'").alias("n_example"),
    )
