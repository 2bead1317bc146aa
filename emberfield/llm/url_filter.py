"""Allow and block lists for urls: a trie over reversed host labels and path segments.

A rule fits its host and all subdomains where the path starts with the rule's. The rule with the longest host
wins, then the longest path; of two equal rules, block. The trie is broadcast while the list has at most ``MAX_RULES``
rows; a longer list is joined on the suffixes of the hosts instead, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii

MAX_RULES = 200_000
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
HOST_END, PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or without ``://``."""
    if not isinstance(url, str) or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = m.start() if (m := HOST_END.search(rest)) else len(rest)
    path = rest[end:]
    return rest[:end].translate(LOWER_ASCII), path[: m.start()] if (m := PATH_END.search(path)) else path


class Trie:
    """Node: (children by label, path node); path node: (children by segment with its slash, rule or None, open rules by prefix)."""

    def __init__(self, rules):
        self.root = ({}, [{}, None, {}])
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, ({}, [{}, None, {}]))
            at, (whole, rest) = node[1], self.segments(path)
            for segment in whole:
                at = at[0].setdefault(segment, [{}, None, {}])
            entry = (host + path, verdict)
            if rest:
                at[2][rest] = self.stricter(at[2].get(rest), entry)
            else:
                at[1] = self.stricter(at[1], entry)

    @staticmethod
    def segments(path: str) -> tuple[list[str], str]:
        *whole, rest = path.split("/")
        return [s + "/" for s in whole], rest

    @staticmethod
    def stricter(old, new):
        return old if old and old[1] == "block" else new

    def path_rule(self, at, path: str):
        best, start = None, 0
        while True:
            best = at[1] or best
            if at[2]:
                rest = path[start:]
                best = max(((len(k), v) for k, v in at[2].items() if rest.startswith(k)), default=(0, best), key=lambda x: x[0])[1]
            end = path.find("/", start) + 1
            at = at[0].get(path[start:end]) if end else None
            if at is None:
                return best
            start = end

    def find(self, host: str, path: str):
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            best = self.path_rule(node[1], path) or best
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Verdict on every url: ``id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    ``rules`` has host, path, verdict. A null url or one without ``://`` has an empty host and path, which only
    a rule with an empty host could fit. Rows repeated are judged alike; rules with nulls are ignored; without rules
    the default holds. Only the id and the url are read from ``pages``.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    listed = rules.limit(max_rules + 1).collect()
    if len(listed) > max_rules:
        return _judge_by_join(urls, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in listed]))
    kind = urls.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [split_url(u) for u in batch["url"]]
            found = [trie.value.find(h, p) for h, p in parts]
            yield pd.DataFrame({
                "id": batch["id"], "host": [h for h, _ in parts], "path": [p for _, p in parts],
                "rule": pd.Series([f and f[0] for f in found], dtype=object), "verdict": [f[1] if f else default for f in found],
            })

    return urls.mapInPandas(work, f"id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a shuffle join of host suffixes with the rules, for lists too long to broadcast."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    urls = urls.withColumn("rest", rest).select(
        "id", F.monotonically_increasing_id().alias("n"), lower_ascii(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), r"^[^?#]*", 0).alias("path"),
    )
    urls = durable(urls)  # the row numbers must stay as they are
    rules = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> concat_ws('.', slice(split(host, '[.]'), i, size(split(host, '[.]')))))")
    fit = urls.withColumn("r_host", F.explode(suffixes)).join(rules, "r_host").filter("startswith(path, r_path)")
    best = fit.groupBy("n").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), F.struct(F.length("r_host"), F.length("r_path"))).alias("best"))
    out = urls.join(best, "n", "left")
    return out.select("id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
