"""URL filters: a trie over reversed host labels and path segments, longest match first.

The trie goes out with the tasks. Rules come as a list, so they fit the driver; more than BLOCK_RULES make several tries, which
read the parsed URLs one after the other and keep the longer match.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_batches

Rule = tuple[str, str, str]
#: Rules of one trie, at most: what is shipped with the tasks at once.
BLOCK_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash sign or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes by host label, from the last one; below each the rules' paths by whole segment.

    A rule's path is a prefix of characters: all its segments but the last must be equal, and the last one must begin
    the URL's segment at that place. The longest host wins, then the longest path, then a block over an allow.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"hosts": {}, "paths": None}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")) if host else ():
                node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}, "lengths": []}
            *whole, last = path.split("/")
            at = node["paths"]
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "ends": {}, "lengths": []})
            known = at["ends"].get(last)
            if known is None or known[0] == "allow":
                at["ends"][last] = (verdict, host + path, len(host), len(path))
                if len(last) not in at["lengths"]:
                    at["lengths"] = sorted([*at["lengths"], len(last)], reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """(verdict, rule, length of its host, of its path) of the longest rule, or None."""
        found = None
        node = self.root
        segments = path.split("/")
        for label in [None, *reversed(host.split(".") if host else [])]:
            if label is not None:
                node = node["hosts"].get(label)
                if node is None:
                    break
            found = (node["paths"] and self._longest(node["paths"], segments)) or found
        return found

    @staticmethod
    def _longest(at: dict, segments: list[str]) -> tuple[str, str, int, int] | None:
        """One lookup for each length that ends of paths have at a node, however many there are."""
        found = None
        for segment in segments:
            found = next((at["ends"][segment[:n]] for n in at["lengths"] if segment[:n] in at["ends"]), found)
            at = at["next"].get(segment)
            if at is None:
                break
        return found


def longer(a: tuple | None, b: tuple | None) -> tuple | None:
    """The longer match of two; of equally long ones that which blocks."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda x: (x[2], x[3], x[0] == "block"))


def filter_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", block_rules: int = BLOCK_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    A null URL, or one without ://, has an empty host and path. Where no rule fits, rule is null and the verdict is
    `default`; this holds without rules, too. Only the two columns are read, so others may have any name; repeated rows,
    null ids included, give repeated results, URLs may be of any length, and no rows give none.
    """
    rules = list(rules)
    out = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    for k, block in enumerate(batched(rules, block_rules)):
        trie = pages.sparkSession.sparkContext.broadcast(Trie(block))

        def judge(frames: Iterator[pd.DataFrame], trie=trie, first=k == 0) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [trie.value.match(h, p) for h, p in zip(frame["host"], frame["path"], strict=True)]
                if not first:
                    before = [None if pd.isna(rule) else (verdict, rule, int(n), int(m)) for rule, verdict, n, m in zip(frame["rule"], frame["verdict"], frame["of_host"], frame["of_path"], strict=True)]
                    found = [longer(a, b) for a, b in zip(before, found, strict=True)]
                found = [x or (default, None, -1, -1) for x in found]
                yield frame.assign(rule=pd.Series([x[1] for x in found], dtype=object), verdict=[x[0] for x in found], of_host=[x[2] for x in found], of_path=[x[3] for x in found])

        out = out.mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string, of_host int, of_path int")
    if not rules:
        out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC NULLS LAST, length(p) DESC NULLS LAST) AS n
  FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
