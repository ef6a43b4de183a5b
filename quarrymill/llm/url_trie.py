"""URL filter: a trie over reversed host labels, with a trie over path segments at each host.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; a rule fits its host and
all subdomains if the path starts with the rule's path (its last segment may be a part of one); the longest rule wins
(characters of host and path together, then the longer host, then block before allow); no rule leaves the url allowed.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: A rule list is broadcast with the tasks; beyond this many rules it is refused.
MOST_RULES = 1_000_000
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class Node:
    """children: by host label or path segment; rules: (last part of a segment, rank, rule, verdict); paths: at a host."""

    children: dict[str, Node] = field(default_factory=dict)
    rules: list[tuple[str, tuple, str, str]] = field(default_factory=list)
    paths: Node | None = None


def build(rules: Iterable[tuple[str, str, str]]) -> Node:
    """rules: (verdict, host, path)."""
    root, n = Node(), 0
    for verdict, host, path in rules:
        if (n := n + 1) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules can't be broadcast")
        node = root
        for label in reversed(host.translate(LOWER).split(".")):
            node = node.children.setdefault(label, Node())
        if node.paths is None:
            node.paths = Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.children.setdefault(segment, Node())
        node.rules.append((last, (len(host) + len(path), len(host), verdict == "block"), host + path, verdict))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    end = min(ends, default=len(rest))
    path = rest[end:]
    ends = [i for i in map(path.find, "?#") if i >= 0]
    return rest[:end].translate(LOWER), path[: min(ends, default=len(path))]


def longest(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    segments, best, node = path.split("/"), None, root
    for label in reversed(host.split(".")):
        if (node := node.children.get(label)) is None:
            break
        at = node.paths
        for segment in segments if at else ():
            for last, rank, rule, verdict in at.rules:
                if segment.startswith(last) and (best is None or rank > best[0]):
                    best = rank, rule, verdict
            if (at := at.children.get(segment)) is None:
                break
    return best and best[1:]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of every row."""
    trie = build(rules)
    kind = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [longest(trie, *p) or (None, default) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["key", "host", "path", "rule", "verdict"])

    judged = pages.select(key, url).mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("key", key)
