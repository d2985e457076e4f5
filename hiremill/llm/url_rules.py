"""URL filters: a trie over reversed host labels and path segments; the longest matching rule wins between allow and block entries.

Rules are a parameter. Their trie is broadcast in parts of bounded size: a list of any length is applied part by part, and the
longest match of all parts is kept, so no worker ever holds more than one part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.shared import ship_package

#: Rules in one broadcast trie.
RULES_PER_PART = 200_000
ALLOW, BLOCK = "allow", "block"
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_AFTER_HOST, _AFTER_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters lowered) and path; both empty for null and for a url without `://`."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = _AFTER_HOST.search(rest)
    host = rest[:end.start()] if end else rest
    tail = rest[len(host):]
    stop = _AFTER_PATH.search(tail)
    return host.translate(_LOWER), tail[:stop.start()] if stop else tail


@dataclass
class Node:
    """Children by label or segment, the path trie below a host, and the rules that end here by the start of the next segment."""

    children: dict[str, Node] = field(default_factory=dict)
    path: Node | None = None
    ends: list[tuple[str, str, str]] = field(default_factory=list)


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as `example.com/en/`; without a slash the path is empty and any path fits."""
    host, sep, path = rule.partition("/")
    return host.translate(_LOWER), sep + path


def build_trie(rules: Sequence[tuple[str, str]]) -> Node:
    """Trie of (verdict, rule). Of a rule that is given twice, block wins over allow."""
    root = Node()
    for verdict, rule in sorted(rules, key=lambda r: (r[1], r[0])):
        host, path = split_rule(rule)
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.children.setdefault(label, Node())
        node.path = node.path or Node()
        node = node.path
        *closed, rest = path.split("/")
        for segment in closed:
            node = node.children.setdefault(segment, Node())
        node.ends = [e for e in node.ends if e[0] != rest] + [(rest, rule, verdict)]
    return root


def longest_match(root: Node, host: str, path: str) -> tuple[int, int, str, str] | None:
    """(host labels, path length, rule, verdict) of the rule with the longest host and, on it, the longest path; None without a match."""
    nodes, node, labels = [(0, root)], root, 0
    for label in reversed(host.split(".")) if host else ():
        node = node.children.get(label)
        if node is None:
            break
        labels += 1
        nodes.append((labels, node))
    for labels, node in reversed(nodes):
        if node.path is None:
            continue
        best, at, length, rest = None, node.path, 0, path
        while at is not None:
            for start, rule, verdict in at.ends:
                if rest.startswith(start) and (best is None or length + len(start) > best[1]):
                    best = (labels, length + len(start), rule, verdict)
            segment, sep, rest = rest.partition("/")
            at, length = (at.children.get(segment), length + len(segment) + 1) if sep else (None, length)
        if best:
            return best
    return None


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = ALLOW, url: str = "url", rules_per_part: int = RULES_PER_PART) -> DataFrame:
    """Adds host, path, rule (null without a match) and verdict to every row; no row is dropped and nothing is shuffled.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of two fitting rules the one with the longer
    host wins, then the one with the longer path. A null url or one without `://` has an empty host and path, which no rule with a host
    fits. Columns of these names that the table has already are replaced; repeated rows are judged alike.
    """
    bad = [r for r in rules if len(r) != 2 or r[0] not in (ALLOW, BLOCK) or not isinstance(r[1], str)]
    if bad or default not in (ALLOW, BLOCK):
        raise ValueError(f"rules are (allow or block, host and path): {bad[:3]}, {default}")
    spark = pages.sparkSession
    ship_package(spark)
    found = "struct<host:string,path:string,labels:int,length:int,rule:string,verdict:string>"
    out, columns = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]), []
    parts = [rules[i:i + rules_per_part] for i in range(0, len(rules), rules_per_part)] or [[]]
    for k, part in enumerate(parts):
        shared = spark.sparkContext.broadcast(list(part))

        @F.pandas_udf(found)
        def match(urls):
            import pandas as pd

            root = build_trie(shared.value)
            rows = []
            for u in urls:
                host, path = split_url(u)
                best = longest_match(root, host, path) or (-1, -1, None, None)
                rows.append((host, path, *best))
            return pd.DataFrame(rows, columns=["host", "path", "labels", "length", "rule", "verdict"])

        columns.append(f"__match{k}")
        out = out.withColumn(columns[-1], match(F.col(url).cast("string")))
    best = columns[0] if len(columns) == 1 else None
    chosen = F.col(best) if best else F.greatest(*(F.struct(F.col(c)["labels"].alias("labels"), F.col(c)["length"].alias("length"),
                                                            F.when(F.col(c)["verdict"] == BLOCK, 1).otherwise(0).alias("block"), F.col(c)["rule"].alias("rule"),
                                                            F.col(c)["verdict"].alias("verdict"), F.col(c)["host"].alias("host"), F.col(c)["path"].alias("path")) for c in columns))
    return out.withColumn("__best", chosen).withColumns({
        "host": F.col("__best")["host"], "path": F.col("__best")["path"], "rule": F.col("__best")["rule"],
        "verdict": F.coalesce(F.col("__best")["verdict"], F.lit(default))}).drop("__best", *columns)
