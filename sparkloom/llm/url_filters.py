"""URL filters: allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from sparkloom.llm.common import Columns, arrow_map

#: The rule set is broadcast; a larger one is refused rather than shipped to every executor.
MAX_RULES = 2_000_000

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # "" or from its "/"

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.translate(_LOWER), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ://."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class UrlTrie:
    """Longest match over hosts with their subdomains and over path prefixes.

    A host node is {label: node}; its entry "" (no label of a host that ends in a name) leads to the
    path trie of the rules for that host. A path node is (children by whole segment, rules by the
    beginning of the next segment), so that /en/7 also fits /en/71.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for n, rule in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, ({}, {}))
            *whole, last = rule.path[1:].split("/") if rule.path else [""]
            key = (bool(rule.path), last)
            for segment in whole:
                node = node[0].setdefault(segment, ({}, {}))
            old = node[1].get(key)
            if old is None or rule.verdict == "block":  # the same rule twice: block wins
                node[1][key] = rule

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule (host and path together) that fits; on a tie the one with the longer host."""
        best, size = None, (-1, -1)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                for rule in self._paths(node[None], path):
                    if (now := (len(rule.text), len(rule.host))) > size:
                        best, size = rule, now
        return best

    @staticmethod
    def _paths(node: tuple, path: str) -> Iterator[Rule]:
        if (False, "") in node[1]:
            yield node[1][False, ""]
        if not path.startswith("/"):
            return
        for segment in path[1:].split("/"):
            starts = node[1]
            if starts:
                for i in range(len(segment) + 1):
                    if (True, segment[:i]) in starts:
                        yield starts[True, segment[:i]]
            node = node[0].get(segment)
            if node is None:
                return


def filter_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge each row's url: (id, host, path, rule, verdict).

    No shuffle: the trie is broadcast (at most MAX_RULES rules) and each partition is mapped. A null
    url, or one without ://, has an empty host and path; then, and when no rule fits, rule is null
    and the verdict is `default`. Ties: see UrlTrie. Repeated rows and null ids are judged row by row; an
    empty table gives an empty result. Other columns are not read.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[Columns]) -> Iterator[Columns]:
        trie = shipped.value
        for b in batches:
            parts = [split_url(u) for u in b["url"]]
            found = [trie.match(h, p) if h else None for h, p in parts]
            yield {
                id_col: b["id"],
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [r and r.text for r in found],
                "verdict": [r.verdict if r else default for r in found],
            }

    kind = pages.schema[id_col].dataType.simpleString()
    return arrow_map(pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")), judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
