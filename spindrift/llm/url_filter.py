"""URL allow and block lists in a trie over reversed host labels and path segments.

A rule is a host and the start of a path. It fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's, character by character. Of the rules that fit, the one with the most host labels wins, then the longest
path; of two equal rules the block entry wins. A url that no rule fits gets the default verdict, allow.

The trie is made once on the driver from a rule list that the caller states (its size is checked against `MOST_RULES`),
broadcast, and walked for each url over Arrow batches of the url column alone: no shuffle.

Defined cases: host and path of a null url or one without `://` are empty; no rule fits an empty host. Ports and user names
stay part of the host. Repeated rows are judged one by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Beyond this many rules, a broadcast trie is refused.
MOST_RULES = 1_000_000
#: (verdict, host, start of the path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"


class Node:
    """labels: next host label to the left; paths: the trie over path segments of rules that end at this host."""

    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.paths: Segment | None = None


class Segment:
    """below: next whole segment; partial: (start of a segment, rule) of rules that end here, longest first."""

    __slots__ = ("below", "partial")

    def __init__(self):
        self.below: dict[str, Segment] = {}
        self.partial: list[tuple[str, str, str]] = []


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    root, count = Node(), 0
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or not path.startswith("/"):
            raise ValueError(f"not a rule: {(verdict, host, path)}")
        if (count := count + 1) > MOST_RULES:
            raise ValueError(f"over {MOST_RULES} rules; split the list or join on it")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, Node())
        node.paths = at = node.paths or Segment()
        *whole, last = path[1:].split("/")
        for segment in whole:
            at = at.below.setdefault(segment, Segment())
        at.partial.append((last, verdict, host + path))
        at.partial.sort(key=lambda x: (-len(x[0]), x[1] != "block"))
    return root


def longest_path(paths: Segment, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule path that the path starts with."""
    if not path.startswith("/"):
        return None
    found, at = None, paths
    *whole, last = path[1:].split("/")
    for i, segment in enumerate([*whole, last]):
        for start, verdict, rule in at.partial:
            if segment.startswith(start):
                found = (rule, verdict)
                break
        if i == len(whole) or (at := at.below.get(segment)) is None:
            break
    return found


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:stop].partition("/")
    return host.translate(ASCII_LOWER), slash + path


def judge(root: Node, url: str | None, default: str = DEFAULT) -> tuple[str, str, str | None, str]:
    host, path = split_url(url)
    found, node = None, root
    for label in reversed(host.split(".")) if host else ():
        if (node := node.labels.get(label)) is None:
            break
        if node.paths and (hit := longest_path(node.paths, path)):
            found = hit
    return (host, path, *(found or (None, default)))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict), a row for each row of pages."""
    root = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    chosen = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = root.value
        for b in batches:
            found = [judge(trie, u, default) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else [[]] * 4))], ["page_id", "host", "path", "rule", "verdict"])

    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(walk, f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
