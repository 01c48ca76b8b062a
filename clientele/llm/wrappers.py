"""Main text by wrappers: union-free regular expressions inferred from the pages of a host.

A wrapper says what the token streams of a host's pages have in common. Pages are aligned with it
one after the other: an element that only one side has becomes optional, one that comes back, or
stands among some that do, becomes repeated, and text that differs becomes a slot. Each content list
thus holds an element once, in the order seen, and merging two wrappers is the same step as adding a
page. Where more than ``KINDS`` elements of one tag stand in a list, those on fewer than a quarter of
the pages differ by page, not by template (an id made of the title), and become one element ``tag.*``;
with paths of bounded depth a wrapper stays as small as the host's template. Wrappers are folded where the pages are, then
merged per host in rounds of groups of ``_GROUP``, so a host with most pages is never in one place.

The article is the element of the wrapper whose slots hold the text: an ``article`` or ``main``
where there is one, else the innermost container of most of it. What every page of a host repeats is
not part of its articles: constant texts in a container without such a name, constant boxes within one.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clientele.llm.common import fresh, stage
from clientele.llm.markup import Block, blocks
from clientele.llm.url_filter import host_of

_HOSTS_HELD = 5_000  # wrappers a task holds before it passes them on
_GROUP = 64
BROADCAST_BYTES = 16 << 20
_MOST = 0.7  # share of the text that the article's container must hold
_CONSTANT_PAGES = 3
KINDS = 16  # different elements of one tag that a list tells apart
SLOT = -1
_BOXES = frozenset("div section aside ul ol dl table fieldset figure form center details".split())


class Node(dict):
    """An element: ``n`` pages, ``chars`` of text below, ``rep``, ``opt``, ``text`` and ``whole`` (a checksum or
    SLOT, of its own text and of all below), ``kids``."""


def _node() -> Node:
    return Node(n=1, chars=0, rep=False, opt=False, text=None, whole=0, chrome=False, kids={})


def _tag(key: str) -> str:
    return key.split(".", 1)[0]


def _bound(node: Node) -> None:
    """The rare ones of too many different elements of one tag become one."""
    kids = node["kids"]
    if len(kids) <= KINDS:
        return
    for tag, n in Counter(map(_tag, kids)).items():
        if n <= KINDS:
            continue
        rare = [k for k, kid in kids.items() if _tag(k) == tag and (
            k == f"{tag}.*" or node["n"] == 1 or 4 * kid["n"] < node["n"])]
        if len(rare) < 2:
            continue
        one = kids.pop(rare[0])
        for k in rare[1:]:
            one = align(one, kids.pop(k))
        one["rep"] = one["rep"] or one["n"] > node["n"]  # then some page has two
        one["opt"] = one["n"] < node["n"]
        kids[f"{tag}.*"] = one


def _step(key: str, kids: dict[str, Node]) -> str:
    """An element in a path; of ``tag.*`` also the elements of the tag that it does not stand for."""
    return key if not key.endswith(".*") else " ".join([key, *(k for k in kids if k != key and _tag(k) == key[:-2])])


def _matches(step: str, key: str) -> bool:
    name, *others = step.split(" ")
    return name == key or (name.endswith(".*") and name[:-2] == _tag(key) and key not in others)


def fits(path: tuple[str, ...], where: tuple[str, ...]) -> bool:
    """Whether an element at ``path`` is the wrapper's element ``where`` or lies in it."""
    head = path[:len(where)]
    return head == where or (len(head) == len(where) and all(map(_matches, where, head)))


def wrapper_of(page: list[Block]) -> Node:
    """The wrapper of one page."""
    root = _node()
    last: tuple[str, ...] = ()
    for b in page:
        node, raw = root, b.text.encode()
        node["chars"] += len(b.text)
        same = 0
        while same < min(len(last), len(b.path)) and last[same] == b.path[same]:
            same += 1
        for i, key in enumerate(b.path):
            kids = node["kids"]
            if key not in kids:
                kids[key] = _node()
            elif i >= same or (i == len(b.path) - 1 and b.path == last):
                kids[key]["rep"] = True
            node = kids[key]
            node["chars"] += len(b.text)
            node["whole"] = zlib.crc32(raw, node["whole"])
        node["chrome"] = node["chrome"] or b.chrome
        mark = zlib.crc32(raw)
        node["text"] = mark if node["text"] is None else SLOT
        last = b.path
    _bound_all(root)
    return root


def _bound_all(node: Node) -> None:
    for kid in node["kids"].values():
        _bound_all(kid)
    _bound(node)


def align(a: Node, b: Node) -> Node:
    """``a`` with what ``b`` has; the order of either does not matter for flags and counts."""
    a["rep"] = a["rep"] or b["rep"]
    a["opt"] = a["opt"] or b["opt"]
    a["chrome"] = a["chrome"] or b["chrome"]
    if a["text"] != b["text"]:
        a["text"] = SLOT
    if a["whole"] != b["whole"]:
        a["whole"] = SLOT
    a["n"] += b["n"]
    a["chars"] += b["chars"]
    kids: dict[str, Node] = {}
    waiting = list(b["kids"])
    for key, kid in a["kids"].items():
        if key in b["kids"]:
            while waiting and waiting[0] != key:  # what b has before it
                other = waiting.pop(0)
                if other not in a["kids"] and other not in kids:
                    kids[other] = b["kids"][other] | {"opt": True}
            if waiting:
                waiting.pop(0)
            kids[key] = align(kid, b["kids"][key])
        else:
            kid["opt"] = True
            kids[key] = kid
    for key in waiting:
        if key not in kids and key not in a["kids"]:
            kids[key] = b["kids"][key] | {"opt": True}
    a["kids"] = {k: Node(v) for k, v in kids.items()}
    _bound(a)
    return a


def expression(node: Node, key: str = "") -> str:
    """The wrapper as a union-free regular expression over tags and #text."""
    inner = " ".join(expression(kid, k) for k, kid in node["kids"].items())
    if node["text"] is not None:
        inner = " ".join(x for x in ("#text" if node["text"] == SLOT else "text", inner) if x)
    if not key:
        return inner
    body = f"<{key}> {inner} </{key.split('.')[0]}>" if inner else f"<{key}/>"
    mark = "*" if node["rep"] and node["opt"] else "+" if node["rep"] else "?" if node["opt"] else ""
    return f"({body}){mark}" if mark else body


def _furniture(key: str, node: Node) -> bool:
    return node["chrome"] or key.split(".")[0] in ("head", "title", "nav", "aside", "footer")


def _mass(node: Node) -> int:
    """Characters below an element that are not furniture."""
    inner = sum(kid["chars"] for kid in node["kids"].values())
    own = 0 if node["chrome"] else node["chars"] - inner
    return own + sum(_mass(kid) for key, kid in node["kids"].items() if not _furniture(key, kid))


def article_path(root: Node) -> tuple[str, ...]:
    """Where a host's articles are."""
    total = _mass(root)
    found: list[tuple[int, int, tuple[str, ...]]] = []

    def look(node: Node, path: tuple[str, ...]) -> None:
        for key, kid in node["kids"].items():
            if _furniture(key, kid):
                continue
            if key.split(".")[0] in ("article", "main"):
                found.append((_mass(kid), -len(found), (*path, _step(key, node["kids"]))))
            else:
                look(kid, (*path, _step(key, node["kids"])))

    look(root, ())
    best = max(found, default=None)
    if best and best[0] * 2 >= total:
        return best[2]
    node, path = root, ()
    while True:
        kids = [(k, v) for k, v in node["kids"].items() if not _furniture(k, v)]
        step = max(kids, key=lambda x: _mass(x[1]), default=None)
        if (step is None or step[1]["rep"] or step[0].split(".")[0] not in ("html", "body", "div", "section", "table",
                                                                           "tbody", "tr", "td", "center")
                or _mass(step[1]) < _MOST * max(1, total)):
            return path
        node, path = step[1], (*path, _step(step[0], node["kids"]))


def constants(root: Node, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Paths of what stands alike in every page of a host whose articles differ otherwise.

    In an ``article`` or ``main`` only whole boxes count, since a heading or a sentence may well be in
    every article; in another container every text does.
    """
    node = root
    for key in path:
        node = node["kids"][key.split(" ")[0]]
    named = bool(path) and _tag(path[-1]) in ("article", "main")
    out: list[tuple[str, ...]] = []
    fixed = 0

    def look(node: Node, at: tuple[str, ...], own: bool) -> None:
        nonlocal fixed
        always = not node["opt"] and not node["rep"] and node["n"] == root["n"]
        if always and node["whole"] != SLOT and node["chars"] and len(at) > len(path) and (
                _tag(at[-1]) in _BOXES or not (named or node["kids"])):
            out.append(at)
            fixed += node["chars"]
            return
        if always and not named and not own and node["text"] not in (None, SLOT):
            out.append((*at, "#text"))
            fixed += node["chars"] - sum(k["chars"] for k in node["kids"].values())
        for key, kid in node["kids"].items():
            look(kid, (*at, _step(key, node["kids"])), False)

    look(node, path, named)
    return out if root["n"] >= _CONSTANT_PAGES and 2 * fixed < node["chars"] else []


def _is_fixed(path: tuple[str, ...], fixed: list[tuple[str, ...]]) -> bool:
    return any(path == f[:-1] if f[-1] == "#text" else fits(path, f) for f in fixed)


def main_text(page: list[Block], path: tuple[str, ...], fixed: list[tuple[str, ...]] | None = None) -> str:
    """The blocks of the article; a page that does not fit its host's wrapper is taken by itself."""
    def inside(where: tuple[str, ...]) -> list[Block]:
        return [b for b in page if not b.chrome and fits(b.path, where)]

    kept = inside(path)
    named = bool(path) and _tag(path[-1]) in ("article", "main")
    if not kept or not named:
        own = wrapper_of(page)
        where = article_path(own)
        if not kept or (where and _tag(where[-1]) in ("article", "main")):
            kept = inside(where)
    if fixed:
        kept = [b for b in kept if not _is_fixed(b.path, fixed)]
    return "\n\n".join(b.text for b in kept)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, fixed, n_pages, expression) from all pages of each host."""
    rows = pages.select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))

    def fold(frames):
        held: dict[str, Node] = {}
        for pdf in frames:
            for host, page in zip(pdf["host"], pdf["html"]):
                one = wrapper_of(blocks(page))
                held[host] = align(held[host], one) if host in held else one
            if len(held) > _HOSTS_HELD:
                yield pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})
                held = {}
        if held:
            yield pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})

    def merge(key, pdf):
        merged = None
        for text in pdf["wrapper"].sort_values():
            one = _load(json.loads(text))
            merged = one if merged is None else align(merged, one)
        return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [json.dumps(merged)]})

    joined = rows.mapInPandas(fold, "host string, wrapper string").withColumn("part", F.spark_partition_id())
    places = max(1, rows.rdd.getNumPartitions())
    while True:
        places = -(-places // _GROUP)
        joined = joined.withColumn("part", F.floor(F.col("part") / F.lit(_GROUP)).cast("int"))
        joined = joined.groupBy("host", "part").applyInPandas(merge, "host string, part int, wrapper string")
        if places == 1:
            break

    def judge(frames):
        for pdf in frames:
            out = []
            for host, text in zip(pdf["host"], pdf["wrapper"]):
                root = _load(json.loads(text))
                path = article_path(root)
                out.append((host, list(path), json.dumps(constants(root, path), separators=(",", ":")), root["n"], expression(root)))
            if out:
                yield pd.DataFrame(out, columns=["host", "path", "fixed", "n_pages", "expression"])

    return joined.mapInPandas(judge, "host string, path array<string>, fixed string, n_pages long, expression string")


def _load(node: dict) -> Node:
    node["kids"] = {k: _load(v) for k, v in node["kids"].items()}
    return Node(node)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with the main text in place of the html; also the new column's name.

    A null or empty html has the text ''. Null urls and urls without a host share one wrapper, which
    only matters for pages that have neither ``article`` nor ``main``. Repeated rows give repeated
    texts. Wrappers are broadcast if they are below BROADCAST_BYTES, else joined by host.
    """
    found = stage(infer(pages, url_col, html_col), "wrappers").select(
        F.col("host").alias("w_host"), F.col("path").alias("w_path"), F.col("fixed").alias("w_fixed"))
    size = found.agg(F.sum(F.octet_length("w_fixed") + F.octet_length(F.array_join("w_path", ">")) + 64)).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    name, row = fresh("main_text", pages.columns), fresh("_row", pages.columns)
    packed = pages.select(F.struct(*[F.col(c) for c in pages.columns if c != html_col]).alias(row),
                          F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("p_host"), F.col(html_col).alias("p_html"))
    joined = packed.join(found, F.col("p_host") == F.col("w_host"), "left").select(row, "p_html", "w_path", "w_fixed")
    schema = T.StructType([joined.schema[row], T.StructField(name, T.StringType())])

    def run(batches):
        known: dict[str | None, list[tuple[str, ...]]] = {}
        for batch in batches:
            texts = []
            for page, path, fixed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if fixed not in known:
                    known.clear()
                    known[fixed] = [tuple(f) for f in json.loads(fixed or "[]")]
                texts.append(main_text(blocks(page), tuple(path or ()), known[fixed]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [row, name])

    out = joined.mapInArrow(run, schema)
    return out.select(f"{row}.*", name), name
