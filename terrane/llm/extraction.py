"""Main text of web pages by wrapper induction.

Pages of one host and one layout - the places, paths of tags and classes, that hold other elements down to ``DEPTH``
levels - share a template. All different pages of a layout are aligned with its first one (that of least hash) by
simple tree matching. Aligned nodes whose own text is the same on all of them are template, nodes whose text
differs and nodes without a partner are slots. The wrapper holds two things: the content place, the lowest node below
which all running text of the slots lies (links, and what tag or role mark as menu, header, footer, sidebar, advert, form, script or reader
comment, do not count); and the template texts below that place, known by their path and hash, if at least ``SURE`` pages
were aligned and less is the same on them than differs. A page is read at its wrapper's place; template texts and marked elements are left out, the rest is content.

Where a layout has one page, or its pages are copies, or the wrapper finds nothing on a page, the page's ``article``,
``main`` or else densest element is read, and only the marks decide what is left out.

Each task merges what it finds of a layout, so a layout costs a row for each task. First pages and wrappers are broadcast if they
are ``small``, and html is shuffled by host and layout only where they are not. Layouts are found for every page, so a second template on a host has a wrapper of
its own, however rare its pages are.

Cases: null or empty html gives an empty text. A url without a host counts as a host of its own, null included. Equal
rows give equal rows. Unclosed tags, stray end tags and cut references are read as browsers read them. Long lists of
siblings are matched exactly, as short ones are. An empty table gives none. Kept columns may have any name but text, which
is set anew.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, beside, masked, small
from .dom import Node, Shapes, blocks, elements, match, parse

SURE, DEPTH = 3, 4
#: First pages a task holds as trees at a time.
HELD = 500
#: Shapes that a task knows of a layout, beyond which it begins anew.
SHAPES = 1000
#: Elements and marks that are never article text.
DROP_TAGS = frozenset("script style noscript template iframe object embed svg canvas head title nav footer aside form button select textarea input dialog menu link meta".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer copyright social share sharing sharebar related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager widget widgets toolbar login search skip".split()
)
#: Elements that hold running text, never a content place by themselves.
INLINE = frozenset("p h1 h2 h3 h4 h5 h6 li span b i u a em strong small code td th tr ul ol dl dt dd table tbody thead blockquote pre figcaption figure time sup sub".split())
_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


def is_noise(n: Node) -> bool:
    if n.tag in DROP_TAGS:
        return True
    if not n.attrs or n.tag in ("html", "body", "article", "main"):
        return False
    if n.get("role").lower() in DROP_ROLES or n.has("hidden") or n.get("aria-hidden") == "true":
        return True
    return any(w.lower() in DROP_NAMES for a in ("class", "id") for w in _NAME.split(n.get(a)))


def skip(n: Node) -> bool:
    """Noise, and what a header holds besides headings; a header without any heading goes whole."""
    if is_noise(n):
        return True
    if n.tag == "header":
        return not any(c.tag in ("h1", "h2", "h3") for c in walk(n))
    up = n.parent
    while up is not None and up.tag not in ("header", "article", "body"):
        if up.tag in ("h1", "h2", "h3"):
            return False
        up = up.parent
    return up is not None and up.tag == "header" and not any(c.tag in ("h1", "h2", "h3") for c in walk(n))


def walk(n: Node):
    todo = [n]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(elements(x))


def own_text(n: Node) -> str:
    return " ".join("".join(c for c in n.children if isinstance(c, str)).split())


def path(n: Node) -> tuple[str, ...]:
    out = []
    while n.parent is not None:
        out.append(n.sign())
        n = n.parent
    return tuple(reversed(out))


def layout(root: Node) -> str:
    """The places down to ``DEPTH`` levels that hold elements themselves, as a checksum of their paths."""
    places, level = set(), [((), root)]
    for _ in range(DEPTH):
        level = [((*p, c.sign()), c) for p, n in level for c in elements(n) if c.tag not in DROP_TAGS and elements(c)]
        places |= {p for p, _ in level}
    return f"{zlib.crc32(repr(sorted(places)).encode()):08x}"


def template_key(n: Node) -> int:
    """Of a node with text of its own: its path and text."""
    return zlib.crc32(repr((path(n), own_text(n))).encode())


def shared(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """What two paths begin with; None is no path."""
    if a is None or b is None:
        return b if a is None else a
    return a[: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))]


def slots_place(nodes: list[Node]) -> list[str] | None:
    """What the paths of those of ``nodes`` begin with that hold running text."""
    at = None
    for n in nodes:
        up, out = n, not own_text(n)
        while up.parent is not None and not out:
            out, up = up.tag == "a" or is_noise(up), up.parent
        if not out:
            at = shared(at, list(path(n)))
    return at


def align(first: Node, texts: list[tuple[int, str]], other: Node, shapes: Shapes | None = None) -> tuple[int, list[str] | None]:
    """Of two pages: bits of the first one's nodes, in the order of ``walk``, that are the same; the place of the other's nodes without a partner.
    ``texts`` has ids and own texts of the first one's nodes in that order.

    All other nodes of the first one vary; those that found no partner stand where pages differ in length.
    """
    pairs = match(first, other, shapes)
    partner = {id(a): b for a, b in pairs}
    there = {id(b) for _, b in pairs}
    bits = "".join("1" if k in partner and own_text(partner[k]) == text else "0" for k, text in reversed(texts))
    return int(bits, 2), slots_place([n for n in walk(other) if id(n) not in there])


def merge(a: tuple[int, list[str] | None], b: tuple[int, list[str] | None]) -> tuple[int, list[str] | None]:
    """What two alignments with one first page say together."""
    return a[0] & b[0], shared(a[1], b[1])


def induce(first: Node, pages: int, found: tuple[int, list[str] | None]) -> dict | None:
    """The wrapper of that many different pages of one layout: ``at``, the content place, and ``fixed``, the template texts below it."""
    nodes = list(walk(first))
    varying = [n for i, n in enumerate(nodes) if not found[0] >> i & 1]
    at = shared(found[1], slots_place(varying))
    if at is None:
        return None
    while at and at[-1].split(".")[0] in INLINE:
        at = at[:-1]
    same = [n for i, n in enumerate(nodes) if found[0] >> i & 1 and own_text(n) and list(path(n)[: len(at)]) == at]
    # Where most is the same on all pages they are near copies, not pages of a template.
    sure = pages >= SURE and sum(len(own_text(n)) for n in same) < sum(len(own_text(n)) for n in varying)
    fixed = sorted({template_key(n) for n in same}) if sure else []
    return {"at": at, "fixed": fixed}


def densest(root: Node) -> Node:
    """Without a wrapper: ``article``, ``main``, or the element most of the paragraphs' text is directly under."""
    for tag in ("article", "main"):
        if found := [n for n in walk(root) if n.tag == tag]:
            return max(found, key=lambda n: sum(map(len, blocks(n, skip))))
    if found := [n for n in walk(root) if n.get("role") == "main"]:
        return found[0]
    best, most = None, 0
    for n in walk(root):
        if n.tag in ("div", "section", "body", "td") and not is_noise(n):
            size = sum(len(own_text(c)) for c in elements(n) if c.tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre") and not is_noise(c))
            if size > most:
                best, most = n, size
    return best or next((n for n in walk(root) if n.tag == "body"), root)


def extract(source: str | None, wrapper: dict | None) -> str:
    if not source:
        return ""
    root = parse(source)
    places: list[Node] = []
    fixed = set(wrapper["fixed"]) if wrapper else set()

    def out(n: Node) -> bool:
        return skip(n) or bool(fixed) and bool(own_text(n)) and template_key(n) in fixed

    if wrapper and wrapper["at"] and wrapper["at"][-1].split(".")[0] not in ("html", "body"):  # the page as a whole says nothing
        places = [root]
        for sign in wrapper["at"]:
            places = [c for n in places for c in elements(n) if c.sign() == sign]
    if not any(blocks(p, out) for p in places):
        places, fixed = [densest(root)], set()
    return "\n".join(b for p in places for b in blocks(p, out))


def wrappers(scratch: Scratch, sites: DataFrame) -> DataFrame:
    """(host, layout, wrapper), written, from all different pages of each layout of ``sites(host, h, html)`` that has two or more."""

    def aligned(batches):
        trees, found, shapes = {}, {}, {}
        for b in batches:
            for host, kind, start, source in zip(*(b.column(c).to_pylist() for c in ("host", "layout", "start", "html"))):
                if (host, kind) not in trees:
                    if len(trees) >= HELD:
                        yield given(found)
                        trees, found, shapes = {}, {}, {}
                    root = parse(start)
                    trees[host, kind] = root, [(id(n), own_text(n)) for n in walk(root)]
                if source != start:
                    if (own := shapes.get((host, kind))) is None or len(own.sign) > SHAPES:
                        own = shapes[host, kind] = Shapes(trees[host, kind][0])
                    new = align(*trees[host, kind], parse(source), own)
                    found[host, kind] = merge(found[host, kind], new) if (host, kind) in found else new
        yield given(found)

    def given(found):
        rows = [(*k, json.dumps([hex(f[0]), f[1]])) for k, f in found.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["host", "layout", "found"])

    def taken(text: str) -> tuple[int, list[str] | None]:
        bits, at = json.loads(text)
        return int(bits, 16), at

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        all_of = functools.reduce(merge, map(taken, g["found"]))
        return pd.DataFrame({"host": [g["host"].iloc[0]], "layout": [g["layout"].iloc[0]], "found": [json.dumps([hex(all_of[0]), all_of[1]])]})

    def induced(batches):
        for b in batches:
            out = [induce(parse(s), n, taken(f)) for s, n, f in zip(*(b.column(c).to_pylist() for c in ("start", "n", "found")))]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("layout"), pa.array([json.dumps(w) if w else None for w in out], pa.string())], names=["host", "layout", "wrapper"])

    pages = with_layout(sites.where("html is not null"))
    places = scratch.write(pages.select("host", "layout", "h").distinct().groupBy("host", "layout").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    first = sites.join(F.broadcast(places) if small(places) else places, ["host", "h"])
    first = scratch.write(first.groupBy("host", "layout").agg(F.min("html").alias("start"), F.first("n").alias("n")))
    each = pages.join(F.broadcast(first) if small(first) else first, ["host", "layout"]).select("host", "layout", "start", "html")
    found = each.mapInArrow(aligned, "host string, layout string, found string")
    found = found.groupBy("host", "layout").applyInPandas(merged, "host string, layout string, found string")
    out = scratch.write(found.join(first, ["host", "layout"]).select("host", "layout", "start", "n", "found").mapInArrow(induced, "host string, layout string, wrapper string"))
    scratch.drop(places, first)
    return out


def with_layout(sites: DataFrame) -> DataFrame:
    """``sites(..., html)`` with ``layout``."""

    def run(batches):
        for b in batches:
            kinds = [layout(parse(t.as_py() or "")) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], names=[*b.schema.names, "layout"])

    return sites.mapInArrow(run, sites.withColumn("layout", F.lit("")).schema)


def extract_pages(spark: SparkSession, pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the main text."""
    scratch, keep = Scratch(spark, "pages"), beside(keep, "text")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]+)", 1)), F.lit(""))
    sites = masked(pages, keep, host.alias("host"), F.xxhash64("html").alias("h"), F.col("html").alias("html"))
    own = sites.columns[:-3]

    found = wrappers(scratch, sites.select("host", "h", "html"))
    joined = with_layout(sites).join(F.broadcast(found) if small(found) else found, ["host", "layout"], "left").select(*own, "html", "wrapper")

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            text = []
            for h, w in zip(b.column("html"), b.column("wrapper")):
                w = w.as_py()
                if w is not None and w not in known:
                    known[w] = json.loads(w)
                text.append(extract(h.as_py(), known.get(w)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [pa.array(text, pa.string())], names=[*own, "text"])

    return joined.mapInArrow(run, sites.select(*own).withColumn("text", F.lit("")).schema).toDF(*keep, "text")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(spark, pages, ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
