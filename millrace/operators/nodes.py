"""HTML as a table of nodes numbered by nested intervals, and contact links made in its texts.

A node's interval holds those of all nodes inside it, so that what is inside
what, and what comes before what, are comparisons of numbers: a text is in an
element if its number lies between the element's two. A text is left alone if
it lies in one of the ``SKIPPED`` elements, which a running maximum of their
ends tells. A label and a place that stand in different nodes of one list item
or paragraph are found in the text of all its nodes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import views
from .edits import without_overlaps
from .links import ADDRESS_WORD, PLACE, POINT, SPAN, _bare, _matches, candidates, map_url

# Elements whose texts are left alone, those that hold a label and its place, those without an end, and those of raw text.
SKIPPED = ("a", "code", "pre", "script", "style")
CONTAINERS = ("li", "p")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset({"script", "style"})
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^'">])*>""", re.S)
#: Numbers of a page that one part of a range join holds.
PART = 1024


def intervals(markup: str) -> list[tuple]:
    """left, right, name (None: a text), text (decoded), start and end (code points of the markup) of every node.

    An end tag closes what is open inside its element; one without a start is
    passed over. A list item or paragraph ends where the next one begins beside
    it, and all ends with the markup.
    """
    nodes: list[list] = []
    stack: list[int] = []
    clock = at = 0

    def text(end: int) -> None:
        nonlocal clock
        if end > at:
            nodes.append([clock, clock + 1, None, html.unescape(markup[at:end]), at, end])
            clock += 2

    def close(depth: int) -> None:
        nonlocal clock
        while len(stack) > depth:
            nodes[stack.pop()][1] = clock
            clock += 1

    while m := _TAG.search(markup, at):
        text(m.start())
        at, name = m.end(), (m[2] or "").lower()
        if name and not m[1]:
            if name in CONTAINERS and stack and nodes[stack[-1]][2] == name:
                close(len(stack) - 1)
            nodes.append([clock, clock + 1, name, None, m.start(), at])
            clock += 1
            if name in VOID:
                clock += 1
                continue
            stack.append(len(nodes) - 1)
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(markup, at)
                stop = end.start() if end else len(markup)
                if stop > at:
                    nodes.append([clock, clock + 1, None, markup[at:stop], at, stop])
                    clock += 2
                at = end.end() if end else stop
                close(len(stack) - 1)
        elif name:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if nodes[stack[k]][2] == name), None)
            if depth is not None:
                close(depth)
    text(len(markup))
    close(0)
    return [tuple(n) for n in nodes]


NODE = "key long, left int, right int, name string, text string, start int, end int"


def nodes(rows: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (key, unique; html): key, left, right, name (null: a text), text, start and end. Null html has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in NODE.split(", ")), strict=True)
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            for key, markup in zip(batch.column("key").to_pylist(), batch.column("html"), strict=True):
                found = [(key, *n) for n in intervals(markup.as_py() or "")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=list(names))

    return rows.select(F.col("key").cast("long").alias("key"), "html").mapInArrow(run, NODE)


def free_texts(found: DataFrame) -> DataFrame:
    """The text nodes that lie in no skipped element: a skipped element before them ends before them."""
    before = Window.partitionBy("key").orderBy("left").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("name").isin(*SKIPPED), F.col("right"))).over(before)
    return found.withColumn("_reach", reach).where("name is null and (_reach is null or _reach < left)").drop("_reach")


def _places(found: DataFrame, texts: DataFrame) -> DataFrame:
    """key, node (left of a text) and span of the places whose label may stand in another node of their container."""
    after = Window.partitionBy("key").orderBy("left").rowsBetween(1, Window.unboundedFollowing)
    link = F.min(F.when(F.col("name") == "a", F.col("left"))).over(after)
    boxes = found.withColumn("_link", link).where(F.col("name").isin(*CONTAINERS)).where("_link is null or _link > right")
    part = lambda c: F.floor(F.col(c) / PART).cast("int")
    boxes = boxes.select("key", F.col("left").alias("box"), F.col("right").alias("box_end"), F.explode(F.sequence(part("left"), part("right"))).alias("part"))
    inside = texts.select("key", part("left").alias("part"), "left", "text").join(boxes, ["key", "part"]).where("left > box and left < box_end")
    whole = inside.groupBy("key", "box", "box_end").agg(F.array_sort(F.collect_list(F.struct("left", "text"))).alias("texts"))
    whole = whole.withColumn("_all", F.array_join(F.transform("texts", lambda t: t["text"]), "")).where(F.col("_all").rlike(PLACE))
    first = F.get(_matches(F.col("_all"), PLACE), F.lit(0))
    value = F.regexp_extract(first["value"], PLACE, 1)
    seen = _bare(value)
    begin = first["start"] + F.char_length(first["value"]) - F.char_length(F.ltrim(value))
    hit = whole.withColumns({"_seen": seen, "_begin": begin}).where((F.char_length("_seen") >= 8) & (F.col("_seen").rlike(ADDRESS_WORD) | F.col("_seen").rlike(POINT)))
    # where each of the texts begins in the whole
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<left: int, at: int, size: int>>").alias("out"))

    def laid(acc: Column, t: Column) -> Column:
        n = F.char_length(t["text"])
        one = F.struct(t["left"].alias("left"), acc["at"].alias("at"), n.alias("size"))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    spread = hit.select("key", "box", "box_end", "_seen", "_begin", F.explode(F.aggregate("texts", none, laid, lambda acc: acc["out"])).alias("t"))
    spread = spread.where((F.col("_begin") >= F.col("t.at")) & (F.col("_begin") + F.char_length("_seen") <= F.col("t.at") + F.col("t.size")))
    span = F.struct(
        (F.col("_begin") - F.col("t.at")).alias("start"), F.char_length("_seen").alias("length"), F.lit(40).alias("priority"),
        F.lit("place").alias("kind"), F.col("_seen").alias("visible"), map_url(F.col("_seen")).alias("href"),
    ).cast(SPAN)
    made = spread.select("key", F.struct("box", "box_end", F.col("t.left").alias("node"), span.alias("span")).alias("m"))
    # outer containers first; one with a link inside by then makes none
    listed = made.groupBy("key").agg(F.array_sort(F.collect_list("m"), lambda a, b: a["box"] - b["box"]).alias("all"))
    kind = f"array<struct<box: int, box_end: int, node: int, span: {SPAN}>>"

    def step(kept: Column, m: Column) -> Column:
        linked = F.exists(kept, lambda k: (k["node"] > m["box"]) & (k["node"] < m["box_end"]))
        return F.when(linked, kept).otherwise(F.concat(kept, F.array(m)))

    return listed.select("key", F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("m")).select("key", "m.node", "m.span")


def linked_texts(found: DataFrame) -> DataFrame:
    """The text nodes of `nodes` that get links: key, left, start, end, text and spans (ordered, apart).

    Places are made first, a node's other spans are looked for in what is left
    of its text on either side. Nodes in skipped elements get none.
    """
    texts = free_texts(found)
    placed = texts.join(_places(found, texts).withColumnRenamed("node", "left"), ["key", "left"], "left")
    spans_of = lambda text: F.filter(without_overlaps(candidates(text), SPAN), lambda s: s["href"].isNotNull())
    end = F.col("span.start") + F.col("span.length")
    moved = lambda s: F.struct(*[(s[c] + end if c == "start" else s[c]).alias(c) for c in ("start", "length", "priority", "kind", "visible", "href")]).cast(SPAN)
    before, after = F.substring("text", F.lit(1), F.col("span.start")), F.substring(F.col("text"), end + 1, F.char_length("text"))
    split = F.concat(spans_of(before), F.array("span"), F.transform(spans_of(after), moved))
    spans = F.when(F.col("span").isNull(), spans_of(F.col("text"))).otherwise(split)
    # by a generator and not by a filter on their number, which would have the spans made twice
    some = F.explode_outer(let(spans, lambda x: F.when(F.size(x) > 0, F.array(x))))
    return placed.select("key", "left", "start", "end", "text", some.alias("spans")).where("spans is not null")


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def linked_html(rows: DataFrame) -> DataFrame:
    """``rows`` (key, html) with linked, the markup with an anchor for each span, and links, their number; all else is as it was."""
    texts = linked_texts(nodes(rows))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def anchor(acc: Column, s: Column) -> Column:
        before = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        one = F.concat(_escaped(before), F.lit('<a href="'), _escaped(s["href"]), F.lit('">'), _escaped(s["visible"]), F.lit("</a>"))
        return F.struct((s["start"] + s["length"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    done = F.aggregate("spans", none, anchor, lambda a: F.concat(a["out"], _escaped(F.substring(F.col("text"), a["at"] + 1, F.char_length("text")))))
    each = texts.select("key", F.struct("start", "end", done.alias("markup"), F.size("spans").alias("n")).alias("r"))
    changed = each.groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("_changed"))
    joined = rows.join(changed, "key", "left")
    whole = lambda at: F.substring(F.col("html"), at, F.char_length("html"))

    def splice(acc: Column, r: Column) -> Column:
        kept = F.substring(F.col("html"), acc["at"] + 1, r["start"] - acc["at"])
        return F.struct(r["end"].alias("at"), F.concat(acc["out"], kept, r["markup"]).alias("out"))

    spliced = F.aggregate("_changed", none, splice, lambda a: F.concat(a["out"], whole(a["at"] + 1)))
    n = F.aggregate("_changed", F.lit(0), lambda s, r: s + r["n"])
    return joined.select(*rows.columns, F.coalesce(spliced, "html").alias("linked"), F.coalesce(n, F.lit(0)).alias("links"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, each with a contact block of its own: labels and places in nodes of their own, links, code and texts."""
    n = F.col("page_id").cast("string")
    block = F.concat(
        F.lit("<ul><li><b>Adres:</b> <i>Büyük Cad. No: "), n, F.lit(" İstanbul</i></li><li>Tel <code>0212 555 12 34</code> 0212 555 12 "),
        F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit('</li><li>Ofis: <a href="/x">Plaza Sok. No: 1</a></li></ul><p>info'), n,
        F.lit("@site.com &amp; www.site.com/"), n, F.lit("<pre>a@b.com</pre>"),
    )
    return views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.concat("html", block).alias("html"))


def q_page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page the numbers of nodes, texts and texts outside the skipped elements."""
    found = nodes(_keyed(spark, sf_dir))
    free = free_texts(found).groupBy("key").agg(F.count("*").alias("free_texts"))
    counts = found.groupBy("key").agg(F.count("*").alias("nodes"), F.count_if(F.col("name").isNull()).alias("texts"))
    return counts.join(free, "key", "left").select(F.col("key").alias("page_id"), "nodes", "texts", F.coalesce("free_texts", F.lit(0)).alias("free_texts"))


def q_linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linked_html(_keyed(spark, sf_dir))
    return done.select(F.col("key").alias("page_id"), "links", F.sha2("linked", 256).alias("linked_hash"))


QUERIES = {"page_nodes": q_page_nodes, "linked_pages": q_linked_pages}
ORACLES: dict[str, str] = {}
