"""Elements of pages and what they tell; the only Python is the HTML parser, run over Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions.scripts import markup_flags

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Attributes that features look at.
KEPT = ("href", "src", "action", "style", "width", "height", "type")
# Features of a page without any markup.
EMPTY = {"dom_node_count": 10.0, "dom_max_depth": 2.0, "graph_avg_degree": 1.5, "request_url_ratio": 0.1, "url_of_anchor_ratio": 0.1, "links_in_tags_ratio": 0.1, "sfh_external": 0.0, "submitting_to_email": 0.0, "iframe_hidden": 0.0, "popup_window": 0.0, "right_click_disabled": 0.0, "on_mouseover": 0.0}
NODES = "idx int, parent_idx int, depth int, tag string, n_children int, " + ", ".join(f"{a} string" for a in KEPT)


class _Tree(HTMLParser):
    """Collects elements with their parent by node identity; text nodes count as children.

    An end tag without an open element of its name is known as such without looking at the others, so time is linear.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.open_tags: Counter[str] = Counter()
        self.in_text = False

    def _child(self) -> None:
        if self.open:
            self.rows[self.open[-1]][4] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.in_text = False
        self._child()
        given = {k: v or "" for k, v in reversed(attrs)}
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, len(self.open) + 1, tag, 0, *[given.get(a) for a in KEPT]])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self) -> str:
        tag = self.rows[self.open.pop()][3]
        self.open_tags[tag] -= 1
        return tag

    def handle_endtag(self, tag: str) -> None:
        self.in_text = False
        if self.open_tags[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.in_text:
            self._child()
            self.in_text = True

    def handle_comment(self, data: str) -> None:
        self.in_text = False
        self._child()


def elements(html: str | None) -> list[list]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.rows


def _nothing(html: str | None) -> list[list]:
    return [[-1, None, 0, "none" if (html or "").strip() else "blank", 0, *[None] * len(KEPT)]]


def dom_nodes(pages: DataFrame, key: str, html: str, first: int | None = None, domain: str | None = None, stand_ins: bool = False) -> DataFrame:
    """``KEY`` and a row per element: index, parent, depth (document = 0), tag, number of children, looked-at attributes.

    FIRST keeps only so many elements of a page, as the graph features do; everything else sees all of them. DOMAIN, a
    string column, goes along with each element, so that no join has to bring it back. With STAND_INS a page without
    elements has one row of index -1, with the tag ``blank`` or, if it has text, ``none``.
    """
    names = [c.split()[0] for c in NODES.split(", ")]
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.iloc[k : k + 64]
                along = part[domain] if domain else part[key]
                rows = [(i, d, *r) for i, d, text in zip(part[key], along, part[html]) for r in elements(text)[:first] or (_nothing(text) if stand_ins else [])]
                if rows:
                    out = pd.DataFrame(rows, columns=[key, "_domain", *names])[[key, *extra, *names]]
                    yield out.astype({"idx": "int32", "depth": "int32", "n_children": "int32", "parent_idx": "Int32"})

    extra = ["_domain"] if domain else []
    return pages.select(key, html, *([domain] if domain else [])).mapInPandas(parse, f"{key} {kind}, " + "_domain string, " * len(extra) + NODES)


def external(link: Column, domain: Column) -> Column:
    """A link with a scheme that doesn't hold the domain anywhere; a substring test, as the rule has it."""
    return link.startswith("http") & ~F.contains(link, domain)


def hidden(style: Column) -> Column:
    lowered = F.lower(F.coalesce(style, F.lit("")))
    return lowered.contains("display:none") | lowered.contains("visibility:hidden")


def target_domain(url: Column) -> Column:
    """The network location of a URL with a scheme, else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def dom_features(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """The twelve structural features of each page; fixed values for a null or empty page.

    Elements are summed up in the task that parsed them, before the shuffle by page; the page's text isn't shuffled.
    """
    joined = dom_nodes(pages.withColumn("_domain", target_domain(F.col(url))).filter(F.col(html) != ""), key, html, domain="_domain")
    domains = pages.select(key, F.coalesce(F.col(html) == "", F.lit(True)).alias("_empty"), *[c.alias(k) for k, c in markup_flags(F.coalesce(F.col(html), F.lit(""))).items()])
    tag, count = F.col("tag"), lambda c: F.count_if(c).cast("double")
    href, action = F.trim("href"), F.trim(F.coalesce("action", F.lit("")))
    away = lambda c: external(c, F.col("_domain"))
    links = (tag == "a") & F.col("href").isNotNull()
    frames = (tag == "iframe") & (hidden(F.col("style")) | (F.coalesce("width", F.lit("")) == "0") | (F.coalesce("height", F.lit("")) == "0"))
    sums = joined.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max("depth").cast("double").alias("depth"),
        count((tag == "img") & away(F.col("src"))).alias("away"), count((tag.isin("img", "script")) & F.col("src").isNotNull()).alias("assets"),
        count(links & (href.isin("#", "", "javascript:void(0)") | away(href))).alias("odd"), count(links).alias("links"),
        count((tag == "form") & ((action == "") | (F.lower(action) == "about:blank") | away(action))).alias("forms"), count(frames).alias("frames"),
    )
    n = F.coalesce("n", F.lit(0.0))
    ratio = lambda a, b: F.coalesce(a, F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce(b, F.lit(0.0)))
    found = {
        "dom_node_count": n, "dom_max_depth": F.coalesce("depth", F.lit(0.0)), "graph_avg_degree": 2.0 * F.greatest(F.lit(1.0), n - 1) / F.greatest(F.lit(1.0), n),
        "request_url_ratio": ratio("away", "assets"), "url_of_anchor_ratio": ratio("odd", "links"), "links_in_tags_ratio": ratio("away", "assets") * 0.8,
        "sfh_external": (F.coalesce("forms", F.lit(0.0)) > 0).cast("double"), "submitting_to_email": F.col("submitting_to_email"), "iframe_hidden": (F.coalesce("frames", F.lit(0.0)) > 0).cast("double"),
        "popup_window": F.lit(0.0), "right_click_disabled": F.col("right_click_disabled"), "on_mouseover": F.col("on_mouseover"),
    }
    return domains.join(sums, key, "left").select(key, *[F.when(F.col("_empty"), F.lit(EMPTY[k])).otherwise(c).alias(k) for k, c in found.items()])


# Place of each tag in the node features; 9 is any other.
PLACES = {"html": 0, "body": 0, "form": 1, "a": 4, "script": 5, "img": 6, "iframe": 7, "div": 8}


# The graphs of pages without any element: the place set in each node's features (none: -1), edges, density.
STAND_INS = {
    "blank": {"places": [0, 1, 2, -1, -1], "edges": [(0, 1), (0, 2), (1, 2), (1, 3)], "density": 0.2},
    "none": {"places": [0, 0, 0], "edges": [(0, 1), (1, 2)], "density": 0.3},
}


def node_features(pages: DataFrame, key: str, html: str, url: str, first: int = 200) -> DataFrame:
    """``KEY, idx, parent_idx, x, stand_in``: the 14 features of the first elements of each page, for graph models.

    A blank page and one without elements have the nodes of :data:`STAND_INS`, so that every page has a graph.
    """
    domain = F.regexp_extract(F.when(F.col(url).contains("://"), F.col(url)).otherwise(F.concat(F.lit("http://"), F.coalesce(url, F.lit("")))), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    named = pages.withColumn("_domain", F.when(domain == "", "example.com").otherwise(domain))
    nodes = dom_nodes(named, key, html, first, "_domain", stand_ins=True)
    place = F.lit(9)
    for tag, k in PLACES.items():
        place = F.when(F.col("tag") == tag, k).otherwise(place)
    place = F.when(F.col("tag") == "input", F.when(F.lower("type").isin("password", "secret"), 2).otherwise(3)).otherwise(place)
    link = F.coalesce(F.nullif("href", F.lit("")), F.nullif("src", F.lit("")), F.nullif("action", F.lit("")), F.lit(""))
    extra = [
        F.least("depth", F.lit(25)) / 25.0, external(link, F.col("_domain")).cast("double"),
        (hidden(F.col("style")) | (F.coalesce("type", F.lit("")) == "hidden")).cast("double"), F.least("n_children", F.lit(50)) / 50.0,
    ]
    joined = nodes.withColumn("_place", place)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("_place")).cast("double"))
    own = F.array(F.struct("idx", "parent_idx", F.concat(one_hot, F.array(*[c.cast("double") for c in extra])).alias("x"), F.lit(None).cast("string").alias("stand_in")))
    made = lambda name: F.array(*[
        F.struct(F.lit(k).alias("idx"), F.lit(None).cast("int").alias("parent_idx"), F.array(*[F.lit(1.0 if j == hot else 0.0) for j in range(14)]).alias("x"), F.lit(name).alias("stand_in"))
        for k, hot in enumerate(STAND_INS[name]["places"])
    ])
    graph = F.when(F.col("idx") >= 0, own).when(F.col("tag") == "blank", made("blank")).otherwise(made("none"))
    return joined.select(key, F.inline(graph))


def graph_edges(nodes: DataFrame, key: str) -> DataFrame:
    """Edges between kept elements and their parents in both directions; a page with a single element gets a loop at 0.

    A parent comes before its children, so a kept element's parent is kept, too, and no join is needed. Stand-ins have
    edges of their own, in one direction.
    """
    edge = lambda a, b: F.struct(a.cast("int").alias("src"), b.cast("int").alias("dst"))
    src, dst = F.col("parent_idx"), F.col("idx")
    fixed = lambda name: F.array(*[edge(F.lit(a), F.lit(b)) for a, b in STAND_INS[name]["edges"]])
    first = F.col("idx") == 0
    mine = F.when(src.isNotNull(), F.array(edge(src, dst), edge(dst, src))).when(first & (F.col("stand_in") == "blank"), fixed("blank")).when(first & (F.col("stand_in") == "none"), fixed("none"))
    both = nodes.select(key, F.explode(mine).alias("e")).select(key, "e.*")
    alone = nodes.filter("stand_in is null").groupBy(key).agg(F.count("parent_idx").alias("n")).filter("n = 0").select(key, F.lit(0).alias("src"), F.lit(0).alias("dst"))
    return both.unionByName(alone)


def graph_stats(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """Nodes, edges, density, hidden forms and external password fields of each page's graph.

    Blank pages and pages without elements have the fixed stand-ins of the graph model.
    """
    nodes = node_features(pages, key, html, url).filter("stand_in is null")
    at = lambda k: F.element_at("x", k + 1) > 0
    sums = nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("node_count"), (2 * F.count("parent_idx")).alias("_edges"), F.count_if(at(1) & at(12)).alias("hidden_form_nodes"), F.count_if(at(2) & at(11)).alias("external_password_nodes")
    )
    blank = F.coalesce(F.regexp_replace(html, r"(?U)[\s\x1c-\x1f]+", "") == "", F.lit(True))
    edges = F.greatest("_edges", F.lit(1))
    density = edges / F.greatest(F.lit(1), F.col("node_count") * (F.col("node_count") - 1))
    pick = lambda empty, none, real: F.when(F.col("_blank"), empty).when(F.col("node_count").isNull(), none).otherwise(real)
    return pages.select(key, blank.alias("_blank")).join(sums, key, "left").select(
        key, pick(len(STAND_INS['blank']['places']), len(STAND_INS['none']['places']), F.col("node_count")).alias("node_count"), pick(len(STAND_INS['blank']['edges']), len(STAND_INS['none']['edges']), edges).alias("edge_count"), F.round(pick(STAND_INS['blank']['density'], STAND_INS['none']['density'], density), 6).alias("graph_density"),
        F.coalesce("hidden_form_nodes", F.lit(0)).alias("hidden_form_nodes"), F.coalesce("external_password_nodes", F.lit(0)).alias("external_password_nodes"),
    )
