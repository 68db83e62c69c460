"""The queries over pages in SQL: markup is cut into tokens and folded over a stack, without a parser."""

from __future__ import annotations

#: Markup put before the texts of documents, by doc_id modulo their number plus two; the others keep their text alone.
SNIPPETS = (
    '<form action="http://other.test/x"><input type="password" name="p"></form>',
    '<script>eval(atob("x"));window.location="a";location.href="b";fetch("/a");fetch("/b");fetch("/c")</script>',
    '<iframe style="display:none" src="http://frame.test/"></iframe><a href="#">x</a><a href="http://away.test/">y</a>',
    '<body onmouseover="window.status=1" oncontextmenu="return false" oncopy="x"><img src="http://img.test/a.png"><img src="/b.png">',
)
_N = len(SNIPPETS) + 2
_CASES = " ".join(f"WHEN ((doc_id % {_N}) + {_N}) % {_N} = {k} THEN '{s}' || coalesce(text, '')" for k, s in enumerate(SNIPPETS))
FETCHED_PAGES = f"pages AS (SELECT doc_id AS page_id, 'http://' || site_host AS url, CASE {_CASES} ELSE text END AS html FROM documents)"

_NAME = "lower(regexp_extract(t, '^</?([a-zA-Z][^ />]*)', 1))"
_AT = f"list_position(list_reverse(a.names), {_NAME})"
_EMPTY = "{'stack': []::INTEGER[], 'names': []::VARCHAR[], 'n': 0, 'nodes': []::STRUCT(idx INTEGER, parent INTEGER, depth INTEGER, tag VARCHAR, tok VARCHAR)[], 'texts': []::INTEGER[]}"


def _state(stack: str = "a.stack", names: str = "a.names", n: str = "a.n", nodes: str = "a.nodes", texts: str = "a.texts") -> str:
    return "{" + f"'stack': {stack}, 'names': {names}, 'n': {n}, 'nodes': {nodes}, 'texts': {texts}" + "}"


_NODE = "[{'idx': a.n, 'parent': a.stack[-1], 'depth': (len(a.stack) + 1)::INTEGER, 'tag': " + _NAME + ", 'tok': t}]"
_STEP = f"""CASE WHEN NOT starts_with(t, '<') THEN {_state(texts="CASE WHEN len(a.stack) > 0 THEN a.texts || [a.stack[-1]] ELSE a.texts END")}
  WHEN starts_with(t, '</') AND {_AT} IS NULL OR starts_with(t, '</') AND {_AT} = 0 THEN {_state()}
  WHEN starts_with(t, '</') THEN {_state(stack=f"a.stack[1:len(a.names) - {_AT}]", names=f"a.names[1:len(a.names) - {_AT}]")}
  WHEN {_NAME} IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') THEN {_state(n="a.n + 1", nodes=f"a.nodes || {_NODE}")}
  ELSE {_state(stack="a.stack || [a.n]", names=f"a.names || [{_NAME}]", n="a.n + 1", nodes=f"a.nodes || {_NODE}")} END"""
_ATTRIBUTES = ("href", "src", "action", "style", "width", "height", "type")
_GIVEN = ", ".join(f"""CASE WHEN regexp_matches(tok, '\\s{k}\\s*=') THEN regexp_extract(tok, '\\s{k}\\s*=\\s*"([^"]*)"', 1) END AS {k}""" for k in _ATTRIBUTES)
NODES = f"""{FETCHED_PAGES}, tokens AS (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z][^<>]*>|[^<]+') AS ts FROM pages WHERE contains(html, '<')),
folded AS (SELECT page_id, list_reduce(ts, lambda a, t: {_STEP}, {_EMPTY}) AS s FROM tokens),
listed AS (SELECT page_id, unnest(s.nodes, recursive := true) FROM folded),
under AS (SELECT page_id, parent AS idx, count(*) AS n FROM (SELECT page_id, parent FROM listed UNION ALL SELECT page_id, unnest(s.texts) FROM folded) WHERE parent IS NOT NULL GROUP BY 1, 2),
nodes AS (SELECT l.page_id, l.idx, l.parent AS parent_idx, l.depth, l.tag, coalesce(u.n, 0)::INTEGER AS n_children, {_GIVEN} FROM listed l LEFT JOIN under u ON u.idx = l.idx AND u.page_id IS NOT DISTINCT FROM l.page_id)"""
_HIDDEN = "(contains(lower(coalesce(style, '')), 'display:none') OR contains(lower(coalesce(style, '')), 'visibility:hidden'))"


def _away(link: str) -> str:
    return f"(starts_with({link}, 'http') AND NOT contains({link}, domain))"


_FEATURES = f"""{NODES}, hosts AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1) AS domain, lower(coalesce(html, '')) AS h, coalesce(html, '') = '' AS bare FROM pages),
sums AS (SELECT n.page_id, count(*)::DOUBLE AS n, max(depth)::DOUBLE AS depth, count(*) FILTER (tag = 'img' AND {_away("src")})::DOUBLE AS away, count(*) FILTER (tag IN ('img', 'script') AND src IS NOT NULL)::DOUBLE AS assets,
  count(*) FILTER (tag = 'a' AND href IS NOT NULL AND (trim(href) IN ('#', '', 'javascript:void(0)') OR {_away("trim(href)")}))::DOUBLE AS odd, count(*) FILTER (tag = 'a' AND href IS NOT NULL)::DOUBLE AS links,
  count(*) FILTER (tag = 'form' AND (trim(coalesce(action, '')) = '' OR lower(trim(action)) = 'about:blank' OR {_away("trim(action)")})) AS forms,
  count(*) FILTER (tag = 'iframe' AND ({_HIDDEN} OR coalesce(width, '') = '0' OR coalesce(height, '') = '0')) AS frames FROM nodes n JOIN hosts h ON n.page_id IS NOT DISTINCT FROM h.page_id GROUP BY n.page_id),
met AS (SELECT h.page_id, bare, h, coalesce(n, 0.0) AS n, coalesce(depth, 0.0) AS depth, coalesce(away, 0.0) / greatest(1.0, coalesce(assets, 0.0)) AS request, coalesce(odd, 0.0) / greatest(1.0, coalesce(links, 0.0)) AS anchor, coalesce(forms, 0) AS forms, coalesce(frames, 0) AS frames
  FROM hosts h LEFT JOIN sums s ON s.page_id IS NOT DISTINCT FROM h.page_id)"""
_PLACE = "CASE WHEN tag IN ('html', 'body') THEN 0 WHEN tag = 'form' THEN 1 WHEN tag = 'input' AND lower(type) IN ('password', 'secret') THEN 2 WHEN tag = 'input' THEN 3 WHEN tag = 'a' THEN 4 WHEN tag = 'script' THEN 5 WHEN tag = 'img' THEN 6 WHEN tag = 'iframe' THEN 7 WHEN tag = 'div' THEN 8 ELSE 9 END"
_LINK = "coalesce(nullif(href, ''), nullif(src, ''), nullif(action, ''), '')"
GRAPH = f"""{NODES}, hosts AS (SELECT page_id, CASE WHEN coalesce(html, '') = '' OR regexp_full_match(html, '\\s*') THEN 'blank' END AS blank, CASE WHEN regexp_extract(url, '//([^/?#]*)', 1) = '' THEN 'example.com' ELSE coalesce(regexp_extract(url, '//([^/?#]*)', 1), 'example.com') END AS domain FROM pages),
kept AS (SELECT n.*, h.domain, {_PLACE} AS place, {_away(_LINK)} AS external, {_HIDDEN} OR coalesce(type, '') = 'hidden' AS hides FROM nodes n JOIN hosts h ON n.page_id IS NOT DISTINCT FROM h.page_id WHERE idx < 200),
counted AS (SELECT h.page_id, blank, k.n, k.e, k.f, k.p FROM hosts h LEFT JOIN (SELECT page_id, count(*) AS n, 2 * count(parent_idx) AS e, count(*) FILTER (place = 1 AND hides) AS f, count(*) FILTER (place = 2 AND external) AS p FROM kept GROUP BY page_id) k ON k.page_id IS NOT DISTINCT FROM h.page_id)"""


def _fixed(name: str, edges: list[tuple[int, int]], where: str) -> str:
    return " UNION ALL ".join(f"SELECT page_id, {a}::INTEGER AS src, {b}::INTEGER AS dst FROM counted WHERE {where}" for a, b in edges)


PAGES_SQL = {
    "dom_node_list": f"WITH {NODES} SELECT page_id, idx, parent_idx, depth, tag, n_children, {', '.join(_ATTRIBUTES)} FROM nodes",
    "dom_structure_features": f"""WITH {_FEATURES} SELECT page_id, CASE WHEN bare THEN 10.0::DOUBLE ELSE n END AS dom_node_count, CASE WHEN bare THEN 2.0::DOUBLE ELSE depth END AS dom_max_depth,
      CASE WHEN bare THEN 1.5::DOUBLE ELSE 2.0 * greatest(1.0, n - 1) / greatest(1.0, n) END AS graph_avg_degree, CASE WHEN bare THEN 0.1::DOUBLE ELSE request END AS request_url_ratio, CASE WHEN bare THEN 0.1::DOUBLE ELSE anchor END AS url_of_anchor_ratio,
      CASE WHEN bare THEN 0.1::DOUBLE ELSE request * 0.8::DOUBLE END AS links_in_tags_ratio, CAST(NOT bare AND forms > 0 AS DOUBLE) AS sfh_external, CAST(contains(h, 'mailto:') AS DOUBLE) AS submitting_to_email, CAST(NOT bare AND frames > 0 AS DOUBLE) AS iframe_hidden,
      0.0::DOUBLE AS popup_window, CAST(contains(h, 'event.button==2') OR contains(h, 'contextmenu') AS DOUBLE) AS right_click_disabled, CAST(contains(h, 'onmouseover') AND contains(h, 'window.status') AS DOUBLE) AS on_mouseover FROM met""",
    "dom_graph_stats": f"""WITH {GRAPH} SELECT page_id, CASE WHEN blank IS NOT NULL THEN 5 ELSE coalesce(n, 3) END AS node_count, CASE WHEN blank IS NOT NULL THEN 4 WHEN n IS NULL THEN 2 ELSE greatest(e, 1) END AS edge_count,
      round(CASE WHEN blank IS NOT NULL THEN 0.2::DOUBLE WHEN n IS NULL THEN 0.3::DOUBLE ELSE greatest(e, 1) / greatest(1, n * (n - 1)) END, 6) AS graph_density, coalesce(f, 0) AS hidden_form_nodes, coalesce(p, 0) AS external_password_nodes FROM counted""",
    "dom_graph_edges": f"""WITH {GRAPH} SELECT page_id, parent_idx AS src, idx AS dst FROM kept WHERE parent_idx IS NOT NULL UNION ALL SELECT page_id, idx, parent_idx FROM kept WHERE parent_idx IS NOT NULL
      UNION ALL SELECT page_id, 0::INTEGER, 0::INTEGER FROM counted WHERE e = 0 UNION ALL {_fixed("blank", [(0, 1), (0, 2), (1, 2), (1, 3)], "blank IS NOT NULL")} UNION ALL {_fixed("none", [(0, 1), (1, 2)], "blank IS NULL AND n IS NULL")}""",
    "dom_node_features": f"""WITH {GRAPH} SELECT page_id, idx, place, CAST(external AS DOUBLE) AS external, CAST(hides AS DOUBLE) AS hides, round(least(depth, 25) / 25.0::DOUBLE, 6) AS depth, round(least(n_children, 50) / 50.0::DOUBLE, 6) AS children FROM kept""",
}
