"""Problems 1 to 4 in SQL of the checking engine, over whole tables; the others need a tokenizer or a learned model.

The fourth compares all keys with each other, which is meant for tables of some ten thousand rows.
"""

from __future__ import annotations

MAIN = "merged_phishing_multimodal_dataset"
NOT = r"[^\p{L}\p{N}]"
BLANK = r"[\s\p{Z}\p{C}]+"
SCHEME = rf"^{NOT}*(?:https?{NOT}*:|[a-z][a-z0-9+.\-]*{NOT}*:{NOT}*[/\\]{{2}})"


def _decoded(text: str) -> str:
    """Valid escapes are marked, other percent signs dropped, then the marked ones resolved."""
    return rf"url_decode(replace(replace(regexp_replace({text}, '%([0-9A-Fa-f]{{2}})', chr(1) || '\1', 'g'), '%', ''), chr(1), '%'))"


def _letters(text: str) -> str:
    return f"regexp_replace(lower({text}), '{NOT}+', '', 'g')"


def _plain(url: str) -> str:
    bare = rf"regexp_replace(lower(regexp_replace({url}, '{BLANK}', '', 'g')), '&(?:amp;)+|&#(?:0*38|x0*26);', '&', 'g')"
    return f"list_transform([{bare}], lambda b: CASE WHEN regexp_matches(b, '{SCHEME}') THEN b ELSE 'http://' || b END)[1]"


def _keyed(rows: str) -> str:
    """``keyed`` with head, params, tail and key for ROWS (tbl, id, url)."""
    return rf"""plained AS (SELECT *, {_plain("url")} AS p FROM ({rows}) WHERE id IS NOT NULL AND url IS NOT NULL),
parted AS (SELECT *, split_part(p, '#', 1) AS b, split_part(split_part(p, '#', 1), '?', 1) AS h FROM plained),
keyed AS (SELECT *, head || array_to_string(params, '') || tail AS key FROM (SELECT tbl, id, {_letters(_decoded("h"))} AS head,
  list_sort(list_filter(list_transform(regexp_split_to_array(substr(b, length(h) + 2), '[&;]'), lambda x: {_letters(_decoded("x"))}), lambda x: x <> '')) AS params,
  CASE WHEN contains(p, '#') THEN {_letters(_decoded("substr(p, length(b) + 2)"))} ELSE '' END AS tail FROM parted))"""


_BOTH = f"SELECT '{MAIN}' AS tbl, record_id AS id, url FROM {MAIN} UNION ALL SELECT 'scan_results', id, target_url FROM scan_results"
_COPIES = f"{_keyed(_BOTH)}, member AS (SELECT DISTINCT tbl, id, key FROM keyed), class AS (SELECT *, min(id) OVER (PARTITION BY tbl, key) AS first, count(*) OVER (PARTITION BY tbl, key) AS copies FROM member)"

_HOST_TEXT = rf"""regexp_replace(regexp_replace({_plain(r"regexp_replace(url, '=\r?\n', '', 'g')")}, '[\[({{]([.:@])[\])}}]', '\1', 'g'), '[\[({{]dot[\])}}]', '.', 'g')"""
_TIED = rf"""suffixed AS (SELECT DISTINCT lower(trim(suffix)) AS s FROM host_suffixes WHERE trim(suffix) <> ''),
located AS (SELECT record_id, dataset_source, regexp_extract(t, '^{NOT}*[a-z][a-z0-9+.\-]*{NOT}*?:[/\\]*([^/\\?#]*)', 1) AS authority FROM (SELECT *, {_HOST_TEXT} AS t FROM {MAIN})),
hosted AS (SELECT *, regexp_replace({_decoded(r"regexp_extract(authority, '([^@]*)$', 1)")}, ':\d*$', '') AS n FROM located),
named AS (SELECT record_id, dataset_source, regexp_replace(regexp_replace(lower(translate(n, '。．｡', '...')), '[<>"''()\[\]{{}}=,;]+', '', 'g'), '^{NOT}+|{NOT}+$', '', 'g') AS n FROM hosted),
dotted AS (SELECT record_id, dataset_source, n, CASE WHEN regexp_matches(n, '^[0-9]{{4,10}}$') THEN CAST(n AS BIGINT) WHEN regexp_matches(n, '^0x[0-9a-f]{{1,8}}$') THEN CAST(n AS BIGINT) END AS v FROM named),
addressed AS (SELECT record_id, dataset_source, CASE WHEN v <= 4294967295 THEN (v >> 24) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) ELSE nullif(n, '') END AS host FROM dotted),
fitting AS (SELECT host, arg_max(s, length(s)) AS s FROM (SELECT DISTINCT host FROM addressed) JOIN suffixed ON ends_with(host, '.' || s) AND regexp_matches(host, '[^.]+[.]' || replace(s, '.', '[.]') || '$') GROUP BY host),
sites AS (SELECT record_id, dataset_source, coalesce(regexp_extract(substr(host, 1, length(host) - length(s) - 1), '([^.]+)$', 1) || '.' || s, host) AS site FROM addressed LEFT JOIN fitting USING (host)),
ties AS (SELECT DISTINCT dataset_source AS source, nullif(regexp_extract(lower(dataset_source), '^[\s\p{{Z}}\p{{C}}]*([^/]*?)[\s\p{{Z}}\p{{C}}]*(?:/|$)', 1), '') AS owner, site FROM sites),
edges AS (SELECT DISTINCT a.owner AS x, b.owner AS y FROM (SELECT owner, site FROM ties WHERE owner IS NOT NULL) a JOIN (SELECT owner, site FROM ties WHERE owner IS NOT NULL) b USING (site)),
reach(x, y) AS (SELECT DISTINCT owner, owner FROM ties WHERE owner IS NOT NULL UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
written AS (SELECT DISTINCT source, owner FROM ties WHERE owner IS NOT NULL),
tied AS (SELECT a.source AS source_a, b.source AS source_b FROM written a JOIN reach r ON r.x = a.owner JOIN written b ON b.owner = r.y WHERE a.source <> b.source)"""

_SIDES = """listed AS (SELECT DISTINCT record_id AS id, lower(trim(split)) AS split FROM dataset_splits WHERE trim(split) <> ''),
sided AS (SELECT DISTINCT k.id, k.key, k.head, k.params, k.tail, l.split = 'train' AS t FROM keyed k JOIN listed l USING (id)),
texts AS (SELECT key, bool_or(t) AS t, bool_or(NOT t) AS e FROM sided GROUP BY key),
same AS (SELECT key AS l, key AS r, 0 AS kind FROM texts WHERE t AND e),
edit AS (SELECT a.key AS l, b.key AS r, 1 AS kind FROM texts a JOIN texts b ON a.t AND b.e AND a.key <> b.key AND abs(length(a.key) - length(b.key)) <= 3 WHERE levenshtein(a.key, b.key) <= 3),
dropped AS (SELECT DISTINCT key, t, head || array_to_string(params[1:i - 1] || params[i + 1:], '') || tail AS less FROM (SELECT *, unnest(range(1, len(params) + 1)) AS i FROM sided)),
less AS (SELECT d.key AS l, x.key AS r, 2 AS kind FROM dropped d JOIN texts x ON x.key = d.less AND d.t AND x.e UNION SELECT x.key, d.key, 2 FROM dropped d JOIN texts x ON x.key = d.less AND NOT d.t AND x.t),
pairs AS (SELECT l, r, min(kind) AS kind FROM (FROM same UNION ALL FROM edit UNION ALL FROM less) GROUP BY l, r),
ids AS (SELECT DISTINCT id, key, t FROM sided),
found AS (SELECT a.id AS train_id, b.id AS other_id, min(kind) AS kind FROM pairs p JOIN ids a ON a.t AND a.key = p.l JOIN ids b ON NOT b.t AND b.key = p.r WHERE a.id <> b.id GROUP BY 1, 2)"""
_OVERLAPS = f"{_keyed(f'SELECT 1 AS tbl, record_id AS id, url FROM {MAIN}')}, {_SIDES}"

# How the two verdicts are written, after lower case and without anything but letters; the normal quantile of two-sided 95 %.
_YES = "('phishing', 'phish', 'malicious', 'notlegitimate', 'malware', 'scam', 'fraud', 'fraudulent', 'unsafe', 'notsafe', 'notbenign', 'bad')"
_NO = "('legitimate', 'legit', 'safe', 'benign', 'notphishing', 'notphish', 'notmalicious', 'clean', 'harmless', 'good', 'ok')"
_Z = "1.959964::DOUBLE"


def _said(verdict: str) -> str:
    word = rf"""regexp_replace(regexp_replace(lower({verdict}), '"?verdict"?\s*:', '', 'g'), '[^a-z]+', '', 'g')"""
    return f"CASE WHEN {word} IN {_YES} THEN 1.0::DOUBLE WHEN {word} IN {_NO} THEN 0.0::DOUBLE END"


def _bound(e: str, n: str) -> str:
    m = f"greatest({n}, 0.5::DOUBLE)"
    return f"least((least({e}, {n} - {e}) + 0.5) / ({m} * pow(greatest(1 - 2 / (9 * {m}) - {_Z} * sqrt(2 / (9 * {m})), 1e-3::DOUBLE), 3)), 0.5::DOUBLE)"


def _consensus(rounds: int = 40) -> str:
    """Labels and weights in turn, written out ROUNDS times: more than it takes until no label changes."""
    parts = [
        f"""called AS (SELECT scan_id AS item, nullif(regexp_replace(lower(engine), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '') AS who, {_said("verdict")} AS v, threat_score AS s FROM engine_results WHERE scan_id IS NOT NULL),
scaled AS (SELECT *, CASE WHEN 2 * count(*) FILTER (s BETWEEN 0 AND 1) OVER (PARTITION BY who) > count(*) FILTER (s BETWEEN 0 AND 100) OVER (PARTITION BY who) THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS top FROM called WHERE who IS NOT NULL),
known AS (SELECT scan_id AS item, avg({_said("verdict")}) AS known FROM scan_labels WHERE {_said("verdict")} IS NOT NULL GROUP BY scan_id),
claims AS MATERIALIZED (SELECT item, who, avg(x) AS x, any_value(known) AS known FROM (SELECT *, coalesce(v, CASE WHEN s BETWEEN 0 AND top AND s <> top / 2 THEN CAST(s > top / 2 AS DOUBLE) END) AS x FROM scaled) LEFT JOIN known USING (item) WHERE x IS NOT NULL GROUP BY item, who),
t0 AS MATERIALIZED (SELECT item, CAST(coalesce(any_value(known), avg(x)) > 0.5 AS DOUBLE) AS t, 0.0::DOUBLE AS margin FROM claims GROUP BY item)"""
    ]
    for k in range(rounds):
        b1, b0 = _bound("e1", "n1"), _bound("e0", "n0")
        parts.append(f"""s{k} AS MATERIALIZED (SELECT who, count(*) AS answers, sum(t) AS n1, sum(t * (1 - x)) AS e1, sum(1 - t) AS n0, sum((1 - t) * x) AS e0 FROM claims JOIN t{k} USING (item) GROUP BY who),
w{k} AS MATERIALIZED (SELECT who, answers, b1, b0, 2 * e1 > n1 AS u1, 2 * e0 > n0 AS u0, ln((1 - b1) / b1) AS g1, ln((1 - b0) / b0) AS g0 FROM (SELECT *, {b1} AS b1, {b0} AS b0 FROM s{k})),
t{k + 1} AS MATERIALIZED (SELECT item, CAST(margin > 0 AS DOUBLE) AS t, margin FROM (SELECT item, CASE WHEN any_value(known) > 0.5 THEN 30.0 WHEN any_value(known) IS NOT NULL THEN -30.0 ELSE
  sum((CASE WHEN u0 THEN g0 * (1 - x) ELSE g0 * x END) - (CASE WHEN u1 THEN g1 * x ELSE g1 * (1 - x) END)) + (SELECT ln((sum(t) + 0.5) / (count(*) - sum(t) + 0.5)) FROM t{k}) END AS margin FROM claims JOIN w{k} USING (who) GROUP BY item))""")
    return ", ".join(parts)


_ROUNDS = 40
_LAST = f"t{_ROUNDS}"
SQL = {
    "p1_found": f"WITH {_consensus(_ROUNDS)} SELECT item AS scan_id FROM {_LAST} WHERE t > 0.5",
    "p1_consensus": f"""WITH {_consensus(_ROUNDS)} SELECT item AS scan_id, CASE WHEN any_value(t) > 0.5 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS verdict, round(1 / (1 + exp(-any_value(margin))), 6) AS probability,
      round(avg(CASE WHEN t > 0.5 THEN x ELSE 1 - x END), 6) AS agreement, count(*) AS answers FROM claims JOIN {_LAST} USING (item) GROUP BY item""",
    "p1_engines": f"""WITH {_consensus(_ROUNDS)}, named AS (SELECT nullif(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '') AS who, name, reliability FROM engines), r AS (SELECT who, answers, CASE WHEN u1 THEN 1 - b1 ELSE b1 END AS m, CASE WHEN u0 THEN 1 - b0 ELSE b0 END AS a FROM w{_ROUNDS - 1})
      SELECT coalesce(name, who) AS engine, answers, round(m, 6) AS miss_rate, round(a, 6) AS false_alarm_rate, round(1 - (m + a) / 2, 6) AS reliability, reliability AS claimed, true AS settled FROM r LEFT JOIN named USING (who)""".replace("reliability AS claimed", "named.reliability AS claimed"),
    "p2_found": f"WITH {_COPIES} SELECT DISTINCT tbl, first AS id_a, id AS id_b FROM class WHERE id <> first",
    "p2_records": f"""WITH {_COPIES}, record AS (SELECT tbl, id, min(url) AS url FROM ({_BOTH}) WHERE id IS NOT NULL GROUP BY tbl, id)
      SELECT tbl, id, coalesce((SELECT max(copies) FROM class c WHERE c.tbl = r.tbl AND c.id = r.id), 1) AS copies, url FROM record r WHERE NOT EXISTS (SELECT 1 FROM class c WHERE c.tbl = r.tbl AND c.id = r.id AND c.id <> c.first)""",
    "p3_found": f"WITH RECURSIVE {_TIED} SELECT DISTINCT source_a, source_b FROM tied WHERE source_a < source_b",
    "p3_classes": f"WITH RECURSIVE {_TIED} SELECT w.source AS dataset_source, least(w.source, min(source_b)) AS class, count(DISTINCT source_b) AS links FROM written w LEFT JOIN tied ON source_a = w.source GROUP BY w.source",
    "p4_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(train_id, other_id) AS id_a, greatest(train_id, other_id) AS id_b FROM found",
    "p4_overlaps": f"""WITH {_OVERLAPS} SELECT l.split, o.dataset_source, ['same', 'edit', 'parameter'][kind + 1] AS kind, count(*) AS pairs, count(DISTINCT other_id) AS rows_touched, count(*) FILTER (o.label <> a.label) AS labels_differ
      FROM found f JOIN listed l ON l.id = f.other_id AND l.split <> 'train' JOIN {MAIN} o ON o.record_id = f.other_id JOIN {MAIN} a ON a.record_id = f.train_id GROUP BY 1, 2, 3""",
}
