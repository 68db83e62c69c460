"""More queries in SQL: image hashes from the generator of their numbers, answers of engines, reports as JSON, samples and drawn tables."""

from __future__ import annotations

from lurescope.plans.oracle import ENSEMBLE, FUSED, LEX, MAIN, PARSED, POINTS, _hit, _ruled

# The same reference vectors, verdict words, draws and names as the engine has, stated for the SQL.
REFERENCES = (
    ("PayPal", "phishing", (0.8, 0.2, 0.9, 0.1, 0.7, 0.3, 0.85, 0.15)),
    ("Microsoft", "phishing", (0.9, 0.1, 0.85, 0.2, 0.8, 0.1, 0.9, 0.2)),
    ("Google", "benign", (0.1, 0.9, 0.1, 0.85, 0.2, 0.9, 0.1, 0.8)),
    ("Apple", "benign", (0.2, 0.8, 0.15, 0.9, 0.1, 0.85, 0.2, 0.9)),
    ("Bank of America", "phishing", (0.85, 0.15, 0.95, 0.05, 0.75, 0.25, 0.8, 0.2)),
)
PHISHING = "('phishing', 'phish', 'malicious', 'notlegitimate', 'malware', 'scam', 'fraud', 'fraudulent', 'unsafe', 'notsafe', 'notbenign', 'bad')"
LEGITIMATE = "('legitimate', 'legit', 'safe', 'benign', 'notphishing', 'notphish', 'notmalicious', 'clean', 'harmless', 'good', 'ok')"
BAD = """ssl_state ones .25, domain_registration_length ones .15, favicon ones .6, port constant 0, request_url_ratio uniform .5 .95, url_of_anchor_ratio uniform .6 .98, links_in_tags_ratio uniform .4 .9,
sfh_external ones .8, submitting_to_email ones .3, redirect_count whole 1 4, on_mouseover ones .4, right_click_disabled ones .3, popup_window ones .2, iframe_hidden ones .6, age_of_domain ones .1, dns_record ones .7,
web_traffic uniform 0 .3, page_rank uniform 0 .2, google_index ones .2, links_pointing_to_page whole 0 3, statistical_report constant 1, dom_node_count whole 25 120, dom_max_depth whole 3 7, graph_avg_degree uniform 1.2 2.1"""
GOOD = """ssl_state constant 1, domain_registration_length constant 1, favicon constant 0, port constant 0, request_url_ratio uniform .05 .3, url_of_anchor_ratio uniform .02 .25, links_in_tags_ratio uniform .05 .3,
sfh_external constant 0, submitting_to_email constant 0, redirect_count constant 0, on_mouseover constant 0, right_click_disabled constant 0, popup_window constant 0, iframe_hidden constant 0, age_of_domain constant 1, dns_record constant 1,
web_traffic uniform .7 1, page_rank uniform .6 1, google_index constant 1, links_pointing_to_page whole 15 100, statistical_report constant 0, dom_node_count whole 150 600, dom_max_depth whole 8 20, graph_avg_degree uniform 2.8 4.5"""
SOURCES = ("structural-features", "page-benchmark", "raw-addresses", "domain-indicators")


def _sum8(of) -> str:  # noqa: ANN001
    """Eight single-precision terms, summed up in pairs."""
    t = [of(k) for k in range(8)]
    return f"((({t[0]}) + ({t[1]})) + (({t[2]}) + ({t[3]}))) + ((({t[4]}) + ({t[5]})) + (({t[6]}) + ({t[7]})))"


def _word(k: int) -> str:
    """The K-th tempered output of the twister for the state list w (from 1) of a seed."""
    y = f"((w[{k + 1}] & 2147483648) | (w[{k + 2}] & 2147483647))"
    return f"xor(xor(w[{k + 398}], {y} >> 1), CASE WHEN w[{k + 2}] % 2 = 1 THEN 2567483615 ELSE 0 END)"


_DISTANCES = ", ".join(
    "[{d}, {k}]".format(d=f"sqrt(({_sum8(lambda j, v=v: f'(u[{j + 1}] - {v[j]}::FLOAT) * (u[{j + 1}] - {v[j]}::FLOAT)')})::DOUBLE)::FLOAT", k=k) for k, (_, _, v) in enumerate(REFERENCES)
)
IMAGES = f"""RECURSIVE words(seed, i, v) AS (SELECT range, 0, range FROM range(10000) UNION ALL SELECT seed, i + 1, (1812433253 * xor(v, v >> 30) + i + 1) % 4294967296 FROM words WHERE i < 413),
states AS (SELECT seed, list(v ORDER BY i) AS w FROM words GROUP BY seed),
raw AS (SELECT seed, [{", ".join(_word(k) for k in range(16))}] AS r FROM states),
tempered AS (SELECT seed, list_transform(list_transform(list_transform(list_transform(r, lambda y: xor(y, y >> 11)), lambda y: xor(y, (y << 7) & 2636928640)), lambda y: xor(y, (y << 15) & 4022730752)), lambda y: xor(y, y >> 18)) AS t FROM raw),
plain AS (SELECT seed, list_transform(range(8), lambda k: (((t[2 * k + 1] >> 5) * 67108864.0::DOUBLE + (t[2 * k + 2] >> 6)) / 9007199254740992.0::DOUBLE)::FLOAT) AS b FROM tempered),
lifted AS (SELECT seed, false AS raised, b FROM plain UNION ALL SELECT seed, true, [b[1] + 0.5::FLOAT, b[2], b[3] + 0.4::FLOAT, b[4], b[5], b[6], b[7], b[8]] FROM plain),
unit AS (SELECT seed, raised, list_transform(b, lambda x: (x / n)::FLOAT) AS u FROM (SELECT *, sqrt(({_sum8(lambda j: f"b[{j + 1}] * b[{j + 1}]")})::DOUBLE)::FLOAT AS n FROM lifted)),
met AS (SELECT seed, raised, list_min([{_DISTANCES}]) AS best FROM unit),
named AS (SELECT seed, raised, best[1]::DOUBLE AS d, (best[2])::INTEGER AS k FROM met),
images AS (SELECT seed, raised, [{", ".join(f"'{n}'" for n, _, _ in REFERENCES)}][k + 1] AS image_nearest, round(d, 4) AS image_distance, d < 0.65 AND k IN (0, 1, 4) AS image_phishing,
  round(CASE WHEN d < 0.65 AND k IN (0, 1, 4) THEN greatest(0.0, least(100.0, (1 - d) * 100)) ELSE greatest(0.0, least(40.0, d * 50)) END, 2)::DOUBLE AS image_score FROM named),
hashed AS (SELECT t.record_id, lower(t.url) AS u, i.* EXCLUDE (seed, raised) FROM {MAIN} t JOIN images i ON i.seed = list_sum(list_transform(range(1, length(url) + 1), lambda i: unicode(substr(url, i, 1)))) % 10000 AND i.raised = {_hit("image_hash", "lower(t.url)")})"""
VISUAL = f"""{IMAGES}, seen AS (SELECT record_id, u, image_phishing OR {_hit("brand_logo")} AS bad, image_score, {_hit("brand_logo")} AS logo, {_hit("page_layout")} AS layout FROM hashed),
visual AS (SELECT record_id, CASE WHEN bad THEN 'PHISHING' ELSE 'BENIGN' END AS verdict, round(image_score * 0.4::DOUBLE + CASE WHEN logo THEN 96.2::DOUBLE ELSE 4.1::DOUBLE END * 0.4::DOUBLE + CASE WHEN layout THEN 88.4::DOUBLE ELSE 12.1::DOUBLE END * 0.2::DOUBLE, 2) AS visual_score,
  CASE WHEN NOT bad THEN 'None' WHEN NOT logo THEN 'None / Authentic' WHEN contains(u, 'paypal') THEN 'PayPal' WHEN contains(u, 'microsoft') THEN 'Microsoft' ELSE 'Generic Financial' END AS brand, bad FROM seen)"""
IMAGE_FUSED = FUSED.replace("round(25.0 * 0.4 +", "round(image_score * 0.4::DOUBLE +").replace("FROM pointed q JOIN pooled USING (record_id))", "FROM pointed q JOIN pooled USING (record_id) JOIN (SELECT record_id, image_score FROM hashed) USING (record_id))")
# Some names of the two chains of expressions are the same; those of the image chain get a prefix.
_RENAMED = IMAGES
for _old in ("words", "plain", "raw", "named", "met"):
    _RENAMED = _RENAMED.replace(f" {_old} AS (", f" i_{_old} AS (").replace(f"\n{_old} AS (", f"\ni_{_old} AS (").replace(f"RECURSIVE {_old}(", f"RECURSIVE i_{_old}(").replace(f"FROM {_old} ", f"FROM i_{_old} ").replace(f"FROM {_old})", f"FROM i_{_old})")
READ = f"""called AS (SELECT scan_id, regexp_replace(lower(engine), '[^a-z0-9]', '', 'g') AS engine, regexp_replace(regexp_replace(lower(verdict), '"?verdict"?\\s*:', '', 'g'), '[^a-z]+', '', 'g') AS w, threat_score AS s, answered_at, result_id FROM engine_results WHERE scan_id IS NOT NULL),
scaled AS (SELECT *, 2 * count(*) FILTER (s BETWEEN 0 AND 1) OVER (PARTITION BY engine) > count(*) FILTER (s BETWEEN 0 AND 100) OVER (PARTITION BY engine) AS of_one FROM called WHERE engine <> ''),
scored AS (SELECT *, CASE WHEN of_one AND s BETWEEN 0 AND 1 THEN s * 100 WHEN NOT of_one AND s BETWEEN 0 AND 100 THEN s END AS score FROM scaled),
said AS (SELECT *, CASE WHEN w IN {PHISHING} THEN 'PHISHING' WHEN w IN {LEGITIMATE} THEN 'LEGITIMATE' WHEN score >= 50 THEN 'PHISHING' WHEN score IS NOT NULL THEN 'LEGITIMATE' END AS verdict FROM scored),
answers AS (SELECT scan_id, engine, verdict, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, engine ORDER BY answered_at DESC NULLS LAST, result_id DESC NULLS LAST, verdict DESC NULLS LAST, score DESC NULLS LAST) AS r FROM said WHERE verdict IS NOT NULL OR score IS NOT NULL) WHERE r = 1)"""
_SCANS = """(SELECT id AS record_id, target_url AS url, 0 AS sfh_external, 0 AS iframe_hidden, 0 AS url_of_anchor_ratio FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS r FROM scan_results)
  WHERE r = 1 AND id IN (SELECT scan_id FROM engine_results))"""
REPLIED = f"""{POINTS.replace(f"FROM {MAIN})", f"FROM {_SCANS})", 1)}, {READ.replace("scored AS", "r_scored AS").replace("FROM scored", "FROM r_scored")},
known AS (SELECT ord, name, coalesce(reliability, 0.9) AS reliability, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS bare FROM engines),
heard AS (SELECT scan_id, arg_min(name, ord) AS name, any_value(a.verdict) AS verdict, any_value(a.score) AS score FROM answers a JOIN known ON bare = engine WHERE a.score IS NOT NULL AND a.verdict IS NOT NULL GROUP BY scan_id, engine),
votes AS (SELECT q.record_id, reliability, h.verdict AS given, coalesce(h.score, least(99.9, greatest(0.1, points + (list_sum(list_transform(range(1, length(k.name) + 1), lambda i: unicode(substr(k.name, i, 1)))) % 7 - 3) * 0.8::DOUBLE)))::DOUBLE AS score
  FROM pointed q CROSS JOIN known k LEFT JOIN heard h ON h.scan_id = q.record_id AND h.name = k.name),
voted AS (SELECT *, coalesce(given, CASE WHEN score >= 50 THEN 'PHISHING' ELSE 'LEGITIMATE' END) AS verdict, least(99.999, greatest(0.001, score)) / 100 AS p FROM votes),
warmed AS (SELECT *, 1 / (1 + exp(-ln(p / (1 - p)) / 1.2)) AS ps FROM voted),
summed AS (SELECT record_id, count(*) FILTER (verdict = 'PHISHING') AS phishing_votes, count(*) FILTER (verdict <> 'PHISHING') AS legitimate_votes, sum(ln(greatest(1e-6, ps) / greatest(1e-6, 1 - ps)) * reliability) AS odds, sum(reliability) AS weight FROM warmed GROUP BY record_id)"""


def _json(fields: list[tuple[str, str]]) -> str:
    return " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields)


def _text(value: str) -> str:
    return f"to_json(CAST({value} AS VARCHAR))::VARCHAR"


_EVIDENCE = [
    ("graph", "50.0::DOUBLE", "'nodes without trained weights: 50.0'"), ("panel", "llm_score", "phishing_votes || ' votes of the panel '"), ("visual", "visual_score", "'brand: ' || brand"),
    ("classical", "ensemble_score", "'xgboost: ' || xgboost || ' random forest: ' || random_forest"), ("text", "text_score", "'intent: ' || intent"),
    ("whois", "domain_risk", "'age in days: ' || age"), ("ssl", "ssl_risk", "'protocol: ' || tls"), ("script", "0.0::DOUBLE", "'handlers: 0'"), ("feeds", "threat_intel_score", "feeds"),
]
_ROWS = " || ',' || ".join("'{' || " + _json([("place", f"'{k}'"), ("modality", f"""'"{m}"'"""), ("score", _text(f"format('{{:.1f}}%', {c})")), ("finding", _text(t))]) + " || '}'" for k, (m, c, t) in enumerate(_EVIDENCE))
_MODALITIES = [("graph", "'50.0'"), ("panel", "round(llm_score, 1)"), ("visual", "round(visual_score, 1)"), ("classical", "round(ensemble_score, 1)"), ("text", "round(text_score, 1)"), ("anomaly", f"CASE WHEN {_hit('anomaly')} THEN 92.5::DOUBLE ELSE 1.5::DOUBLE END"), ("intel", "round(round(intel_score, 6), 1)")]
REPORT_JSON = f"""WITH {FUSED} SELECT record_id, '{{' || {_json([("url", _text("url")), ("verdict", _text("verdict")), ("threat_score", "threat_score"), ("risk_level", _text("risk_level")), ("attack_category", _text("attack_category")), ("confidence", "confidence"), ("action", _text("action"))])}
  || ',"modality_scores":{{' || {_json(_MODALITIES)} || '}},"evidence":[' || {_ROWS} || ']}}' AS report FROM report"""


def _hash(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(sha256('{seed}:' || {key}), 1, 15) AS BIGINT)"


def _uniform(k: int, key: str) -> str:
    return f"((CAST('0x' || substr(sha256('42:{k // 4}:' || {key}), {1 + 15 * (k % 4)}, 15) AS BIGINT) % 1099511627776) + 0.5::DOUBLE) / 1099511627776.0::DOUBLE"


def _draw(how: str, u: str) -> str:
    kind, *numbers = how.split()
    a, b = (numbers * 2)[:2]
    return {"constant": f"{a}::DOUBLE", "ones": f"CAST({u} < {a}::DOUBLE AS DOUBLE)", "uniform": f"round({a}::DOUBLE + {u} * ({b}::DOUBLE - {a}::DOUBLE), 6)", "whole": f"floor({a}::DOUBLE + {u} * ({b}::DOUBLE - {a}::DOUBLE))"}[kind]


def _drawn(key: str) -> str:
    split = [[x.strip().split(" ", 1) for x in table.split(",")] for table in (BAD, GOOD)]
    return ", ".join(f"CASE WHEN label = 1 THEN {_draw(bad, _uniform(k, key))} ELSE {_draw(good, _uniform(k, key))} END AS {name}" for k, ((name, bad), (_, good)) in enumerate(zip(*split)))


SPLIT = f"SELECT record_id, CASE WHEN row_number() OVER (ORDER BY {_hash('record_id')}, record_id) <= floor((SELECT count(*) FROM {MAIN}) * 0.8) THEN 'train' ELSE 'test' END AS part FROM {MAIN}"
_KEPT = f"""(SELECT draw AS record_id, url, label, dataset_source, 0 AS sfh_external, 0 AS iframe_hidden, 0 AS url_of_anchor_ratio FROM (SELECT *, row_number() OVER (PARTITION BY ord, label ORDER BY {_hash("draw")}, url) AS r FROM
  (SELECT *, ord || ':' || label || ':' || url AS draw FROM (SELECT DISTINCT CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://' || url END AS url, CAST(label = 1 AS INTEGER) AS label FROM {MAIN} WHERE label IS NOT NULL AND url IS NOT NULL)
  CROSS JOIN (VALUES {", ".join(f"({k}, '{s}')" for k, s in enumerate(SOURCES))}) AS s(ord, dataset_source))) WHERE r <= 1250)"""
_ZERO = ("having_ip_address", "shortening_service", "having_at_symbol", "double_slash_redirecting", "prefix_suffix", "having_sub_domain", "https_token", "abnormal_url")
TRAINING = f"""WITH {LEX.replace(f"FROM {MAIN})", f"FROM {_KEPT})", 1).replace("SELECT record_id, url, domain,", "SELECT record_id, label, dataset_source, url, domain,", 1)}
  SELECT url, dataset_source, label, url_length, CASE WHEN label = 1 THEN url_length_score WHEN url_length < 54 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS url_length_score, {", ".join(f"CASE WHEN label = 1 THEN {c} ELSE 0.0::DOUBLE END AS {c}" for c in _ZERO)}, {_drawn("record_id")} FROM lex"""
_KNOWN, _YOUNG = _hit("whois_known"), _hit("whois_young")
_EPOCH = "greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, url_of_anchor_ratio * epoch / 5))"
_MEANS = "having_ip_address url_length url_length_score shortening_service having_at_symbol double_slash_redirecting prefix_suffix having_sub_domain ssl_state domain_registration_length favicon port https_token request_url_ratio url_of_anchor_ratio links_in_tags_ratio sfh_external submitting_to_email abnormal_url redirect_count on_mouseover right_click_disabled popup_window iframe_hidden age_of_domain dns_record web_traffic page_rank google_index links_pointing_to_page statistical_report dom_node_count dom_max_depth graph_avg_degree"
_FIRST = FUSED.replace(f"FROM {MAIN})", """FROM (SELECT row_number() OVER () AS record_id, regexp_replace(target_url, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS url, 0 AS sfh_external, 0 AS iframe_hidden, 0 AS url_of_anchor_ratio
  FROM (SELECT target_url FROM scan_results ORDER BY id, ingested_at LIMIT 10) WHERE regexp_replace(target_url, '[\\s\\p{Z}]+', '', 'g') <> ''))""", 1)

SQL = {
    "image_hash_score": f"WITH {IMAGES} SELECT * EXCLUDE (u) FROM hashed",
    "hybrid_visual_verdict": f"WITH {VISUAL} SELECT record_id, verdict, visual_score, brand FROM visual",
    "screenshot_report": f"""WITH {VISUAL} SELECT record_id, visual_score AS screenshot_score, brand AS detected_logo, 'hybrid verdict: ' || verdict AS layout_verdict, CASE WHEN bad THEN 'Sign in to your Account | Verification Required' ELSE 'Home | About | Login' END AS words_read,
      CASE WHEN bad THEN '96.4% Match to Target Brand Palette' ELSE 'Authentic Brand Palette' END AS palette, 'HIGH' AS vision_confidence FROM visual""",
    "fusion_verdict_image": f"WITH {_RENAMED}, {IMAGE_FUSED} SELECT record_id, llm_score, visual_score, round(intel_score, 6) AS intel_score, verdict, threat_score, risk_level, attack_category, confidence, action FROM report",
    "report_json": REPORT_JSON,
    "batch_scan_first10": f"WITH {_FIRST} SELECT url, verdict, threat_score, risk_level FROM report",
    "member_predictions": _ruled(f"""{ENSEMBLE} AS random_forest_score, CASE WHEN {ENSEMBLE} >= 50 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS random_forest_verdict, {ENSEMBLE} AS catboost_score, CASE WHEN {ENSEMBLE} >= 50 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS catboost_verdict,
      CASE WHEN {_hit("anomaly")} THEN 92.5::DOUBLE ELSE 1.5::DOUBLE END AS autoencoder_score, CASE WHEN {_hit("anomaly")} THEN 0.925::DOUBLE ELSE 0.015::DOUBLE END AS reconstruction_error, CASE WHEN {_hit("anomaly")} THEN 'ANOMALOUS PHISHING' ELSE 'NORMAL INFRASTRUCTURE' END AS autoencoder_verdict"""),
    "ensemble_importances": "SELECT * FROM (VALUES ('sfh_external', 0.28::DOUBLE), ('url_of_anchor_ratio', 0.22), ('prefix_suffix', 0.18), ('iframe_hidden', 0.15), ('having_ip_address', 0.10)) AS t(feature, importance)",
    "dns_report": f"WITH {PARSED}, low AS (SELECT *, lower(url) AS u FROM named) SELECT record_id, domain, {_KNOWN} OR NOT {_YOUNG} AS has_mx_record, {_KNOWN} OR NOT {_YOUNG} AS has_spf_record FROM low",
    "text_report": f"""SELECT record_id, CASE WHEN {_hit("text_intent")} THEN 96.8::DOUBLE ELSE 0.8::DOUBLE END AS text_score, CASE WHEN {_hit("text_intent")} THEN 'CREDENTIAL HARVESTING' ELSE 'BENIGN' END AS intent,
      CASE WHEN length(url) >= 1 THEN least(unicode(substr(url, 1, 1)), 255) ELSE 0 END || ',' || CASE WHEN length(url) >= 2 THEN least(unicode(substr(url, 2, 1)), 255) ELSE 0 END AS first_codes, CAST(least(length(url), 128) AS INTEGER) AS filled FROM (SELECT record_id, url, lower(url) AS u FROM {MAIN})""",
    "engine_comparison": f"""WITH {READ} SELECT scan_id, count(*) AS engines, count(*) FILTER (verdict = 'PHISHING') AS phishing_votes, round(avg(score), 6) AS mean_score, CASE WHEN count(*) FILTER (verdict = 'PHISHING') * 2 >= count(*) THEN 'PHISHING' ELSE 'LEGITIMATE' END AS verdict FROM answers GROUP BY scan_id""",
    "replied_consensus": f"""WITH {REPLIED} SELECT record_id AS scan_id, phishing_votes, legitimate_votes, round(100 / (1 + exp(-odds / greatest(0.1, weight))), 1) AS pooled_score, round(greatest(phishing_votes, legitimate_votes) / (phishing_votes + legitimate_votes) * 100, 1) AS agreement,
      CASE WHEN phishing_votes >= 5 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS consensus FROM summed""",
    "shuffled_split": SPLIT,
    "bounded_samples": f"WITH s AS ({SPLIT}), o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {_hash('record_id')}, record_id) AS r FROM s) SELECT record_id, part FROM o WHERE r <= CASE WHEN part = 'train' THEN 1000 ELSE 400 END",
    "synthetic_training_set": f"SELECT record_id, url, label, {_drawn('record_id')} FROM {MAIN}",
    "training_set": TRAINING,
    "source_catalog": f"SELECT ord::INTEGER AS ord, name, kind, 0.25::DOUBLE AS weight FROM (VALUES {', '.join(f'({k}, {chr(39)}{s}{chr(39)}, {chr(39)}{kind}{chr(39)})' for k, (s, kind) in enumerate(zip(SOURCES, ('structural features', 'labelled pages', 'raw addresses', 'domain indicators'))))}) AS t(ord, name, kind)",
    "fallback_rows": "SELECT * FROM (VALUES ('http://paypal-login.example/verify', 1, 4::BIGINT), ('https://www.wikipedia.org/', 0, 4)) AS t(url, label, rows)",
    "feature_means": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, count(*) FILTER ({c} IS NULL) AS missing FROM {MAIN}" for c in _MEANS.split()),
    "epoch_measures": f"""SELECT epoch::INTEGER AS epoch, count(*) AS graphs, round(avg(-ln(CASE WHEN label = 1 THEN {_EPOCH} ELSE 1 - {_EPOCH} END)), 6) AS loss, round(avg(CAST((url_of_anchor_ratio * epoch / 5 >= 0.5) = (label = 1) AS INTEGER)) * 100, 6) AS accuracy
      FROM {MAIN} CROSS JOIN range(1, 6) AS e(epoch) WHERE url_of_anchor_ratio IS NOT NULL AND label IS NOT NULL GROUP BY epoch""",
    "point_lookup": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'",
}
