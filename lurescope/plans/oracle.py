"""The queries once more, in the SQL of the checking engine, over the same tables."""

from __future__ import annotations

from lurescope.plans.oracle_pages import FETCHED_PAGES, PAGES_SQL

# Fixed values, stated here on their own so that the SQL does not take them from the code it checks.
RULES = {
    "whois_young": (("paypal", "verify", "secure", "login", "update", "bank", "account", "000webhost", "xyz", "top", "club"), ()),
    "whois_known": (("google.com", "github.com", "microsoft.com", "apple.com", "amazon.com", "wikipedia.org"), ()),
    "ssl": (("paypal", "login", "verify", "update", "bank"), ("paypal.com", "google.com")),
    "threat_intel": (("paypal", "verify", "signin", "login", "update", "bank", "account"), ("paypal.com", "google.com", "microsoft.com")),
    "classical": (("paypal", "verify", "signin", "login", "update", "bank", "account"), ("paypal.com", "google.com", "microsoft.com")),
    "anomaly": (("paypal", "verify", "signin", "login", "update", "bank"), ("paypal.com", "google.com")),
    "text_intent": (("paypal", "verify", "signin", "login", "update", "bank", "account"), ("paypal.com", "google.com")),
    "image_hash": (("paypal", "verify", "login", "bank", "account"), ()),
    "brand_logo": (("paypal", "login", "verification", "secure", "bank"), ("paypal.com", "google.com", "microsoft.com")),
    "page_layout": (("paypal", "verify", "login", "account"), ("paypal.com", "google.com")),
    "browser_fallback": (("paypal", "login", "verify", "security"), ()),
}
SUSPICIOUS = ("login", "verify", "secure", "account", "update", "bank", "paypal", "apple", "chase", "signin", "support", "billing", "recover", "crypto", "wallet", "2fa")
BRANDS = ("paypal", "apple", "microsoft", "google", "chase", "bankofamerica", "netflix", "binance", "metamask")
OFFICIAL = ("paypal.com", "apple.com", "microsoft.com", "google.com", "chase.com", "bankofamerica.com", "netflix.com", "binance.com", "metamask.io")
CLASSICAL = {
    "xgboost": (99.4, 0.1, 0.25),
    "random_forest": (97.8, 0.3, 0.2),
    "catboost": (98.5, 0.1, 0.2),
    "lightgbm": (97.1, 0.2, 0.15),
    "extra_trees": (96.8, 0.4, 0.1),
    "svm": (95.4, 0.5, 0.1),
}
COUNTS = {
    "eval_count": r"\beval\s*\(",
    "base64_count": r"atob\s*\(|btoa\s*\(|data:text/html;base64",
    "document_write_count": r"document\.write\s*\(",
    "redirect_count": r"window\.location|location\.href",
    "fetch_count": r"fetch\s*\(|xmlhttprequest",
    "websocket_count": r"new\s+websocket\s*\(",
    "timer_count": r"settimeout\s*\(|setinterval\s*\(",
    "handler_count": r"onmouseover|oncontextmenu|oncopy|onpaste|keydown",
}
SHORTENERS = r"bit\.ly|goo\.gl|tinyurl|tiny\.cc|is\.gd|cli\.gs|yfrog|ow\.ly|t\.co|bit\.do|short\.to|buff\.ly|adf\.ly"

MAIN = "merged_phishing_multimodal_dataset"


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _hit(rule: str, text: str = "u") -> str:
    words, unless = RULES[rule]
    return f"({_any(text, words)} AND NOT {_any(text, unless)})" if unless else _any(text, words)


def _ruled(columns: str) -> str:
    return f"SELECT record_id, {columns} FROM (SELECT record_id, lower(url) AS u FROM {MAIN})"


SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"
PARSED = rf"""parsed AS (SELECT *, regexp_replace(url, '^[\x00-\x20]+|[\t\r\n]', '', 'g') AS bare FROM {MAIN}),
located AS (SELECT *, CASE WHEN contains(url, '://') THEN bare ELSE 'http://' || regexp_replace(url, '[\t\r\n]', '', 'g') END AS parsed_url FROM parsed),
cut AS (SELECT *, regexp_extract(parsed_url, '^{SCHEME}//([^/?#]*)', 1) AS netloc, regexp_extract(parsed_url, '^{SCHEME}(?://[^/?#]*)?([^?#]*)', 1) AS path FROM located),
named AS (SELECT *, CASE WHEN regexp_matches(netloc, '[\[\]]') AND NOT regexp_matches(netloc, '^(?:[^@]*@)?\[[0-9a-fA-F:.]+\](?::\d*)?$') THEN 'example.com'
  WHEN netloc <> '' THEN netloc ELSE path END AS domain FROM cut)"""
LEX = rf"""{PARSED}, lex AS (SELECT record_id, url, domain, sfh_external, iframe_hidden, url_of_anchor_ratio,
  CAST(regexp_matches(domain, '^(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') AS DOUBLE) AS having_ip_address, CAST(length(url) AS DOUBLE) AS url_length,
  CASE WHEN length(url) > 75 THEN 1.0::DOUBLE WHEN length(url) >= 54 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS url_length_score,
  CAST(regexp_matches(url, '(?i){SHORTENERS}') AS DOUBLE) AS shortening_service, CAST(contains(url, '@') AS DOUBLE) AS having_at_symbol,
  CAST(contains(url, '//') AND length(url) - strpos(reverse(url), '//') - 1 > 7 AS DOUBLE) AS double_slash_redirecting,
  CAST(contains(domain, '-') AS DOUBLE) AS prefix_suffix,
  CASE WHEN length(domain) - length(replace(domain, '.', '')) > 3 THEN 1.0::DOUBLE WHEN length(domain) - length(replace(domain, '.', '')) = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS having_sub_domain,
  CAST(contains(lower(domain), 'https') AS DOUBLE) AS https_token, CAST(NOT contains(lower(url), lower(domain)) AS DOUBLE) AS abnormal_url FROM named)"""
_WORDS = SUSPICIOUS
POINTS = rf"""{LEX}, hosts AS (SELECT *, lower(url) AS u, CASE WHEN regexp_extract(lower(url), 'https?://([^/]+)', 1) <> '' THEN regexp_extract(lower(url), 'https?://([^/]+)', 1) ELSE lower(url) END AS host FROM lex),
words AS (SELECT *, list_filter([{", ".join(f"'{w}'" for w in _WORDS)}], lambda w: contains(u, w)) AS hits, {_any("host", BRANDS)} AND NOT {_any("host", OFFICIAL)} AS branded FROM hosts),
pointed AS (SELECT *, least(99.9, greatest(0.1, CASE WHEN branded THEN 45 ELSE 0 END + 12 * len(hits) + CASE WHEN having_ip_address > 0 THEN 30 ELSE 0 END
  + CASE WHEN prefix_suffix > 0 THEN 15 ELSE 0 END + CASE WHEN having_sub_domain > 0.5 THEN 20 ELSE 0 END + CASE WHEN coalesce(sfh_external, 0) > 0 THEN 35 ELSE 0 END
  + CASE WHEN coalesce(iframe_hidden, 0) > 0 THEN 25 ELSE 0 END + CASE WHEN coalesce(url_of_anchor_ratio, 0) > 0.5 THEN 15 ELSE 0 END))::DOUBLE AS points,
  list_filter([CASE WHEN branded THEN 'brand on a foreign host: ' || host END, CASE WHEN len(hits) > 0 THEN 'keywords: ' || array_to_string(hits, ', ') END,
  CASE WHEN having_ip_address > 0 THEN 'host is an IP address' END, CASE WHEN prefix_suffix > 0 THEN 'hyphen in the host' END, CASE WHEN having_sub_domain > 0.5 THEN 'many subdomains' END,
  CASE WHEN coalesce(sfh_external, 0) > 0 THEN 'form posts to another host' END, CASE WHEN coalesce(iframe_hidden, 0) > 0 THEN 'hidden frame or form' END,
  CASE WHEN coalesce(url_of_anchor_ratio, 0) > 0.5 THEN 'most links leave the site' END], lambda r: r IS NOT NULL) AS why FROM words)"""
VOTES = f"""{POINTS}, votes AS (SELECT record_id, url, ord, name AS engine, coalesce(reliability, 0.9) AS reliability, CASE WHEN len(why) = 0 THEN 'nothing suspicious' ELSE array_to_string(why, '; ') END AS reasons,
  least(99.9, greatest(0.1, points + (list_sum(list_transform(range(1, length(name) + 1), lambda i: unicode(substr(name, i, 1)))) % 7 - 3) * 0.8::DOUBLE))::DOUBLE AS score FROM pointed CROSS JOIN engines),
voted AS (SELECT *, CASE WHEN score >= 50 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS verdict, least(99.999, greatest(0.001, score)) / 100 AS p FROM votes),
warmed AS (SELECT *, 1 / (1 + exp(-ln(p / (1 - p)) / 1.2)) AS ps FROM voted),
summed AS (SELECT record_id, count(*) FILTER (verdict = 'PHISHING') AS phishing_votes, count(*) FILTER (verdict <> 'PHISHING') AS legitimate_votes,
  sum(ln(greatest(1e-6, ps) / greatest(1e-6, 1 - ps)) * reliability) AS odds, sum(reliability) AS weight FROM warmed GROUP BY record_id),
pooled AS (SELECT record_id, phishing_votes, legitimate_votes, round(100 / (1 + exp(-odds / greatest(0.1, weight))), 1) AS pooled_score,
  round(greatest(phishing_votes, legitimate_votes) / (phishing_votes + legitimate_votes) * 100, 1) AS agreement, CASE WHEN phishing_votes >= 5 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS consensus FROM summed)"""
ENSEMBLE = f"CASE WHEN {_hit('classical')} THEN {round(sum(h * w for h, _, w in CLASSICAL.values()), 1)}::DOUBLE ELSE {round(sum(n * w for _, n, w in CLASSICAL.values()), 1)}::DOUBLE END"
WHOIS_AGE = f"CASE WHEN {_hit('whois_known')} THEN 7300 WHEN {_hit('whois_young')} THEN 30 ELSE 1200 END"
WHOIS_RISK = f"CASE WHEN {_hit('whois_known')} THEN 10.0::DOUBLE WHEN {_hit('whois_young')} THEN 85.0::DOUBLE ELSE 10.0::DOUBLE END"
SSL_RISK = f"CASE WHEN starts_with(u, 'http://') THEN 95.0::DOUBLE WHEN {_hit('ssl')} THEN 75.0::DOUBLE ELSE 2.0::DOUBLE END"
FUSED = f"""{VOTES}, parts AS (SELECT q.record_id, q.url, q.u, phishing_votes, pooled_score AS llm_score, agreement, consensus, coalesce(sfh_external, 0) AS sfh, coalesce(iframe_hidden, 0) AS frame,
  {ENSEMBLE} AS ensemble_score, CASE WHEN {_hit('classical')} THEN 99.4::DOUBLE ELSE 0.1::DOUBLE END AS xgboost, CASE WHEN {_hit('classical')} THEN 97.8::DOUBLE ELSE 0.3::DOUBLE END AS random_forest,
  CASE WHEN {_hit('text_intent')} THEN 96.8::DOUBLE ELSE 0.8::DOUBLE END AS text_score, CASE WHEN {_hit('text_intent')} THEN 'CREDENTIAL HARVESTING' ELSE 'BENIGN' END AS intent,
  CASE WHEN {_hit('threat_intel')} THEN 96.5::DOUBLE ELSE 0.1::DOUBLE END AS threat_intel_score, CASE WHEN {_hit('threat_intel')} THEN '18 of 90 feeds ' ELSE '0 of 92 feeds ' END AS feeds,
  {WHOIS_AGE} AS age, {WHOIS_RISK} AS domain_risk, {SSL_RISK} AS ssl_risk,
  CASE WHEN starts_with(u, 'http://') THEN 'None' WHEN {_hit('ssl')} THEN 'TLSv1.0' ELSE 'TLSv1.3' END AS tls,
  round(25.0 * 0.4 + CASE WHEN {_hit('brand_logo')} THEN 96.2 ELSE 4.1 END * 0.4 + CASE WHEN {_hit('page_layout')} THEN 88.4 ELSE 12.1 END * 0.2, 2)::DOUBLE AS visual_score,
  CASE WHEN NOT {_hit('brand_logo')} THEN 'None / Authentic' WHEN contains(u, 'paypal') THEN 'PayPal' WHEN contains(u, 'microsoft') THEN 'Microsoft' ELSE 'Generic Financial' END AS brand
  FROM pointed q JOIN pooled USING (record_id)),
raw AS (SELECT *, threat_intel_score * 0.5 + domain_risk * 0.3 + ssl_risk * 0.2 AS intel_score FROM parts),
scored AS (SELECT *, least(99.9, greatest(0.1, 50.0 * 0.25 + llm_score * 0.25 + visual_score * 0.20 + ensemble_score * 0.15 + text_score * 0.10 + intel_score * 0.05)) AS fused FROM raw),
report AS (SELECT *, CASE WHEN fused >= 50 THEN 'PHISHING DETECTED' ELSE 'LEGITIMATE SITE' END AS verdict, round(fused, 1) AS threat_score,
  CASE WHEN fused >= 85 THEN 'CRITICAL RISK' WHEN fused >= 50 THEN 'HIGH RISK' ELSE 'SAFE' END AS risk_level,
  CASE WHEN fused < 50 THEN 'NONE' WHEN visual_score > 80 THEN 'BRAND IMPERSONATION' WHEN sfh > 0 THEN 'CREDENTIAL HARVESTING' WHEN frame > 0 THEN 'CLOAKING' ELSE 'TYPOSQUATTING' END AS attack_category,
  round(least(100.0, greatest(95.0, agreement * 0.6 + abs(fused - 50) * 0.8)), 1) AS confidence, CASE WHEN consensus = 'PHISHING' THEN 'BLOCK' ELSE 'ALLOW' END AS action FROM scored)"""


def _pick(rule: str, high: str, low: str) -> str:
    return f"CASE WHEN {_hit(rule)} THEN {high} ELSE {low} END"


def sql() -> dict[str, str]:
    pages = FETCHED_PAGES
    counts = ", ".join(f"CAST(len(regexp_extract_all(script, '{p}')) AS INTEGER) AS {k}" for k, p in COUNTS.items())
    fields = "having_ip_address, url_length, url_length_score, shortening_service, having_at_symbol, double_slash_redirecting, prefix_suffix, having_sub_domain, https_token, abnormal_url"
    counted = "count(*) AS rows, count(*) FILTER (label = 1) AS phishing, count(*) FILTER (label = 0) AS legitimate"
    drifted = """SELECT {k} rows, round(phishing / rows, 6) AS phishing_ratio, format('{{:.1f}}%', round(phishing / rows * 100, 1)) AS ratio_text, abs(phishing / rows - 0.5) > 0.15 AS drifted,
      CASE WHEN abs(phishing / rows - 0.5) > 0.15 THEN 'TRIGGER RETRAINING' ELSE 'NO DRIFT DETECTED' END AS action FROM (SELECT {k} {c} FROM {t} {g})"""
    measures = """SELECT tp, fp, tn, fn, round((tp + tn) / greatest(1, tp + fp + tn + fn) * 100, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(0.001, pr + re), 6) AS f1,
      round((tp::DOUBLE * tn - fp::DOUBLE * fn) / greatest(1.0, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))), 6) AS mcc
      FROM (SELECT *, tp / greatest(1, tp + fp) * 100 AS pr, tp / greatest(1, tp + fn) * 100 AS re FROM
      (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM ({src})))"""
    matrix = [
        ("graph", "50.0::DOUBLE", "'nodes without trained weights: 50.0'"), ("panel", "llm_score", "phishing_votes || ' votes of the panel '"), ("visual", "visual_score", "'brand: ' || brand"),
        ("classical", "ensemble_score", "'xgboost: ' || xgboost || ' random forest: ' || random_forest"), ("text", "text_score", "'intent: ' || intent"),
        ("whois", "domain_risk", "'age in days: ' || age"), ("ssl", "ssl_risk", "'protocol: ' || tls"), ("script", "0.0::DOUBLE", "'handlers: 0'"), ("feeds", "threat_intel_score", "feeds"),
    ]
    long = " UNION ALL ".join(f"SELECT record_id, CAST({k} AS INTEGER) AS place, '{m}' AS modality, format('{{:.1f}}%', {c}) AS score, {t} AS finding FROM report" for k, (m, c, t) in enumerate(matrix))
    flags = ", ".join(f"CAST({_hit(r, 'url' if r == 'browser_fallback' else 'u')} AS INTEGER) AS {r}" for r in RULES)
    members = ", ".join(f"{_pick('classical', f'{h}::DOUBLE', f'{n}::DOUBLE')} AS {k}" for k, (h, n, _) in CLASSICAL.items())
    values = ["0.0::DOUBLE"] * 14
    values[10] = "CASE WHEN node >= 4 THEN node / 15.0::DOUBLE ELSE 0.0 END"
    values[11] = "CASE WHEN node IN (1, 2) THEN coalesce(sfh_external, 0) WHEN node >= 4 THEN coalesce(url_of_anchor_ratio, 0) ELSE 0.0 END"
    values[12] = "CASE WHEN node = 1 THEN coalesce(iframe_hidden, 0) ELSE 0.0 END"
    for k in range(10):
        values[k] = f"CASE WHEN hot = {k} THEN 1.0::DOUBLE ELSE 0.0 END"
    vector = ", ".join(f"CAST(round(({v})::DOUBLE, 6) AS VARCHAR)" for v in values)
    scanned = FUSED.replace(f"FROM {MAIN})", """FROM (SELECT row_number() OVER () AS record_id, regexp_replace(target_url, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS url, 0 AS sfh_external, 0 AS iframe_hidden, 0 AS url_of_anchor_ratio
      FROM scan_results WHERE regexp_replace(target_url, '[\\s\\p{Z}]+', '', 'g') <> ''))""", 1)
    last = "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS r FROM scan_results)"
    return {
        "url_lexical_features": f"WITH {LEX} SELECT record_id, {fields} FROM lex",
        "url_host_extract": f"WITH {PARSED} SELECT record_id, domain, CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://' || url END AS corpus_url, parsed_url FROM named",
        "url_length_buckets": f"WITH {LEX} SELECT url_length_score, count(*) AS n, round(avg(url_length), 6) AS mean_length FROM lex GROUP BY 1",
        "keyword_intent_flags": f"SELECT record_id, {flags} FROM (SELECT record_id, url, lower(url) AS u FROM {MAIN})",
        "js_signal_counts": f"""WITH {pages}, low AS (SELECT page_id, lower(' ' || coalesce(html, '')) AS script FROM pages), counted AS (SELECT page_id, {counts} FROM low)
          SELECT *, eval_count > 0 OR base64_count > 0 OR document_write_count > 0 AS obfuscated, least(99.9, CASE WHEN eval_count > 0 OR base64_count > 0 OR document_write_count > 0 THEN 40 ELSE 0 END
          + CASE WHEN handler_count > 2 THEN 25 ELSE 0 END + CASE WHEN redirect_count > 1 THEN 20 ELSE 0 END + CASE WHEN fetch_count > 2 THEN 15 ELSE 0 END)::DOUBLE AS script_risk FROM counted""",
        "html_string_flags": f"""WITH {pages}, low AS (SELECT page_id, lower(coalesce(html, '')) AS h FROM pages) SELECT page_id, CAST(contains(h, 'mailto:') AS DOUBLE) AS submitting_to_email,
          CAST(contains(h, 'onmouseover') AND contains(h, 'window.status') AS DOUBLE) AS on_mouseover, CAST(contains(h, 'event.button==2') OR contains(h, 'contextmenu') AS DOUBLE) AS right_click_disabled FROM low""",
        "crawled_pages": f"""WITH {PARSED}, schemed AS (SELECT *, lower(regexp_extract(parsed_url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) AS sch FROM named)
          SELECT record_id, domain, CASE WHEN sch = '' THEN 'http' ELSE sch END AS scheme, CAST(length('<html><head><title></title></head><body><h1>Welcome to </h1></body></html>') + 2 * length(domain) AS INTEGER) AS html_length, 'nginx/1.18.0' AS server FROM schemed""",
        "whois_rules": _ruled(
            f"{WHOIS_AGE} AS registration_age_days, CASE WHEN {_hit('whois_known')} THEN 365 WHEN {_hit('whois_young')} THEN 30 ELSE 200 END AS days_to_expiry, "
            f"CASE WHEN NOT {_hit('whois_known')} AND {_hit('whois_young')} THEN 'RU' ELSE 'US' END AS country, NOT {_hit('whois_known')} AS privacy_protected, "
            f"{_hit('whois_known')} OR NOT {_hit('whois_young')} AS has_mx_record, {_hit('whois_known')} OR NOT {_hit('whois_young')} AS has_spf_record, {WHOIS_RISK} AS domain_risk_score"
        ),
        "ssl_rules": _ruled(
            f"NOT starts_with(u, 'http://') AS has_ssl, CASE WHEN starts_with(u, 'http://') THEN 'None' WHEN {_hit('ssl')} THEN 'TLSv1.0' ELSE 'TLSv1.3' END AS tls_version, "
            f"CASE WHEN starts_with(u, 'http://') THEN 0 WHEN {_hit('ssl')} THEN 1024 ELSE 256 END AS public_key_length, CASE WHEN starts_with(u, 'http://') THEN 0 WHEN {_hit('ssl')} THEN 12 ELSE 280 END AS days_until_expiration, "
            f"NOT starts_with(u, 'http://') AND NOT {_hit('ssl')} AS certificate_valid, {SSL_RISK} AS ssl_risk_score"
        ),
        "threat_intel_rules": _ruled(f"{_pick('threat_intel', '18', '0')} AS feed_positives, {_pick('threat_intel', '90', '92')} AS feed_total, {_pick('threat_intel', chr(39) + 'MALICIOUS' + chr(39), chr(39) + 'CLEAN' + chr(39))} AS feed_verdict, {_pick('threat_intel', '96.5::DOUBLE', '0.1::DOUBLE')} AS threat_intel_score"),
        "classical_ensemble_score": _ruled(f"{members}, {ENSEMBLE} AS ensemble_score"),
        "anomaly_score": _ruled(f"{_pick('anomaly', '92.5::DOUBLE', '1.5::DOUBLE')} AS isolation_score, {_pick('anomaly', '0.842::DOUBLE', '0.012::DOUBLE')} AS model_error, {_pick('anomaly', '0.925::DOUBLE', '0.015::DOUBLE')} AS reconstruction_error, {_hit('anomaly')} AS zero_day"),
        "text_intent_score": _ruled(f"{_pick('text_intent', '96.8::DOUBLE', '0.8::DOUBLE')} AS text_score, CASE WHEN {_hit('text_intent')} THEN 'CREDENTIAL HARVESTING' ELSE 'BENIGN' END AS intent"),
        "brand_match_score": _ruled(
            f"{_pick('brand_logo', '96.2::DOUBLE', '4.1::DOUBLE')} AS logo_score, {_pick('brand_logo', '0.962::DOUBLE', '0.05::DOUBLE')} AS logo_similarity, "
            f"CASE WHEN NOT {_hit('brand_logo')} THEN 'None / Authentic' WHEN contains(u, 'paypal') THEN 'PayPal' WHEN contains(u, 'microsoft') THEN 'Microsoft' ELSE 'Generic Financial' END AS brand"
        ),
        "layout_match_score": _ruled(f"{_pick('page_layout', '4.2::DOUBLE', '12.8::DOUBLE')} AS layout_distance, 8.0::DOUBLE AS layout_threshold, {_pick('page_layout', '88.4::DOUBLE', '12.1::DOUBLE')} AS layout_score"),
        "engine_catalog": "SELECT ord, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS engine_id, name, developer, weight, reliability, CAST(list_sum(list_transform(range(1, length(name) + 1), lambda i: unicode(substr(name, i, 1)))) AS BIGINT) AS name_sum FROM engines",
        "engine_fanout_scores": f"WITH {VOTES} SELECT record_id, engine, round(score, 6) AS score, verdict FROM voted",
        "engine_lookup_fuzzy": """WITH names AS (SELECT DISTINCT engine AS asked, regexp_replace(lower(engine), '[^a-z0-9]', '', 'g') AS b FROM engine_results WHERE engine IS NOT NULL),
          known AS (SELECT ord, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM engines)
          SELECT asked, coalesce((SELECT arg_min(name, ord) FROM known WHERE contains(k, b)), (SELECT arg_min(name, ord) FROM known)) AS engine FROM names""",
        "consensus_pooling": f"WITH {VOTES} SELECT * FROM pooled",
        "evidence_top4": f"""WITH {VOTES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ord) AS r FROM voted WHERE verdict = 'PHISHING')
          SELECT record_id, string_agg('[' || engine || '] ' || reasons, ' | ' ORDER BY r) AS evidence FROM ranked WHERE r <= 4 GROUP BY record_id""",
        "fusion_verdict": f"WITH {FUSED} SELECT record_id, llm_score, visual_score, round(intel_score, 6) AS intel_score, verdict, threat_score, risk_level, attack_category, confidence, action FROM report",
        "attack_category": f"WITH {FUSED} SELECT attack_category, risk_level, count(*) AS n FROM report GROUP BY ALL",
        "evidence_matrix_long": f"WITH {FUSED} {long}",
        "batch_scan_report": f"WITH {scanned} SELECT url, verdict, threat_score, risk_level FROM report",
        "training_graphs": f"""SELECT record_id, CAST(node AS INTEGER) AS node, array_to_string([{vector}], ',') AS x
          FROM (SELECT *, CASE WHEN node < 4 THEN node ELSE node % 5 + 4 END AS hot FROM {MAIN} CROSS JOIN range(15) AS n(node))""",
        "class_balance": f"SELECT {counted} FROM {MAIN}",
        "class_balance_by_source": f"SELECT dataset_source, {counted} FROM {MAIN} GROUP BY dataset_source",
        "drift_by_source": drifted.format(k="dataset_source,", c=counted, t=MAIN, g="GROUP BY dataset_source"),
        "drift_overall": drifted.format(k="", c=counted, t=MAIN, g=""),
        "drift_daily": f"""SELECT start, rows, round(phishing / rows, 6) AS phishing_ratio, abs(phishing / rows - 0.5) > 0.15 AS drifted
          FROM (SELECT date_trunc('day', collected_at)::TIMESTAMP AS start, {counted} FROM {MAIN} WHERE collected_at IS NOT NULL GROUP BY 1)""",
        "dataset_preview": f"SELECT record_id, url, label FROM {MAIN} ORDER BY record_id LIMIT 6",
        "confusion_metrics": measures.format(src=f"SELECT url_of_anchor_ratio >= 0.5 AS p, label = 1 AS y FROM {MAIN} WHERE url_of_anchor_ratio IS NOT NULL AND label IS NOT NULL"),
        "reviewed_scan_quality": measures.format(src=f"SELECT overall_threat_score >= 50 AS p, l.verdict = 'PHISHING' AS y FROM {last} s JOIN scan_labels l ON l.scan_id = s.id WHERE r = 1 AND overall_threat_score IS NOT NULL AND l.verdict IS NOT NULL"),
        "per_source_accuracy": f"""SELECT dataset_source, count(*) FILTER ((url_of_anchor_ratio >= 0.5) = (label = 1)) AS correct, count(*) AS total,
          round(count(*) FILTER ((url_of_anchor_ratio >= 0.5) = (label = 1)) / count(*) * 100, 6) AS accuracy FROM {MAIN} WHERE url_of_anchor_ratio IS NOT NULL AND label IS NOT NULL GROUP BY dataset_source""",
        "roc_auc": f"""WITH s AS (SELECT url_of_anchor_ratio AS x, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM {MAIN} WHERE url_of_anchor_ratio IS NOT NULL AND label IS NOT NULL GROUP BY 1),
          w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS roc_auc FROM w""",
        "stratified_sample": f"SELECT record_id, dataset_source, label FROM (SELECT record_id, dataset_source, label, row_number() OVER (PARTITION BY dataset_source, label ORDER BY record_id) AS r FROM {MAIN}) WHERE r <= 3",
        "ordered_split": f"SELECT record_id, CASE WHEN row_number() OVER (ORDER BY record_id) <= floor((SELECT count(*) FROM {MAIN}) * 0.8) THEN 'train' ELSE 'test' END AS part FROM {MAIN}",
        "source_union": f"SELECT 'training' AS dataset_source, count(*) AS n, sum(length(url))::BIGINT AS chars FROM {MAIN} UNION ALL SELECT 'scans', count(*), sum(length(target_url))::BIGINT FROM scan_results",
        "scan_deliveries": f"SELECT id, target_url, verdict, overall_threat_score FROM {last} WHERE r = 1",
        "scan_modality_scores": """WITH j AS (SELECT DISTINCT * FROM scan_results), k AS (SELECT modality_scores AS m, unnest(json_keys(modality_scores)) AS key FROM j WHERE modality_scores IS NOT NULL)
          SELECT key, count(v) AS n, round(avg(v), 6) AS mean_score FROM (SELECT key, CAST(json_extract_string(m, '$."' || key || '"') AS DOUBLE) AS v FROM k) GROUP BY key""",
        "nearest_reference_vector": """WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label),
          d AS (SELECT vec_id, r.label, list_distance(embedding::DOUBLE[], ref::DOUBLE[]) AS dist FROM embeddings CROSS JOIN r)
          SELECT vec_id, arg_min(label, (dist, label)) AS nearest, round(min(dist), 4) AS distance FROM d GROUP BY vec_id""",
        "pooled_embedding": """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
          SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 5) AS value FROM e GROUP BY 1, 2 UNION ALL SELECT label, CAST(dim + 64 AS INTEGER), round(max(v), 5) FROM e GROUP BY 1, 2""",
        "graph_degree_density": """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), n AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
          SELECT count(*) AS nodes, sum(degree)::BIGINT AS edges_both_ways, max(degree) AS most, round(sum(degree) / greatest(1, count(*) * (count(*) - 1)), 9) AS density FROM n""",
        "message_passing_sum": "SELECT l_suppkey, round(sum(p_retailprice), 2) AS message FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey",
        "char_token_rows": f"""SELECT record_id, array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i <= length(url) THEN least(unicode(substr(url, i, 1)), 255) ELSE 0 END), ',') AS tokens,
          CAST(list_sum(list_transform(range(1, length(url) + 1), lambda i: unicode(substr(url, i, 1)))) AS BIGINT) AS code_sum FROM {MAIN}""",
    }


SQL = {**sql(), **PAGES_SQL}
