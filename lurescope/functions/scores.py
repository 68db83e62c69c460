"""Rule scores of a URL: which constants follow from which keyword rule. They are rules, not learned models.

All scores, ages and names below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope.functions.rules import hit

# Score of each member of the classical ensemble if its rule holds, else, and its weight.
CLASSICAL = {"xgboost": (99.4, 0.1, 0.25), "random_forest": (97.8, 0.3, 0.20), "catboost": (98.5, 0.1, 0.20), "lightgbm": (97.1, 0.2, 0.15), "extra_trees": (96.8, 0.4, 0.10), "svm": (95.4, 0.5, 0.10)}


def whois(u: Column) -> dict[str, Column]:
    """Registration facts by rule: a known host, else a suspicious one, else a usual one."""
    known, young = hit("whois_known", u), hit("whois_young", u)
    pick = lambda a, b, c: F.when(known, a).when(young, b).otherwise(c)
    age = pick(7300, 30, 1200)
    return {
        "registration_age_days": age, "days_to_expiry": pick(365, 30, 200), "country": pick("US", "RU", "US"),
        "privacy_protected": pick(False, True, True), "has_mx_record": pick(True, False, True), "has_spf_record": pick(True, False, True),
        "domain_risk_score": F.when(age < 60, 85.0).when(age > 1000, 10.0).otherwise(35.0),
    }


def ssl(u: Column) -> dict[str, Column]:
    plain, odd = u.startswith("http://"), hit("ssl", u)
    pick = lambda a, b, c: F.when(plain, a).when(odd, b).otherwise(c)
    return {
        "has_ssl": ~plain, "tls_version": pick("None", "TLSv1.0", "TLSv1.3"), "public_key_length": pick(0, 1024, 256),
        "days_until_expiration": pick(0, 12, 280), "certificate_valid": pick(False, False, True), "ssl_risk_score": pick(95.0, 75.0, 2.0),
    }


def threat_intel(u: Column) -> dict[str, Column]:
    bad = hit("threat_intel", u)
    pick = lambda a, b: F.when(bad, a).otherwise(b)
    return {"feed_positives": pick(18, 0), "feed_total": pick(90, 92), "feed_verdict": pick("MALICIOUS", "CLEAN"), "threat_intel_score": pick(96.5, 0.1)}


def intel_score(intel: Column, domain_risk: Column, ssl_risk: Column) -> Column:
    return intel * 0.5 + domain_risk * 0.3 + ssl_risk * 0.2


def classical(u: Column) -> dict[str, Column]:
    """Scores of the members and their weighted sum, to one digit. Looking up a single member gives the sum, as before."""
    bad = hit("classical", u)
    members = {k: F.when(bad, high).otherwise(low) for k, (high, low, _) in CLASSICAL.items()}
    total = sum((members[k] * w for k, (_, _, w) in CLASSICAL.items()), F.lit(0.0))
    return {**members, "ensemble_score": F.round(total, 1)}


# What the ensemble is said to look at most.
IMPORTANCES = [("sfh_external", 0.28), ("url_of_anchor_ratio", 0.22), ("prefix_suffix", 0.18), ("iframe_hidden", 0.15), ("having_ip_address", 0.10)]


def members(u: Column) -> dict[str, Column]:
    """Verdicts of members that are asked alone: the two of the ensemble answer with the ensemble's score, as a look-up of theirs never finds them."""
    ensemble, odd = classical(u)["ensemble_score"], anomaly(u)
    verdict = F.when(ensemble >= 50, "PHISHING").otherwise("LEGITIMATE")
    return {
        "random_forest_score": ensemble, "random_forest_verdict": verdict, "catboost_score": ensemble, "catboost_verdict": verdict, "autoencoder_score": odd["isolation_score"],
        "reconstruction_error": odd["reconstruction_error"], "autoencoder_verdict": F.when(odd["isolation_score"] >= 50, "ANOMALOUS PHISHING").otherwise("NORMAL INFRASTRUCTURE"),
    }


def anomaly(u: Column) -> dict[str, Column]:
    bad = hit("anomaly", u)
    score = F.when(bad, 92.5).otherwise(1.5)
    return {"isolation_score": score, "model_error": F.when(bad, 0.842).otherwise(0.012), "reconstruction_error": F.round(score / 100, 4), "zero_day": score > 50}


def text_intent(u: Column) -> dict[str, Column]:
    bad = hit("text_intent", u)
    return {"text_score": F.when(bad, 96.8).otherwise(0.8), "intent": F.when(bad, "CREDENTIAL HARVESTING").otherwise("BENIGN")}


def brand_logo(u: Column) -> dict[str, Column]:
    bad = hit("brand_logo", u)
    brand = F.when(u.contains("paypal"), "PayPal").when(u.contains("microsoft"), "Microsoft").otherwise("Generic Financial")
    return {"logo_score": F.when(bad, 96.2).otherwise(4.1), "logo_similarity": F.when(bad, 0.962).otherwise(0.05), "brand": F.when(bad, brand).otherwise("None / Authentic")}


def page_layout(u: Column) -> dict[str, Column]:
    bad = hit("page_layout", u)
    return {"layout_distance": F.when(bad, 4.2).otherwise(12.8), "layout_threshold": F.lit(8.0), "layout_score": F.when(bad, 88.4).otherwise(12.1)}


def visual_score(image: Column, logo: Column, layout: Column) -> Column:
    return F.round(image * 0.4 + logo * 0.4 + layout * 0.2, 2)


def columns(named: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in named.items()]
