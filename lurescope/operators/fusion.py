"""Fusion of all scores of a URL into verdict, risk, category and evidence; every step stays in its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions import scores
from lurescope.functions.scripts import with_script_signals
from lurescope.functions.urls import lexical, with_domain
from lurescope.operators.panel import pooled_in_row, with_points

# Weight of each score in the fused one.
WEIGHTS = {"gnn_score": 0.25, "llm_score": 0.25, "visual_score": 0.20, "ensemble_score": 0.15, "text_score": 0.10, "intel_score": 0.05}
#: Stands for the graph model while no trained weights are given.
NEUTRAL_GRAPH = 50.0
#: Stands for the image hash where no image vectors are joined.
NEUTRAL_IMAGE = 25.0


def with_lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the domain and the ten lexical features, in place of columns of these names."""
    staged = with_domain(df, url)
    features = lexical(F.col(url), F.col("domain"))
    return staged.select(*[c for c in staged.columns if c not in features], *scores.columns(features))


def with_scores(df: DataFrame, engines: DataFrame, url: str = "url", html: str | None = None, gnn: Column | None = None, image: Column | None = None) -> DataFrame:
    """Adds every score that the fusion takes. GNN and IMAGE are columns between 0 and 100, neutral where missing."""
    base = with_lexical(df, url)
    base = with_points(base, url)
    base = pooled_in_row(base, engines).withColumn("_u", F.lower(url))
    text = html or "_html"
    base = with_script_signals(base if html else base.withColumn(text, F.lit("")), text)
    u = F.col("_u")
    named = {
        **scores.whois(u), **scores.ssl(u), **scores.threat_intel(u), **scores.anomaly(u), **scores.text_intent(u), **scores.brand_logo(u), **scores.page_layout(u),
        "ensemble_score": scores.classical(u)["ensemble_score"], "xgboost": scores.classical(u)["xgboost"], "random_forest": scores.classical(u)["random_forest"],
        "gnn_score": F.coalesce(gnn, F.lit(NEUTRAL_GRAPH)) if gnn is not None else F.lit(NEUTRAL_GRAPH),
        "image_score": F.coalesce(image, F.lit(NEUTRAL_IMAGE)) if image is not None else F.lit(NEUTRAL_IMAGE),
    }
    kept = [c for c in base.columns if c not in named and c not in ("_u", "_html")]
    staged = base.select(*kept, *scores.columns(named))
    staged = staged.withColumn("intel_score", scores.intel_score(F.col("threat_intel_score"), F.col("domain_risk_score"), F.col("ssl_risk_score")))
    return staged.withColumn("visual_score", scores.visual_score(F.col("image_score"), F.col("logo_score"), F.col("layout_score")))


def fused(scored: DataFrame) -> DataFrame:
    """Adds the fused score and what follows from it; thresholds look at the unrounded score."""
    value = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in scored.columns else F.lit(0.0)
    raw = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    staged = scored.withColumn("_score", F.least(F.lit(99.9), F.greatest(F.lit(0.1), raw)))
    bad = F.col("_score") >= 50
    category = (
        F.when(~bad, "NONE")
        .when(F.col("visual_score") > 80, "BRAND IMPERSONATION")
        .when((value("external_password_nodes") > 0) | (value("sfh_external") > 0), "CREDENTIAL HARVESTING")
        .when((value("iframe_hidden") > 0) | F.col("obfuscated"), "CLOAKING")
        .otherwise("TYPOSQUATTING")
    )
    confidence = F.least(F.lit(100.0), F.greatest(F.lit(95.0), F.col("agreement") * 0.6 + F.abs(F.col("_score") - 50) * 0.8))
    return (
        staged.withColumn("verdict", F.when(bad, "PHISHING DETECTED").otherwise("LEGITIMATE SITE"))
        .withColumn("threat_score", F.round("_score", 1))
        .withColumn("risk_level", F.when(F.col("_score") >= 85, "CRITICAL RISK").when(bad, "HIGH RISK").otherwise("SAFE"))
        .withColumn("attack_category", category)
        .withColumn("confidence", F.round(confidence, 1))
        .withColumn("action", F.when(F.col("consensus") == "PHISHING", "BLOCK").otherwise("ALLOW"))
        .drop("_score")
    )


def modality_scores() -> Column:
    """The seven reported scores as a struct."""
    names = {"graph": "gnn_score", "panel": "llm_score", "visual": "visual_score", "classical": "ensemble_score", "text": "text_score", "anomaly": "isolation_score", "intel": "intel_score"}
    return F.struct(*[F.round(F.round(c, 6), 1).alias(k) for k, c in names.items()])


def evidence_rows() -> Column:
    """Nine rows of evidence: place, modality, score and finding."""
    tenth = lambda c: F.format_string("%.1f%%", F.col(c).cast("double"))
    text = lambda *parts: F.concat(*[F.lit(p) if p.endswith((" ", ":")) or p[0] in " /(" else F.col(p).cast("string") for p in parts])
    rows = [
        ("graph", "gnn_score", text("nodes without trained weights: ", "gnn_score")),
        ("panel", "llm_score", text("phishing_votes", " votes of the panel ")),
        ("visual", "visual_score", text("brand: ", "brand")),
        ("classical", "ensemble_score", text("xgboost: ", "xgboost", " random forest: ", "random_forest")),
        ("text", "text_score", text("intent: ", "intent")),
        ("whois", "domain_risk_score", text("age in days: ", "registration_age_days")),
        ("ssl", "ssl_risk_score", text("protocol: ", "tls_version")),
        ("script", "script_risk", text("handlers: ", "handler_count")),
        ("feeds", "threat_intel_score", text("feed_positives", " of ", "feed_total", " feeds ")),
    ]
    return F.array(*[F.struct(F.lit(k).alias("place"), F.lit(m).alias("modality"), tenth(c).alias("score"), t.alias("finding")) for k, (m, c, t) in enumerate(rows)])


def evidence_matrix(report: DataFrame, key: str) -> DataFrame:
    """The evidence of each report in long form."""
    return report.select(key, F.inline(evidence_rows()))


def as_json(report: DataFrame, key: str) -> DataFrame:
    """One JSON document per report."""
    return report.select(key, F.to_json(F.struct("url", "verdict", "threat_score", "risk_level", "attack_category", "confidence", "action", modality_scores().alias("modality_scores"), evidence_rows().alias("evidence"))).alias("report"))


def batch_scan(df: DataFrame, engines: DataFrame, url: str = "url", first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``url, verdict, threat_score, risk_level`` of each URL; with FIRST only of the first rows in ORDER, taken before blanks are left out.

    An empty list is refused.
    """
    if df.isEmpty():
        raise ValueError("the list of URLs is empty")
    rows = df.orderBy(*(order or [url])).limit(first) if first is not None else df
    rows = rows.select(F.regexp_replace(url, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("url")).filter("url != ''")
    return fused(with_scores(rows, engines)).select("url", "verdict", "threat_score", "risk_level")


def scan_one(url: str | None, engines: DataFrame) -> DataFrame:
    """The report of a single URL without its surrounding blanks; an empty one is refused."""
    if url is None or not url.strip():
        raise ValueError("the URL is empty")
    return fused(with_scores(engines.sparkSession.createDataFrame([(url.strip(),)], "url string"), engines))
