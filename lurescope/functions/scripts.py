"""Signals in scripts and raw markup: pattern counts over the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is counted. The third branch of the fetch pattern of older rule sets can match nothing and is left out.
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


def with_script_signals(df: DataFrame, html: str, script: Column | None = None) -> DataFrame:
    """Adds the eight counts, ``obfuscated`` and ``script_risk``; a null text counts as an empty one."""
    text = F.lower(F.concat(F.coalesce(script, F.lit("")) if script is not None else F.lit(""), F.lit(" "), F.coalesce(F.col(html), F.lit(""))))
    counted = df.withColumn("_script", text).select("*", *[F.regexp_count("_script", F.lit(p)).alias(k) for k, p in COUNTS.items()]).drop("_script")
    hidden = (F.col("eval_count") > 0) | (F.col("base64_count") > 0) | (F.col("document_write_count") > 0)
    add = lambda condition, points: F.when(condition, points).otherwise(0.0)
    risk = add(F.col("obfuscated"), 40.0) + add(F.col("handler_count") > 2, 25.0) + add(F.col("redirect_count") > 1, 20.0) + add(F.col("fetch_count") > 2, 15.0)
    return counted.withColumn("obfuscated", hidden).withColumn("script_risk", F.least(F.lit(99.9), risk))


def markup_flags(html: Column) -> dict[str, Column]:
    """Features that need only the lower-cased markup as a string."""
    has = lambda word: F.contains(F.lower(html), F.lit(word))
    return {
        "submitting_to_email": has("mailto:").cast("double"),
        "on_mouseover": (has("onmouseover") & has("window.status")).cast("double"),
        "right_click_disabled": (has("event.button==2") | has("contextmenu")).cast("double"),
    }
