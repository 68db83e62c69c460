"""Pages without a network: given markup, or a stand-in made from the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.functions.urls import for_parsing, with_domain


def crawled(df: DataFrame, url: str = "url", html: str | None = None) -> DataFrame:
    """Adds ``domain, scheme, html_content, html_length`` (in characters) and the fixed response headers."""
    staged = with_domain(df, url)
    title = F.concat(F.lit("<html><head><title>"), "domain", F.lit("</title></head><body><h1>Welcome to "), "domain", F.lit("</h1></body></html>"))
    content = F.when(F.coalesce(F.col(html), F.lit("")) != "", F.col(html)).otherwise(title) if html else title
    scheme = F.lower(F.regexp_extract(for_parsing(F.col(url)), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    headers = F.create_map(*[F.lit(x) for x in ("server", "nginx/1.18.0", "content-type", "text/html; charset=UTF-8", "x-frame-options", "SAMEORIGIN")])
    staged = staged.withColumn("scheme", F.when(scheme == "", "http").otherwise(scheme)).withColumn("html_content", content)
    return staged.withColumn("html_length", F.length("html_content")).withColumn("headers", headers)
