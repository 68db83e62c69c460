"""Lexical features of URLs, one column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"
# Hosts of link shorteners.
SHORTENERS = r"bit\.ly|goo\.gl|tinyurl|tiny\.cc|is\.gd|cli\.gs|yfrog|ow\.ly|t\.co|bit\.do|short\.to|buff\.ly|adf\.ly"


def for_corpus(url: Column) -> Column:
    """URL with http:// in front unless it starts with http: the rule of the corpus builder."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))


def for_parsing(url: Column) -> Column:
    """URL with http:// in front unless it holds a ://, without the control characters that parsers skip."""
    bare = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    return F.when(url.contains("://"), bare).otherwise(F.concat(F.lit("http://"), F.regexp_replace(url, r"[\t\r\n]", "")))


def with_domain(df: DataFrame, url: str = "url", out: str = "domain") -> DataFrame:
    """Adds the network location as written (user, port and case stay), else the path; example.com for broken brackets."""
    staged = df.withColumn("_parsed", for_parsing(F.col(url)))
    netloc = F.regexp_extract("_parsed", rf"^{SCHEME}//([^/?#]*)", 1)
    path = F.regexp_extract("_parsed", rf"^{SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    staged = staged.withColumn("_netloc", netloc).withColumn("_path", path)
    broken = F.col("_netloc").rlike(r"[\[\]]") & ~F.col("_netloc").rlike(r"^(?:[^@]*@)?\[[0-9a-fA-F:.]+\](?::\d*)?$")
    domain = F.when(broken, "example.com").when(F.col("_netloc") != "", F.col("_netloc")).otherwise(F.col("_path"))
    return staged.withColumn(out, domain).drop("_parsed", "_netloc", "_path")


def flag(condition: Column) -> Column:
    return condition.cast("double")


def length_score(length: Column) -> Column:
    return F.when(length > 75, 1.0).when(length >= 54, 0.5).otherwise(0.0)


def lexical(url: Column, domain: Column) -> dict[str, Column]:
    """The ten lexical features; a null URL has null features."""
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    last = F.length(url) - F.locate("//", F.reverse(url)) - 1
    return {
        "having_ip_address": flag(domain.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")),
        "url_length": F.length(url).cast("double"),
        "url_length_score": F.when(url.isNotNull(), length_score(F.length(url))),
        "shortening_service": flag(url.rlike(f"(?i){SHORTENERS}")),
        "having_at_symbol": flag(url.contains("@")),
        "double_slash_redirecting": flag(url.contains("//") & (last > 7)),
        "prefix_suffix": flag(domain.contains("-")),
        "having_sub_domain": F.when(dots > 3, 1.0).when(dots == 3, 0.5).when(dots.isNotNull(), 0.0),
        "https_token": flag(F.lower(domain).contains("https")),
        "abnormal_url": flag(~F.contains(F.lower(url), F.lower(domain))),
    }


def char_tokens(text: Column, size: int = 128, top: int = 255) -> Column:
    """Character codes of the first SIZE characters, capped at TOP and filled up with zeros: a model's input."""
    codes = F.transform(F.filter(F.split(F.substring(text, 1, size), ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(top)))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), size)), 1, size)


def code_sum(text: Column) -> Column:
    """Sum of the character codes of TEXT."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c))
