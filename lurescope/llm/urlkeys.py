"""Canonical keys, hosts and sites of URLs as people and tools wrote them; all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, separators, control and format characters (zero width space, soft hyphen and the like).
BLANK = r"[\s\p{Z}\p{C}]+"
NOT_ALNUM = r"[^\p{L}\p{N}]"
#: A scheme, also a defanged one such as https[:]//, behind any opening punctuation.
SCHEME = rf"^{NOT_ALNUM}*(?:https?{NOT_ALNUM}*:|[a-z][a-z0-9+.\-]*{NOT_ALNUM}*:{NOT_ALNUM}*[/\\]{{2}})"


def plain(url: Column) -> Column:
    """URL in lower case, without blanks, with escaped ampersands as such and with ``http`` where no scheme stands.

    Like all functions here it names its input once, so that the plan stays as small as the rule.
    """
    bare = F.lower(F.regexp_replace(url, BLANK, ""))
    bare = F.regexp_replace(bare, r"&(?:amp;)+|&#(?:0*38|x0*26);", "&")
    return F.regexp_replace(bare, f"^(?!{SCHEME[1:]})", "http://")


def decoded(text: Column) -> Column:
    """TEXT with its percent escapes resolved once; a % that starts no escape stays out, as punctuation."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", ""))


def letters(text: Column) -> Column:
    """The letters and digits of TEXT, in lower case."""
    return F.regexp_replace(F.lower(text), f"{NOT_ALNUM}+", "")


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds ``_head``, ``_params`` (sorted, normalised, without empty ones) and ``_tail`` (fragment) of the column URL."""
    text = plain(F.col(url))
    before = F.substring_index("_plain", "#", 1)
    head = F.substring_index("_before", "?", 1)
    param = lambda x: letters(decoded(x))
    query = F.expr("substring(_before, length(_raw_head) + 2)")
    tail = F.expr("substring(_plain, length(_before) + 2)")
    return (
        df.withColumn("_plain", text)
        .withColumn("_before", before)
        .withColumn("_raw_head", head)
        .withColumn("_query", query)
        .withColumn("_head", letters(decoded(F.col("_raw_head"))))
        .withColumn(
            "_params",
            F.when(F.col("_query") == "", F.array().cast("array<string>")).otherwise(
                F.array_sort(F.filter(F.transform(F.split("_query", "[&;]"), param), lambda x: x != ""))
            ),
        )
        .withColumn("_tail", F.when(F.col("_plain").contains("#"), letters(decoded(tail))).otherwise(F.lit("")))
        .drop("_plain", "_before", "_raw_head", "_query")
    )


def with_key(df: DataFrame, url: str, key: str = "key") -> DataFrame:
    """Adds the canonical KEY of the column URL: two addresses are the same exactly when their keys are equal.

    White space, invisible characters, letter case, punctuation and the order of the query parameters don't count, an
    escaped character counts as that character and a missing scheme as http. A null URL has a null key; one without
    any letter or digit has the key ``http``, as an empty address.
    """
    made = with_parts(df, url).withColumn(key, F.concat("_head", F.array_join("_params", ""), "_tail"))
    return made.drop("_head", "_params", "_tail")


def wide_hash(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: with 128 bits, chance collisions stay out of reach at any table size."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(0x5EED), *columns).alias("k2")]


def with_host(df: DataFrame, url: str, out: str) -> DataFrame:
    """Adds the host that a browser would contact for URL, in lower case, without port, user part and final dot.

    Defanged dots and colons, soft line breaks, wrapping punctuation, backslashes and surplus slashes are resolved
    first; a numeric IPv4 host in decimal or hexadecimal is given in dotted form. Null without a usable host.
    """
    text = plain(F.regexp_replace(F.col(url), r"=\r?\n", ""))
    text = F.regexp_replace(text, r"[\[({]([.:@])[\])}]", "$1")
    text = F.regexp_replace(text, r"[\[({]dot[\])}]", ".")
    authority = F.regexp_extract(text, rf"^{NOT_ALNUM}*[a-z][a-z0-9+.\-]*{NOT_ALNUM}*?:[/\\]*([^/\\?#]*)", 1)
    name = F.regexp_replace(decoded(F.regexp_extract(authority, r"([^@]*)$", 1)), r":\d*$", "")
    name = F.regexp_replace(F.lower(F.translate(name, "。．｡", "...")), r"[<>\"'()\[\]{}=,;]+", "")
    name = F.regexp_replace(name, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return df.withColumn(out, F.transform(F.array(name), _dotted)[0])


def _dotted(name: Column) -> Column:
    """NAME, dotted if it is a number, null if empty; as a lambda it is computed once."""
    value = F.when(name.rlike("^[0-9]{4,10}$"), name.cast("bigint")).when(name.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(name, 3, 8), 16, 10).cast("bigint"))
    octets = [F.shiftright(value, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(value <= 0xFFFFFFFF, F.concat_ws(".", *octets)).when(name != "", name)


def site(host_name: Column, suffixes: list[str]) -> Column:
    """The site of a host: its longest suffix of SUFFIXES with the one label before it, an IPv4 address itself.

    SUFFIXES is a table with a bound (the registries and shared hosts known, at most some ten thousand); here it
    becomes one pattern, longest first, so that no join and no shuffle is needed. A host under none of them is its
    own site.
    """
    if not suffixes:
        return host_name
    tails = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-len(s), s)))
    fits = rf"[^.]+\.(?:{tails})$"
    return F.regexp_replace(host_name, rf"^(?!{fits}).*?\.(?={fits})", "")
