"""Keyword rules over the lower-cased URL, as data and as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of each rule and the words that lift it, as substrings of the lower-cased URL.
RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
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
# Words that each add points, brands, and the hosts that may carry them.
SUSPICIOUS = ("login", "verify", "secure", "account", "update", "bank", "paypal", "apple", "chase", "signin", "support", "billing", "recover", "crypto", "wallet", "2fa")
BRANDS = ("paypal", "apple", "microsoft", "google", "chase", "bankofamerica", "netflix", "binance", "metamask")
OFFICIAL = ("paypal.com", "apple.com", "microsoft.com", "google.com", "chase.com", "bankofamerica.com", "netflix.com", "binance.com", "metamask.io")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether TEXT contains one of the words; plain substring tests that stay in generated code."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def hit(rule: str, lowered: Column) -> Column:
    """Whether RULE holds for the lower-cased URL. The browser rule is meant for the URL as written."""
    words, unless = RULES[rule]
    return any_of(lowered, words) & ~any_of(lowered, unless) if unless else any_of(lowered, words)
