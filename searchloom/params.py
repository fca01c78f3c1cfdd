"""Parameters of the analytics: every list and threshold an operator uses can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass

# Click-through rates by rounded position, 1 to 10.
CTR_CURVE = (0.28, 0.15, 0.11, 0.08, 0.06, 0.05, 0.04, 0.03, 0.028, 0.025)


@dataclass(frozen=True)
class Params:
    site: str = "https://shop.example.com"
    brand_terms: tuple[str, ...] = ("shopvox",)
    # Names and markers that make a query one about a competitor's own product.
    competitors: tuple[str, ...] = ("day one", "dayone", "journey", "rosebud", "reflectly", "daylio", "penzu", "diarium", "momento", "stoic", "otter", "grid diary", "five minute journal")
    internal_markers: tuple[str, ...] = ("cloud vs", "premium", "subscription", "pricing", "price", "cost", "plan", "refund", "cancel", "login", "sign in", "not working", "export from", "free trial", "upgrade", "downgrade", "student discount")
    comparative: tuple[str, ...] = (" vs shopvox", "shopvox vs", "alternative", "better than", "instead of")
    irrelevant_pattern: str = r"\b(id [a-z]+kit|com\.[a-z]+\.|nsuser|uikit|swiftui|widgetkit)\b"
    irrelevant_terms: tuple[str, ...] = ('"', "sf symbols", "android")
    # Domains that never list a product, and hints of list articles.
    skip_domains: tuple[str, ...] = ("shop.example.com", "apps.apple.com", "play.google.com", "youtube.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "wikipedia.org", "google.com")
    listicle_hints: tuple[str, ...] = ("best", "top", "alternative", "vs", "review", "compare", "roundup", "apps for")
    known_clusters: tuple[str, ...] = ("blog", "for", "in", "alternative", "use", "reports", "research", "press")
    protected_prefixes: tuple[str, ...] = ("shopvox-vs", "speak-your-first")
    retired_clusters: tuple[str, ...] = ("for", "in")


DEFAULT = Params()
