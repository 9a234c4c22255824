"""Collection: landed search hits to a diverse, located set of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postlab import rules
from postlab.functions.geo import resolve_location
from postlab.functions.text import contains_any, detect_language, truncate
from postlab.operators.aggregates import (collection_summary, diversity_summary,
                                          language_distribution, location_distribution)
from postlab.operators.joins import join_profile
from postlab.operators.sampling import trim_total
from postlab.operators.windows import (cap_after_first_accept, cap_per_search,
                                       dedupe_across_terms, limit_per_term, one_post_per_user)
from postlab.session import stored_table


def select_posts(hits: DataFrame, profile: str = "v3", per_term: int | None = None) -> DataFrame:
    """Which hits are kept: the caps and de-duplication of a collector profile.

    ``per_term``: keep the first so many of each term, all by default. The hits are stored with their match: the caps below
    read them up to four times, each time only the columns they need, the landed files once.
    """
    limited = limit_per_term(hits, per_term)
    if profile not in ("v1", "v2"):
        limited = limited.withColumn("match", contains_any("content", rules.TOPIC_KEYWORDS))
    limited = stored_table(limited, "limited-hits")
    if profile == "v1":
        return dedupe_across_terms(limited)
    if profile == "v2":
        return one_post_per_user(cap_per_search(limited))
    return dedupe_across_terms(cap_after_first_accept(limited)).drop("match")


def collect_posts(hits: DataFrame, profiles: DataFrame, profile: str = "v3", total: int | None = None,
                  per_term: int | None = None, content_limit: int | None = None) -> DataFrame:
    """Flattened hits (with ``term_idx``, ``pos``) to located posts.

    ``total`` and ``per_term`` limit the posts, ``content_limit`` their stored characters; nothing is cut by default.
    Caps run first, so profiles, location and language are only worked out for
    the posts that stay.
    """
    kept = select_posts(hits, profile, per_term)
    if total is not None:
        kept = trim_total(kept, total)
    located = join_profile(kept, profiles).withColumn(
        "location", resolve_location("description", "username", profile)).drop("description")
    if profile == "v3":
        located = located.withColumn("language", detect_language("content"))
    if content_limit is not None:
        located = located.withColumn("content", truncate("content", content_limit))
    return located


def collection_report(posts: DataFrame, profile: str = "v3") -> dict[str, DataFrame]:
    """Statistics tables of a finished collection."""
    if profile == "v1":
        return {"summary": collection_summary(posts), "locations": location_distribution(posts)}
    report = {"summary": diversity_summary(posts, profile), "locations": location_distribution(posts)}
    if "language" in posts.columns:
        report["languages"] = language_distribution(posts)
    return report

